"""Score and number of triples of a sentence's best parse, without building its trees.

A rule sees a node and its open neighbours only, so a ruleset acts on each run of nodes that it names by
itself. What it does to a run is worked out once by the rules of ``parser`` and kept; a hypothesis is then a
string of open types to which such changes apply. Edges of ``plain`` grammars never cross and give each consumed
node a parent that is finished later, so depth follows as edges are added. What is not plain is left to ``parser``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, product
from operator import attrgetter

from . import parser
from .parser import AMBIGUOUS, BE_FORMS, CATEGORIES, NODE_TYPES, Config, Grammar, Hypothesis, Rule

#: Words, and changes of runs for each ruleset, that a worker keeps.
WORDS, RUNS = 300_000, 100_000
_GONE = 0x80


class NotPlain(Exception):
    """The sentence needs the general parser."""


# -- shapes: what a parse sees of a sentence, one character for each word


def _lang(lang: str) -> str:
    return "es" if lang == "es" else "en"


@lru_cache(2)
def _grammar(lang: str) -> Grammar:
    return parser.load_grammar(parser.builtin_grammar(lang))


@lru_cache(2)
def _flags_asked(lang: str) -> tuple[frozenset[str], frozenset[str]]:
    """Flags and categories that the grammar or the passive asks for."""
    rules = [r for _, rs in _grammar(lang).rulesets for r in rs]
    elements = [e for r in rules for e in (r.anchor, *r.before, *r.after)]
    flags = {"PAST_PARTICIPLE", "PASSIVE", "EQUIVALENCE", *(s for e in elements for s in e.subtypes)}
    return frozenset(flags), frozenset([*(c for e in elements for c in e.categories), *(c for r in rules for c in (*r.pull, *r.pop))])


def _asked(flags: tuple[str, ...], lang: str) -> tuple[str, ...]:
    names, categories = _flags_asked(lang)
    return tuple(f for f in flags if f in names or CATEGORIES.get(f) in categories)


def _types(tags: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(NODE_TYPES.get(t, "NIL") for t in tags)


Seen = tuple[tuple[str, ...], tuple[str, ...], str]


@lru_cache(2)
def _table(lang: str) -> tuple[dict[Seen, str], dict[str, Seen]]:
    """Characters of all that can be seen of a word, the same in each worker: possible types, flags, a text that is asked for."""
    types = {(t,) for t in (*NODE_TYPES.values(), "NIL")} | {_types(tuple(tags.split())) for tags in AMBIGUOUS.values()}
    flags = {(), ("PARTICIPLE",), ("PAST_PARTICIPLE",), ("PARTICIPLE", "PAST_PARTICIPLE"), *parser._SUBTYPES.values()}
    seen = list(product(sorted(types), sorted({_asked(f, lang) for f in flags}), ("-", "be", "by")))
    chars = {s: chr(0x21 + i) for i, s in enumerate(seen)}
    return chars, {c: s for s, c in chars.items()}


class _Chars(dict):
    """Character of each word."""

    def __init__(self, lang: str, ambiguity: bool):
        self.lang, self.ambiguity, self.kinds = lang, ambiguity, {}

    def __missing__(self, text: str) -> str:
        tag, low = parser.tag_token(text, self.lang), text.lower()
        tags = AMBIGUOUS.get(low, tag) if self.ambiguity else tag
        kind = tags, parser.subtypes(text, tag, self.lang), "be" if low in BE_FORMS else "by" if low == "by" else "-"
        found = self.kinds.get(kind)
        if found is None:
            found = self.kinds[kind] = _table(self.lang)[0][_types(tuple(tags.split())), _asked(kind[1], self.lang), kind[2]]
        if len(self) < WORDS:  # common words come early
            self[text] = found
        return found


@lru_cache(4)
def _chars(lang: str, ambiguity: bool) -> _Chars:
    return _Chars(lang, ambiguity)


def shape(text: str, lang: str = "en", c: Config = Config()) -> str:
    """The sentence as the parser sees it; raises ``ValueError`` for empty and overlong ones."""
    tokens = parser.tokens_of(text)
    if not tokens:
        raise ValueError("empty sentence")
    if len(tokens) > c.max_words:
        raise ValueError(f"sentence too long ({len(tokens)} > {c.max_words})")
    return "".join(map(_chars(_lang(lang), c.ambiguity).__getitem__, tokens))


# -- rulesets over runs of open nodes


@dataclass(frozen=True)
class _Rule:
    anchor: int
    before: int | None
    after: int | None
    result: int
    links: tuple[tuple[str, str], ...]
    consume: tuple[str, ...]


@dataclass(frozen=True)
class _Change:
    """``types`` holds (place, type) with the mark of consumed nodes, ``gone`` their places from the right."""

    run: bytes
    types: tuple[tuple[int, int], ...]
    gone: tuple[int, ...]
    edges: tuple[tuple[str, int, int], ...]


@dataclass(eq=False)
class _Ruleset:
    rules: tuple[_Rule, ...]
    recursive: bool
    renames: bytes | None
    any: re.Pattern
    runs: re.Pattern
    known: dict = field(default_factory=dict)

    def found(self, types: list[int], at: list[int]) -> list[tuple[_Rule, int, int | None, int | None]]:
        out = []
        for place, i in enumerate(at):
            left, right = (at[place - 1] if place else None), (at[place + 1] if place + 1 < len(at) else None)
            for r in self.rules:
                if types[i] == r.anchor and (r.before is None or left is not None and types[left] == r.before):
                    if r.after is None or right is not None and types[right] == r.after:
                        out.append((r, i, left, right))
        return out

    def change(self, run: bytes, exhaust: bool, matches: list | None) -> _Change:
        """The run after ``exhaust``, if asked, and the given matches, each followed by all others if rules are recursive."""
        types, at, edges = list(run), list(range(len(run))), {}

        def one(m) -> None:
            r, i, left, right = m
            types[i] = r.result
            for kind, side in r.links:
                edges[kind, i, left if side == "before" else right] = None
            for side in r.consume:
                if (gone := left if side == "before" else right) in at:
                    at.remove(gone)

        def rest() -> None:
            while m := self.found(types, at):
                one(m[0])

        if exhaust:
            rest()
        for m in matches or ():
            one(m)
            if self.recursive:
                rest()
        children: set[int] = set()
        for _, parent, child in edges:
            if parent in children:
                raise NotPlain
            children.add(child)
        gone = [i for i in range(len(run)) if i not in at]
        marked = [t | _GONE if i in gone else t for i, t in enumerate(types)]
        return _Change(bytes(types[i] for i in at), tuple((i, t) for i, t in enumerate(marked) if t != run[i]), tuple(reversed(gone)), tuple(edges))

    def of(self, run: bytes) -> tuple | None:
        """Changes as the first run with a match and as a later one, and the forks; None without a match.

        The first match of a sentence exhausts recursive rules everywhere, before the matches of later runs are applied.
        """
        if len(self.known) >= RUNS:
            self.known.clear()
        found = self.found(list(run), list(range(len(run))))
        if not found:
            out = None
        elif len({i for _, i, _, _ in found}) < len(found):
            out = (None, None, [self.change(run, False, [m]) for m in found])
        else:
            out = (self.change(run, False, found), self.change(run, self.recursive, found), None)
        self.known[run] = out
        return out

    def forks(self, run: bytes) -> tuple[list[_Change], _Change | None]:
        """The run after each match alone, and after none: exhausted if rules are recursive."""
        key = (run,)
        if key not in self.known:
            found = self.found(list(run), list(range(len(run))))
            self.known[key] = [self.change(run, False, [m]) for m in found], (self.change(run, True, None) if self.recursive else None)
        return self.known[key]


@dataclass(frozen=True)
class _Plain:
    code: dict[str, int]
    rulesets: tuple[_Ruleset, ...]


def _rule(r: Rule, code: dict[str, int]) -> _Rule | None:
    """None if the rule never fits: its elements of one side all stand for the same node."""
    if any(e.subtypes or e.categories or e.by_original for e in (r.anchor, *r.before, *r.after)) or "VERB" in (*r.pull, *r.pop):
        raise NotPlain
    links = []
    for kind, parent, child in r.connections:
        side, _, rest = child.partition("[")
        if parent != "anchor" or side not in ("before", "after"):
            raise NotPlain
        elements = r.before if side == "before" else r.after
        if rest == "*]" and elements or rest != "*]" and int(rest[:-1]) < len(elements):
            links.append((kind, side))
    consume = tuple(s for s in ("before", "after") if s in r.consume and getattr(r, s))
    if "anchor" in r.consume or {s for _, s in links} != set(consume) or r.recursive and not consume:
        raise NotPlain
    sides = [{code[e.type] for e in side} for side in (r.before, r.after)]
    if any(len(s) > 1 for s in sides):
        return None
    return _Rule(code[r.anchor.type], *(next(iter(s), None) for s in sides), code[r.result], tuple(links), consume)


@lru_cache(2)
def _plain(lang: str) -> _Plain | None:
    g = _grammar(lang)
    rules = [r for _, rs in g.rulesets for r in rs]
    names = {*NODE_TYPES.values(), "NIL", "PREDICATE", "CLAUSE", "NOMINAL", "VERBAL", *(r.result for r in rules)}
    names |= {e.type for r in rules for e in (r.anchor, *r.before, *r.after)}
    code = {t: i + 1 for i, t in enumerate(sorted(names))}
    if len(code) >= _GONE or not g.rulesets:
        return None
    out = []
    for _, rs in g.rulesets:
        try:
            own = tuple(x for r in rs if (x := _rule(r, code)))
        except NotPlain:
            return None
        if len({r.recursive for r in rs}) > 1:
            return None
        alone = [r for r in own if r.before is None and r.after is None]
        renames = None
        if own and len(alone) == len(own) == len({r.anchor for r in own}) and not rs[0].recursive:
            table = bytearray(range(256))
            for r in own:
                table[r.anchor] = r.result
            renames = bytes(table)
        sides = [bytes(x for x in (r.before, r.anchor, r.after) if x is not None) for r in own]
        named = b"".join(re.escape(bytes([x])) for x in sorted({x for s in sides for x in s}))
        least = min(map(len, sides), default=1)
        anything = re.compile(b"|".join(re.escape(s) for s in sides) if sides else b"(?!)", re.DOTALL)
        runs = re.compile(b"[" + named + b"]{%d,}" % least if named else b"(?!)", re.DOTALL)
        out.append(_Ruleset(own, any(r.recursive for r in rs), renames, anything, runs))
    return _Plain(code, tuple(out))


# -- hypotheses


class _Hyp:
    """``types`` of all nodes with the mark of consumed ones, open types and nodes, heights, edges, depth."""

    __slots__ = ("first", "types", "open", "nodes", "heights", "edges", "depth", "score")

    def __init__(self, first, types, open_, nodes, heights, edges, depth, score):
        self.first, self.types, self.open, self.nodes = first, types, open_, nodes
        self.heights, self.edges, self.depth, self.score = heights, edges, depth, score

    def copy(self) -> _Hyp:
        return _Hyp(self.first, self.types[:], self.open, self.nodes[:], self.heights[:], self.edges[:], self.depth, self.score)

    def apply(self, changes: list[tuple[int, int, _Change]]) -> None:
        """(start, end, change) of runs, from the right."""
        types, nodes, heights, edges, depth, open_ = self.types, self.nodes, self.heights, self.edges, self.depth, self.open
        for start, end, x in changes:
            for kind, p, c in x.edges:
                p, c = nodes[start + p], nodes[start + c]
                high = heights[c] + 1
                if high > heights[p]:
                    heights[p] = high
                    if high > depth:
                        depth = high
                edges.append((kind, p, c))
            for i, t in x.types:
                types[nodes[start + i]] = t
            for i in x.gone:
                del nodes[start + i]
            open_ = open_[:start] + x.run + open_[end:]
        self.open, self.depth = open_, depth


def _changes(open_: bytes, rules: _Ruleset) -> tuple[list[tuple[int, int, _Change]], bool] | None:
    """Changes of all runs, from the right, and whether hypotheses fork; None if there is no match."""
    if not rules.any.search(open_):
        return None
    runs, later, forked, known = [], 0, False, rules.known
    for m in rules.runs.finditer(open_):
        run = m.group()
        found = known[run] if run in known else rules.of(run)
        if found:
            runs.append((*m.span(), found[later]))
            later, forked = 1, forked or found[2] is not None
    return runs[::-1], forked


def _forks(h: _Hyp, runs: list, rules: _Ruleset) -> list[_Hyp]:
    """One hypothesis for each match, from the left."""
    parts = [(a, b, *rules.forks(h.open[a:b])) for a, b, _ in reversed(runs)]
    rest = [(a, b, x) for a, b, _, x in reversed(parts) if x is not None]
    out, seen = [], set()
    for a, b, each, alone in parts:
        for x in each:
            same = x.run == alone.run and x.types == alone.types and set(x.edges) == set(alone.edges) if alone else False
            key = None if same else (a, x.run, x.types, frozenset(x.edges))
            if key not in seen:  # the others would be pruned as equal
                seen.add(key)
                out.append(new := h.copy())
                new.apply([(s, e, x if s == a else y) for s, e, y in rest] if alone else [(a, b, x)])
    return out


_by_score = attrgetter("score")


@lru_cache(200_000)
def _score(n: int, consumed: int, edges: int, crossing: int, depth: int) -> float:
    """``parser.structural_score`` of what it counts."""
    connectivity = 1 - abs(edges - (n - 1)) / n if n > 1 else float(not edges)
    projectivity = max(0.0, 1 - 0.1 * crossing)
    ideal = parser.log2(n) if n > 1 else 1.0
    balance = 1 - min(1.0, abs(depth - ideal) / n)
    return max(0.0, min(1.0, 0.4 * consumed / n + 0.3 * connectivity + 0.2 * projectivity + 0.1 * balance))


def _prune(hs: list[_Hyp], c: Config, forked: bool) -> list[_Hyp]:
    """``parser.prune``. Equal hypotheses have equal scores and stay equal, so they matter only if others would be cut."""
    n = len(hs[0].types)
    for h in hs:
        h.score = _score(n, n - len(h.nodes), len(h.edges), 0, h.depth)
    if len(hs) == 1:
        return hs
    if (forked or len(hs) > c.max_hypotheses) and len({bytes(h.types) for h in hs}) < len(hs):
        hs = list({(bytes(h.types), frozenset(h.edges)): h for h in reversed(hs)}.values())[::-1]
    hs.sort(key=_by_score, reverse=True)  # stable, so the first of equal scores stays first
    least = c.prune_threshold * hs[0].score
    del hs[c.max_hypotheses :]
    return hs if hs[-1].score >= least else [h for h in hs if h.score >= least]


def _final(h: _Hyp, code: dict[str, int]) -> tuple[float, int]:
    """Score and number of edges after ``parser.normalise``."""
    n = len(h.types)
    edges, consumed = len(h.edges), n - len(h.nodes)
    if h.score <= 0:
        return h.score, edges
    types = [t & ~_GONE for t in h.types]
    predicate, nominal = code["PREDICATE"], code["NOMINAL"]
    subjects = {p for kind, p, _ in h.edges if kind == "SUBJECT"}
    you = [i for i, t in enumerate(types) if t == predicate and i not in subjects]
    if you:
        crossing, depth = len(you) * (len(you) - 1) // 2, max(h.depth, 1)
        around = [0] * (n + 1)  # edges over a node, as differences
        for _, p, c in h.edges:
            around[min(p, c) + 1] += 1
            around[max(p, c)] -= 1
        over, at = 0, set(you)
        for i in range(n):
            over += around[i]
            if i in at:
                crossing += over
        if any(not h.heights[i] for i in you):
            heights = [0] * n
            for i in you:
                heights[i] = 1
            for _, p, c in h.edges:  # a child is finished when it gets its parent
                heights[p] = max(heights[p], heights[c] + 1)
            depth = max(heights)
        return _score(n + len(you), consumed, edges + len(you), crossing, depth), edges + len(you)
    if types.count(nominal) == 1 and predicate not in types and code["CLAUSE"] not in types:
        i = types.index(nominal)
        crossing = sum(min(p, c) < i < max(p, c) for _, p, c in h.edges)
        return _score(n + 2, consumed, edges + 2, crossing, max(h.depth, h.heights[i] + 2)), edges + 2
    return _score(n, consumed, edges, 0, h.depth), edges


def _agents(h: _Hyp, words: list[Seen], verbal: int) -> int:
    """Triples of the agents of passives, beside one for each edge."""
    helped = {p for kind, p, c in h.edges if kind == "MODIFICATION" and words[c][2] == "be"}
    passive = {i for i in helped if h.first[i] == verbal and "PAST_PARTICIPLE" in words[i][1] and "PASSIVE" not in words[i][1]}
    passive |= {i for i, w in enumerate(words) if "PASSIVE" in w[1]}
    by = {c for kind, p, c in h.edges if kind == "PREPOSITION" and p in passive and words[c][2] == "by"}
    return sum(kind == "PREPOSITION" and p in by for kind, p, _ in h.edges)


def _general(words: list[Seen], lang: str, c: Config) -> tuple[float, int]:
    texts, flags = tuple(w[2] for w in words), tuple(w[1] for w in words)
    first = [Hypothesis(texts, ("X",) * len(words), t, t, flags) for t in islice(product(*(w[0] for w in words)), c.max_initial)]
    best = parser.search(first, _grammar(lang), c)[0]
    return best.score, len(parser.triples(best))


def measure(shape: str, lang: str = "en", c: Config = Config()) -> tuple[float, int]:
    """Score and number of triples of the best parse of a sentence of this shape, as ``parser.measure`` has them."""
    lang = _lang(lang)
    seen = _table(lang)[1]
    words = [seen[x] for x in shape]
    plain, n = _plain(lang), len(words)
    if plain is None or n > c.max_rounds:
        return _general(words, lang, c)
    code = plain.code
    first = dict.fromkeys(bytes(t) for t in islice(product(*([code[t] for t in w[0]] for w in words)), c.max_initial))
    beam = [_Hyp(t, bytearray(t), t, list(range(n)), [0] * n, [], 0, 0.0) for t in first]
    ranked = False
    try:
        for rules in plain.rulesets:
            changed, forked = not ranked, False
            if rules.renames:
                for h in beam:
                    types = h.open.translate(rules.renames)
                    if types != h.open:
                        h.open, h.types = types, h.types.translate(rules.renames)
            else:
                hs, found = [], {}
                for h in beam:
                    open_ = h.open
                    if open_ not in found:
                        found[open_] = _changes(open_, rules)
                    x = found[open_]
                    if x is None:
                        hs.append(h)
                        continue
                    changed = True
                    if x[1]:
                        forked = True
                        hs += _forks(h, x[0], rules)
                    else:
                        h.apply(x[0])
                        hs.append(h)
                beam = hs
            if changed:  # new types alone change no score
                beam, ranked = _prune(beam, c, forked), True
    except NotPlain:
        return _general(words, lang, c)
    best, score, edges = None, -1.0, 0
    for h in [h for h in beam if len(h.nodes) == 1] or beam:
        now, m = _final(h, code)
        if now > score:
            best, score, edges = h, now, m
    return score, edges + _agents(best, words, code["VERBAL"])
