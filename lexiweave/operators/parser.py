"""Beam parser over data-driven grammars: pure Python, no Spark, used inside Arrow workers.

A hypothesis is a value: node types, flags, an edge tuple and a bit mask of consumed nodes.
Applying a rule makes a new value and shares everything it does not change. Heads are parents
throughout. A pattern element always takes the nearest unconsumed node on its side, whatever
its quantifier, and each rule gives at most one match for an anchor.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import islice, product
from math import log2
from pathlib import Path

from ..functions import wordlists
from ..functions.text import AMBIGUOUS, ENGLISH_ENDINGS, ENGLISH_TAGS, PUNCTUATION_TAGS, QUOTES, SPANISH_ENDINGS, SPANISH_TAGS

# Node type of each tag; all other tags give NIL.
NODE_TYPES = {
    "ADJ": "DESCRIPTOR", "ADP": "PREP", "ADV": "SPECIFIER", "AUX": "MODIFIER", "CCONJ": "COORD", "DET": "DESCRIPTOR", "INTJ": "INTJ",
    "NOUN": "NOUN", "NUM": "DESCRIPTOR", "PART": "MODIFIER", "PRON": "NOUN", "PROPN": "NOUN", "SCONJ": "SUBOORD", "VERB": "VERBAL", "LOG": "COORD",
    "COMMA": "COMMA", "SEMICOLON": "SEMICOLON", "COLON": "COLON", "LPAREN": "LPAREN", "RPAREN": "RPAREN", "EM_DASH": "EM_DASH", "QUOTE": "QUOTE",
}
# Relation of each edge type; all others are related-to. Prepositions refine PREPOSITION.
RELATIONS = {
    "SUBJECT": "is-agent-of", "OBJECT": "is-patient-of", "SUBJECT_COMPLEMENT": "is-theme-of", "DESCRIPTION": "describes",
    "MODIFICATION": "modifies-manner", "SPECIFICATION": "modifies-degree", "COORDINATION": "coordinates-with", "SUBORDINATION": "subordinates",
}
PREPOSITIONS = {
    "in": "has-location", "on": "has-location", "at": "has-location", "to": "has-goal", "from": "has-source", "with": "has-instrument",
    "for": "has-beneficiary", "by": "has-instrument", "during": "has-time", "before": "has-time", "after": "has-time",
}
# Category of each subtype that agrees.
CATEGORIES = {
    "SUBORDINATE": "CLAUSE", "INDEPENDENT": "CLAUSE", "NOMINAL": "VERB", "MODAL": "VERB", "PERFECT": "VERB", "PROGRESSIVE": "VERB", "PASSIVE": "VERB",
    "COMPARATIVE": "DESCRIPTOR", "SUPERLATIVE": "DESCRIPTOR", "POSSESSIVE": "DESCRIPTOR", "NEGATIVE": "DESCRIPTOR", "RELATIVE": "DESCRIPTOR",
    "INFINITIVE": "DESCRIPTOR", "PARTICIPLE": "DESCRIPTOR", "MASCULINE": "GENDER", "FEMININE": "GENDER", "NEUTER": "GENDER",
    "SINGULAR": "NUMBER", "PLURAL": "NUMBER", "QUESTION": "QUESTIONS",
}
QUANTIFIERS = ("one", "all", "one_or_more")
BE_FORMS = frozenset("be am is are was were been being".split())


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Element:
    type: str
    quantifier: str = "one"
    subtypes: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    by_original: bool = False


@dataclass(frozen=True)
class Rule:
    result: str
    anchor: Element
    before: tuple[Element, ...]
    after: tuple[Element, ...]
    connections: tuple[tuple[str, str, str], ...]
    consume: tuple[str, ...]
    pull: tuple[str, ...] = ()
    pop: tuple[str, ...] = ()
    recursive: bool = False
    note: str = ""


@dataclass(frozen=True)
class Grammar:
    language: str
    rulesets: tuple[tuple[str, tuple[Rule, ...]], ...]


def _element(raw: dict, where: str) -> Element:
    if "type" not in raw:
        raise GrammarError(f"{where}: an element needs a type")
    quantifier = raw.get("quantifier", "one")
    if quantifier not in QUANTIFIERS:
        raise GrammarError(f"{where}: unknown quantifier {quantifier}")
    return Element(raw["type"], quantifier, tuple(raw.get("subtypes", ())), tuple(raw.get("subcategories", ())), raw.get("original_type") is not None)


def _check_reference(ref: str, where: str) -> None:
    side, _, rest = ref.partition("[")
    if ref != "anchor" and not (side in ("before", "after") and rest.endswith("]") and (rest[:-1] == "*" or rest[:-1].isdigit())):
        raise GrammarError(f"{where}: bad reference {ref}")


def read_grammar(raw: dict) -> Grammar:
    """Checked grammar from its JSON form."""
    for name in ("metadata", "order", "rulesets"):
        if name not in raw:
            raise GrammarError(f"a grammar needs {name}")
    rulesets = []
    for name in raw["order"]:
        if name not in raw["rulesets"]:
            raise GrammarError(f"order names the unknown ruleset {name}")
        body = raw["rulesets"][name]
        rules = []
        for i, r in enumerate(body.get("rules", ())):
            where = f"{name}, rule {i}"
            if "pattern" not in r or "anchor" not in r["pattern"]:
                raise GrammarError(f"{where}: a rule needs a pattern with an anchor")
            p = r["pattern"]
            unknown = set(r.get("consume", ())) - {"before", "after", "anchor"}
            if unknown:
                raise GrammarError(f"{where}: cannot consume {sorted(unknown)}")
            links = []
            for c in r.get("connections", ()):
                for ref in (c["from"], c["to"]):
                    _check_reference(ref, where)
                links.append((c["type"], c["from"], c["to"]))
            flags = r.get("flags", {})
            rules.append(
                Rule(
                    r.get("result", body.get("result", "NIL")), _element(p["anchor"], where), tuple(_element(e, where) for e in p.get("before", ())),
                    tuple(_element(e, where) for e in p.get("after", ())), tuple(links), tuple(r.get("consume", ())),
                    tuple(flags.get("pull_categories", ())), tuple(flags.get("pop_categories", ())), bool(r.get("recursive")), r.get("note", ""),
                )
            )
        rulesets.append((name, tuple(rules)))
    return Grammar(raw["metadata"].get("language", "und"), tuple(rulesets))


@lru_cache(16)
def load_grammar(path: str) -> Grammar:
    return read_grammar(json.loads(Path(path).read_text(encoding="utf-8")))


def builtin_grammar(lang: str) -> str:
    """Path of the grammar for a language; languages without one use the English rules."""
    here = Path(__file__).resolve().parent.parent / "grammars"
    return str(here / ("es.json" if lang == "es" else "en.json"))


@lru_cache(2)
def _lexicon(lang: str) -> dict[str, str]:
    return {w: t for t, ws in (SPANISH_TAGS if lang == "es" else ENGLISH_TAGS).items() for w in ws}


@dataclass(frozen=True)
class Word:
    text: str
    pos: str
    subtypes: tuple[str, ...] = ()


def tag_token(text: str, lang: str = "en") -> str:
    """The tag rule of ``functions.text.tag`` for one token."""
    if lang != "es":
        if text in PUNCTUATION_TAGS:
            return PUNCTUATION_TAGS[text]
        if text in QUOTES:
            return "QUOTE"
    low = text.lower()
    known = _lexicon("es" if lang == "es" else "en").get(low)
    if known:
        return known
    if text[:1].isupper() and (lang == "es" or text not in ("I", "A")):
        return "PROPN"
    for end, name in SPANISH_ENDINGS if lang == "es" else ENGLISH_ENDINGS:
        if low.endswith(end):
            return name
    return "NOUN"


_PARTICIPLES = wordlists.participles()
_SUBTYPES: dict[str, tuple[str, ...]] = {}
for _words, _kind in (
    (wordlists.ENGLISH_MODALS, "MODAL"), (("have", "has", "had"), "PERFECT"), (sorted(BE_FORMS), "PROGRESSIVE"), (wordlists.ENGLISH_NEGATIVE, "NEGATIVE"),
    (wordlists.ENGLISH_RELATIVE, "RELATIVE"), (("'s",), "POSSESSIVE"), (("to",), "INFINITIVE"),
):
    for _w in _words:
        _SUBTYPES[_w] = (*_SUBTYPES.get(_w, ()), _kind)


def subtypes(text: str, tag: str, lang: str = "en") -> tuple[str, ...]:
    """Features of a word: of auxiliaries and other function words by list, of verb forms by list and ending."""
    low = text.lower()
    if lang == "es":
        ends = ("ando", "iendo", "ado", "ido")
        return ("PARTICIPLE", *(("PAST_PARTICIPLE",) if low.endswith(("ado", "ido")) else ())) if tag == "VERB" and low.endswith(ends) else ()
    if tag == "VERB":
        past = low in _PARTICIPLES or low.endswith("ed")
        return (("PARTICIPLE",) if low.endswith("ing") else ()) + (("PAST_PARTICIPLE",) if past else ())
    return _SUBTYPES.get(low, ())


def tagged(tokens: list[str], lang: str = "en") -> list[Word]:
    """Words of a sentence that is already split."""
    return [Word(t, tag := tag_token(t, lang), subtypes(t, tag, lang)) for t in tokens]


_BETWEEN = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def sentences_of(text: str) -> list[str]:
    """The sentences of ``functions.text.sentences`` for one text; ``\\s`` and ``strip`` take the same white space."""
    return [s for part in _BETWEEN.split(text) if len(s := part.strip()) > 1]


#: Marks at the end of a token that are not part of the word.
_ENDS = ".!?"


def tokens_of(text: str) -> list[str]:
    """Tokens of a sentence split at white space; an end mark is no part of the last one."""
    tokens = text.split()
    if tokens and len(tokens[-1]) > 1:
        tokens[-1] = tokens[-1].rstrip(_ENDS) or tokens[-1]
    return tokens


def tag_sentence(text: str, lang: str = "en") -> list[Word]:
    """Words of a sentence."""
    return tagged(tokens_of(text), lang)


@dataclass(frozen=True)
class Config:
    max_hypotheses: int = 20
    prune_threshold: float = 0.4
    max_words: int = 100
    max_initial: int = 50
    ambiguity: bool = True
    max_rounds: int = 100


@dataclass(frozen=True)
class Hypothesis:
    texts: tuple[str | None, ...]
    tags: tuple[str, ...]
    original: tuple[str, ...]
    types: tuple[str, ...]
    flags: tuple[tuple[str, ...], ...]
    edges: tuple[tuple[str, int, int], ...] = ()
    consumed: int = 0
    score: float = 0.0

    def open_nodes(self) -> list[int]:
        return [i for i in range(len(self.types)) if not self.consumed >> i & 1]

    def key(self) -> tuple:
        return self.types, frozenset(self.edges), self.consumed

    def category(self, node: int, category: str) -> str | None:
        return next((f for f in self.flags[node] if CATEGORIES.get(f) == category), None)


def _set(t: tuple, i: int, value) -> tuple:
    return (*t[:i], value, *t[i + 1 :])


def fits(h: Hypothesis, node: int, e: Element, anchor: int) -> bool:
    have = h.original[node] if e.by_original else h.types[node]
    return (
        have == e.type
        and set(e.subtypes) <= set(h.flags[node])
        and all(h.category(anchor, c) == h.category(node, c) for c in e.categories)
    )


@dataclass(frozen=True)
class Match:
    rule: Rule
    anchor: int
    before: tuple[int, ...]
    after: tuple[int, ...]

    def nodes(self, ref: str) -> tuple[int, ...]:
        if ref == "anchor":
            return (self.anchor,)
        side, _, rest = ref.partition("[")
        found = self.before if side == "before" else self.after
        return found if rest == "*]" else found[int(rest[:-1]) :][:1]


def match(h: Hypothesis, rule: Rule, anchor: int, open_nodes: list[int], place: int) -> Match | None:
    """``place`` is the anchor's position among the open nodes, so its neighbours there are the nearest ones."""
    if not fits(h, anchor, rule.anchor, anchor):
        return None
    left = open_nodes[place - 1] if place else None
    right = open_nodes[place + 1] if place + 1 < len(open_nodes) else None
    for side, elements in ((left, rule.before), (right, rule.after)):
        if elements and (side is None or not all(fits(h, side, e, anchor) for e in elements)):
            return None
    return Match(rule, anchor, (left,) * len(rule.before), (right,) * len(rule.after))


def apply(h: Hypothesis, m: Match) -> Hypothesis:
    r = m.rule
    flags = list(h.flags[m.anchor])
    for c in r.pull:
        values = (h.category(i, c) for i in (*m.before, *m.after))
        value = next((v for v in values if v and v not in flags), None)
        if value:
            flags.append(value)
    flags = [f for f in flags if CATEGORIES.get(f) not in r.pop] if r.pop else flags
    edges = dict.fromkeys(h.edges)
    for kind, a, b in r.connections:
        edges.update(dict.fromkeys((kind, p, c) for p in m.nodes(a) for c in m.nodes(b)))
    gone = h.consumed
    for name, nodes in (("before", m.before), ("after", m.after), ("anchor", (m.anchor,))):
        if name in r.consume:
            for i in nodes:
                gone |= 1 << i
    return replace(
        h, types=_set(h.types, m.anchor, r.result), flags=_set(h.flags, m.anchor, tuple(flags)), edges=tuple(edges), consumed=gone
    )


def _matches(h: Hypothesis, rules: tuple[Rule, ...]):
    nodes = h.open_nodes()
    for place, i in enumerate(nodes):
        for r in rules:
            m = match(h, r, i, nodes, place)
            if m:
                yield m


def exhaust(h: Hypothesis, rules: tuple[Rule, ...], rounds: int) -> Hypothesis:
    """The first match again and again, until none is left or the types and edges stop changing."""
    for _ in range(rounds):
        m = next(_matches(h, rules), None)
        if m is None:
            break
        after = apply(h, m)
        if after.key() == h.key():
            break
        h = after
    return h


def crossing(edges) -> int:
    spans = [(min(p, c), max(p, c)) for _, p, c in edges]
    return sum(a < c < b < d or c < a < d < b for i, (a, b) in enumerate(spans) for c, d in spans[i + 1 :])


def depth(n: int, edges, roots: list[int]) -> int:
    """Longest path down from a root; a node on the path is not entered again."""
    below: dict[int, list[int]] = {}
    for _, p, c in edges:
        below.setdefault(p, []).append(c)
    done: dict[int, int] = {}

    def down(i: int, path: frozenset) -> int:
        if i in done:
            return done[i]
        found = max((1 + down(c, path | {i}) for c in below.get(i, ()) if c not in path and c != i), default=0)
        if not path:
            done[i] = found
        return found

    return max(down(r, frozenset()) for r in (roots or [0])) if n and edges else 0


def structural_score(n: int, consumed: int, edges, roots: list[int]) -> float:
    """0.4 coverage + 0.3 connectivity + 0.2 projectivity + 0.1 balance, within [0, 1]."""
    if not n:
        return 0.0
    connectivity = 1 - abs(len(edges) - (n - 1)) / n if n > 1 else float(not edges)
    projectivity = max(0.0, 1 - 0.1 * crossing(edges))
    ideal = log2(n) if n > 1 else 1.0
    balance = 1 - min(1.0, abs(depth(n, edges, roots) - ideal) / n)
    return max(0.0, min(1.0, 0.4 * consumed / n + 0.3 * connectivity + 0.2 * projectivity + 0.1 * balance))


def scored(h: Hypothesis) -> Hypothesis:
    return replace(h, score=structural_score(len(h.types), h.consumed.bit_count(), h.edges, h.open_nodes()))


def prune(hs: list[Hypothesis], c: Config) -> list[Hypothesis]:
    """The better of equal ones, then the best 20 within 0.4 of the best score."""
    best: dict[tuple, Hypothesis] = {}
    for h in hs:
        k = h.key()
        if k not in best or h.score > best[k].score:
            best[k] = h
    ranked = sorted(best.values(), key=lambda h: -h.score)[: c.max_hypotheses]
    return [h for h in ranked if h.score >= c.prune_threshold * ranked[0].score]


def _step(h: Hypothesis, rules: tuple[Rule, ...], c: Config) -> list[Hypothesis]:
    found = list(_matches(h, rules))

    def one(base: Hypothesis, m: Match) -> Hypothesis:
        after = apply(base, m)
        return exhaust(after, rules, c.max_rounds) if m.rule.recursive else after

    if not found:
        return [h]
    if len({m.anchor for m in found}) < len(found):
        return [one(h, m) for m in found]  # conflicting matches fork
    for m in found:
        h = one(h, m)
    return [h]


def initial(words: list[Word], c: Config) -> list[Hypothesis]:
    choices = [tuple(AMBIGUOUS[w.text.lower()].split()) if c.ambiguity and w.text.lower() in AMBIGUOUS else (w.pos,) for w in words]
    texts, flags = tuple(w.text for w in words), tuple(w.subtypes for w in words)
    out = []
    for tags in islice(product(*choices), c.max_initial):
        types = tuple(NODE_TYPES.get(t, "NIL") for t in tags)
        out.append(Hypothesis(texts, tags, types, types, flags))
    return out


def _add(h: Hypothesis, text: str | None, tag: str, kind: str, flags: tuple[str, ...], *edges: tuple[str, int, int]) -> Hypothesis:
    return replace(
        h, texts=(*h.texts, text), tags=(*h.tags, tag), original=(*h.original, kind), types=(*h.types, kind), flags=(*h.flags, flags), edges=(*h.edges, *edges)
    )


def normalise(h: Hypothesis) -> Hypothesis:
    """Implied ``you`` of imperatives, passive marks, and an equivalence predicate for a lone nominal."""
    if h.score <= 0:
        return h
    for i, kind in enumerate(h.types):
        if kind == "PREDICATE" and not any(t == "SUBJECT" and p == i for t, p, _ in h.edges):
            h = _add(h, "you", "PRON", "NOMINAL", ("SECOND_PERSON", "SINGULAR"), ("SUBJECT", i, len(h.types)))
    for i in range(len(h.types)):
        if h.original[i] == "VERBAL" and "PAST_PARTICIPLE" in h.flags[i] and "PASSIVE" not in h.flags[i]:
            helpers = (c for t, p, c in h.edges if p == i and t == "MODIFICATION")
            if any((h.texts[c] or "").lower() in BE_FORMS for c in helpers):
                h = replace(h, flags=_set(h.flags, i, (*h.flags[i], "PASSIVE")))
    nominals = [i for i, k in enumerate(h.types) if k == "NOMINAL"]
    if len(nominals) == 1 and not {"PREDICATE", "CLAUSE"} & set(h.types):
        p = len(h.types)
        h = _add(h, None, "LOG", "PREDICATE", ("EQUIVALENCE",), ("SUBJECT", p, nominals[0]))
        h = _add(h, None, "X", "CLAUSE", (), ("COMPLEMENT", p + 1, p))
    return h


def parse(words: list[Word], g: Grammar, c: Config = Config()) -> list[Hypothesis]:
    """Ranked hypotheses of a tagged sentence; raises ``ValueError`` for empty and overlong ones."""
    if not words:
        raise ValueError("empty sentence")
    if len(words) > c.max_words:
        raise ValueError(f"sentence too long ({len(words)} > {c.max_words})")
    return search(initial(words, c), g, c)


def search(beam: list[Hypothesis], g: Grammar, c: Config = Config()) -> list[Hypothesis]:
    """Ranked hypotheses that the rules make of the first ones."""
    for _, rules in g.rulesets:
        beam = prune([scored(x) for h in beam for x in _step(h, rules, c)], c)
    complete = [h for h in beam if len(h.open_nodes()) == 1]
    return sorted((scored(normalise(h)) for h in complete or beam), key=lambda h: -h.score)


#: Shapes of sentences and words that a worker keeps.
SHAPES = 20_000
WORDS = 100_000


@lru_cache(WORDS)
def _outline(text: str, lang: str) -> tuple[str, str, tuple[str, ...]]:
    """What a parse sees of a word: its tag and features, and its text only where a rule asks for it."""
    tag, low = tag_token(text, lang), text.lower()
    return (low if low in AMBIGUOUS or low in BE_FORMS or low == "by" else "-"), tag, subtypes(text, tag, lang)


@lru_cache(SHAPES)
def _of_shape(shape: tuple[tuple[str, str, tuple[str, ...]], ...], lang: str, c: Config) -> tuple[Hypothesis, int]:
    best = parse([Word(*w) for w in shape], load_grammar(builtin_grammar(lang)), c)[0]
    return best, len(triples(best))


def _shaped(text: str, lang: str, c: Config) -> tuple[list[str], Hypothesis, int]:
    tokens = tokens_of(text)
    if len(tokens) > c.max_words:  # not worth keeping
        raise ValueError(f"sentence too long ({len(tokens)} > {c.max_words})")
    return tokens, *_of_shape(tuple(_outline(t, lang) for t in tokens), lang, c)


def parse_best(text: str, lang: str = "en", c: Config = Config()) -> Hypothesis:
    """The first of ``parse`` for a sentence; sentences of one shape (all that a rule looks at) are parsed once."""
    tokens, h, _ = _shaped(text, lang, c)
    return replace(h, texts=(*tokens, *h.texts[len(tokens) :]))


def measure(text: str, lang: str = "en", c: Config = Config()) -> tuple[float, int]:
    """Score and number of triples of the best parse."""
    _, h, n = _shaped(text, lang, c)
    return h.score, n


def head(h: Hypothesis, i: int, seen: frozenset = frozenset()) -> str:
    """Word of a node; for constructed nodes that of the first child, or a mark."""
    if "EQUIVALENCE" in h.flags[i]:
        return "[EQUIVALENCE]"
    if h.texts[i]:
        return h.texts[i]
    child = next((c for _, p, c in h.edges if p == i and c not in seen), None)
    return f"[{h.types[i]}]" if child is None else head(h, child, seen | {i})


def triples(h: Hypothesis) -> list[tuple[str, str, str]]:
    """(subject, relation, object) of each edge: the child's head word relates to the parent's.

    A prepositional edge takes its relation from the preposition it passes through. Of a passive verb the
    subject is the patient and the noun after ``by`` the agent.
    """
    out = []
    passive = {i for i, f in enumerate(h.flags) if "PASSIVE" in f}
    by = {c for kind, p, c in h.edges if kind == "PREPOSITION" and p in passive and (h.texts[c] or "").lower() == "by"}
    for kind, p, c in h.edges:
        relation = RELATIONS.get(kind, "related-to")
        if kind == "SUBJECT" and p in passive:
            relation = "is-patient-of"
        if kind == "PREPOSITION" and p in by:
            verb = next(v for k, v, x in h.edges if x == p and v in passive)
            out.append((head(h, c), "is-agent-of", head(h, verb)))
        if kind == "PREPOSITION":
            words = [h.texts[i].lower() for i in (c, p) if h.texts[i] and h.tags[i] == "ADP"]
            if words:
                relation = PREPOSITIONS.get(words[0], "has-location")
        out.append((head(h, c), relation, head(h, p)))
    return out


def contexts(h: Hypothesis) -> list[tuple[str, str, str | None, list[str]]]:
    """(word, tag, last subject or object role, neighbours over edges) of each node with a word."""
    near: dict[int, list[tuple[int, str]]] = {}
    for kind, p, c in h.edges:
        near.setdefault(p, []).append((c, kind))
        near.setdefault(c, []).append((p, kind))
    out = []
    for i, text in enumerate(h.texts):
        if text:
            mine = near.get(i, [])
            roles = [k for _, k in mine if k in ("SUBJECT", "OBJECT")]
            out.append((text, h.tags[i], roles[-1] if roles else None, [h.texts[j] for j, _ in mine if h.texts[j]]))
    return out


def to_dot(h: Hypothesis, name: str = "parse_tree") -> str:
    """Graphviz text of a tree."""
    lines = [f"digraph {name} {{", f'  label="score {h.score:.3f}";']
    for i, kind in enumerate(h.types):
        label = f"{(h.texts[i] or kind)}\\n{kind}".replace('"', r"\"")
        lines.append(f'  n{i} [label="{label}"];')
    lines += [f'  n{c} -> n{p} [label="{t}"];' for t, p, c in h.edges]
    return "\n".join([*lines, "}"])


def to_text(h: Hypothesis) -> str:
    """Indented tree from each open node."""
    below: dict[int, list[tuple[str, int]]] = {}
    for t, p, c in h.edges:
        below.setdefault(p, []).append((t, c))
    lines: list[str] = []

    def walk(i: int, indent: int, via: str, path: frozenset) -> None:
        lines.append("  " * indent + (f"{via}: " if via else "") + f"{h.texts[i] or '-'} [{h.types[i]}]")
        for t, c in below.get(i, ()):
            if c not in path:
                walk(c, indent + 1, t, path | {i})

    children = {c for _, _, c in h.edges}
    for r in h.open_nodes():
        if r not in children:
            walk(r, 0, "", frozenset())
    return "\n".join(lines)
