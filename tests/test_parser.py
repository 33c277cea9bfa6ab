import json

import pytest
from hypothesis import given, settings, strategies as st

from lexiweave.operators import parser, parser as p
from lexiweave.operators.parse_op import record

GOLDENS = [
    (3, 2, [(0, 1), (1, 2)], [2], 0.8138),
    (3, 2, [(0, 1), (2, 1)], [1], 0.8138),
    (8, 6, [(0, 1), (3, 4), (6, 7), (5, 7), (5, 4), (2, 1)], [2, 4], 0.8375),
]


@pytest.mark.parametrize("n, consumed, edges, roots, want", GOLDENS)
def test_golden_scores(n, consumed, edges, roots, want):
    assert p.structural_score(n, consumed, [("X", a, b) for a, b in edges], roots) == pytest.approx(want, abs=5e-5)


def test_cycles_and_empty_trees():
    assert p.depth(2, [("X", 0, 1), ("X", 1, 0)], []) == 1
    assert p.structural_score(0, 0, [], []) == 0.0


def grammar(lang="en"):
    return p.load_grammar(p.builtin_grammar(lang))


def test_clause():
    best = p.parse(p.tag_sentence("the dogs are chasing mice in the garden"), grammar())[0]
    assert {("dogs", "is-agent-of", "chasing"), ("mice", "is-patient-of", "chasing"), ("the", "describes", "dogs")} <= set(p.triples(best))
    assert ("garden", "has-location", "in") in p.triples(best)
    role = {w: r for w, _, r, _ in p.contexts(best)}
    assert role["dogs"] == "SUBJECT" and role["mice"] == "OBJECT"


def test_single_noun_gets_equivalence():
    best = p.parse(p.tag_sentence("dog"), grammar())[0]
    assert ("dog", "is-agent-of", "[EQUIVALENCE]") in p.triples(best)
    assert "dog" in p.to_text(best) and p.to_dot(best).startswith("digraph")


def test_spanish_adjectives_follow():
    words = [p.Word("casa", "NOUN"), p.Word("verde", "ADJ")]
    assert ("verde", "describes", "casa") in p.triples(p.parse(words, grammar("es"))[0])


def test_bad_sentences():
    with pytest.raises(ValueError):
        p.parse([], grammar())
    with pytest.raises(ValueError):
        p.parse(p.tag_sentence("a " * 101), grammar())


@pytest.mark.parametrize(
    "change",
    [
        lambda g: g.pop("order"),
        lambda g: g["order"].append("nothing"),
        lambda g: g["rulesets"]["clause"]["rules"][0].update(consume=["all"]),
        lambda g: g["rulesets"]["clause"]["rules"][0]["pattern"]["anchor"].pop("type"),
        lambda g: g["rulesets"]["clause"]["rules"][0]["pattern"]["before"][0].update(quantifier="some"),
        lambda g: g["rulesets"]["clause"]["rules"][0]["connections"][0].update(to="beside[0]"),
    ],
)
def test_grammar_errors(change):
    g = json.loads(open(p.builtin_grammar("en")).read())
    change(g)
    with pytest.raises(p.GrammarError):
        p.read_grammar(g)


WORDS = st.lists(st.sampled_from("the big dog that runs to a house and sees cats very often , with it".split()), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_beam_properties(words):
    tagged = p.tag_sentence(" ".join(words))
    hs = p.parse(tagged, grammar())
    assert 1 <= len(hs) <= 20
    assert all(0 <= h.score <= 1 for h in hs)
    assert [h.score for h in hs] == sorted((h.score for h in hs), reverse=True)
    again = p.prune(hs, p.Config())
    assert {h.key() for h in again} <= {h.key() for h in hs}
    assert p.prune(again, p.Config()) == again


def test_one_parse_for_a_shape(monkeypatch):
    """Sentences that differ only in words no rule asks for are parsed once, with the results of a parse of their own."""
    calls = []
    parse = parser.parse
    monkeypatch.setattr(parser, "parse", lambda *a: calls.append(1) or parse(*a))
    parser._of_shape.cache_clear()
    words = "The {} mill was built by a {} near the {} ."
    same = [words.format(*w) for w in (("old", "blorn", "grint"), ("old", "plim", "stovk"), ("old", "drub", "kelm"))]
    other = ["The mill was built near a river .", "The mill is built by hand .", "Run !", "", "The saw saw that light .", "El molino viejo muele ."]
    for lang in ("en", "es"):
        for text in same + other:
            calls.clear()
            got = record(1, text, lang, parser.Config())
            if text in same[1:]:
                assert not calls
            try:
                best = parse(parser.tag_sentence(text, lang), parser.load_grammar(parser.builtin_grammar(lang)), parser.Config())[0]
            except ValueError as e:
                assert got["error"] == str(e)
                continue
            assert got["parse_score"] == best.score and [tuple(t.values()) for t in got["triples"]] == parser.triples(best)
            assert [tuple(c.values()) for c in got["contexts"]] == parser.contexts(best) and [n["text"] for n in got["nodes"]] == list(best.texts)
            assert parser.measure(text, lang) == (best.score, len(parser.triples(best)))
