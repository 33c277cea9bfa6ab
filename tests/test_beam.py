import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiweave.functions import text as fx
from lexiweave.operators import beam, parse_op, parser
from lexiweave.plans import parsing

ENGLISH = "the big dogs that very quickly was built were seen by a to run saw if , and ( it of not Rome".split()
SPANISH = "el perro grande que muy corre por casa y verde la de , si rápidamente viejo comido".split()


def best(text, lang):
    h = parser.parse(parser.tag_sentence(text, lang), parser.load_grammar(parser.builtin_grammar(lang)))[0]
    return h.score, len(parser.triples(h))


@settings(max_examples=300, deadline=None)
@given(st.one_of(*(st.tuples(st.just(x), st.lists(st.sampled_from(ws), min_size=1, max_size=22)) for x, ws in (("en", ENGLISH), ("es", SPANISH)))))
def test_same_as_parser(case):
    lang, words = case
    text = " ".join(words)
    assert beam.measure(beam.shape(text, lang), lang) == best(text, lang)


def test_no_general_parse(monkeypatch):
    """Sentences of the given grammars need no trees, however long; what no rule tells apart is one shape."""
    monkeypatch.setattr(parser, "search", lambda *a: pytest.fail("general parse"))
    for lang, words in (("en", ENGLISH), ("es", SPANISH)):
        beam.measure(beam.shape(" ".join(words * 5)[:300], lang), lang)
    assert beam.shape("The old mill stood .") == beam.shape("Three old mills stood .")


@pytest.mark.parametrize("change", [{"subtypes": ["PAST_PARTICIPLE"]}, {"subcategories": ["VERB"]}])
def test_other_grammars(change, monkeypatch, tmp_path):
    """Rules that ask for flags are left to the parser, and shapes keep those flags."""
    g = json.loads(open(parser.builtin_grammar("en")).read())
    g["rulesets"]["verb"]["rules"][0]["pattern"]["anchor"].update(change)
    (tmp_path / "g.json").write_text(json.dumps(g))
    caches = (beam._grammar, beam._flags_asked, beam._table, beam._chars, beam._plain)
    for c in caches:
        c.cache_clear()
    with monkeypatch.context() as m:
        m.setattr(parser, "builtin_grammar", lambda lang: str(tmp_path / "g.json"))
        for text in ("The mill was built by hand", "The mill was running", "It can not be seen by dogs in the old town"):
            assert beam.measure(beam.shape(text)) == best(text, "en")
    for c in caches:
        c.cache_clear()


TEXTS = [
    ("The mill was built by a miller. It stands! \nDogs run . I\x1c? A. B", "en-GB"), ("El molino viejo muele. La casa verde es grande.", "ES"), (None, "en"),
    ("", None), (" ".join(["word"] * 101) + ". Cats saw the dog. Cats saw a dog. cats.", None), ("\x85One　two. ​Three.\x1d\x1eFour  ", " "), (" . ! ?A", "en"),
]


def test_whole_texts(spark):
    d = spark.createDataFrame(TEXTS, "text string, lang string").repartition(3)
    split = {(r.text, s) for r in d.select("text", fx.sentences(F.col("text")).alias("l")).collect() for s in r.l or ()}
    assert split == {(t, s) for t, _ in TEXTS for s in parser.sentences_of(t or "")}
    want = {}
    for t, x in TEXTS:
        for s in parser.sentences_of(t or ""):
            try:
                score, n = best(s, "es" if x == "ES" else "en")
            except ValueError as e:
                score, n = str(e), 0
            want[score, n] = want.get((score, n), 0) + 1
    got = parse_op.measure_texts(d.select("text", fx.plain_lang(F.col("lang")).alias("lang")), "text", "lang").collect()
    found = {}
    for r in got:
        key = (r.parse_score if r.success else r.error, r.num_triples)
        found[key] = found.get(key, 0) + r.sentences
    assert found == want


def test_statistics(spark, tmp_path):
    spark.createDataFrame(TEXTS, "text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    each = [best(s, "es" if x == "ES" else "en") for t, x in TEXTS for s in parser.sentences_of(t or "") if len(s.split()) <= 100]
    rows = {r.success: r for r in parsing.parse_documents(spark, str(tmp_path)).collect()}
    assert (rows[False].sentences, rows[False].triples, rows[False].score, rows[False].error) == (1, 0, None, "sentence too long (n > n)")
    assert (rows[True].sentences, rows[True].triples) == (len(each), sum(n for _, n in each))
    assert rows[True].score == pytest.approx(sum(x for x, _ in each) / len(each))
