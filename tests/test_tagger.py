"""Tags and parses against expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import text as fx, wordlists
from lexiweave.operators import parser as p

TAGS = [
    ("the dog runs", "DET NOUN VERB"),
    ("the very big red dog", "DET ADV ADJ ADJ NOUN"),
    ("the dog on the table", "DET NOUN ADP DET NOUN"),
    ("the dog chases the cat", "DET NOUN VERB DET NOUN"),
    ("the dog runs quickly", "DET NOUN VERB ADV"),
    ("the dog and the cat", "DET NOUN CCONJ DET NOUN"),
    ("the dog is happy", "DET NOUN AUX ADJ"),
    ("three birds flew over Paris", "NUM NOUN VERB ADP PROPN"),
    ("she has never seen it", "PRON AUX ADV VERB PRON"),
    ("they would not sing this morning", "PRON AUX PART VERB DET NOUN"),
]
SPANISH = [
    ("el perro corre", "DET NOUN VERB"),
    ("la casa verde", "DET NOUN ADJ"),
    ("los gatos comen en la mesa", "DET NOUN VERB ADP DET NOUN"),
    ("el libro es bueno", "DET NOUN AUX ADJ"),
    ("ella canta muy bien", "PRON VERB ADV ADV"),
]


@pytest.mark.parametrize("lang, cases", [("en", TAGS), ("es", SPANISH)])
def test_tags(spark, lang, cases):
    df = spark.createDataFrame([(i, w) for i, (s, _) in enumerate(cases) for w in s.split()], "i int, w string")
    by_column = [r.t for r in df.select(fx.tag(F.col("w"), lang).alias("t")).collect()]
    assert by_column == [t for _, ts in cases for t in ts.split()]
    for s, ts in cases:
        assert [w.pos for w in p.tag_sentence(s, lang)] == ts.split()


def test_forms():
    assert wordlists.english_forms("carry") == {"third": "carries", "ing": "carrying", "past": "carried", "participle": "carried"}
    assert wordlists.english_forms("run") == {"third": "runs", "ing": "running", "past": "ran", "participle": "run"}
    assert wordlists.english_forms("stop")["past"] == "stopped" and wordlists.english_forms("lie")["ing"] == "lying"
    assert {"canta", "cantan", "cantando", "cantado"} <= set(wordlists.spanish_forms("cantar"))


def test_candidates(spark):
    df = spark.createDataFrame([("Book",), ("runs",), ("light",), ("table",), ("her",)], "w string")
    got = [r.t for r in df.select(fx.possible_tags(F.col("w")).alias("t")).collect()]
    assert got == [["NOUN", "VERB"], ["VERB", "NOUN"], ["ADJ", "VERB", "NOUN"], ["NOUN"], ["DET", "PRON"]]


def best(sentence, lang="en"):
    return p.parse(p.tag_sentence(sentence, lang), p.load_grammar(p.builtin_grammar(lang)))[0]


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("The dog chases the big cat.", {("dog", "is-agent-of", "chases"), ("cat", "is-patient-of", "chases"), ("big", "describes", "cat")}),
        ("The big red ball hit the wall", {("ball", "is-agent-of", "hit"), ("wall", "is-patient-of", "hit"), ("red", "describes", "ball")}),
        ("The cat was chased by the dog", {("cat", "is-patient-of", "chased"), ("dog", "is-agent-of", "chased")}),
        ("The book was written by a teacher", {("book", "is-patient-of", "written"), ("teacher", "is-agent-of", "written")}),
        ("The dog runs quickly", {("dog", "is-agent-of", "runs"), ("quickly", "modifies-degree", "runs")}),
        ("The dog is happy", {("dog", "is-agent-of", "is"), ("happy", "is-theme-of", "is")}),
        ("I saw her duck", {("duck", "is-patient-of", "saw"), ("I", "is-agent-of", "saw")}),
        ("book the flight", {("flight", "is-patient-of", "book"), ("you", "is-agent-of", "book")}),
        ("light the candle", {("candle", "is-patient-of", "light")}),
        ("the light is bright", {("bright", "is-theme-of", "is"), ("light", "is-agent-of", "is")}),
    ],
)
def test_triples(sentence, want):
    got = set(p.triples(best(sentence)))
    assert want <= got
    assert not {t for t in got if t[1] == "is-agent-of" and (t[0], "is-patient-of", t[2]) in want}


def test_spanish_triples():
    assert {("perro", "is-agent-of", "mira"), ("gato", "is-patient-of", "mira")} <= set(p.triples(best("el perro mira el gato", "es")))


def test_passive_flag():
    h = best("The cat was chased by the dog")
    assert any("PASSIVE" in f for f in h.flags) and not any("PASSIVE" in f for f in best("The dog chased the cat").flags)


def test_already_split():
    assert [w.pos for w in p.tagged(["the", "dog", "runs", "."])][:3] == ["DET", "NOUN", "VERB"]
    assert p.subtypes("would", "AUX") == ("MODAL",) and p.subtypes("seen", "VERB") == ("PAST_PARTICIPLE",) and p.subtypes("was", "AUX") == ("PROGRESSIVE",)
