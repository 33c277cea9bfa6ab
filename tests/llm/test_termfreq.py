import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiweave.core import sizing
from lexiweave.llm import termfreq

SCHEMA = "id long, rec long, a string, b string, term string, term_id string"


def data():
    rng = random.Random(4)
    words = ["the", *[f"w{i}" for i in range(700)]]

    def word():
        return rng.choice([None, "the", "the", "x" * 5000, rng.choice(words)])

    rows = [(i, rng.choice([None, *range(200)]) if rng.random() < 0.7 else 7, word(), word(), "clash", "clash") for i in range(3000)]
    return rows + rows[100:300]


def brute(rows):
    occ, recs = Counter(), defaultdict(set)
    for _, rec, a, b, *_ in set(rows):
        for t in (a, b):
            if t is not None:
                occ[t] += 1
                if rec is not None:
                    recs[t].add(rec)
    return {t: (n, len(recs[t])) for t, n in occ.items()}


@pytest.mark.parametrize("block, bound", [(1 << 14, None), (64, None), (64, 0)])
def test_against_brute_force(spark, monkeypatch, block, bound):
    if bound is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", bound)
    rows = data()
    got = termfreq.term_frequencies(spark.createDataFrame(rows, SCHEMA), "id", "rec", [F.col("a"), F.col("b")], block).collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == brute(rows)
    assert len(got) == len({r.term for r in got})


def test_dictionary_is_dense(spark):
    df = spark.createDataFrame([(f"t{i % 500}",) for i in range(2000)] + [(None,)], "term string")
    ids = sorted(r.term_id for r in termfreq.dictionary(df).collect())
    assert ids == list(range(500))


def test_marks(spark):
    df = spark.createDataFrame([("a", 2, 2), ("b", 9, 3), ("c", 30, 20)], "term string, occurrences long, records long")
    assert {r.term: r.mark for r in termfreq.mark_terms(df, 100, 3, (1, 5)).collect()} == {"a": "rare", "b": None, "c": "common"}


def test_empty(spark):
    assert termfreq.term_frequencies(spark.createDataFrame([], SCHEMA), "id", "rec", [F.col("a")]).collect() == []
