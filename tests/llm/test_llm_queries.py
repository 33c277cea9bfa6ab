"""Queries of the subpackage against their SQL, and those without SQL against plain Python."""

import pytest

from lexiweave.llm import mojibake, tokenize
from lexiweave.llm.queries import registry
from oracle import assert_same, connect
from test_contamination import brute


@pytest.mark.parametrize("name", sorted(n for n, e in registry.items() if e.sql))
def test_same_as_sql(spark, data, name):
    assert_same(spark, data, registry[name])


def docs(data):
    return connect(data).execute("SELECT DISTINCT doc_id, text FROM documents").fetchall()


def test_p6_ids(spark, data):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokenize.encoder(tokenize.vocabulary_path()).ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in registry["p6_ids"].run(spark, data).collect()}
    assert got == {d: enc.encode_ordinary(t or "") for d, t in docs(data)}


def test_p7_found(spark, data):
    items = connect(data).execute("SELECT DISTINCT item_id, text FROM eval_item").fetchall()
    got = {(r.doc_id, r.item_id) for r in registry["p7_found"].run(spark, data).collect()}
    assert got == brute(docs(data), items, 10)


def test_p7_clean_documents_have_no_leaks(spark, data):
    items = connect(data).execute("SELECT DISTINCT item_id, text FROM eval_item").fetchall()
    clean = [(r.doc_id, r.text) for r in registry["p7_clean_documents"].run(spark, data).collect()]
    assert len(clean) == len(docs(data)) and not brute(clean, items, 10)


def test_p8(spark, data):
    found = {r.doc_id for r in registry["p8_found"].run(spark, data).collect()}
    restored = {r.doc_id: r for r in registry["p8_restored"].run(spark, data).collect()}
    assert found == set(restored)
    for d, t in docs(data):
        if d not in found and t:
            assert mojibake.cost(t) == 0
    for r in restored.values():
        assert r.lost or mojibake.cost(r.restored) == 0
