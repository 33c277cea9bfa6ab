import random

import pytest
from hypothesis import given, settings, strategies as st

from lexiweave.llm import tokenize as tk

PIECES = ["'s", "'re", "'", "'d", " ", "  ", "\n", "\t", "\xa0", "a", "é", "1", "²", "!", "—", "'ll", "'v", "'ve", "\r\n", "́", "日", "🙂", "‍", "Z", "ǅ", "Ⅷ", "\x1c", "\x85", "　", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tk.encoder(tk.vocabulary_path()).ranks, special_tokens={})


def encode(texts):
    ids, sizes = tk.encoder(tk.vocabulary_path()).encode_batch(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_same_ids_as_a_public_encoder(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab" * 3000, "1" * 1000, " " * 3000 + "x", "é" * 700, "x" + " " * 999]
    assert encode(texts) == reference.encode_ordinary_batch(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_round_trip(texts):
    enc = tk.encoder(tk.vocabulary_path())
    assert [enc.decode(x) for x in encode(texts)] == texts


def test_small_chunks_change_nothing(monkeypatch):
    texts = ["one two", "", "x" * 300, "it's 3 o'clock"]
    want = encode(texts)
    monkeypatch.setattr(tk, "CHUNK_CHARS", 3)
    assert encode(texts) == want


def test_scan_width_changes_nothing():
    import numpy as np

    sym = np.random.default_rng(0).integers(0, 9, 1000).astype(np.uint8)
    want, at = [], 0
    for s in sym:
        want.append(at)
        at = int(tk._automaton()[0][s, at])
    for w in (1, 7, 64, 2000):
        assert tk._compose_scan(sym, w).tolist() == want


def test_operator(spark):
    rows = [(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (4, " \n ", "w"), (5, "é" * 100_000, "v"), (None, "no key", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in tk.encode(df, "doc_id", "text", offsets=True).collect()}
    assert got[1].ids == [15496, 995] and got[1].starts == [0, 5]
    assert got[2].ids == got[3].ids == [] and len(got[5].ids) == len(got[5].starts) > 0
    assert None in got
    back = {r.doc_id: r.text for r in tk.decode(tk.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    assert tk.encode(df.limit(0), "doc_id", "text").collect() == []
