"""Evaluation texts leaking into training texts.

The normalised word n-grams of the evaluation items form a hash set that is broadcast if its
rows and bytes are within bounds. Workers slide a window over every corpus text, look its hash
up in the set and verify hits word by word. Above the bounds a bit filter of bounded size takes
the set's place: only windows that pass it are joined with the n-grams by a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..core.session import materialise
from ..core.sizing import bounded_join, fits

#: Most evaluation n-grams that are broadcast, and their most bytes.
MAX_BROADCAST_NGRAMS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
#: Most bits of the filter that stands for a larger set (64 MB); two bits are tested for each window.
MAX_FILTER_BITS = 1 << 29
#: Bits of one part of the filter, which one task makes.
FILTER_PART = 1 << 23
#: Words whose hashes a worker remembers.
_REMEMBERED = 500_000
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal_form(text: str) -> str:
    """NFKD, without combining marks U+0300–U+036F, in lower case."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the normal form; none for null."""
    return _WORD.findall(normal_form(text)) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of ``words(text)`` stands in the text as written (code point offsets)."""
    pieces, owner = [], []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):  # a base and its marks normalise together
            j += 1
        piece = normal_form(text[i:j])
        pieces.append(piece)
        owner += [(i, j)] * len(piece)
        i = j
    return [(owner[m.start()][0], owner[m.end() - 1][1]) for m in _WORD.finditer("".join(pieces))]


_known_words: dict[str, int] = {}


def _codes(ws: list[str]) -> list[int]:
    """A 63-bit number for each word, the same in all workers."""
    get, out = _known_words.get, []
    for w in ws:
        c = get(w)
        if c is None:
            if len(_known_words) >= _REMEMBERED:
                _known_words.clear()
            c = _known_words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
        out.append(c)
    return out


def window_hashes(docs: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of every window of ``n`` words that lies within one text."""
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = np.fromiter((x for d in docs for x in _codes(d)), np.uint64, total)
    m = total - n + 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h ^= c[j : j + m]
            h *= _ODD
            h ^= h >> np.uint64(29)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(docs)), sizes)[:m]
    at = np.flatnonzero(np.arange(m) + n <= ends[doc])
    return doc[at], at - (ends - sizes)[doc[at]], h[at]


class BitFilter:
    """A set of hashes as bits: no false negatives, few false positives. ``bits`` is a power of two."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.shift = np.uint64(64 - (len(packed) * 8).bit_length() + 1)

    @staticmethod
    def size(hashes: int) -> int:
        """Bits for so many hashes: at least sixteen for each, up to the bound."""
        return min(MAX_FILTER_BITS, max(FILTER_PART, 1 << (16 * hashes).bit_length()))

    @staticmethod
    def places(h: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return h >> shift, (h * _ODD) >> shift

    @staticmethod
    def of(h: np.ndarray) -> "BitFilter":
        f = BitFilter(np.zeros(BitFilter.size(len(h)) // 8, np.uint8))
        for p in BitFilter.places(h, f.shift):
            np.bitwise_or.at(f.packed, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        return f

    def has(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the set."""
        a, b = BitFilter.places(h, self.shift)
        at = np.flatnonzero((self.packed[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        b = b[at]
        return at[((self.packed[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)]


class NgramSet:
    """Word n-grams of the items: sorted hashes, the n-grams as text, and the items of each, in flat arrays."""

    def __init__(self, items: list[tuple[object, list[str]]], n: int):
        self._fill([(" ".join(ws[i : i + n]), item) for item, ws in items for i in range(len(ws) - n + 1)], n)

    @staticmethod
    def of_grams(rows: list[tuple[str, object]], n: int) -> "NgramSet":
        made = NgramSet([], n)
        made._fill(rows, n)
        return made

    def _fill(self, rows: list[tuple[str, object]], n: int) -> None:
        self.n = n
        grams: dict[str, list] = {}
        for gram, item in rows:
            grams.setdefault(gram, []).append(item)
        texts = sorted(grams)
        hashes = window_hashes([t.split(" ") for t in texts], n)[2]
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        self.text = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        self.items = [i for o in order for i in sorted(set(grams[texts[o]]))]
        self.item_ends = np.cumsum([len(set(grams[texts[o]])) for o in order], dtype=np.int64)
        self.filter = BitFilter.of(self.hashes)

    def find(self, docs: list[list[str]]) -> list[tuple[int, int, tuple]]:
        """(document, word position, items) of each window that is an item's n-gram, verified word by word."""
        if not len(self.hashes):
            return []
        doc, pos, h = window_hashes(docs, self.n)
        at = self.filter.has(h)
        first = np.searchsorted(self.hashes, h[at])
        out = []
        for d, p, x, g in zip(doc[at].tolist(), pos[at].tolist(), h[at], first.tolist()):
            gram = None
            while g < len(self.hashes) and self.hashes[g] == x:
                gram = gram or " ".join(docs[d][p : p + self.n]).encode("utf-8", "surrogatepass")
                if self.text[self.ends[g - 1] if g else 0 : self.ends[g]] == gram:
                    out.append((d, p, tuple(self.items[self.item_ends[g - 1] if g else 0 : self.item_ends[g]])))
                    break
                g += 1
        return out


def _check(n: int) -> None:
    if n < 1:
        raise ValueError("n must be positive")


def leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", n: int = 10, max_broadcast: int = MAX_BROADCAST_NGRAMS, pos: bool = False,
) -> DataFrame:
    """Documents and items with ``n`` consecutive words in common: ``doc_key``, ``item_key``, ``windows``.

    ``windows`` is the number of window positions shared. With ``pos``, one row for each
    document, item and position of a window instead. Items with fewer than ``n`` words are
    never a case; null and empty texts hold no words; repeated rows count once (a document's
    key names one text); texts of any length are scanned whole. Other columns are ignored.
    """
    _check(n)
    dk, ik = docs.schema[doc_key].dataType, items.schema[item_key].dataType
    item_rows = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    doc_rows = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("t")).where("doc IS NOT NULL AND t IS NOT NULL")
    schema = T.StructType([T.StructField("doc", dk), T.StructField("item", ik), T.StructField("pos", T.IntegerType())])
    # written once: items without a window of n words leave nothing here, however many there are
    grams = materialise(_windows(item_rows, "item", ik, n).select("gram", "item").distinct(), "leak-grams")
    if fits(grams, max_broadcast, MAX_BROADCAST_BYTES):
        shared = docs.sparkSession.sparkContext.broadcast(NgramSet.of_grams([(r.gram, r.item) for r in grams.toLocalIterator()], n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                keys = batch.column(0)
                found = [(d, i, p) for d, p, its in known.find([words(t) for t in batch.column(1).to_pylist()]) for i in its]
                if found:
                    d, i, p = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(d)), pa.array(i), pa.array(p, pa.int32())], names=["doc", "item", "pos"]
                    )

        hits = doc_rows.mapInArrow(run, schema)
    else:
        passed = docs.sparkSession.sparkContext.broadcast(_bit_filter(grams, n))
        near = materialise(_windows(doc_rows, "doc", dk, n, passed), "leak-windows")
        hits = bounded_join(near, grams, "gram", bound=max_broadcast, spread=["doc", "pos"]).select("doc", "item", "pos")
    hits = hits.distinct()
    if not pos:
        hits = hits.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("windows"))
    return hits.withColumnsRenamed({"doc": doc_key, "item": item_key})


def _bit_filter(grams: DataFrame, n: int) -> BitFilter:
    """The filter of all n-grams, made in parts; the driver gets its bits, of which there are at most ``MAX_FILTER_BITS``."""
    bits = BitFilter.size(grams.count())
    shift, part_bits = BitFilter(np.zeros(bits // 8, np.uint8)).shift, min(bits, FILTER_PART)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = window_hashes([g.split(" ") for g in b.column(0).to_pylist()], n)[2]
            p = np.concatenate(BitFilter.places(h, shift)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p // part_bits), pa.array(p % part_bits)], names=["part", "place"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, np.zeros(part_bits // 8, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["part", "bits"])

        for b in batches:
            parts, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            for x in np.unique(parts).tolist():
                if x != part:
                    if part >= 0:
                        yield done()
                    part, held = x, np.zeros(part_bits // 8, np.uint8)
                p = place[parts == x]
                np.bitwise_or.at(held, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
        if part >= 0:
            yield done()

    spread = grams.select("gram").mapInArrow(places, "part long, place long").repartition("part").sortWithinPartitions("part")
    packed = np.zeros(bits // 8, np.uint8)
    for r in spread.mapInArrow(fill, "part long, bits binary").collect():  # at most MAX_FILTER_BITS / FILTER_PART rows
        packed[r.part * (part_bits // 8) :][: part_bits // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return BitFilter(packed)


def _windows(rows: DataFrame, key: str, kind: T.DataType, n: int, passed=None) -> DataFrame:
    """Every window of n words as one string, with its position; with ``passed`` (a broadcast filter) only those it lets through."""
    schema = T.StructType([T.StructField(key, kind), T.StructField("gram", T.StringType()), T.StructField("pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                ws = words(t)
                if passed is None:
                    every = np.arange(max(0, len(ws) - n + 1))
                else:
                    _, pos, h = window_hashes([ws], n)
                    every = pos[passed.value.has(h)]
                for a in range(0, len(every), 10_000):
                    at = every[a : a + 10_000].tolist()
                    grams = [" ".join(ws[i : i + n]) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(grams), k.type), pa.array(grams), pa.array(at, pa.int32())], names=[key, "gram", "pos"]
                    )

    return rows.mapInArrow(run, schema)


def remove_leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", mode: str = "spans", n: int = 10, **names
) -> DataFrame:
    """``docs`` without the leaked passages (``spans``) or without the documents that hold any (``documents``).

    In ``spans`` mode the words of all shared windows are cut from the text as it was written,
    and the number of cut characters stands in ``removed_chars`` (0 where nothing was cut).
    Documents with a null key or text stay as they are; a column named ``removed_chars`` is replaced.
    """
    if mode not in ("spans", "documents"):
        raise ValueError("mode is spans or documents")
    hits = leaks(docs, items, doc_key, text, n=n, pos=True, **names)
    if mode == "documents":
        return bounded_join(docs, materialise(hits.select(doc_key).distinct(), "leak-documents"), doc_key, "left_anti")
    cut = hits.groupBy(F.col(doc_key).alias("__doc")).agg(F.array_sort(F.collect_set("pos")).alias("__at"))
    cut = materialise(cut.withColumnRenamed("__doc", doc_key), "leak-cuts")
    joined = bounded_join(docs, cut, doc_key, "left")

    @F.pandas_udf("text string, removed_chars long")
    def without(texts, at):
        import pandas as pd

        out, removed = [], []
        for t, ps in zip(texts, at):
            if t is None or ps is None or not len(ps):
                out.append(t)
                removed.append(0)
                continue
            spans = word_spans(t)
            merged: list[list[int]] = []
            for p in ps:
                a, b = spans[p][0], spans[p + n - 1][1]
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            kept, last = [], 0
            for a, b in merged:
                kept.append(t[last:a])
                last = b
            out.append("".join(kept) + t[last:])
            removed.append(sum(b - a for a, b in merged))
        return pd.DataFrame({"text": out, "removed_chars": removed})

    done = joined.withColumn("__r", without(F.col(text), F.col("__at")))
    return done.withColumn(text, F.col("__r.text")).withColumn("removed_chars", F.col("__r.removed_chars")).drop("__r", "__at")
