"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts of an Arrow batch are laid out as one array of code points. Each code point gets a
class, and a finite automaton over the classes is run by composing transition functions, an
associative operation: blocks are composed side by side, then the blocks' results in order.
That gives all word boundaries of the batch without a regular expression. The slices between
them are merged pair by pair, once for each distinct slice, and kept in a cache.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

DEFAULT_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Slices whose ids a worker keeps; beyond it the cache starts anew.
CACHE_SLICES = 1_000_000
#: Texts laid out at once hold at most this many characters, unless one text is longer.
CHUNK_CHARS = 1 << 20

# classes of code points as the automaton sees them
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, APOS_1, APOS_2, END = range(9)
# states: a slice may not go on; a blank that may lead a slice; in letters, numbers, others, white space; 1 or 2 letters of a contraction left
FRESH, LEAD, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, LEFT_1, LEFT_2 = range(8)
#: Letters after an apostrophe that make a contraction: with one letter, and with two.
CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a slice starts here' for (class, state)."""
    state = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for s in range(8):
        for cls, own in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            state[cls, s] = own
            starts[cls, s] = s not in (LEAD, own)
        state[SPACE_LAST, s] = LEAD
        state[WHITE_LAST, s] = FRESH
        state[WHITE, s] = IN_WHITE
        starts[WHITE, s] = s != IN_WHITE
        joined = s in (LEAD, IN_OTHER)  # then the apostrophe goes on with a slice
        state[APOS_1, s] = IN_OTHER if joined else LEFT_1
        state[APOS_2, s] = IN_OTHER if joined else LEFT_2
        starts[APOS_1, s] = starts[APOS_2, s] = not joined
        state[END, s] = FRESH
    state[LETTER, LEFT_2], state[LETTER, LEFT_1] = LEFT_1, FRESH
    starts[LETTER, LEFT_2] = starts[LETTER, LEFT_1] = False
    return state, starts


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point; white space is WHITE here."""
    out = np.full(0x110000 + 1, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = NUMBER
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = WHITE
    out[0x110000] = END
    return out


def _compose_scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each symbol, from FRESH, by composing transition functions.

    A symbol is the function state → next state. Rows of ``width`` symbols are composed for all
    start states at once, the rows' functions are then applied in order, and each row is run
    again from its now known start.
    """
    table, _ = _automaton()
    n = len(symbols)
    rows = -(-n // width)
    padded = np.full(rows * width, END, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for column in grid:
        whole = table[column[:, None], whole]
    begin = np.empty(rows, np.uint8)
    at = FRESH
    for i, f in enumerate(whole.tolist()):
        begin[i] = at
        at = f[at]
    before = np.empty((width, rows), np.uint8)
    now = begin
    for i, column in enumerate(grid):
        before[i] = now
        now = table[column, now]
    return before.T.reshape(-1)[:n]


def slice_starts(cps: np.ndarray) -> np.ndarray:
    """Where slices begin in an array of code points; 0x110000 separates texts and is a slice of its own."""
    base = _classes()[cps]
    nxt = np.concatenate((base[1:], np.array([END], np.uint8)))
    sym = base.copy()
    last_white = (base == WHITE) & (nxt != WHITE) & (nxt != END)
    sym[last_white] = WHITE_LAST
    sym[last_white & (cps == 32)] = SPACE_LAST
    quote = np.flatnonzero(cps == 39)
    if len(quote):
        after = np.concatenate((cps, np.full(2, 0x110000, cps.dtype)))
        a, b = after[quote + 1], after[quote + 2]
        one = np.isin(a, [ord(x) for x in CONTRACTIONS[0]])
        two = np.zeros(len(quote), bool)
        for x, y in CONTRACTIONS[1]:
            two |= (a == ord(x)) & (b == ord(y))
        sym[quote[one]] = APOS_1
        sym[quote[two]] = APOS_2
    return _automaton()[1][sym, _compose_scan(sym)]


class Encoder:
    """Byte-level BPE by the ranks of a vocabulary file (one base64 token and its rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {i: t for t, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of lowest rank is merged until none has a rank."""
        got = self.cache.get(piece)
        if got is None:
            if piece in self.ranks:
                got = (self.ranks[piece],)
            else:
                got = self._merge_pairs(piece) if len(piece) <= 256 else self._merge_long(piece)
            if len(self.cache) >= CACHE_SLICES:
                self.cache.clear()
            if len(piece) <= 256:
                self.cache[piece] = got
        return got

    def _merge_pairs(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks)
        pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap and a linked list, for slices of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for a in (prev[i], i):
                if a >= 0 and nxt[a] < n and (r := ranks.get(parts[a] + parts[nxt[a]])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[nxt[a]])))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of ids of each text."""
        ids: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= CHUNK_CHARS):
                chars += len(texts[j])
                j += 1
            self._encode_some(texts[i:j], ids, sizes[i:j])
            i = j
        return np.array(ids, np.int32), sizes

    def _encode_some(self, texts: list[str], ids: list[int], sizes: np.ndarray) -> None:
        raw = [t.encode("utf-32-le") for t in texts]
        lengths = np.array([len(r) // 4 for r in raw], np.int64)
        total = int(lengths.sum()) + len(texts)
        cps = np.full(total, 0x110000, np.uint32)
        at = np.concatenate(([0], np.cumsum(lengths + 1)))
        for r, a in zip(raw, at):
            cps[a : a + len(r) // 4] = np.frombuffer(r, np.uint32)
        starts = np.flatnonzero(slice_starts(cps))
        width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
        width[cps == 0x110000] = 0
        offsets = np.concatenate(([0], np.cumsum(width)))[np.concatenate((starts, [total]))].tolist()
        data = "".join(texts).encode()
        owner = (np.searchsorted(at, starts, "right") - 1).tolist()
        merge, cached = self.merge, self.cache.get
        counts = [0] * len(texts)
        for k, text in enumerate(owner):
            piece = data[offsets[k] : offsets[k + 1]]
            if not piece:
                continue  # a separator
            got = cached(piece) or merge(piece)
            ids.extend(got)
            counts[text] += len(got)
        sizes[:] = counts

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")

    def widths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id's token."""
        return np.array([len(self.pieces[int(i)]) for i in ids], np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(directory: str | None = None, name: str = BYTE_BPE_50K) -> str:
    return os.path.join(directory or os.environ.get("LEXIWEAVE_TOKENIZERS", DEFAULT_DIR), name)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, offsets: bool = False) -> DataFrame:
    """``key`` and ``ids``, the text's token ids without special tokens; ``[]`` for an empty or a null text.

    With ``offsets`` also ``starts``, the byte at which each token starts in the UTF-8 text, so
    spans of tokens can be cut from the text without decoding. Strings of special tokens are
    ordinary text. Blank and very long texts are encoded whole. One output row for each input
    row; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    key_type = df.schema[key].dataType
    fields = [T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()), False)]
    if offsets:
        fields.append(T.StructField("starts", T.ArrayType(T.IntegerType()), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, sizes = enc.encode_batch(texts)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids))]
            if offsets:
                w = enc.widths(ids)
                before = np.concatenate(([0], np.cumsum(w)))
                first = np.repeat(before[np.asarray(ends)[:-1]], sizes)
                columns.append(pa.ListArray.from_arrays(ends, pa.array((before[:-1] - first).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and ``text`` of the token ids; null ids give null."""
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, F.col(ids).alias("__ids")).mapInArrow(run, schema)
