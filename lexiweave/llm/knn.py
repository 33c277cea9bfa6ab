"""Most similar vectors for every vector: exactly (``allpairs``), or with a wanted recall by multiprobe p-stable hashing.

Each table hashes a centred unit vector by floor((a·x + b) / w) over several Gaussian directions a.
A vector lies in one bucket of each table and visits, besides its own bucket, those reached by
moving single hash values across their nearest boundaries, in the order of the estimated
chance of success. In each bucket visited, exact cosines rank candidates for the visitor and,
by the same product, for the members; the best of all buckets are merged.

Width, functions, tables and probes are chosen for the data at hand (``tune``): true neighbours of a
bounded sample of vectors, found in one pass over all rows, tell which choices reach the wanted recall,
and a bounded sample of the rows tells what each would cost. A bucket of any size is ranked exactly,
in pairs of blocks; where no choice of hashing is cheaper, one bucket holds all and the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..core.session import materialise, task_count
from ..core.sizing import bounded_join, rows_at_most
from .allpairs import matrix as _matrix, nearest, unit as _unit


#: Similarities that a worker holds at once.
CELLS = 2_000_000
#: Sampled recall that the hashing is chosen for.
RECALL = 0.98
#: Vectors whose true neighbours are sought, and vectors that estimate bucket sizes: the bounds of both samples.
QUERIES = 200
SAMPLE = 8192
#: Choices that are tried: widths as multiples of the sampled neighbours' distance, tables, probes.
WIDTHS = (1.2, 2.0, 3.5, 6.0)
MOST_TABLES = 8
LEAST_PROBES = 2
MOST_PROBES = 12
MOST_FUNCTIONS = 32
#: What a shipped row and a bucket cost, in compared pairs.
ROW_COST = 400
BUCKET_COST = 20_000
_FAR = 1e9


@dataclass(frozen=True)
class Hashing:
    """``tables`` hash tables of ``functions`` p-stable functions of ``width``, each probed ``probes`` + 1 times.

    ``centre`` is taken off the unit vectors before they are hashed (distances stay the same).
    """

    dims: int
    functions: int
    tables: int = 5
    probes: int = 8
    width: float = 2.0
    seed: int = 7
    #: Members of one bucket that one task ranks; larger buckets are cut into blocks of about this size.
    block: int = 20_000
    centre: tuple[float, ...] | None = None

    @staticmethod
    def whole(dims: int, **more) -> "Hashing":
        """One bucket for all vectors: every pair is compared, block by block."""
        return Hashing(dims, 1, 1, 0, _FAR, **more)


@dataclass(frozen=True)
class Tuning:
    """The hashing chosen and, on the samples, its ``recall`` and the ``share`` of all rows that a vector is compared with."""

    hashing: Hashing
    recall: float
    share: float


@lru_cache(64)
def _directions(dims: int, table: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and multipliers of one table; fewer functions take the first ones."""
    rng = np.random.default_rng((seed, table))
    a = rng.standard_normal((MOST_FUNCTIONS, dims)).T
    return a, rng.random(MOST_FUNCTIONS), rng.integers(1, 2**62, MOST_FUNCTIONS, dtype=np.int64) | 1


@lru_cache(256)
def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundary moves in order of expected score.

    Moves are numbered by the distance to their boundary, the nearest first; a move and its
    opposite (numbers adding up to 2 × functions − 1) exclude each other.
    """
    k = functions
    z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    out, heap = [], [(z[0], (0,))]
    while heap and len(out) < probes:
        score, moves = heapq.heappop(heap)
        if not any(2 * k - 1 - m in moves for m in moves):
            out.append(moves)
        m = moves[-1]
        if m + 1 < 2 * k:
            heapq.heappush(heap, (score - z[m] + z[m + 1], (*moves[:-1], m + 1)))
            heapq.heappush(heap, (score + z[m + 1], (*moves, m + 1)))
    return out


def _mix(values: np.ndarray, mult: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit bucket number for each row of hash values."""
    with np.errstate(over="ignore"):
        return (values.astype(np.int64) * mult).sum(-1) * np.int64(31) + np.int64(table)


def _visits(p: np.ndarray, mult: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Bucket numbers (rows, probes + 1) of hash values before rounding; the first is a row's own bucket.

    With few functions there are fewer sets of moves than ``probes``; the last column repeats then.
    """
    n, k = p.shape
    low = np.floor(p)
    out = [_mix(low, mult, table)]
    if probes:
        gap = np.concatenate([p - low, 1 - (p - low)], 1)
        order = np.argsort(gap, 1, kind="stable")
        with np.errstate(over="ignore"):
            for moves in perturbations(k, probes):
                bucket = out[0].copy()
                for m in moves:
                    c = order[:, m]
                    bucket += np.where(c < k, -1, 1) * mult[c % k] * np.int64(31)
                out.append(bucket)
        out += [out[-1]] * (probes + 1 - len(out))
    return np.stack(out, 1)


def _projected(x: np.ndarray, h: Hashing, table: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, mult = _directions(h.dims, table, h.seed)
    centred = x - np.asarray(h.centre) if h.centre else x
    return centred @ a[:, : h.functions] / h.width + b[: h.functions], mult[: h.functions]


def buckets(x: np.ndarray, h: Hashing, probe: bool) -> np.ndarray:
    """Bucket numbers of unit vectors: (rows, tables), or with ``probe`` (rows, tables, probes + 1)."""
    out = []
    for t in range(h.tables):
        p, mult = _projected(x, h, t)
        v = _visits(p, mult, t, h.probes if probe else 0)
        out.append(v if probe else v[:, 0])
    return np.stack(out, 1)


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id`` and ``v``: vectors of ``dims`` finite numbers that are not all zero; the others take no part."""
    v = F.col(vector)
    good = (
        F.col(key).isNotNull()
        & v.isNotNull()
        & (F.size(v) == dims)
        & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists(v, lambda e: e != 0)
    )
    return df.select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v")).where(good)


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: ``id`` (its smallest), ``heads`` (its k + 1 smallest ids), ``bytes``.

    Exact copies share all similarities, and of equal ones the smallest ids win, so k + 1 ids
    stand for a group of copies of any size. The dense rank is cut within partitions before
    the shuffle, so a group that holds a third of all rows arrives as a few rows of each.
    """
    from pyspark.sql import Window

    keyed = vectors.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(11), "v")})
    ranked = keyed.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    found = ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("heads"), F.first("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            rows = flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 0)
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed], names=["heads", "bytes"])

    packed = found.select("heads", "v").mapInArrow(pack, "heads array<long>, bytes binary")
    return packed.select(F.element_at("heads", 1).alias("id"), "heads", "bytes")


def _best_of(sim: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row as (row id, column id, rounded similarity); ties to the smaller id, nobody beside itself.

    All that may be among the best are kept (an own id and what rounding makes equal included), and only those are rounded.
    """
    if sim.shape[1] > k + 1:
        edge = -np.partition(-sim, k, axis=1)[:, k : k + 1]
        r, c = np.nonzero(sim >= edge - 2e-9)
    else:
        r, c = np.nonzero(np.ones(sim.shape, bool))
    other = rows[r] != cols[c]
    r, c = r[other], c[other]
    v = np.round(sim[r, c], 9)
    o = np.lexsort((cols[c], -v, r))
    r, c, v = r[o], c[o], v[o]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r] < k
    return rows[r[keep]], cols[c[keep]], v[keep]


def true_neighbours(groups: DataFrame, sample: list[tuple[int, bytes]], dims: int, k: int) -> dict[int, list[tuple[int, bytes]]]:
    """The k most similar distinct vectors of each sampled one, by one pass over all rows; ids and bytes."""
    from pyspark.sql import Window

    qi = np.array([i for i, _ in sample], np.int64)
    qx = _unit(np.frombuffer(b"".join(v for _, v in sample), np.float32).reshape(-1, dims).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, float, bytes]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                b = whole.slice(at, 10_000)
                ids = b.column(0).to_numpy()
                q, c, s = _best_of(qx @ _unit(_matrix(b.column(1), dims)).T, qi, ids, k)
                place = {int(i): n for n, i in enumerate(ids)}
                held += [(int(x), int(y), float(z), b.column(1)[place[int(y)]].as_py()) for x, y, z in zip(q, c, s)]
            if len(held) > 20 * k * len(qi):
                held = _trim(held, k)
        held = _trim(held, k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["q", "id", "s", "bytes"])

    near = groups.select("id", "bytes").mapInArrow(run, "q long, id long, s double, bytes binary")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    out: dict[int, list[tuple[int, bytes]]] = {int(i): [] for i in qi}
    for r in near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect():  # k rows for each sampled vector
        out[r.q].append((r.id, bytes(r.bytes)))
    return out


def _trim(held: list[tuple[int, int, float, bytes]], k: int) -> list[tuple[int, int, float, bytes]]:
    held.sort(key=lambda x: (x[0], -x[2], x[1]))
    out, last, n = [], None, 0
    for row in held:
        n = n + 1 if row[0] == last else 1
        last = row[0]
        if n <= k:
            out.append(row)
    return out


def tune(groups: DataFrame, dims: int, k: int, recall: float = RECALL, block: int = 20_000, seed: int = 7) -> Tuning:
    """Choose width, functions, tables and probes for ``groups`` (``id``, ``bytes``).

    Of all choices whose recall on the true neighbours of ``QUERIES`` sampled vectors reaches ``recall``, the
    cheapest by the bucket sizes of ``SAMPLE`` sampled vectors; if none compares fewer pairs than all, one
    bucket for all. A collision depends on the distance of two vectors only, so neighbours sought among
    all rows make the sampled recall an estimate for all rows, whatever their number.
    """
    n = groups.count()
    rows = groups.select("id", "bytes").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).collect()  # at most SAMPLE rows
    if n < 3:
        return Tuning(Hashing.whole(dims, block=block), 1.0, 1.0)
    base = _unit(np.frombuffer(b"".join(bytes(r.bytes) for r in rows), np.float32).reshape(-1, dims).astype(np.float64))
    centre = base.mean(0)
    sample = [(r.id, bytes(r.bytes)) for r in rows[:QUERIES]]
    near = true_neighbours(groups, sample, dims, k)
    at = np.array([i for i, (q, _) in enumerate(sample) for _ in near[q]])
    other = _unit(np.frombuffer(b"".join(v for q, _ in sample for _, v in near[q]), np.float32).reshape(-1, dims).astype(np.float64))
    distance = float(np.quantile(np.linalg.norm(base[at] - other, axis=1), 0.9)) or 1e-6
    best = (float(n) * n / 2, Tuning(Hashing.whole(dims, block=block), 1.0, 0.5))
    most = max(2, min(MOST_FUNCTIONS, round(1.3 * log2(max(n, 4)))))
    for factor in WIDTHS:
        for functions in range(2, most + 1, 2):
            h = Hashing(dims, functions, MOST_TABLES, MOST_PROBES, distance * factor, seed, block, tuple(centre))
            found = np.zeros((MOST_PROBES + 1, len(at)), bool)
            shares = np.zeros(MOST_PROBES + 1)
            own_share = 0.0
            for t in range(MOST_TABLES):
                pb, mult = _projected(base, h, t)
                own = np.sort(_visits(pb, mult, t, 0)[:, 0])
                vq = _visits(pb[: len(sample)], mult, t, MOST_PROBES)
                vo = _visits(_projected(other, h, t)[0], mult, t, MOST_PROBES)
                held = (np.searchsorted(own, vq, "right") - np.searchsorted(own, vq, "left")).mean(0) / len(own)
                own_share += max(0.0, held[0] - 1 / len(own)) / 2
                shares += np.concatenate(([0.0], np.cumsum(held[1:])))
                hit = (vq[at] == vo[:, :1]) | (vo == vq[at][:, :1])
                found |= np.logical_or.accumulate(hit, 1).T
                reached = found.mean(1)
                for probes in range(LEAST_PROBES, MOST_PROBES + 1):
                    if reached[probes] < recall:
                        continue
                    share = own_share + shares[probes]
                    if share >= 0.5:
                        continue
                    size = max(1.0, n * held[0])
                    cost = n * (n * share + ROW_COST * (t + 1) * (1 + probes) + BUCKET_COST * (t + 1) / size)
                    if best[1].hashing.width == _FAR or cost < best[0]:
                        best = (cost, Tuning(replace(h, tables=t + 1, probes=probes), float(reached[probes]), float(share)))
                    break  # more probes cost more
    return best[1]


def _emit(h: Hashing):
    """Rows (bucket, probe, id, bytes): one in each own bucket, and a probe row in each other bucket visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                ids, raw = b.column(0), b.column(1)
                visits = buckets(_unit(_matrix(raw, h.dims)), h, True)
                each = visits.shape[1] * visits.shape[2]
                rows = pa.array(np.repeat(np.arange(len(ids)), each))
                probe = np.broadcast_to(np.arange(visits.shape[2]) > 0, visits.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(visits.reshape(-1)), pa.array(probe.reshape(-1)), ids.take(rows), raw.take(rows)], names=["bucket", "probe", "id", "bytes"]
                )

    return run


def _rank(dims: int, k: int):
    """Sorted (bucket, block, probe) rows to candidates: members come first and are held, probes stream past them.

    Each product of vectors gives the best members of every probe and the best probes of every member.
    """

    def compare(qi: np.ndarray, qx: np.ndarray, mi: np.ndarray, mx: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
        sim = qx @ mx.T
        yield _best_of(sim, qi, mi, k)
        if both:
            yield _best_of(sim.T, mi, qi, k)

    def bucket(segments: Iterator[tuple[bool, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        ids, xs, ready = [], [], False
        mi = mx = None
        for probe, i, x in segments:
            if not probe:
                ids.append(i)
                xs.append(x)
                continue
            if not ids:
                continue  # nobody lies in this bucket
            if not ready:
                mi, mx, ready = np.concatenate(ids), np.concatenate(xs), True
                yield from inside(mi, mx)
            some = max(8, CELLS // len(mi))
            for t in range(0, len(i), some):
                yield from compare(i[t : t + some], x[t : t + some], mi, mx, True)
        if ids and not ready:
            yield from inside(np.concatenate(ids), np.concatenate(xs))

    def inside(mi: np.ndarray, mx: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        some = max(8, CELLS // len(mi))
        if len(mi) > 1:
            for t in range(0, len(mi), some):
                yield from compare(mi[t : t + some], mx[t : t + some], mi, mx, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def segments() -> Iterator[tuple[tuple[int, int], bool, np.ndarray, np.ndarray]]:
            for b in batches:
                if not b.num_rows:
                    continue
                place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)], 1)
                ids, x = b.column(3).to_numpy(), _unit(_matrix(b.column(4), dims))
                cuts = np.concatenate(([0], np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1, [len(place)]))
                for s, e in zip(cuts[:-1], cuts[1:]):
                    yield (int(place[s, 0]), int(place[s, 1])), bool(place[s, 2]), ids[s:e], x[s:e]

        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["a", "b", "similarity"])

        for _, own in groupby(segments(), key=lambda s: s[0]):
            for found in bucket((s[1:] for s in own)):
                held.append(found)
                size += len(found[0])
                if size > 50_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _best(k: int):
    """Merge of candidates: (a, its candidates' ids and similarities) to the k best of each a."""
    from pyspark.sql import Window

    def merge(candidates: DataFrame) -> DataFrame:
        # the same candidate comes from several buckets: a dense rank gives its copies one place
        w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
        return candidates.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k).dropDuplicates(["a", "rank"])

    return merge


def _placed(groups: DataFrame, h: Hashing) -> DataFrame:
    """Rows of ``_emit`` with their ``block``. In a bucket above the block size a member lies in one block by its id and
    visits the later ones, a visitor visits all: every pair of the bucket meets, once for members."""
    rows = groups.select("id", "bytes").repartition(task_count(groups.sparkSession)).mapInArrow(_emit(h), "bucket long, probe boolean, id long, bytes binary")
    sizes = groups.select("id", "bytes").mapInArrow(_members(h), "bucket long").groupBy("bucket").count()
    large = materialise(sizes.where(F.col("count") > h.block).select("bucket", F.ceil(F.col("count") / h.block).cast("int").alias("blocks")), "knn-large")
    if rows_at_most(large, 0):
        return rows.withColumn("block", F.lit(0))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    first = F.when(F.col("blocks").isNull() | F.col("probe"), F.lit(0)).otherwise(own)
    last = F.coalesce(F.col("blocks") - 1, F.lit(0))
    cut = bounded_join(rows, large, "bucket", "left", spread=["id"]).withColumn("own", own).withColumn("block", F.explode(F.sequence(first, last)))
    return cut.withColumn("probe", F.col("probe") | F.coalesce(F.col("block") != F.col("own"), F.lit(False)))


def similar_vectors(
    df: DataFrame, key: str, vector: str, dims: int, k: int = 5, hashing: Hashing | None = None, recall: float | None = None
) -> DataFrame:
    """For every usable vector its k most similar others: ``id``, ``neighbour``, ``similarity``, ``rank``.

    Similarity is the cosine in double precision, rounded to 9 decimals; of equal ones the
    smaller id comes first. ``key`` is a whole number. Vectors that are null, of another length, all zero or hold a null,
    a NaN or an infinite number take no part; repeated rows count once; exact copies are
    neighbours of one another. With fewer than k + 1 vectors all others are given.
    The result is exact, unless ``hashing`` or a ``recall`` is given: then candidates are approximate (a neighbour
    in no bucket visited is missed), and hashing that is not given is chosen by ``tune`` for a sampled recall of ``recall``.
    """
    vectors = usable_vectors(df, key, vector, dims)
    groups = materialise(classes(vectors, k), "knn-classes")
    if hashing is None and recall is None:
        return _expand(materialise(nearest(groups, dims, k), "knn-near"), groups, vectors, k)
    h = hashing or tune(groups, dims, k, recall).hashing
    placed = _placed(groups, h).select("bucket", "block", "probe", "id", "bytes").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "probe")
    found = placed.mapInArrow(_rank(dims, k), "a long, b long, similarity double")
    # k rows for each vector: written once, since the copies' joins read and count them again
    near = materialise(_best(k)(found).select("a", "b", "similarity"), "knn-near")
    return _expand(near, groups, vectors, k)


def measured(df: DataFrame, key: str, vector: str, dims: int, k: int = 5, recall: float = RECALL) -> DataFrame:
    """One row, or none without a usable vector: the hashing that ``similar_vectors`` would choose for ``recall``, its recall on the sampled vectors' true
    neighbours and the share of all distinct vectors that one is compared with."""
    groups = materialise(classes(usable_vectors(df, key, vector, dims), k), "knn-classes")
    n, t = groups.count(), tune(groups, dims, k, recall)
    h = t.hashing
    row = (n, h.functions, h.tables, h.probes, h.width, t.recall, t.share)
    return df.sparkSession.createDataFrame([row] if n else [], "vectors long, functions int, tables int, probes int, width double, recall double, compared_share double")


def _members(h: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = buckets(_unit(_matrix(b.column(1), h.dims)), h, False).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(own)], names=["bucket"])

    return run


def _expand(near: DataFrame, groups: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Neighbours of distinct vectors to neighbours of all ids.

    Single vectors keep their rows. Copies get the k smallest other ids of their own group at
    similarity 1 and the ids of the neighbouring groups, and are ranked again.
    """
    from pyspark.sql import Window

    copies = materialise(groups.where(F.size("heads") > 1).select(F.col("id").alias("cls"), "heads"), "knn-copies")
    if rows_at_most(copies, 0):
        w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
        return near.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "similarity", F.row_number().over(w).alias("rank"))
    wide = bounded_join(near, copies.select(F.col("cls").alias("b"), "heads"), "b", "left")
    named = wide.select("a", F.explode(F.coalesce("heads", F.array("b"))).alias("b"), "similarity")
    own = copies.select(F.col("cls").alias("a"), F.explode("heads").alias("b"), F.lit(1.0).alias("similarity"))
    lists = named.unionByName(own)
    ranked = lists.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("r") <= k + 1)
    member = copies.select("cls", F.explode("heads").alias("id"))
    full = copies.where(F.size("heads") > k).select("cls", F.element_at("heads", 1).alias("id"))
    if not rows_at_most(full, 0):  # groups with more copies than heads
        hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(11), "v").alias("h2")]
        keys = bounded_join(vectors, full, "id", "inner").select("cls", *hashes).distinct()
        everyone = bounded_join(vectors.select("id", *hashes), keys, ["h1", "h2"]).select("cls", "id")
        member = member.unionByName(everyone).distinct()
    cls = copies.select(F.col("cls").alias("a"))
    single = bounded_join(ranked, cls, "a", "left_anti").select(F.col("a").alias("id"), "b", "similarity")
    shared = bounded_join(ranked, cls, "a", "left_semi")
    # a group of any size is on the streamed side, where a hot key can be split
    each = single.unionByName(bounded_join(member.withColumnRenamed("cls", "a"), shared, "a").select("id", "b", "similarity"))
    named = each.select("id", F.col("b").alias("neighbour"), "similarity").where("id <> neighbour")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
