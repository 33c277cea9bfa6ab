"""The parser as a DataFrame operator: one row in, one record out, errors as data."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..core.session import task_count
from . import beam, parser

RECORD = (
    "sentence_id long, sentence string, success boolean, parse_score double, num_triples int, error string, "
    "triples array<struct<subject:string,relation:string,object:string>>, "
    "contexts array<struct<word:string,pos:string,syntactic_role:string,neighbors:array<string>>>, "
    "nodes array<struct<text:string,pos:string,type:string>>, edges array<struct<type:string,parent:int,child:int>>, consumed array<int>"
)


def record(sentence_id: int | None, sentence: str | None, lang: str, config: parser.Config) -> dict:
    out = dict.fromkeys(("parse_score", "error", "triples", "contexts", "nodes", "edges", "consumed"))
    out |= {"sentence_id": sentence_id, "sentence": sentence, "success": False, "num_triples": 0}
    try:
        best = parser.parse_best(sentence or "", lang, config)
    except (ValueError, RecursionError) as e:
        out["error"] = str(e)[:200]
        return out
    ts = parser.triples(best)
    out |= {
        "success": best.score > 0,
        "parse_score": best.score,
        "num_triples": len(ts),
        "triples": [dict(zip(("subject", "relation", "object"), t)) for t in ts],
        "contexts": [dict(zip(("word", "pos", "syntactic_role", "neighbors"), c)) for c in parser.contexts(best)],
        "nodes": [{"text": t, "pos": p, "type": k} for t, p, k in zip(best.texts, best.tags, best.types)],
        "edges": [{"type": t, "parent": p, "child": c} for t, p, c in best.edges],
        "consumed": [i for i in range(len(best.types)) if best.consumed >> i & 1],
    }
    return out


def parse_sentences(
    df: DataFrame, key: str = "sentence_id", sentence: str = "sentence", lang: str | None = None, config: parser.Config = parser.Config(), spread: bool = True
) -> DataFrame:
    """Parse records of all rows; null, empty and overlong sentences give ``success`` false and an error.

    The parse is heavy, so rows are spread over tasks first (``spread``; streams leave it out).
    ``lang`` names a column with the language; without it English is taken.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(sentence).alias("s"), (F.col(lang) if lang else F.lit("en")).alias("l"))
    if spread:
        rows = rows.repartition(2 * task_count(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [record(k, s, x or "en", config) for k, s, x in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(RECORD))
    return rows.mapInArrow(run, RECORD)


#: Distinct shapes that a task holds before it hands on their counts.
SHAPES = 100_000


def _mapped(each: Callable[[Iterator[tuple]], Iterator[tuple]], df: DataFrame, out: str) -> DataFrame:
    """Rows of ``each`` over all rows of a partition."""
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = each(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        while part := list(islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def measure_texts(df: DataFrame, text: str, lang: str, config: parser.Config = parser.Config()) -> DataFrame:
    """``success``, ``parse_score``, ``num_triples`` and ``error`` of ``parse_sentences``, without the trees, for ``sentences`` of the texts each.

    Sentences of one shape (all that a parse sees) are counted, then each shape is parsed once, by one task.
    """

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        for t, x in rows:
            x = "es" if x == "es" else "en"
            for s in parser.sentences_of(t or ""):
                try:
                    seen[x, beam.shape(s, x, config), None] += 1
                except ValueError as e:
                    seen[x, None, str(e)[:200]] += 1
            if len(seen) >= SHAPES:
                yield from ((*k, n) for k, n in seen.items())
                seen.clear()
        yield from ((*k, n) for k, n in seen.items())

    def one(rows: Iterator[tuple]) -> Iterator[tuple]:
        for x, shape, error, n in rows:
            if error is not None:
                yield False, None, 0, error, n
                continue
            try:
                score, triples = beam.measure(shape, x, config)
                yield score > 0, score, triples, None, n
            except (ValueError, RecursionError) as e:
                yield False, None, 0, str(e)[:200], n

    shapes = _mapped(count, df.select(text, lang), "lang string, shape string, error string, n long")
    shapes = shapes.repartition(4 * task_count(df.sparkSession), "lang", "shape", "error")  # by number: a small table may be a long parse
    shapes = shapes.groupBy("lang", "shape", "error").agg(F.sum("n").alias("n"))
    return _mapped(one, shapes, "success boolean, parse_score double, num_triples int, error string, sentences long")


def triples_of(parsed: DataFrame) -> DataFrame:
    """(sentence_id, subject, relation, object, confidence) of the successful parses."""
    t = parsed.where("success").select("sentence_id", F.col("parse_score").alias("confidence"), F.explode("triples").alias("t"))
    return t.select("sentence_id", "t.subject", "t.relation", "t.object", "confidence")


def contexts_of(parsed: DataFrame) -> DataFrame:
    c = parsed.where("success").select("sentence_id", F.explode("contexts").alias("c"))
    return c.select("sentence_id", "c.word", F.col("c.pos").alias("pos_tag"), "c.syntactic_role", "c.neighbors")
