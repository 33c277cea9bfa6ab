"""Queries over texts: splitting, tagging, cleaning, filters and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core.sizing import spread
from ..functions import text as fx
from ..operators.graph import mean
from . import Registry, table

registry = Registry()


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, lang, sentence) of all documents."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    d = d.select("doc_id", fx.plain_lang(F.col("lang")).alias("lang"), "text")
    return d.select("doc_id", "lang", F.posexplode(fx.sentences(F.col("text"))).alias("pos", "sentence"))


SENTENCES = f"""
SELECT doc_id, {fx.plain_lang_sql('lang')} AS lang, unnest(range(len(l)))::INT AS pos, unnest(l) AS sentence
FROM (SELECT doc_id, lang, {fx.sentences_sql('text')} AS l FROM documents WHERE text IS NOT NULL)"""
TOKENS = f"SELECT doc_id, lang, pos, unnest({fx.tokens_sql('sentence')}) AS token FROM ({SENTENCES})"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(spark, sf_dir).select("doc_id", "lang", "pos", F.explode(fx.tokens(F.col("sentence"))).alias("token"))


@registry.query("sent_split", SENTENCES)
def sent_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(spark, sf_dir)


@registry.query(
    "corpus_stats",
    f"""SELECT lang, count(*) AS sentences, avg(n) AS avg_words, min(n) AS min_words, max(n) AS max_words
FROM (SELECT lang, len({fx.tokens_sql('sentence')}) AS n FROM ({SENTENCES})) GROUP BY lang""",
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sentence_rows(spark, sf_dir).select("lang", F.size(fx.tokens(F.col("sentence"))).alias("n"))
    return n.groupBy("lang").agg(
        F.count(F.lit(1)).alias("sentences"), F.avg("n").alias("avg_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words")
    )


@registry.query(
    "token_tags",
    f"SELECT lang, CASE WHEN lang = 'es' THEN {fx.tag_sql('token', 'es')} ELSE {fx.tag_sql('token')} END AS tag, count(*) AS n FROM ({TOKENS}) GROUP BY 1, 2",
)
def token_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_rows(spark, sf_dir)
    by_lang = F.when(F.col("lang") == "es", fx.tag(F.col("token"), "es")).otherwise(fx.tag(F.col("token")))
    return t.groupBy("lang", by_lang.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    "token_tags_es",
    f"""SELECT token, {fx.tag_sql('token', 'es')} AS tag, count(*) AS n,
       regexp_matches(lower(token), '(ando|iendo|ado|ido)$') AND {fx.tag_sql('token', 'es')} = 'VERB' AS participle
FROM ({TOKENS}) WHERE lang = 'es' GROUP BY ALL""",
)
def token_tags_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_rows(spark, sf_dir).where("lang = 'es'").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tag = fx.tag(F.col("token"), "es")
    return t.select("token", tag.alias("tag"), "n", (F.lower("token").rlike("(ando|iendo|ado|ido)$") & (tag == "VERB")).alias("participle"))


@registry.query(
    "tag_ambiguity",
    f"SELECT len({fx.possible_tags_sql('token')}) AS candidates, count(*) AS n, count(DISTINCT lower(token)) AS words FROM ({TOKENS}) WHERE lang = 'en' GROUP BY 1",
)
def tag_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_rows(spark, sf_dir).where("lang = 'en'")
    counts = t.groupBy(F.lower("token").alias("w"), F.size(fx.possible_tags(F.col("token"))).cast("long").alias("candidates"))
    return counts.agg(F.count(F.lit(1)).alias("c")).groupBy("candidates").agg(F.sum("c").alias("n"), F.countDistinct("w").alias("words"))


@registry.query("markup_clean", f"SELECT doc_id, {fx.clean_markup_sql('text')} AS clean FROM documents WHERE length({fx.clean_markup_sql('text')}) > 100")
def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # a generated column, so that the filter does not run the rules a second time
    d = d.select("doc_id", F.explode(F.array(fx.clean_markup(F.col("text")))).alias("clean"))
    return d.where(F.length("clean") > 100)


@registry.query(
    "sentence_quality",
    f"SELECT lang, count(*) AS sentences, count(*) FILTER ({fx.is_quality_sentence_sql('sentence')}) AS good FROM ({SENTENCES}) GROUP BY lang",
)
def sentence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_rows(spark, sf_dir)
    return s.groupBy("lang").agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(fx.is_quality_sentence(F.col("sentence"))).alias("good")
    )


@registry.query(
    "quality_filter",
    f"SELECT doc_id, pos, sentence FROM ({SENTENCES}) WHERE {fx.is_quality_sentence_sql('sentence')}",
)
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(spark, sf_dir).where(fx.is_quality_sentence(F.col("sentence"))).select("doc_id", "pos", "sentence")


@registry.query(
    "dedup_first",
    f"SELECT arg_min(sentence, (doc_id, pos)) AS sentence, min(doc_id) AS doc_id FROM ({SENTENCES}) GROUP BY lower({fx.strip_sql('sentence')})",
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence of each case-folded sentence; an aggregate instead of a window, so copies combine map-side."""
    s = sentence_rows(spark, sf_dir)
    first = s.groupBy(F.lower(fx.strip(F.col("sentence"))).alias("k")).agg(F.min(F.struct("doc_id", "pos", "sentence")).alias("m"))
    return first.select("m.sentence", "m.doc_id")


_TOPIC = f"lower(array_to_string({fx.tokens_sql('sentence')}[1:3], ' '))"


@registry.query(
    "stratified_sample",
    f"""WITH s AS (SELECT doc_id, pos, sentence, {_TOPIC} AS topic FROM ({SENTENCES}) WHERE len({fx.tokens_sql('sentence')}) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(sentence), doc_id, pos) AS k FROM s)
SELECT doc_id, pos, topic FROM r WHERE k <= 2""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two sentences of each topic (first three words), chosen by hash."""
    s = sentence_rows(spark, sf_dir).withColumn("w", fx.tokens(F.col("sentence"))).where(F.size("w") >= 3)
    s = s.withColumn("topic", F.lower(F.array_join(F.slice("w", 1, 3), " ")))
    w = Window.partitionBy("topic").orderBy(F.md5("sentence"), "doc_id", "pos")
    return s.withColumn("k", F.row_number().over(w)).where("k <= 2").select("doc_id", "pos", "topic")


@registry.query(
    "hash_sample",
    f"SELECT doc_id, pos, md5(sentence || '#7') AS h FROM ({SENTENCES}) ORDER BY h, doc_id, pos LIMIT 500",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded uniform sample of 500 sentences: the smallest hashes, found without a full sort."""
    s = sentence_rows(spark, sf_dir).select("doc_id", "pos", F.md5(F.concat("sentence", F.lit("#7"))).alias("h"))
    return s.orderBy("h", "doc_id", "pos").limit(500)


@registry.query(
    "exclude_anti",
    f"""SELECT doc_id, pos FROM ({SENTENCES}) s WHERE NOT EXISTS (
  SELECT 1 FROM eval_item e WHERE lower({fx.strip_sql('e.text')}) = lower({fx.strip_sql('s.sentence')}))""",
)
def exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "eval_item").select(F.lower(fx.strip(F.col("text"))).alias("k")).distinct()
    s = sentence_rows(spark, sf_dir).withColumn("k", F.lower(fx.strip(F.col("sentence"))))
    return s.join(seen, "k", "left_anti").select("doc_id", "pos")


@registry.query(
    "split_sets",
    f"SELECT CASE WHEN substr(md5(sentence), 1, 1) IN ('0', '1') THEN 'valid' ELSE 'train' END AS part, count(*) AS n FROM ({SENTENCES}) GROUP BY 1",
)
def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation parts by hash (1 in 8), so that copies of a sentence never part."""
    part = F.when(F.substring(F.md5("sentence"), 1, 1).isin("0", "1"), F.lit("valid")).otherwise(F.lit("train"))
    return sentence_rows(spark, sf_dir).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


# Word lists of the sentence generator.
SUBJECTS, VERBS, OBJECTS = "dog cat man woman child".split(), "sees likes finds chases".split(), "ball house tree book".split()


@registry.query(
    "generated_sentences",
    f"SELECT DISTINCT 'The ' || s || ' ' || v || ' the ' || o || '.' AS sentence FROM unnest({SUBJECTS}) a(s), unnest({VERBS}) b(v), unnest({OBJECTS}) c(o)",
)
def generated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subject–verb–object sentences of the literal word lists (80 rows)."""
    words = [F.explode(F.array(*[F.lit(w) for w in ws])).alias(n) for n, ws in (("s", SUBJECTS), ("v", VERBS), ("o", OBJECTS))]
    base = spark.range(1)
    for w in words:
        base = base.select("*", w)
    return base.select(F.concat(F.lit("The "), "s", F.lit(" "), "v", F.lit(" the "), "o", F.lit(".")).alias("sentence")).distinct()


@registry.query("content_words", f"SELECT w, count(*) AS n FROM (SELECT unnest({fx.content_words_sql('sentence')}) AS w FROM parse_record) GROUP BY w")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "parse_record").select(F.explode(fx.content_words(F.col("sentence"))).alias("w"))
    return r.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


_RECORDS = "SELECT DISTINCT * FROM parse_record"


@registry.query(
    "parse_statistics",
    f"""SELECT batch_id, count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT coalesce(success, false)) AS failed,
  sum(num_triples) AS triples, round(sum(CASE WHEN success THEN parse_score END), 6) / count(CASE WHEN success THEN parse_score END) AS avg_score,
  (list(error ORDER BY sentence_id) FILTER (error IS NOT NULL))[1:10] AS errors
FROM ({_RECORDS}) GROUP BY batch_id""",
)
def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each batch with its first ten errors; partial aggregates merge by themselves."""
    r = table(spark, sf_dir, "parse_record").distinct()
    # the rank is cut within partitions, so ten rows of a batch are gathered at most
    w = Window.partitionBy("batch_id").orderBy("sentence_id", "error")
    ten = r.where("error IS NOT NULL").select("batch_id", "sentence_id", "error", F.row_number().over(w).alias("k")).where("k <= 10")
    first = ten.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "error"))), lambda e: e["error"]).alias("errors"))
    counts = r.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("success"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"),
        F.sum("num_triples").alias("triples"),
        mean(F.when(F.col("success"), F.col("parse_score"))).alias("avg_score"),
    )
    first = first.withColumnRenamed("batch_id", "__batch")
    return counts.join(first, F.col("batch_id").eqNullSafe(F.col("__batch")), "left").drop("__batch")
