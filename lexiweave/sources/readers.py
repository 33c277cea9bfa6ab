"""Sources: text, wiki dumps and exports, lexicons, graphs, vectors and axes, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as fx

WIKI_JSON = "id string, title string, url string, text string"
PARSE_RECORD = (
    "sentence_id long, sentence string, success boolean, parse_score double, num_triples int, error string, "
    "triples array<struct<relation:string,subject:string,object:string>>, "
    "word_contexts array<struct<word:string,pos:string,context:string,syntactic_role:string,neighbors:array<string>>>"
)
GRAPH_EDGES = "source string, relation string, target string, confidence double, source_type string"
GRAPH_NODES = "word string, language string, frequency long, metadata map<string,string>"
TRAINING_EDGES = "source_id long, relation string, target_id long, confidence double"
SYNSETS = (
    "synset_id string, pos string, definition string, lemmas array<string>, examples array<string>, hypernyms array<string>, "
    "hyponyms array<string>, meronyms array<string>, holonyms array<string>, similar array<string>"
)
AXIS = (
    "axis_id int, name string, poles array<array<string>>, pole_names array<string>, member_pairs array<array<string>>, "
    "coherence double, separation double, size int, source string"
)
#: Title prefixes of pages that are no articles.
OTHER_SPACES = ("Wikipedia:", "Template:", "Category:", "File:")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sentence in each line: stripped, blank lines dropped, with the file as source."""
    t = spark.read.text(path).select(fx.strip(F.col("value")).alias("sentence"), F.col("_metadata.file_name").alias("source"))
    return t.where("sentence <> ''")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of whole files (books), with their position."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    return t.select("source", F.posexplode(fx.sentences(F.col("value"))).alias("pos", "sentence"))


def with_ids(df: DataFrame, order: list[str | Column], name: str = "sentence_id") -> DataFrame:
    """Ids that grow with ``order`` without one sorting task: range partitions numbered on their own (not dense)."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def wiki_xml(spark: SparkSession, path: str, min_chars: int = 100) -> DataFrame:
    """Articles of a dump: no redirects, no other name spaces, cleaned text of more than ``min_chars``."""
    schema = "title string, redirect struct<_title:string>, revision struct<text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    keep = F.col("redirect").isNull() & ~F.lower(F.col("revision.text")).startswith("#redirect")
    for p in OTHER_SPACES:
        keep &= ~F.col("title").startswith(p)
    return pages.where(keep).select("title", fx.clean_markup(F.col("revision.text")).alias("text")).where(F.length("text") > min_chars)


def wiki_json(spark: SparkSession, path: str) -> DataFrame:
    """Articles of an extractor's output: files wiki_* below ``path``, one JSON object in each line."""
    return spark.read.schema(WIKI_JSON).option("recursiveFileLookup", True).option("pathGlobFilter", "wiki_*").json(path)


def parse_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSE_RECORD).json(path)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as ``sinks.save_graph`` writes them; frequency and metadata survive."""
    return spark.read.schema(GRAPH_NODES).parquet(f"{path}/nodes"), spark.read.schema(GRAPH_EDGES).parquet(f"{path}/edges")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one JSON document {nodes: [...], edges: [...]}."""
    edge = "source:string,target:string,source_lang:string,target_lang:string,relation:string,confidence:double,source_type:string"
    node = "word:string,language:string,frequency:bigint,metadata:map<string,string>"
    d = spark.read.schema(f"nodes array<struct<{node}>>, edges array<struct<{edge}>>").option("multiLine", True).json(path)
    return d.select(F.explode("nodes").alias("n")).select("n.*"), d.select(F.explode("edges").alias("e")).select("e.*")


def training_edges(spark: SparkSession, path: str) -> DataFrame:
    """Encoded edges; a missing confidence is 1.0."""
    return spark.read.schema(TRAINING_EDGES).parquet(path).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def synsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SYNSETS).json(path)


def synset_edges(synsets: DataFrame) -> DataFrame:
    """(src, kind, dst) of the relation lists of synset records."""
    kinds = {"hypernyms": "hypernym", "hyponyms": "hyponym", "meronyms": "meronym", "holonyms": "holonym", "similar": "similar"}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("dst")) for c, k in kinds.items()])
    e = synsets.select(F.col("synset_id").alias("src"), F.explode(pairs).alias("e")).select("src", "e.kind", F.explode("e.dst").alias("dst"))
    return e.distinct()


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(dim, side, word) of {dimension: {side: [words]}}; keys that are no numbers are comments."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("dim", "body")).where(F.col("dim").rlike("^[0-9]+$"))
    sides = raw.select(F.col("dim").cast("int").alias("dim"), F.explode(F.from_json("body", "map<string,array<string>>")).alias("side", "words"))
    return sides.select("dim", "side", F.explode("words").alias("word"))


def dimension_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(type, dim) of {type: [dimensions]}, the polarity configuration; keys that start with _ are comments."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("type", "body")).where(~F.col("type").startswith("_"))
    return raw.select("type", F.explode(F.from_json("body", "array<int>")).alias("dim"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def axes(spark: SparkSession, path: str) -> DataFrame:
    """Axes of a JSON file that is a list or {axes: [...]}."""
    fields = AXIS.replace(" ", ":").replace(",:", ",")
    raw = spark.read.schema(f"axes array<struct<{fields}>>, {AXIS}").option("multiLine", True).json(path)
    nested = raw.where("axes IS NOT NULL").select(F.explode("axes").alias("a")).select("a.*")
    return nested.unionByName(raw.where("axes IS NULL").drop("axes"))


def typed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(type, word1, word2) of {type: [[a, b], ...]}; keys that start with _ are comments."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("type", "pairs")).where(~F.col("type").startswith("_"))
    return m.select("type", F.explode("pairs").alias("p")).select("type", F.get("p", F.lit(0)).alias("word1"), F.get("p", F.lit(1)).alias("word2"))
