"""Queries over sense tags, word features, categories, lexicon graphs and smaller losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core.sizing import bounded_join
from ..core.terms import relation_name, relation_name_sql, term, term_sql
from ..functions import anchors, features as fx, vec
from ..operators import graph, lexicon, train
from . import Registry, table
from .graph import EDGES, edges_of
from .lexicon import EDG, SYN, SENSES, TAG, _PROFILE, _scores
from .parsing import parsed
from .vectors import E, LONG, PAIRS, long_form, pairs, r6, vectors

registry = Registry()


@registry.query(
    "sense_tags",
    r"""SELECT DISTINCT word, regexp_replace(word, '_wn\..*$', '') AS base, nullif(regexp_extract(word, '^(.*)_wn\.([0-9]+)_([a-z])$', 2), '') AS sense,
  nullif(regexp_extract(word, '^(.*)_wn\.([0-9]+)_([a-z])$', 3), '') AS pos FROM word_vector WHERE word IS NOT NULL""",
)
def sense_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags taken apart; words without a sense have none."""
    w = F.col("word")

    def part(i: int):
        return F.nullif(F.regexp_extract(w, fx.TAG, i), F.lit(""))

    return table(spark, sf_dir, "word_vector").where("word IS NOT NULL").select("word", fx.base_word(w).alias("base"), part(2).alias("sense"), part(3).alias("pos")).distinct()


_BEST = f"""{_PROFILE}, b AS (SELECT context_id, word, sense_tag FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, sense_idx) AS k FROM w) WHERE k = 1),
f AS (SELECT sentence_id, word, sense_tag FROM (SELECT x.sentence_id, b.word, sense_tag, row_number() OVER (PARTITION BY x.sentence_id, b.word ORDER BY b.context_id) AS k
      FROM b JOIN (SELECT DISTINCT context_id, sentence_id FROM word_context) x USING (context_id)) WHERE k = 1)"""


@registry.query(
    "sense_tagged_triples",
    f"""WITH {_BEST}, tr AS (SELECT DISTINCT triple_id, sentence_id, {term_sql('subject')} AS s, {relation_name_sql('relation')} AS relation, {term_sql('object')} AS o FROM semantic_triple)
SELECT triple_id, coalesce(a.sense_tag, s) AS subject, relation, coalesce(b.sense_tag, o) AS object FROM tr LEFT JOIN f a ON a.sentence_id = tr.sentence_id AND a.word = s
LEFT JOIN f b ON b.sentence_id = tr.sentence_id AND b.word = o WHERE s IS NOT NULL AND relation IS NOT NULL AND o IS NOT NULL""",
)
def sense_tagged_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples whose words carry the sense found first in their sentence, or stay as they are."""
    where = table(spark, sf_dir, "word_context").select("context_id", "sentence_id").distinct()
    best = lexicon.wsd_best(_scores(spark, sf_dir), "context_id").join(where, "context_id")
    first = best.groupBy("sentence_id", "word").agg(F.min_by("sense_tag", "context_id").alias("tag"))
    t = table(spark, sf_dir, "semantic_triple").select(
        "triple_id", "sentence_id", term("subject").alias("s"), relation_name("relation").alias("relation"), term("object").alias("o")
    )
    t = t.where("s IS NOT NULL AND relation IS NOT NULL AND o IS NOT NULL").distinct()
    for c, out in (("s", "subject"), ("o", "object")):
        t = bounded_join(t, first.select("sentence_id", F.col("word").alias(c), F.col("tag").alias(f"{c}_tag")), ["sentence_id", c], "left")
        t = t.withColumn(out, F.coalesce(f"{c}_tag", c))
    return t.select("triple_id", "subject", "relation", "object")


@registry.query("sense_vocabulary", f"WITH {_BEST} SELECT sense_tag, count(*) AS sentences FROM f GROUP BY sense_tag")
def sense_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = table(spark, sf_dir, "word_context").select("context_id", "sentence_id").distinct()
    best = lexicon.wsd_best(_scores(spark, sf_dir), "context_id").join(where, "context_id")
    first = best.groupBy("sentence_id", "word").agg(F.min_by("sense_tag", "context_id").alias("sense_tag"))
    return first.groupBy("sense_tag").agg(F.count(F.lit(1)).alias("sentences"))


_NODES = f"(SELECT DISTINCT {term_sql('word')} AS word, metadata['pos'] AS pos FROM graph_node WHERE {term_sql('word')} IS NOT NULL)"
_ADJ = "pos = 'ADJ'"


@registry.query(
    "grammar_features",
    f"""WITH n AS {_NODES}, f AS (
  SELECT 'number' AS feature, CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN 'plural' ELSE 'singular' END AS value FROM n WHERE pos = 'NOUN'
  UNION ALL SELECT k, v FROM n, (VALUES ('tense', 'present'), ('aspect', 'simple'), ('voice', 'active'), ('mood', 'indicative')) t(k, v) WHERE pos = 'VERB'
  UNION ALL SELECT 'degree', CASE WHEN word LIKE '%er' THEN 'comparative' WHEN word LIKE '%est' THEN 'superlative' ELSE 'positive' END FROM n WHERE pos IN ('ADJ', 'ADV')
  UNION ALL SELECT 'polarity', CASE WHEN regexp_matches(word, '^(un|in|im|il|ir|non|dis)') THEN 'negative' ELSE 'positive' END FROM n WHERE {_ADJ})
SELECT feature, value, count(*) AS n FROM f GROUP BY 1, 2""",
)
def grammar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each grammatical feature has each value over the graph's words."""
    n = table(spark, sf_dir, "graph_node").select(term("word").alias("word"), F.try_element_at("metadata", F.lit("pos")).alias("pos")).where("word IS NOT NULL").distinct()
    m = n.select(F.explode(fx.features(F.col("word"), F.coalesce("pos", F.lit("")))).alias("feature", "value"))
    return m.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


_CATS = "(SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in fx.CATEGORIES.items() for w in ws.split()) + ") t(category, w))"


@registry.query(
    "semantic_types",
    f"""WITH c AS (SELECT relation, category, count(*) AS n FROM ({EDGES}) JOIN {_CATS} ON w = source OR w = target GROUP BY 1, 2)
SELECT relation, category, n FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, category) AS k FROM c) WHERE k = 1""",
)
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic type that most keyword hits of a relation's pairs speak for, alphabetical among equals."""
    hits = F.array_union(fx.category(F.col("source")), F.array().cast("array<string>"))
    e = edges_of(spark, sf_dir).select("relation", F.concat(hits, fx.category(F.col("target"))).alias("c"), "source", "target")
    # a pair whose two words are different keywords of a type counts twice, one whose words are equal once
    one = F.when(F.col("source") == F.col("target"), F.array_distinct("c")).otherwise(F.col("c"))
    n = e.select("relation", F.explode(one).alias("category")).groupBy("relation", "category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("relation").orderBy(F.desc("n"), "category")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("relation", "category", "n")


_DIST = "(SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{r}', {d}::DOUBLE)" for p, t in fx.DISTANCES.items() for r, d in t.items()) + ") t(profile, relation, distance))"


@registry.query(
    "relation_distances",
    f"SELECT profile, d.relation, distance, count(*) AS edges, round(sum(confidence), 6) / count(*) AS confidence FROM {_DIST} d JOIN ({EDGES}) e ON e.relation = d.relation GROUP BY 1, 2, 3",
)
def relation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that have a target distance in each profile; others drop out of training."""
    d = spark.createDataFrame([(p, r, x) for p, t in fx.DISTANCES.items() for r, x in t.items()], "profile string, relation string, distance double")
    n = edges_of(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), graph.mean("confidence").alias("c"))
    return d.join(n, "relation").select("profile", "relation", "distance", "edges", F.col("c").alias("confidence"))


@registry.query("adjective_scan", f"SELECT lemma, count(*) AS n FROM (SELECT unnest(lemmas) AS lemma FROM {SYN} WHERE pos = 'a') GROUP BY lemma ORDER BY n DESC, lemma LIMIT 2000")
def adjective_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexicon.literal_synsets(spark).where("pos = 'a'").select(F.explode("lemmas").alias("lemma"))
    return s.groupBy("lemma").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lemma").limit(2000)


_L = f"l AS (SELECT synset_id, word, sense_idx, {TAG} AS tag FROM {SENSES})"


@registry.query(
    "lexicon_graph",
    f"""WITH {_L}, e AS (SELECT * FROM {EDG}) SELECT DISTINCT a.tag AS source, kind AS relation, b.tag AS target FROM e JOIN l a ON a.synset_id = src JOIN l b ON b.synset_id = dst
UNION SELECT DISTINCT a.tag, 'synonym', b.tag FROM l a JOIN l b ON a.synset_id = b.synset_id AND a.tag <> b.tag""",
)
def lexicon_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lexicon relations between sense tags, with synonyms of one synset."""
    s = lexicon.senses(lexicon.literal_synsets(spark)).select("synset_id", "sense_tag")
    a, b = s.toDF("src", "source"), s.toDF("dst", "target")
    typed = lexicon.literal_edges(spark).join(a, "src").join(b, "dst").select("source", F.col("kind").alias("relation"), "target")
    same = s.toDF("synset_id", "source").join(s.toDF("synset_id", "target"), "synset_id").where("source <> target")
    return typed.unionByName(same.select("source", F.lit("synonym").alias("relation"), "target")).distinct()


SEEDS = ["hot", "good", "word"]


@registry.query(
    "seed_expansion",
    f"""WITH {_L}, s AS (SELECT unnest({SEEDS}) AS seed), t AS (SELECT seed, synset_id FROM s JOIN l ON word = seed WHERE sense_idx < 3),
n AS (SELECT seed, dst AS synset_id FROM (SELECT seed, dst, row_number() OVER (PARTITION BY seed, src ORDER BY dst) AS k FROM t JOIN {EDG} ON src = synset_id AND kind = 'similar') WHERE k <= 2)
SELECT DISTINCT seed, word FROM (SELECT seed, seed AS word FROM s UNION SELECT seed, word FROM t JOIN l USING (synset_id) UNION SELECT seed, word FROM n JOIN l USING (synset_id)) WHERE word NOT LIKE '% %'""",
)
def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with the lemmas of their first three senses and of two similar synsets of each."""
    l = lexicon.senses(lexicon.literal_synsets(spark)).select("word", "sense_idx", "synset_id")
    s = spark.createDataFrame([(x,) for x in SEEDS], "seed string")
    t = s.join(l.where("sense_idx < 3"), F.col("seed") == F.col("word")).select("seed", "synset_id")
    near = t.join(lexicon.literal_edges(spark).where("kind = 'similar'"), F.col("synset_id") == F.col("src"))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("seed", "src").orderBy("dst"))).where("k <= 2").select("seed", F.col("dst").alias("synset_id"))
    words = t.unionByName(near).join(l.select("word", "synset_id"), "synset_id").select("seed", "word")
    return words.unionByName(s.select("seed", F.col("seed").alias("word"))).where(~F.col("word").contains(" ")).distinct()


@registry.query(
    "vocabulary_antonyms",
    f"""WITH {_L}, p AS (SELECT a.word AS w1, b.word AS w2 FROM {EDG} JOIN l a ON a.synset_id = src JOIN l b ON b.synset_id = dst WHERE kind = 'antonym' AND a.sense_idx < 3),
v AS (SELECT {term_sql('word')} AS word, min(node_id) AS id FROM graph_node GROUP BY 1) SELECT DISTINCT least(w1, w2) AS word1, greatest(w1, w2) AS word2 FROM p JOIN v a ON a.word = w1 JOIN v b ON b.word = w2""",
)
def vocabulary_antonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antonym pairs whose words are both in the graph."""
    l = lexicon.senses(lexicon.literal_synsets(spark))
    a = l.where("sense_idx < 3").select(F.col("synset_id").alias("src"), F.col("word").alias("w1"))
    b = l.select(F.col("synset_id").alias("dst"), F.col("word").alias("w2"))
    p = lexicon.literal_edges(spark).where("kind = 'antonym'").join(a, "src").join(b, "dst").select(F.least("w1", "w2").alias("word1"), F.greatest("w1", "w2").alias("word2")).distinct()
    v = table(spark, sf_dir, "graph_node").select(term("word").alias("w")).where("w IS NOT NULL").distinct()
    return p.join(v, p["word1"] == v["w"], "left_semi").join(v, p["word2"] == v["w"], "left_semi")


@registry.query(
    "word_similarity",
    f"""WITH RECURSIVE {_L}, e AS (SELECT src AS c, dst AS p FROM {EDG} WHERE kind = 'hypernym'), n AS (SELECT c AS x FROM e UNION SELECT p FROM e),
u AS (SELECT x AS d, x AS a, 0 AS k FROM n UNION ALL SELECT d, p, k + 1 FROM u JOIN e ON a = c WHERE k < 20), m AS (SELECT d, a, min(k) AS k FROM u GROUP BY 1, 2),
q AS (SELECT x.word AS w1, y.word AS w2, 1.0::DOUBLE / (1 + min(p.k + r.k)) AS path FROM l x JOIN m p ON p.d = x.synset_id JOIN m r ON r.a = p.a JOIN l y ON y.synset_id = r.d AND x.word < y.word GROUP BY 1, 2),
h AS (SELECT x.word, list(DISTINCT p.a) AS up FROM l x JOIN m p ON p.d = x.synset_id AND p.k > 0 GROUP BY 1)
SELECT w1, w2, round((path + CASE WHEN coalesce(len(list_intersect(a.up, b.up)), 0) > 0 THEN len(list_intersect(a.up, b.up)) / len(list_distinct(list_concat(a.up, b.up)))::DOUBLE ELSE 0 END)
  / (1 + (coalesce(len(list_intersect(a.up, b.up)), 0) > 0)::INT), 6) AS similarity FROM q LEFT JOIN h a ON a.word = w1 LEFT JOIN h b ON b.word = w2""",
)
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the signals that two words have: path similarity over senses, and shared hypernyms where there are any."""
    up = graph.closure(lexicon.literal_edges(spark).where("kind = 'hypernym'"), "src", "dst")
    s = lexicon.senses(lexicon.literal_synsets(spark)).select("word", "synset_id")
    above = s.join(up, F.col("synset_id") == F.col("descendant")).select("word", "ancestor", "depth")
    x, y = above.toDF("w1", "ancestor", "d1"), above.toDF("w2", "ancestor", "d2")
    path = x.join(y, "ancestor").where("w1 < w2").groupBy("w1", "w2").agg((1.0 / (1 + F.min(F.col("d1") + F.col("d2")))).alias("path"))
    h = above.where("depth > 0").groupBy("word").agg(F.collect_set("ancestor").alias("up"))
    j = path.join(h.toDF("w1", "u1"), "w1", "left").join(h.toDF("w2", "u2"), "w2", "left")
    shared = F.coalesce(F.size(F.array_intersect("u1", "u2")), F.lit(0))
    jaccard = F.when(shared > 0, shared / F.size(F.array_union("u1", "u2"))).otherwise(F.lit(0.0))
    return j.select("w1", "w2", r6((F.col("path") + jaccard) / (1 + (shared > 0).cast("int")), "similarity"))


@registry.query("regularization_loss", f"SELECT round(avg(v * v), 6) AS l2, round(avg(abs(v)) FILTER (dim < 51), 6) AS anchor_l1, round(var_pop(v) FILTER (dim >= 51), 6) AS diversity FROM {LONG}")
def regularization_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return long_form(spark, sf_dir).agg(
        r6(F.avg(v * v), "l2"), r6(F.avg(F.when(F.col("dim") < 51, F.abs(v))), "anchor_l1"), r6(F.var_pop(F.when(F.col("dim") >= 51, v)), "diversity")
    )


@registry.query("relevance_gate", f"SELECT id1, id2, list_transform(list_zip(a, b), lambda t: round(t[1] / (1 + exp(-t[2])), 6) + 0.0) AS v FROM {PAIRS}")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v ⊙ σ(r), the second vector of a pair as the relevance of the first."""
    gated = F.zip_with("a", "b", lambda x, y: x / (1 + F.exp(-y)))
    return pairs(spark, sf_dir).select("id1", "id2", vec.rounded(gated).alias("v"))


@registry.query("expand_dimensions", f"SELECT vec_id, list_concat(v, list_transform(range(4), lambda i: 0.001::DOUBLE)) AS v FROM {E}")
def expand_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions with four new ones of scale 0.001 behind them."""
    return vectors(spark, sf_dir).select("vec_id", F.concat("v", F.array_repeat(F.lit(0.001), 4)).alias("v"))


@registry.query("anchor_matrix")
def anchor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded small vectors of the graph's words with the anchor cells of their tag written over them."""
    n = table(spark, sf_dir, "graph_node").select(term("word").alias("word"), F.try_element_at("metadata", F.lit("pos")).alias("pos")).where("word IS NOT NULL")
    n = n.groupBy("word").agg(F.max("pos").alias("pos"))
    cells = anchors.vector(F.coalesce("pos", F.lit("X")), F.array().cast("array<string>"), 64)
    v = train.initial_vectors(n, 64)
    return n.join(v, "word").select("word", F.zip_with("v", cells, lambda x, c: F.when(c != 0, c).otherwise(x)).alias("v"))


@registry.query("parse_json")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse records as JSON lines with a fixed schema."""
    p = parsed(spark, sf_dir)
    return p.select("sentence_id", F.to_json(F.struct("sentence_id", "sentence", "success", "parse_score", "num_triples", "error", "triples", "contexts")).alias("line"))


# Templates of the second sentence generator.
TEMPLATES = ("The {a} {n} runs.", "A {n} sees the {a} {m}.", "The {n} is {a}.")
NOUNS, ADJECTIVES = "dog cat house tree".split(), "big small red old".split()


@registry.query(
    "template_sentences",
    f"""SELECT DISTINCT replace(replace(replace(t, '{{n}}', n), '{{m}}', m), '{{a}}', a) AS sentence FROM unnest({list(TEMPLATES)}) x(t), unnest({NOUNS}) y(n), unnest({NOUNS}) z(m), unnest({ADJECTIVES}) w(a)""",
)
def template_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fillings of the literal templates (at most 192)."""
    d = spark.range(1)
    for name, ws in (("t", TEMPLATES), ("n", NOUNS), ("m", NOUNS), ("a", ADJECTIVES)):
        d = d.select("*", F.explode(F.array(*[F.lit(w) for w in ws])).alias(name))
    s = F.col("t")
    for name in ("n", "m", "a"):
        s = F.replace(s, F.lit("{" + name + "}"), F.col(name))
    return d.select(s.alias("sentence")).distinct()


@registry.query("sentence_similarity")
def sentence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each sentence's tree vector with the next sentence's; −1 where one has none."""
    from .jobs import encode_sentences

    v = encode_sentences(spark, sf_dir)
    nxt = v.select((F.col("sentence_id") - 1).alias("sentence_id"), F.col("v").alias("w"))
    return v.join(nxt, "sentence_id", "left").select("sentence_id", F.when(F.col("w").isNull(), F.lit(-1.0)).otherwise(vec.cosine(F.col("v"), F.col("w"))).alias("cosine"))
