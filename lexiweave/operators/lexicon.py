"""A lexicon of synsets and typed edges: senses, relations and word-sense disambiguation.

Tables (any source can fill them): synsets(synset_id, pos, definition, examples ARRAY, lemmas
ARRAY ordered) and edges(src, kind, dst) between synsets. A small literal lexicon stands in
where none is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..core.sizing import bounded_join
from ..functions.text import content_words

# A literal fixture: synset, pos, lemmas, definition, examples.
SYNSETS = [
    ("river.n.01", "n", "river stream", "a large natural stream of water", "the river crosses the valley"),
    ("bank.n.01", "n", "bank shore", "sloping land beside a body of water", "they pulled the boat up on the bank"),
    ("bank.n.02", "n", "bank", "a financial institution that keeps money", "the bank holds the merchant money"),
    ("word.n.01", "n", "word term", "a unit of language that speakers can identify", "a word in the sentence"),
    ("phrase.n.01", "n", "phrase", "an expression of several words forming part of a sentence", "a noun phrase in the sentence"),
    ("noun.n.01", "n", "noun", "a word that names a person or thing", "the noun precedes the verb"),
    ("verb.n.01", "n", "verb", "a word that serves as the predicate of a sentence", "the verb follows the noun"),
    ("language.n.01", "n", "language tongue", "a systematic means of communicating by words", "the language of the valley"),
    ("unit.n.01", "n", "unit", "a single thing or part", ""),
    ("thing.n.01", "n", "thing entity", "that which exists", ""),
    ("water.n.01", "n", "water", "a liquid that fills rivers and seas", "the water of the river"),
    ("land.n.01", "n", "land ground", "the solid part of the surface", ""),
    ("hot.a.01", "a", "hot warm", "having a high temperature", "the hot kitchen"),
    ("cold.a.01", "a", "cold", "having a low temperature", "a cold morning in winter"),
    ("good.a.01", "a", "good fine", "having desirable qualities", ""),
    ("bad.a.01", "a", "bad", "having undesirable qualities", ""),
    ("large.a.01", "a", "large big", "of more than usual size or amount", "a large house"),
    ("huge.a.01", "a", "huge enormous", "of very great size", ""),
    ("small.a.01", "a", "small little", "of less than usual size or amount", "a small house"),
    ("tiny.a.01", "a", "tiny", "of very small size", ""),
    ("happy.a.01", "a", "happy glad", "feeling joy or pleasure", ""),
    ("sad.a.01", "a", "sad gloomy", "feeling sorrow or grief", ""),
    ("strong.a.01", "a", "strong powerful", "having much force or strength", ""),
    ("weak.a.01", "a", "weak feeble", "having little force or strength", ""),
    ("light.a.01", "a", "light bright", "having much light", ""),
    ("dark.a.01", "a", "dark dim", "having little light", ""),
    ("warm.a.01", "a", "warm", "having a fairly high temperature", ""),
    ("cool.a.01", "a", "cool chilly", "having a fairly low temperature", ""),
    ("narrow.a.01", "a", "narrow", "of small width", "a narrow bridge"),
    ("wide.a.01", "a", "wide broad", "of great width", ""),
    ("ancient.a.01", "a", "ancient", "belonging to times long past", "an ancient harbour"),
    ("modern.a.01", "a", "modern", "belonging to the present time", ""),
    ("evil.a.01", "a", "evil wicked", "morally bad", ""),
    ("organism.n.01", "n", "organism", "a living thing", ""),
    ("animal.n.01", "n", "animal", "a living organism that moves by itself", ""),
    ("dog.n.01", "n", "dog dogs", "a tame animal that barks", ""),
    ("chair.n.01", "n", "chair seat", "a piece of furniture for one person to sit on", ""),
    ("furniture.n.01", "n", "furniture", "a mass of movable objects in a room", ""),
    ("stool.n.01", "n", "stool", "a chair without a back", ""),
    ("abstraction.n.01", "n", "abstraction", "a general idea", ""),
    ("rule.n.01", "n", "rule", "a principle that one follows", ""),
    ("carry.v.01", "v", "carry bear", "move something from one place to another", ""),
    ("rest.v.01", "v", "rest", "be still", ""),
    ("link.v.01", "v", "link join", "connect two things", "the bridge links the land"),
    ("links.n.01", "n", "links", "ground where a game is played", ""),
]
EDGES = [
    ("river.n.01", "hypernym", "water.n.01"), ("bank.n.01", "hypernym", "land.n.01"), ("bank.n.02", "hypernym", "thing.n.01"),
    ("word.n.01", "hypernym", "unit.n.01"), ("phrase.n.01", "hypernym", "unit.n.01"), ("noun.n.01", "hypernym", "word.n.01"),
    ("verb.n.01", "hypernym", "word.n.01"), ("language.n.01", "hypernym", "thing.n.01"), ("unit.n.01", "hypernym", "thing.n.01"),
    ("water.n.01", "hypernym", "thing.n.01"), ("land.n.01", "hypernym", "thing.n.01"), ("word.n.01", "holonym", "phrase.n.01"),
    ("hot.a.01", "antonym", "cold.a.01"), ("cold.a.01", "antonym", "hot.a.01"), ("good.a.01", "antonym", "bad.a.01"), ("bad.a.01", "antonym", "good.a.01"),
    ("hot.a.01", "similar", "good.a.01"), ("word.n.01", "meronym", "language.n.01"),
    ("large.a.01", "antonym", "small.a.01"), ("small.a.01", "antonym", "large.a.01"), ("huge.a.01", "antonym", "tiny.a.01"), ("tiny.a.01", "antonym", "huge.a.01"),
    ("happy.a.01", "antonym", "sad.a.01"), ("sad.a.01", "antonym", "happy.a.01"), ("strong.a.01", "antonym", "weak.a.01"), ("weak.a.01", "antonym", "strong.a.01"),
    ("light.a.01", "antonym", "dark.a.01"), ("dark.a.01", "antonym", "light.a.01"), ("warm.a.01", "antonym", "cool.a.01"), ("cool.a.01", "antonym", "warm.a.01"),
    ("narrow.a.01", "antonym", "wide.a.01"), ("wide.a.01", "antonym", "narrow.a.01"), ("good.a.01", "antonym", "evil.a.01"), ("evil.a.01", "antonym", "good.a.01"),
    ("large.a.01", "similar", "huge.a.01"), ("large.a.01", "similar", "wide.a.01"), ("huge.a.01", "similar", "large.a.01"), ("huge.a.01", "similar", "wide.a.01"),
    ("small.a.01", "similar", "tiny.a.01"), ("small.a.01", "similar", "narrow.a.01"), ("tiny.a.01", "similar", "small.a.01"), ("tiny.a.01", "similar", "narrow.a.01"),
    ("hot.a.01", "similar", "warm.a.01"), ("warm.a.01", "similar", "good.a.01"), ("cold.a.01", "similar", "cool.a.01"), ("cool.a.01", "similar", "bad.a.01"),
    ("ancient.a.01", "antonym", "modern.a.01"), ("modern.a.01", "antonym", "ancient.a.01"), ("bad.a.01", "similar", "evil.a.01"), ("evil.a.01", "similar", "bad.a.01"), ("happy.a.01", "similar", "light.a.01"), ("sad.a.01", "similar", "dark.a.01"),
    ("animal.n.01", "hypernym", "organism.n.01"), ("organism.n.01", "hypernym", "thing.n.01"), ("dog.n.01", "hypernym", "animal.n.01"),
    ("chair.n.01", "hypernym", "furniture.n.01"), ("furniture.n.01", "hypernym", "thing.n.01"), ("stool.n.01", "hypernym", "chair.n.01"),
    ("abstraction.n.01", "hypernym", "thing.n.01"), ("rule.n.01", "hypernym", "abstraction.n.01"), ("unit.n.01", "hypernym", "abstraction.n.01"),
]

# Confidence of an imported relation.
CONFIDENCE = {"synonym": 0.95, "antonym": 0.05, "hypernym": 0.8, "hyponym": 0.8}


def literal_synsets(spark: SparkSession) -> DataFrame:
    rows = [(i, p, ls.split(), d, [e] if e else []) for i, p, ls, d, e in SYNSETS]
    return spark.createDataFrame(rows, "synset_id string, pos string, lemmas array<string>, definition string, examples array<string>")


def literal_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "src string, kind string, dst string")


def senses(synsets: DataFrame) -> DataFrame:
    """(word, sense_idx, synset_id, sense_tag): senses of a word in order of synset id, tag ``word_wn.NN_p``."""
    s = synsets.select("synset_id", "pos", F.explode("lemmas").alias("word"))
    w = Window.partitionBy("word").orderBy("synset_id")
    s = s.withColumn("sense_idx", F.row_number().over(w) - 1)
    tag = F.concat("word", F.lit("_wn."), F.lpad(F.col("sense_idx").cast("string"), 2, "0"), F.lit("_"), "pos")
    return s.withColumn("sense_tag", tag)


def word_relations(synsets: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, relation, other): synonyms, antonyms, hypernyms and hyponyms, lower case, blanks for underscores."""
    plain = F.translate(F.lower("l"), "_", " ")
    lemma = synsets.select("synset_id", F.explode("lemmas").alias("l")).select("synset_id", plain.alias("word"))
    other = lemma.withColumnsRenamed({"synset_id": "other_id", "word": "other"})
    near = lemma.join(other, F.col("synset_id") == F.col("other_id")).select("word", F.lit("synonym").alias("relation"), "other")
    down = edges.where("kind = 'hypernym'").select(F.col("dst").alias("src"), F.lit("hyponym").alias("kind"), F.col("src").alias("dst"))
    typed = edges.where(F.col("kind").isin("antonym", "hypernym")).unionByName(down)
    far = lemma.join(typed, lemma["synset_id"] == typed["src"]).join(other, F.col("dst") == F.col("other_id"))
    out = near.unionByName(far.select("word", F.col("kind").alias("relation"), "other"))
    return out.where("word <> other").distinct()


def import_relations(synsets: DataFrame, edges: DataFrame, vocabulary: DataFrame, most: int = 10) -> DataFrame:
    """At most ``most`` relations of each kind for every vocabulary word, alphabetically, as graph edges."""
    r = word_relations(synsets, edges).join(vocabulary.select("word").distinct(), "word", "left_semi")
    w = Window.partitionBy("word", "relation").orderBy("other")
    r = r.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    confidence = F.lit(None).cast("double")
    for name, c in CONFIDENCE.items():
        confidence = F.when(F.col("relation") == name, F.lit(c)).otherwise(confidence)
    return r.select(
        F.col("word").alias("source"), F.lit("related-to").alias("relation"), F.col("other").alias("target"),
        confidence.alias("confidence"), F.col("relation").alias("source_type"),
    )


def sense_profiles(synsets: DataFrame, edges: DataFrame) -> DataFrame:
    """Senses with the word sets that a context is held against: gloss, hypernyms' lemmas and glosses, examples."""
    text = synsets.select(
        "synset_id", F.array_distinct(content_words(F.coalesce("definition", F.lit("")))).alias("gloss"),
        F.array_distinct(content_words(F.array_join("examples", " "))).alias("example"), "lemmas",
    )
    up = edges.where("kind = 'hypernym'").join(text, F.col("dst") == text["synset_id"])
    up = up.groupBy(F.col("src").alias("h_id")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat("lemmas", "gloss")))).alias("upper"))
    s = senses(synsets).join(text.drop("lemmas"), "synset_id").join(up, F.col("synset_id") == F.col("h_id"), "left").drop("h_id")
    return s.withColumn("upper", F.coalesce("upper", F.array().cast("array<string>")))


def overlap_score(near: Column, gloss: Column, upper: Column, example: Column) -> Column:
    """(0.4 gloss + 0.3 hypernym + 0.2 example overlap) / (0.9 · neighbours), within [0.01, 1]."""

    def shared(words: Column) -> Column:
        return F.size(F.array_intersect(near, words))

    raw = 0.4 * shared(gloss) + 0.3 * shared(upper) + 0.2 * shared(example)
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce(F.try_divide(raw, 0.9 * F.size(near)), F.lit(0.01))))


def wsd_scores(contexts: DataFrame, key: str, word: Column, near: Column, profiles: DataFrame) -> DataFrame:
    """Score of every candidate sense of every occurrence; words without senses drop out."""
    c = contexts.select(F.col(key), word.alias("word"), F.array_distinct(near).alias("near"))
    j = bounded_join(c, profiles, "word", spread=[key])
    return j.select(key, "word", "sense_idx", "sense_tag", F.round(overlap_score(F.col("near"), F.col("gloss"), F.col("upper"), F.col("example")), 6).alias("score"))


def wsd_best(scores: DataFrame, key: str) -> DataFrame:
    """Best sense of each occurrence, the first among equals; a single sense scores 1.0.

    An aggregate over (score, −index) rather than a window, so it combines map-side.
    """
    best = scores.groupBy(key, "word").agg(
        F.max(F.struct("score", (-F.col("sense_idx")).alias("i"), "sense_tag")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    return best.select(key, "word", (-F.col("m.i")).alias("sense_idx"), "m.sense_tag", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("m.score")).alias("score"))


#: Shares of the four signals in the combined similarity of two antonym pairs.
SIGNAL_WEIGHTS = {"transitivity": 0.4, "quadrilateral": 0.3, "definition": 0.2, "hypernym": 0.1}


def antonym_signals(synsets: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(p1, p2, transitivity, quadrilateral, definition, hypernym, combined) of pairs of antonym pairs with a signal above zero.

    A pair ``p`` is ``synset1|synset2`` in order. Transitivity: a shared synset or lemma. Quadrilateral: mean of the Jaccard
    overlaps of the first and of the second synsets' similar ones. Definition: TF-IDF cosine of both definitions
    together, ln(N / (1 + df)) over the pairs. Hypernym: Jaccard of all hypernyms of both, themselves included.
    Candidates come from equi-joins on what two pairs share, so pairs without any signal are never made.
    """
    pairs = edges.where("kind = 'antonym'").select(F.least("src", "dst").alias("s1"), F.greatest("src", "dst").alias("s2")).distinct()
    pairs = pairs.select(F.concat_ws("|", "s1", "s2").alias("p"), "s1", "s2")
    sides = pairs.select("p", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("s1").alias("synset_id")), F.struct(F.lit(2).alias("side"), F.col("s2").alias("synset_id")))).alias("x"))
    sides = sides.select("p", "x.side", "x.synset_id")
    lemmas = synsets.select("synset_id", F.explode("lemmas").alias("item"))

    def shared(items: DataFrame, *same: str) -> DataFrame:
        """(p1, p2, *same, i): number of equal items of two pairs."""
        b = items.withColumnRenamed("p", "p2")
        j = items.withColumnRenamed("p", "p1").join(b, [*same, "item"]).where("p1 < p2")
        return j.groupBy("p1", "p2", *same).agg(F.count(F.lit(1)).alias("i"))

    def jaccard(items: DataFrame, *same: str) -> DataFrame:
        n = items.groupBy("p", *same).agg(F.count(F.lit(1)).alias("n"))
        j = shared(items, *same).join(n.withColumnsRenamed({"p": "p1", "n": "n1"}), ["p1", *same]).join(n.withColumnsRenamed({"p": "p2", "n": "n2"}), ["p2", *same])
        return j.select("p1", "p2", *same, (F.col("i") / (F.col("n1") + F.col("n2") - F.col("i") + 1e-6)).alias("x"))

    ends = sides.select("p", F.col("synset_id").alias("item")).unionByName(sides.join(lemmas, "synset_id").select("p", "item")).distinct()
    transitivity = shared(ends).select("p1", "p2", F.lit("transitivity").alias("k"), F.lit(1.0).alias("x"))
    near = edges.where("kind = 'similar'").select(F.col("src").alias("synset_id"), F.col("dst").alias("item"))
    quads = jaccard(sides.join(near, "synset_id").select("p", "side", "item").distinct(), "side")
    quads = quads.groupBy("p1", "p2").agg((F.sum("x") / 2).alias("x")).select("p1", "p2", F.lit("quadrilateral").alias("k"), "x")
    up = jaccard(sides.join(closure.withColumnRenamed("descendant", "synset_id"), "synset_id").select("p", F.col("ancestor").alias("item")).distinct())
    up = up.select("p1", "p2", F.lit("hypernym").alias("k"), "x")
    bags = sides.join(synsets.select("synset_id", content_words(F.coalesce("definition", F.lit(""))).alias("ws")), "synset_id")
    words = bags.select("p", F.explode("ws").alias("item"))
    size = words.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    counts = words.groupBy("p", "item").agg(F.count(F.lit(1)).alias("c"))
    df = counts.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    total = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    v = counts.join(size, "p").join(df, "item").join(F.broadcast(total)).select("p", "item", (F.col("c") / F.col("size") * F.log(F.col("pairs") / (1 + F.col("df")))).alias("w"))
    norm = v.groupBy("p").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = v.withColumnsRenamed({"p": "p1", "w": "w1"}).join(v.withColumnsRenamed({"p": "p2", "w": "w2"}), "item").where("p1 < p2").groupBy("p1", "p2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    cosine = dot.join(norm.withColumnsRenamed({"p": "p1", "norm": "n1"}), "p1").join(norm.withColumnsRenamed({"p": "p2", "norm": "n2"}), "p2")
    cosine = cosine.select("p1", "p2", F.lit("definition").alias("k"), F.coalesce(F.try_divide("dot", F.col("n1") * F.col("n2")), F.lit(0.0)).alias("x"))
    every = transitivity.unionByName(quads).unionByName(cosine).unionByName(up)
    signals = {k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("x"))), F.lit(0.0)) for k in SIGNAL_WEIGHTS}
    out = every.groupBy("p1", "p2").agg(*[(F.round(c, 6) + 0.0).alias(k) for k, c in signals.items()], F.round(sum((SIGNAL_WEIGHTS[k] * c for k, c in signals.items()), F.lit(0.0)), 6).alias("combined"))
    return out.where("combined > 0")


def expand(synsets: DataFrame, edges: DataFrame, seeds: DataFrame, kind: str, pos: str | None = None, first: int = 3, near: int = 2) -> DataFrame:
    """(*seed columns, word): seeds, lemmas of their first senses, and of the first ``near`` synsets that ``kind`` leads to; single words only."""
    s = senses(synsets if pos is None else synsets.where(F.col("pos") == pos)).where(F.col("sense_idx") < first).select(F.col("word").alias("seed"), "synset_id")
    keys = seeds.columns
    own = seeds.join(s, "seed").select(*keys, "synset_id")
    e = edges.where(F.col("kind") == kind).select(F.col("src").alias("synset_id"), "dst").distinct()
    w = Window.partitionBy(*keys, "synset_id").orderBy("dst")
    far = own.join(e, "synset_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= near).select(*keys, F.col("dst").alias("synset_id"))
    lemmas = synsets.select("synset_id", F.explode("lemmas").alias("l")).select("synset_id", F.translate(F.lower("l"), "_", " ").alias("word"))
    words = own.unionByName(far).join(lemmas, "synset_id").select(*keys, "word").unionByName(seeds.select(*keys, F.col("seed").alias("word")))
    return words.where(~F.col("word").contains(" ")).distinct()


def word_paths(synsets: DataFrame, closure: DataFrame) -> DataFrame:
    """(w1, w2, path): 1 / (1 + shortest path over a common hypernym) of the words' senses, for w1 < w2 that have one."""
    above = senses(synsets).select("word", "synset_id").join(closure, F.col("synset_id") == F.col("descendant"))
    best = above.groupBy("word", "ancestor").agg(F.min("depth").alias("d"))
    j = best.toDF("w1", "ancestor", "d1").join(best.toDF("w2", "ancestor", "d2"), "ancestor").where("w1 < w2")
    return j.groupBy("w1", "w2").agg((1.0 / (1 + F.min(F.col("d1") + F.col("d2")))).alias("path"))


def noun_features(synsets: DataFrame, closure: DataFrame) -> DataFrame:
    """(synset_id, animacy, living, embodiment, countability) of nouns, by their hypernyms and definition."""
    up = closure.groupBy(F.col("descendant").alias("synset_id")).agg(*[
        F.bool_or(F.col("ancestor").rlike(p)).alias(n)
        for n, p in (("animate", "person|animal|organism"), ("living", "organism|living_thing"), ("abstract", "abstraction|psychological_feature"))
    ])
    n = synsets.where("pos = 'n'").join(up, "synset_id", "left")

    def either(c: str, yes: str, no: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.col("synset_id").rlike("person|animal|organism") if c != "abstract" else F.lit(False)), F.lit(yes)).otherwise(F.lit(no))

    mass = F.lower("definition").rlike("amount|mass|substance")
    return n.select(
        "synset_id", either("animate", "animate", "inanimate").alias("animacy"), either("living", "living", "nonliving").alias("living"),
        either("abstract", "abstract", "physical").alias("embodiment"), F.when(mass, F.lit("uncountable")).otherwise(F.lit("countable")).alias("countability"),
    )
