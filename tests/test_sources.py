import bz2
import json

from lexiweave.operators import lexicon, parse_op
from lexiweave.sources import readers, sinks

PAGE = "<page><title>{t}</title>{r}<revision><text>{x}</text></revision></page>"


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  One line. \n\n\tTwo lines.\n")
    assert sorted(r.sentence for r in readers.text_lines(spark, str(tmp_path / "a.txt")).collect()) == ["One line.", "Two lines."]
    (tmp_path / "b.txt").write_text("First one. Second one! third. X\nFourth?")
    got = readers.whole_texts(spark, str(tmp_path / "b.txt")).orderBy("pos").collect()
    assert [r.sentence for r in got] == ["First one.", "Second one! third.", "X\nFourth?"]
    ids = [r.sentence_id for r in readers.with_ids(readers.text_lines(spark, str(tmp_path / "*.txt")), ["sentence"]).orderBy("sentence").collect()]
    assert ids == sorted(ids) and len(set(ids)) == len(ids)


def test_wiki_xml(spark, tmp_path):
    body = "'''Long''' text " * 20
    pages = [("Dog", "", body), ("Cat", "<redirect title='Dog'/>", body), ("Template:X", "", body), ("Tiny", "", "short"), ("Old", "", "#REDIRECT [[Dog]] " + body)]
    xml = "<mediawiki>" + "".join(PAGE.format(t=t, r=r, x=x) for t, r, x in pages) + "</mediawiki>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    got = readers.wiki_xml(spark, str(tmp_path / "dump.xml.bz2")).collect()
    assert [r.title for r in got] == ["Dog"] and "'" not in got[0].text


def test_wiki_json(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    (tmp_path / "AA" / "wiki_00").write_text(json.dumps({"id": "1", "title": "t", "url": "u", "text": "x"}) + "\n")
    (tmp_path / "AA" / "other").write_text("no")
    assert [r.title for r in readers.wiki_json(spark, str(tmp_path)).collect()] == ["t"]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("dog", "en", 5, {"pos": "NOUN"})], readers.GRAPH_NODES)
    edges = spark.createDataFrame([("dog", "describes", "cat", 0.5, "parse"), ("dog", "determines", "cat", 1.0, "parse")], readers.GRAPH_EDGES)
    sinks.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = readers.graph(spark, str(tmp_path / "g"))
    assert n.first().frequency == 5 and n.first().metadata == {"pos": "NOUN"}
    assert sorted(map(str, e.select(edges.columns).collect())) == sorted(map(str, edges.collect()))
    plan = e.where("relation = 'describes'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(relation" in plan
    doc = {"nodes": [{"word": "a", "language": "en", "frequency": 2, "metadata": {}}], "edges": [{"source": "a", "target": "b", "relation": "r", "confidence": 1.0}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    n, e = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert n.first().frequency == 2 and e.first().target == "b"


def test_axes_and_pairs(spark, tmp_path):
    axis = {"axis_id": 1, "name": "size", "poles": [["big"], ["small"]], "coherence": 0.5, "separation": 0.7, "size": 2, "source": "x"}
    (tmp_path / "list.json").write_text(json.dumps([axis]))
    (tmp_path / "doc.json").write_text(json.dumps({"axes": [axis, axis]}))
    assert readers.axes(spark, str(tmp_path / "list.json")).count() == 1
    assert [r.poles for r in readers.axes(spark, str(tmp_path / "doc.json")).collect()] == [[["big"], ["small"]]] * 2
    assert sinks.axis_report(readers.axes(spark, str(tmp_path / "doc.json"))).first().axes == 2
    (tmp_path / "pairs.json").write_text(json.dumps({"_note": [["x"]], "size": [["big", "small"]]}))
    assert [tuple(r) for r in readers.typed_pairs(spark, str(tmp_path / "pairs.json")).collect()] == [("size", "big", "small")]


def test_synset_edges(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"synset_id": "a", "lemmas": ["x"], "hypernyms": ["b"], "similar": ["c"]}) + "\n")
    e = readers.synset_edges(readers.synsets(spark, str(tmp_path / "s.json")))
    assert {tuple(r) for r in e.collect()} == {("a", "hypernym", "b"), ("a", "similar", "c")}


def test_parse_sinks(spark, tmp_path):
    p = parse_op.parse_sentences(spark.createDataFrame([(1, "the dog sees a cat")], "sentence_id long, sentence string"))
    sinks.parse_batches(p, str(tmp_path / "p"))
    sinks.consolidate(spark, str(tmp_path / "p"), str(tmp_path / "all"), parse_op.RECORD)
    assert spark.read.parquet(str(tmp_path / "all")).first().num_triples > 0
    text = sinks.dot(p).first().dot
    assert text.startswith("digraph parse_tree {\n") and " -> " in text
    sinks.save_sample(p, str(tmp_path / "sample"))
    assert spark.read.text(str(tmp_path / "sample")).first().value == "the dog sees a cat"


def test_wsd_prefers_overlap(spark):
    profiles = lexicon.sense_profiles(lexicon.literal_synsets(spark), lexicon.literal_edges(spark))
    from pyspark.sql import functions as F

    c = spark.createDataFrame([(1, "bank", ["money", "merchant"]), (2, "bank", ["water", "river"]), (3, "noun", [])], "k long, w string, n array<string>")
    best = {r.k: (r.sense_tag, r.score) for r in lexicon.wsd_best(lexicon.wsd_scores(c, "k", F.col("w"), F.col("n"), profiles), "k").collect()}
    assert best[1][0] == "bank_wn.01_n" and best[2][0] == "bank_wn.00_n" and best[3] == ("noun_wn.00_n", 1.0)


def test_simplex_is_regular():
    from math import dist

    from lexiweave.functions.anchors import ANCHORS, simplex

    assert len(ANCHORS) == 51 and simplex(1) == [[1.0]] and simplex(2) == [[1.0], [-1.0]]
    for n in range(3, 8):
        v = simplex(n)
        sides = {round(dist(a, b), 9) for i, a in enumerate(v) for b in v[:i]}
        assert len(sides) == 1 and all(abs(sum(x * x for x in a) - 1) < 1e-9 for a in v)


def test_lexicon_round_trip(spark, tmp_path):
    from lexiweave.operators import lexicon

    s, e = lexicon.literal_synsets(spark), lexicon.literal_edges(spark)
    sinks.save_lexicon(s, e, lexicon.senses(s), str(tmp_path))
    back = readers.synsets(spark, f"{tmp_path}/synsets")
    assert {r.synset_id for r in back.collect()} == {x[0] for x in lexicon.SYNSETS}
    want = {(a, k, b) for a, k, b in lexicon.EDGES if k in ("hypernym", "meronym", "holonym", "similar")}
    assert {tuple(r) for r in readers.synset_edges(back).collect()} == want
    assert spark.read.json(f"{tmp_path}/antonyms").count() == len({tuple(sorted((a, b))) for a, k, b in lexicon.EDGES if k == "antonym"})


def test_clusters_and_assignments(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_note": {"x": []}, "0": {"positive": ["good"], "negative": ["bad", "evil"]}, "4": {"neutral": []}}')
    (tmp_path / "d.json").write_text('{"_note": "dimensions", "moral": [0, 7], "size": [2]}')
    assert {tuple(r) for r in readers.clusters(spark, str(tmp_path / "c.json")).collect()} == {(0, "positive", "good"), (0, "negative", "bad"), (0, "negative", "evil")}
    assert {tuple(r) for r in readers.dimension_assignments(spark, str(tmp_path / "d.json")).collect()} == {("moral", 0), ("moral", 7), ("size", 2)}
    c = spark.createDataFrame([(0, "positive", ["good"]), (0, "negative", ["bad"])], "dim int, side string, words array<string>")
    sinks.save_clusters(c, f"{tmp_path}/out")
    assert [r.sides.asDict() for r in spark.read.json(f"{tmp_path}/out").collect()] == [{"positive": ["good"], "negative": ["bad"]}]
