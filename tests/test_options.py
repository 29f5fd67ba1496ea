"""Operator options and sinks not covered by a registered query."""

from pyspark.sql import functions as F

from graphwright.operators import authority as A, relations as R, triples as T, wikidata as W
from graphwright.operators import replies as P
from graphwright.session import scratch_path
from graphwright.sources.fixtures import fixture


def test_class_members_top_exact_label_filter(spark, sf_small):
    t = fixture(spark, sf_small, "entity_triples")
    # customer 2 has an English label, a population and coordinates
    some = t.where((F.col("p") == "rdfs:label") & (F.col("s") == "wd:C2")).first()
    rows = W.class_members_top(t, "wd:Q515", location=some["o"]).collect()
    assert rows and all(r["city_label"] == some["o"] for r in rows)
    # a label without the English tag does not match
    odd = t.where((F.col("p") == "rdfs:label") & (F.col("s") == "wd:C3")).first()  # untagged label
    assert W.class_members_top(t, "wd:Q515", location=odd["o"]).count() == 0


def test_vocab_merge_modes(spark, sf_small):
    g = T.kg_skos(R.atoms(fixture(spark, sf_small, "responses")))
    extra = g.limit(5).withColumn("o", F.concat("o", F.lit("-new")))
    assert P.vocab_merge(g, extra, mode="merge").count() == g.count() + 5
    assert P.vocab_merge(g, extra, mode="replace").count() == 5


def test_ntriples_sink_round_trip(spark, sf_small):
    g = T.kg_skos(R.atoms(fixture(spark, sf_small, "responses")))
    path = scratch_path(spark, "nt")
    T.write_ntriples(g, path)
    lines = spark.read.text(path)
    assert lines.count() == g.count()
    assert lines.where(~F.col("value").rlike(r'^<[^>]+> <[^>]+> (<[^>]+>|".*"(@\w+)?) \.$')).count() == 0


def test_nodelink_sink(spark, sf_small):
    rows = A.authority_rows(fixture(spark, sf_small, "authority_triples"))
    nodes = A.authority_nodes(rows)
    links = A.authority_links(rows, nodes)
    path = scratch_path(spark, "nodelink")
    A.write_nodelink(nodes, links, path)
    assert spark.read.json(f"{path}/nodes").count() == nodes.count()
    back = spark.read.json(f"{path}/links")
    assert set(back.columns) == {"topic", "id", "topic_size"} and back.count() == links.count()
