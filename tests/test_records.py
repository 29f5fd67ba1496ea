"""Whole records: deep documents, open keys, HTML, CSV folders, restarts, plans."""

import json

import pytest
from pyspark.sql import functions as F

from graphwright.functions import joins as J
from graphwright.operators import authority as A, cache as K, entities as E, links as L, relations as R, wikidata as W
from graphwright.session import scratch_path
from graphwright.sources import files as S
from graphwright.sources.fixtures import fixture
from graphwright.streaming import jobs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _deep(levels, value):
    doc = {"a": value}
    for i in range(levels):
        doc = {f"k{i}": doc, "own": f"{value}_{i}"}
    return json.dumps(doc)


def test_deep_documents_are_equal_in_batch_and_stream(spark):
    rows = [(i, _deep(12 + i, f"id_{i}")) for i in range(6)]
    df = spark.createDataFrame(rows, "record_id long, data string")
    base = scratch_path(spark, "deep")
    df.repartition(3).write.parquet(f"{base}/in")
    want = {r.value: r.n for r in E.identifier_stats(E.identifier_values(df)).collect()}
    assert "id_5" in want and len(want) == 6 + sum(12 + i for i in range(6))
    got = jobs.stream_identifier_stats(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", df.schema)
    assert {r.value: r.n for r in got.collect()} == want
    # more files arrive: the same job goes on from its checkpoint
    df.limit(1).write.mode("append").parquet(f"{base}/in")
    jobs.stream_identifier_stats(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", df.schema)
    again = {r.value: r.n for r in jobs.current_counts(spark, f"{base}/out").collect()}
    assert sum(again.values()) == sum(want.values()) + sum(json.dumps(rows[0][1]).count("id_") for _ in range(1))


def test_stream_goes_on_after_a_failed_first_write(spark, sf_small):
    df = fixture(spark, sf_small, "responses").limit(60)
    base = scratch_path(spark, "restart")
    df.repartition(2).write.parquet(f"{base}/in")
    # what a first write that died leaves behind
    spark.range(1).write.parquet(f"{base}/out/_temporary/0/_temporary/attempt_0")
    first = jobs.stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", df.schema).count()
    assert first > 0
    # a run without new files adds nothing
    assert jobs.stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", df.schema).count() == first
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt2", df.schema)


def test_every_key_of_an_atom_is_kept(spark):
    reply = '{\n"concept1": "a",\n"colour": "red",\n"colour": "blue",\n"x-1": 5\n}'
    df = spark.createDataFrame([(0, 0, "A sentence long enough.", reply)], "doc_id long, uid long, sentence string, response string")
    want = {("concept1", "a"), ("colour", "blue"), ("x-1", "5")}
    assert {(r.key, r.value) for r in R.atom_fields(R.atoms(df)).collect()} == want
    cached = K.cache_relationship(R.artefacts(df), F.lit("u"))
    assert {(r.key, r.value) for r in K.relationship_atoms(cached).collect()} == want
    assert cached.first().source == "A sentence long enough."


def test_cache_folders_by_type(spark):
    recs = spark.createDataFrame([(1, "n", '{"a": "x_y", "b": {"c": "x_y"}}')], "record_id long, name string, data string")
    cached = K.cache_resource(recs, E.identifier_values(recs), as_of=F.lit("2024-01-01").cast("date"))
    assert cached.first().identifiers == {"x_y": 2}
    path = scratch_path(spark, "cache")
    K.write_cache(cached.drop("parsed"), path)
    assert [r.type for r in spark.read.parquet(path).collect()] == ["resource"]


def test_payload_without_fields_has_a_type(spark):
    df = spark.createDataFrame([(1, '{"title": "t", "text": "x"}')], "payload_id long, payload string")
    assert [(r.p, r.o_kind) for r in E.jsonld_triples(df).collect()] == [(E.C.RDF_TYPE, "iri")]


def _page(spark, html, url="https://en.wikipedia.org/wiki/Own"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_anchor_attributes_and_references(spark):
    html = ("<a href=\"/wiki/A\" data-href=\"/x\">one</a><A HREF='/wiki/B'>t&eacute;&amp;lt;</A><a class=c href=/wiki/C>x &#233;&#xe9;</a>"
            "<a data-href=\"/wiki/D\">no</a><abbr href=\"/wiki/E\">no</abbr><a title=\"a > b\" href=\"/wiki/F?x=1&amp;y=2\">&nope; & <b>f</b></a>")
    got = [(r.href, r.text) for r in L.page_anchors(_page(spark, html)).orderBy("pos").collect()]
    assert got == [("/wiki/A", "one"), ("/wiki/B", "té&lt;"), ("/wiki/C", "x éé"), ("/wiki/F?x=1&y=2", "&nope; & f")]


def test_pages_without_a_path_keep_their_links(spark):
    html = '<a href="/wiki/A">a</a><a href="/wiki/Own">self</a>'
    links = lambda url: sorted(r.value for r in L.page_links(L.page_anchors(_page(spark, html, url))).collect())
    assert links("https://en.wikipedia.org/wiki/Own") == ["a"]
    for url in ("https://site.example/", "https://site.example", "not a url at all %%", None):
        assert links(url) == ["a", "self"]


def test_image_source_in_any_quoting(spark):
    html = "<img data-src=\"//upload.wikimedia.org/no.png\"><IMG SRC='//upload.wikimedia.org/a.png'>"
    assert L.first_image(_page(spark, html)).first().image == "http://upload.wikimedia.org/a.png" \
        or L.first_image(_page(spark, html)).first().image == "http:" + "//upload.wikimedia.org/a.png"
    assert L.first_image(_page(spark, "<img alt=x>")).count() == 0


def test_csv_folder_with_mixed_types_and_missing_words(spark):
    base = scratch_path(spark, "mixed")
    for text in ("a,b,d\n1,2.5,true\n2,NA,false", "b,a,c\nx,3,\"p, q\"\nnull,4,n/a"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(base)
    df = S.scan_csv_union(spark, base, marker="part")
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "boolean"}
    got = sorted((r.a, r.b, r.c, r.d) for r in df.collect())
    assert got == [(1, "2.5", None, True), (2, None, None, False), (3, "x", "p, q", None), (4, None, None, None)]


def test_null_keys_are_spread_and_kept(spark, monkeypatch):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("k"), F.col("id"))
    dim = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "k long, v string")
    want = sorted(map(tuple, big.join(dim, "k", "left").collect()), key=str)
    assert sorted(map(tuple, J.skew_join(big, dim, "k", "left").collect()), key=str) == want
    monkeypatch.setattr(J, "HOT_ROWS", 50)
    monkeypatch.setattr(J, "ROWS_PER_TASK", 20)
    joined = J.skew_join(big, dim, "k", "left")
    assert sorted(map(tuple, joined.collect()), key=str) == want and "_salt" in _plan(joined)
    inner = J.skew_join(big, dim, "k")
    assert sorted(map(tuple, inner.collect()), key=str) == sorted(map(tuple, big.join(dim, "k").collect()), key=str)


def test_store_is_scanned_once_per_slice(spark, sf_small):
    base = scratch_path(spark, "store")
    fixture(spark, sf_small, "entity_triples").write.parquet(f"{base}/kb")
    fixture(spark, sf_small, "authority_triples").write.parquet(f"{base}/auth")
    store, rows = spark.read.parquet(f"{base}/kb"), A.authority_rows(spark.read.parquet(f"{base}/auth"))
    ids = spark.createDataFrame([("wd:S1",)], "entity string")
    assert _plan(W.property_values(store, ids)).count("FileScan parquet") == 1
    nodes = A.authority_nodes(rows)
    nodes.collect()
    ran = _plan(nodes).split("== Initial Plan ==")[0]  # hot keys are none, so the plan as it ran has no part of them
    assert ran.count("FileScan parquet") == 3  # edges, labels, topics
    assert _plan(W.class_members_top(store)).count("FileScan parquet") <= 2  # the labels; the rest is written once


def test_target_classes_end_on_cycles(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x", "y")], "s string, o string") \
        .withColumn("p", F.lit(W.SUBCLASS_OF))
    assert sorted(r.cls for r in W.subclasses_of(t, "c").collect()) == ["a", "b", "c", "d"]
