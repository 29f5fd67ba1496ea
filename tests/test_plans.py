"""Plan shape: pushdown, pruning, narrow parsing, no pair explosion."""

from pyspark.sql import functions as F

from graphwright.operators import authority as A, relations as R, replies as P
from graphwright.plans import registry
from graphwright.session import scratch_path
from graphwright.sources.fixtures import fixture
from graphwright.sources.tables import table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_authority_rows_one_scan_with_prefix_pushdown(spark, sf_small):
    path = scratch_path(spark, "triples")
    fixture(spark, sf_small, "authority_triples").write.parquet(path)
    plan = _plan(A.authority_rows(spark.read.parquet(path)))
    assert plan.count("FileScan parquet") == 1
    assert "StringStartsWith(s,http://viaf.org/viaf/)" in plan


def test_question_filters_reach_the_scan(spark, sf_small):
    o = table(spark, sf_small, "orders")
    df = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).agg(F.count("*"))
    plan = _plan(df)
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in plan


def test_reply_parsing_is_narrow(spark, sf_small):
    r = fixture(spark, sf_small, "responses")
    plan = _plan(R.atoms(r))
    assert plan.count("Exchange") == 1  # only the fixture's own; parsing adds none


def test_links_are_linear_in_members(spark, sf_small):
    rows = A.authority_rows(fixture(spark, sf_small, "authority_triples"))
    links = A.authority_links(rows, A.authority_nodes(rows))
    members = A.topic_members(rows).join(A.authority_nodes(rows).select("id"), "id", "left_semi").distinct()
    assert links.count() == members.count()  # one row per member, never per pair


def test_replies_and_their_pieces_are_never_broadcast(spark, sf_small):
    """A few rows in small files here, but the pieces of the replies are many times the files."""
    replies = fixture(spark, sf_small, "replies")
    ctx = table(spark, sf_small, "documents").select(F.col("doc_id").alias("reply_id"), F.col("text").alias("context"), "lang")
    kv = P.reply_kv(replies)
    rec = P.translation_record(replies, kv, ctx)
    assert "Broadcast" not in _plan(rec)
    assert rec.count() == kv.count() > 0
    assert "Broadcast" not in _plan(P.concept_fields(P.cache_concept(rec)))
    assert "Broadcast" not in _plan(registry.queries()["translation_record"](spark, sf_small))
