"""The triple store: equal to the plain operators, its layout in plans, hashes that clash."""

import re

import pytest
from pyspark.sql import functions as F

from graphwright.functions import joins as J
from graphwright.operators import store as S, wikidata as W
from graphwright.sources.fixtures import fixture
from graphwright.sources.tables import table


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(map(str, r)) for r in df.select(*names).collect()))


@pytest.fixture(scope="module")
def triples(spark, sf_small):
    return fixture(spark, sf_small, "entity_triples")


@pytest.fixture(scope="module")
def classes(spark, sf_small):
    return table(spark, sf_small, "supplier").select(F.concat(F.lit("wd:S"), F.col("s_suppkey").cast("string")).alias("entity"))


@pytest.fixture(scope="module")
def store(triples):
    st = S.build(triples)
    yield st
    st.drop()


def same(store, triples, classes):
    assert rows(store.describe(classes)) == rows(W.entity_describe(triples, classes))
    assert rows(store.property_values(classes)) == rows(W.property_values(triples, classes))
    assert rows(store.external_id_reverse()) == rows(W.external_id_reverse(triples))
    assert rows(store.external_id_describe()) == rows(W.external_id_describe(triples))
    assert rows(store.label_fallback()) == rows(W.label_fallback(triples))
    for target in ("wd:Q515", "wd:N7", "wd:nothing"):
        assert rows(store.class_members_top(target)) == rows(W.class_members_top(triples, target))


def test_store_equals_the_plain_operators(store, triples, classes):
    same(store, triples, classes)
    name = triples.where((F.col("p") == W.LABEL) & (F.col("lang") == "en") & F.col("s").startswith("wd:C")).orderBy("s").first().o
    assert rows(store.class_members_top(location=name)) == rows(W.class_members_top(triples, location=name))
    assert store.clashes is None


def test_terms_that_share_a_hash_get_ids_of_their_own(triples, classes, monkeypatch):
    monkeypatch.setattr(S, "term_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(40)))
    few = triples.where(F.coalesce(F.regexp_extract("s", r"(\d+)$", 1).try_cast("int"), F.lit(0)) < 30)
    st = S.build(few, buckets=3)
    n = st.terms.count()
    assert st.clashes.count() > n / 2 and st.terms.select("id").distinct().count() == n
    same(st, few, classes)
    st.drop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_is_read_in_its_layout(spark, store):
    star = store.slice(W.POPULATION, o="a").join(store.slice(W.COORDINATES, o="b"), "s").join(store.slice(W.INSTANCE_OF, o="c"), "s")
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    try:
        named = star.join(store.names().select(F.col("id").alias("s"), "label"), "s")
        for df in (star, named, store.names(), store.triples.groupBy("s", "o").count()):
            assert "Exchange" not in plan(df)
        assert len(re.findall(r"PartitionFilters: \[[^\]]*\(p#\d+ = wdt:P", plan(star))) == 3
        assert "SelectedBucketsCount" in plan(star)
        # only the ids that are asked for are shuffled
        ids = spark.createDataFrame([("wd:S1",)], "entity string")
        told = plan(store.statements(ids))
        assert told.count("Exchange hashpartitioning") <= 2 and not re.search(r"Exchange[^\n]*\n[^\n]*\n?[^\n]*FileScan parquet[^\n]*store_triples", told)
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)


def test_store_of_odd_triples(spark):
    t = spark.createDataFrame([("a", "p", None, None), ("a", "p", "b", "en"), (None, "p", "x", ""), ("c", None, "x", ""),
                               ("b", W.LABEL, "Label", "en"), ("b", W.LABEL, "Other", "en"), ("a", "p", "b", "en"), ("", "q/ü =", "", "")],
                              "s string, p string, o string, lang string")
    st = S.build(t)
    got = rows(st.describe(spark.createDataFrame([("a",), ("a",), ("",), (None,), ("zzz",)], "entity string")))
    clean = t.where("s IS NOT NULL AND p IS NOT NULL")
    assert got == rows(W.entity_describe(clean, spark.createDataFrame([("a",), ("",)], "entity string")))
    st.drop()
    empty = S.build(t.limit(0))
    assert empty.label_fallback().count() == 0 and empty.class_members_top().count() == 0
    empty.drop()


def test_no_job_runs_while_a_skewed_join_is_planned(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "skewed join")
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = J.skew_join(J.skew_join(big, dim, "k"), dim.withColumnRenamed("v", "w"), "k", "left", counted=big)
    assert not tracker.getJobIdsForGroup("planning")
    assert joined.count() == 1000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_keys_are_bounded_by_their_share(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_ROWS", 1)
    monkeypatch.setattr(J, "HOT_SHARE", 10)
    counts = spark.range(100).select("id", (F.col("id") % 7 * 100 + 1).alias("_n"))
    hot = J.hot_keys(counts, ["id"])
    assert hot.count() == 0
    one = counts.unionByName(spark.createDataFrame([(1000, 500_000)], "id long, _n long"))
    assert [r.id for r in J.hot_keys(one, ["id"]).collect()] == [1000]
