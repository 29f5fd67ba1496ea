"""Profiles that merge: equal to one pass over everything, within the stated bounds."""

from collections import Counter

from pyspark.sql import functions as F

from graphwright.operators import profiles as P, questions as Q
from graphwright.session import scratch_path
from graphwright.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_states_equal_the_exact_profile_within_bounds(spark, sf_small):
    li = table(spark, "/root/testdata/sf0.01", "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", "l_partkey")
    df = li.withColumn("word", F.concat(F.lit("w"), (F.col("l_orderkey") % 10).cast("string")))
    rows = df.collect()
    states = P.column_states(df.withColumn("part", F.col("l_partkey") % 7), "part")
    assert states.count() == 7 * 6 and "Expand" not in plan(states)
    got = {r.column_name: r for r in P.profile(states, (0.1, 0.5, 0.9)).collect()}
    exact = {r.column_name: r for r in Q.table_profile(df, exact=True).collect()}
    for name, e in exact.items():
        g = got[name]
        assert (g.column_type, g.n_rows, g.n_nulls, g.min_num, g.max_num, g.min_str, g.max_str) == \
            (e.column_type, e.n_rows, e.n_nulls, e.min_num, e.max_num, e.min_str, e.max_str)
        assert abs(g.n_distinct - e.n_distinct) <= 3 * 1.04 / 64 * e.n_distinct + 1
        assert e.avg_num is None or abs(g.avg_num - e.avg_num) < 1e-3 * abs(e.avg_num)
        values = sorted(r[name] for r in rows)
        if e.min_num is not None:
            for q, v in zip((0.1, 0.5, 0.9), g.quantiles):
                at = [i for i, x in enumerate(values) if x == v]
                assert at[0] - 0.02 * len(values) <= q * len(values) <= at[-1] + 0.02 * len(values), (name, q)
        else:
            assert g.quantiles is None
    count = Counter(r.word for r in rows)
    for item in got["word"].most_common:
        assert abs(item["count"] - count[item["item"]]) <= len(rows) / P.TRACKED
    assert {i["item"] for i in got["l_returnflag"].most_common} == {r.l_returnflag for r in rows}


def test_exact_profiles_repeat_no_rows(spark, sf_small):
    c = table(spark, sf_small, "customer")
    assert "Expand" not in plan(Q.table_profile(c, exact=True)) and "Expand" not in plan(Q.question_answers(c))
    odd = spark.createDataFrame([(1, None, None), (2, None, "x"), (None, None, "x"), (None, None, "b")], "a long, n string, t string")
    got = {r.column_name: (r.n_rows, r.n_nulls, r.n_distinct) for r in Q.table_profile(odd, exact=True).collect()}
    assert got == {"a": (4, 2, 2), "n": (4, 4, 0), "t": (4, 1, 2)}
    asked = {r.question: (r.answer_num, r.answer_text) for r in Q.question_answers(odd).collect()}
    assert asked["How many different n are there?"] == (0.0, None) and asked["What is the most common t?"] == (None, "x")
    assert "What is the most common n?" not in asked and asked["What is the maximum a?"] == (2.0, None)


def test_appended_files_are_profiled_alone(spark):
    base = scratch_path(spark, "profiled")
    make = lambda low, high: spark.range(low, high).select("id", (F.col("id") % 5).cast("string").alias("k"))
    make(0, 100).repartition(3).write.parquet(f"{base}/in")
    first = P.refresh(spark, f"{base}/in", f"{base}/store")
    n = first.select("file").distinct().count()
    make(100, 150).coalesce(1).write.mode("append").parquet(f"{base}/in")
    states = P.refresh(spark, f"{base}/in", f"{base}/store")
    assert states.select("file").distinct().count() == n + 1 and states.count() == 2 * (n + 1)
    again = P.refresh(spark, f"{base}/in", f"{base}/store")
    assert again.count() == states.count()
    got = {r.column_name: r for r in P.profile(again).collect()}
    assert (got["id"].n_rows, got["id"].min_num, got["id"].max_num, got["id"].n_distinct, got["k"].n_distinct) == (150, 0, 149, 150, 5)


def test_states_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None, None)], "a long, b string, c double")
    got = {r.column_name: r for r in P.profile(P.column_states(df)).collect()}
    assert all((r.n_rows, r.n_nulls, r.n_distinct, r.avg_num, r.quantiles, r.most_common) == (1, 1, 0, None, None, None) for r in got.values())
    assert P.profile(P.column_states(df.limit(0))).first().n_rows == 0
