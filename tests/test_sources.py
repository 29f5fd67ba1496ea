"""File sources and the language model."""

from pyspark.sql import functions as F

from graphwright.functions.lineage import checkpoint
from graphwright.operators import text as X
from graphwright.session import scratch_path
from graphwright.sources import files as S
from graphwright.sources.tables import table


def test_csv_folder_union_by_name(spark, sf_small):
    base = scratch_path(spark, "csv")
    c = table(spark, sf_small, "customer")
    c.write.option("header", True).csv(base)
    c.drop("c_mktsegment").withColumn("c_note", F.lit("x")).write.mode("append").option("header", True).csv(base)
    df = S.scan_csv_union(spark, base)
    assert set(df.columns) == set(c.columns) | {"c_note"}
    assert dict(df.dtypes)["c_custkey"] in ("int", "bigint")
    n = c.count()
    assert df.count() == 2 * n
    assert df.where(F.col("c_mktsegment").isNull()).count() == n
    assert S.scan_csv_union(spark, base + "-missing") is None


def test_source_precedence_replaces(spark):
    rows = [("d1", "csv", 1, 1), ("d1", "xls", 2, 2), ("d2", "csv", 1, 3)]
    df = spark.createDataFrame(rows, "dataset string, kind string, priority int, v int")
    got = sorted(r["v"] for r in S.source_precedence(df).collect())
    assert got == [2, 3]


def test_language_detection_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = checkpoint(X.lang_model(X.lang_profile(docs.where(~held))))
    found = X.lang_detect(docs.where(held), model)
    assert "Exchange" not in found._jdf.queryExecution().simpleString().split("Subquery")[0]  # one narrow projection
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_detected")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97
    few = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... !"), (4, "the"), (5, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_detected for r in X.lang_detect(few, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [None] * 3 and got[4] == "en" and got[5] is not None


def test_trigrams_equal_plain_python(spark, monkeypatch):
    texts = ["Straße, 3 ÄPFEL!", "a", "", None, "  ab  ", "été-là", "x9y", "12", "Ω𝔘x"]
    want = {}
    for t in texts:
        s = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower())
        s = " " + " ".join(s.split()) + " "
        for x, y, z in zip(s, s[1:], s[2:]):
            key = ((ord(x) * 31337 + ord(y)) * 31337 + ord(z)) % X.LANG_BUCKETS
            want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame([(t, "xx") for t in texts] + [("none", None)], "text string, lang string")
    for most in (1, 9, 1 << 20):
        monkeypatch.setattr(X, "_CHARACTERS", most)
        assert {r.bucket: r.n for r in X.lang_profile(df.coalesce(1)).collect()} == want
    model = X.lang_model(X.lang_profile(df))
    assert [r.lang_detected for r in X.lang_detect(df.coalesce(1), model).collect()] == ["xx", "xx", None, None, "xx", "xx", "xx", None, "xx", "xx"]
    nothing = X.lang_model(X.lang_profile(df.limit(0)))
    assert X.lang_detect(df, nothing).where("lang_detected IS NOT NULL").count() == 0


def test_jobs_catalogue_read_by_spark_matches_driver_parse(spark):
    from importlib import resources

    from graphwright.operators import questions as Q
    path = scratch_path(spark, "jobs") + ".conf"
    text = resources.files("graphwright.resources").joinpath("jobs.conf").read_text("utf-8")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    got = {r["job"]: {k: r[k] for k in Q.JOB_FIELDS} for r in Q.read_jobs(spark, path).collect()}
    assert got == Q.load_jobs()
