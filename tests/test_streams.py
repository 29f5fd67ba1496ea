"""Streams with state: equal to the batch after many files, restarts and replays."""

import json
import os

import pytest
from pyspark.sql import functions as F

from graphwright.operators import entities as E, relations as R, triples as T
from graphwright.session import scratch_path
from graphwright.sources.fixtures import fixture
from graphwright.streaming import jobs


def folder(spark, name):
    base = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(base)
    return base


def forget_last_commit(ckpt):
    """As after a failure between the sink's write and the commit of the batch."""
    last = max((n for n in os.listdir(f"{ckpt}/commits") if n.isdigit()), key=int)
    for n in (last, f".{last}.crc"):
        os.remove(f"{ckpt}/commits/{n}")


def arrive(df, base, part):
    """A third of the rows, as files of their own."""
    df.where(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == part).repartition(2).write.mode("append").parquet(f"{base}/in")


def replayed(spark, df, job, name):
    """The job's rows after files that came in three runs, two of which failed at their end."""
    base = folder(spark, name)
    for part in range(3):
        arrive(df, base, part)
        rows = job(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", df.schema, files_per_batch=1)
        if part < 2:
            forget_last_commit(f"{base}/ckpt")
    return sorted(map(tuple, rows.collect()))


def test_counts_equal_the_batch_after_replays(spark, sf_small):
    df = fixture(spark, sf_small, "json_values").select("record_id", "data")
    values = E.identifier_values(df)
    want = sorted((r.value, r["count"]) for r in values.groupBy("value").count().collect())
    assert replayed(spark, df, jobs.stream_identifier_stats, "counts") == want


def test_first_contexts_equal_the_batch_after_replays(spark, sf_small):
    df = fixture(spark, sf_small, "responses")
    want = sorted(map(tuple, R.concept_worklist(R.atoms(df)).select("concept", "doc_id", "uid", "context").collect()))
    assert replayed(spark, df, jobs.stream_concept_worklist, "firsts") == want


def test_graph_equals_the_batch_after_replays(spark, sf_small):
    df = fixture(spark, sf_small, "responses")
    want = sorted(map(tuple, T.kg_skos(R.atoms(df)).select(*T.TRIPLE_COLS).collect()))
    got = replayed(spark, df, jobs.stream_ingest, "graph")
    assert got == want and len(got) == len(set(got))


def test_concepts_are_forgotten_after_their_time(spark):
    reply = lambda c: f'{{\n"concept1": "{c}",\n"concept2": "b",\n"relationship": "related",\n"importance": "1"\n}}'
    base = folder(spark, "timed")
    rows = [[("2024-01-01 00:00:00", "a"), ("2024-01-01 00:10:00", "a")], [("2024-01-01 00:40:00", "a"), ("2024-01-02 00:00:00", "c")],
            [("2024-01-03 00:00:00", "a")]]
    schema = "t timestamp, doc_id long, uid long, sentence string, response string"
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(t, k, i, f"A sentence about {c}, long enough.", reply(c)) for i, (t, c) in enumerate(part)],
                                   "t string, doc_id long, uid long, sentence string, response string")
        df.withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        got = jobs.stream_new_concepts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", spark.createDataFrame([], schema).schema, "t", "1 hour")
    seen = sorted((r.concept, str(r.t)) for r in got.collect())
    assert [s for s in seen if s[0] in "ac"] == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-03 00:00:00"), ("c", "2024-01-02 00:00:00")]
    assert all("A sentence about" in r.context for r in got.collect())


@pytest.mark.parametrize("doc", [
    {"a": "x_1", "b": ["in_list", {"c": "y_2", "d": [["z_3"], {"e": "w_4"}]}], "f": {"g": {"h": "v_5"}}, "n": 5, "t": None},
    {"quo\"te_": "a\"b_\\c", "esc": "tab\t_nl\n_é\U0001f600", "empty": "", "colon": "x:_\"y\": \"z_z\""},
    ["only_list", "a_b"], "text_alone", {}, {"k": ["a_b", "c_d"]}, {"deep": json.loads('{"x":' * 60 + '"low_est"' + "}" * 60)},
])
def test_keyed_strings_equal_a_walk(spark, doc):
    def walk(d):
        if isinstance(d, dict):
            for v in d.values():
                yield from [v] if isinstance(v, str) else walk(v)
        elif isinstance(d, list):
            for v in d:
                if not isinstance(v, str):
                    yield from walk(v)

    for text in (json.dumps(doc), json.dumps(doc, indent=2), json.dumps(doc, ensure_ascii=False, separators=(",", ":"))):
        got = spark.createDataFrame([(text,)], "j string").select(E.keyed_strings(F.col("j")).alias("v")).first().v
        assert got == list(walk(doc)), text


def test_keyed_strings_of_texts_that_are_no_json(spark):
    df = spark.createDataFrame([("{",), (None,), ("",), ('{"a": "b_c"',), ('{"a": "' + "x_" * 200_000 + '"}',)], "j string")
    got = [r.v for r in df.select(E.keyed_strings(F.col("j")).alias("v")).collect()]
    assert got[:4] == [None] * 4 and len(got[4][0]) == 400_000
