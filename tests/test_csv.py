"""CSV folders: records over several lines and blocks, held against the standard library's reader."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from graphwright.session import scratch_path
from graphwright.sources import files as S

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(params=["64b", "1000b", "128m"])
def split(spark, request):
    before = {k: spark.conf.get(k) for k in SPLITS}
    spark.conf.set(SPLITS[0], request.param)
    spark.conf.set(SPLITS[1], "1b")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def folder(spark, *texts):
    base = scratch_path(spark, "csv-test").removeprefix("file:")
    os.makedirs(base)
    for i, t in enumerate(texts):
        with open(f"{base}/part{i}.csv", "w", newline="") as f:
            f.write(t)
    return base


def read(spark, *texts):
    df = S.scan_csv_union(spark, folder(spark, *texts))
    return df.columns, sorted((tuple(None if v is None else str(v) for v in r) for r in df.collect()), key=str)


def test_line_feeds_quotes_and_rows_like_the_header(spark, split):
    got = read(spark, 'a,b\n1,x\na,b\n2,"two\nlines"\n3,"say ""a,b""\na,b\n\nend"\n\n4,z')
    assert got == (["a", "b"], sorted([("1", "x"), ("a", "b"), ("2", "two\nlines"), ("3", 'say "a,b"\na,b\n\nend'), ("4", "z")], key=str))


def test_header_of_two_lines_and_other_line_ends(spark, split):
    got = read(spark, '"a\nb",c\r\n1,"x\r\ny"\r\n"3",z\r\n', "c,d\n5,6\n")
    assert got == (["a\nb", "c", "d"], sorted([("1", "x\r\ny", None), ("3", "z", None), (None, "5", "6")], key=str))


def test_quotes_inside_plain_values_are_plain(spark, split):
    assert read(spark, 'a,b\n5" pipe,x\n6" pipe,y\n') == (["a", "b"], [('5" pipe', "x"), ('6" pipe', "y")])


@pytest.mark.parametrize("seed", range(3))
def test_random_files_equal_the_standard_reader(spark, split, seed):
    rng = random.Random(seed)
    word = lambda: "v" + "".join(rng.choice(['"', ",", "\n", "x", "y", " ", "a,b\n"]) for _ in range(rng.randrange(12)))
    texts, want = [], []
    for n in (0, 1, 40):
        rows = [[word(), word()] for _ in range(n)] + [["a", "b"]] * (n // 9)
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        writer.writerows([["a", "b"], *rows])
        texts.append(out.getvalue())
        want += list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:]
    assert read(spark, *texts) == (["a", "b"], sorted(map(tuple, want), key=str))


def test_states_of_lines_equal_a_reader(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice('",x') for _ in range(rng.randrange(9))) for _ in range(800)]

    def end(line, inside):
        i, start = 0, True
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside = False
            elif c == '"' and start:
                inside = True
            start = not inside and c == ","
            i += 1
        return inside

    df = spark.createDataFrame([(x,) for x in lines], "value string")
    quoted = F.col("value").contains('"')
    got = df.select("value", (quoted & F.col("value").rlike(S.OPENS)).alias("o"), (~quoted | F.col("value").rlike(S.STAYS)).alias("s"))
    for r in got.collect():
        assert (r.o, r.s) == (end(r.value, False), end(r.value, True)), r.value


def test_open_value_at_the_end_is_an_error(spark, split):
    base = folder(spark, "a,b\n1,x\n", 'a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="part1.csv"):
        S.scan_csv_union(spark, base)


def test_long_values(spark, split):
    if split == "64b":
        pytest.skip("one block for each line is enough above")
    text = "word\n" * 40_000
    assert read(spark, f'a,b\n1,"{text}"\n2,{"y" * 200_000}\n') == (["a", "b"], [("1", text), ("2", "y" * 200_000)])


def test_types_are_those_of_the_cast(spark):
    """The shapes of the types rule out no text that a cast takes."""
    rng = random.Random(2)
    texts = ["", " ", "1", "+7", " -12\t", "1.5", "1.", "0x1p3", "1e9", "2f", "3D", "NaN", " infinity", "-INF", "+Infinity", "nAn", "TRUE", " y", "No", "t",
             "2024", "2024-1", "2024-01-02", " 2024-01-02 03:04:05 ", "2024-01-02T03:04:05.1Z", "+2024-01-02", "-2024-1-1", "123", "1234567", "12345678",
             "123456", "1234567-01-01", "294247-01-10", "294247-01-10 04:00:54", "299999", "300000", "-290308", "-300000", "999999", "12:30", "T12:30", "9223372036854775807", "9223372036854775808", "\x7f5\x01", "\u00a05",
             "\u0661", "x", "no 5", "1 2", "--1", "+", ".", "now", "today", "epoch", "null"]
    texts += ["".join(rng.choice("0129+-.:TZeEfdnatruyx \t\n") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "v string")
    v = F.col("v")
    for kind in S.TYPES:
        assert not df.where(S._fits(v, kind) != (v.try_cast(kind).isNotNull() | v.isNull())).collect(), kind


def test_records_of_a_file_are_not_gathered_in_one_task(spark):
    """Files are few and may be large: nothing that holds the records is shuffled by file."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    base = folder(spark, "a,b\n" + "".join(f'{i},"x\ny"\n' if i % 3 else f"{i},z\n" for i in range(300)), "b,a\nq,7\n")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are large
        df = S.scan_csv_union(spark, base)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(file" not in plan
        assert sorted(r.a for r in df.collect()) == sorted([*range(300), 7])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
