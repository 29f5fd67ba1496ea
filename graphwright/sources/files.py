"""File sources: a folder of CSV parts, source precedence, JSON documents."""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.lineage import checkpoint, written
from ..session import exists


# Words that stand for a missing value in delimited files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Types in the order they are tried, each with a shape that every text of it has.  The cast decides, but
# one that fails throws inside: texts of another shape are not tried.  Timestamps end in the year 294247.
_BLANK = r"[\x00-\x20\x7f]*+"
TYPES = {
    "bigint": rf"\A{_BLANK}[+-]?[0-9]++{_BLANK}\z",
    "double": r"\A[0-9a-fA-FxXpPiInNtTyY.+\-\x00-\x20\x7f]*+\z",
    "boolean": rf"(?i)\A{_BLANK}(?:t|true|y|yes|1|f|false|n|no|0){_BLANK}\z",
    "timestamp_ntz": rf"\A{_BLANK}[+-]?(?:[0-9]{{4,5}}|[0-2][0-9]{{5}})(?:-|{_BLANK}\z)",
}

# A line is a map of two states, outside and inside a quoted value, to the state at its end.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
OPENS = rf'^{_FIELDS}"{_INSIDE}$'  # begun outside, ends inside
STAYS = rf'^{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?+$'  # begun inside, ends inside
_LINES = "file string, block bigint, at bigint, value string, opens boolean, stays boolean"
_PLACED = _LINES + ", in_out boolean, in_in boolean, head_out bigint, head_in bigint"


def _line_placer():
    """Adds to each line, in the order of its block: whether it begins inside a quoted
    value, and the ``at`` of the line that its record began with (-1: in an earlier block),
    both for a block that begins outside and for one that begins inside a value."""
    names = [f.split()[0] for f in _PLACED.split(", ")]

    def place(batches):
        block, state, head = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            at, opens, stays = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5))
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            inside, heads = np.empty((2, len(keys)), bool), np.empty((2, len(keys)), np.int64)
            for low, high in zip(cuts, cuts[1:]):
                if keys[low] != block:
                    block, state, head = keys[low], [False, True], [-1, -1]
                o, s = opens[low:high], stays[low:high]
                nth = np.arange(1, high - low + 1)
                fixed = np.maximum.accumulate(np.where(o == s, nth, 0))  # last line that forgets the state before
                turns = np.r_[0, np.cumsum(o & ~s)]
                for h in (0, 1):
                    known = np.where(fixed > 0, o[fixed - 1], state[h])
                    after = known ^ ((turns[1:] - turns[fixed]) % 2 == 1)
                    begin = np.r_[state[h], after[:-1]]
                    inside[h, low:high] = begin
                    last = np.maximum.accumulate(np.where(begin, 0, nth))
                    heads[h, low:high] = np.where(last > 0, at[low:high][last - 1], head[h])
                    state[h], head[h] = bool(after[-1]), int(heads[h, high - 1])
            columns = [*b.columns, *(pa.array(x) for x in (*inside, *heads))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return place


def _joined_records(lines: DataFrame) -> DataFrame:
    """``file, block, at, value`` of the records of files in which a value holds a line feed.

    Each block is scanned alone for both states it may begin in; windows over the one
    row of each block then give the state and the open record that it does begin with, so
    files stay splittable.  Only lines of records with several lines are shuffled."""
    placed = lines.mapInArrow(_line_placer(), _PLACED)
    ends = lambda h, inside: F.when(F.col(inside), F.col("stays")).otherwise(F.col("opens"))
    last = F.struct(ends(0, "in_out").alias("e0"), ends(1, "in_in").alias("e1"), "head_out", "head_in")
    blocks = checkpoint(placed.groupBy("file", "block").agg(F.max_by(last, "at").alias("z")).select("file", "block", "z.*"))
    by = Window.partitionBy("file").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks.withColumn("turns", F.sum(((~F.col("e1")) & F.col("e0")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("fixed", F.when(F.col("e0") == F.col("e1"), F.struct("e0", "turns")))
              .withColumn("fixed", F.last("fixed", True).over(before))
              .withColumn("turned", F.coalesce(F.lag("turns").over(by), F.lit(0)) - F.coalesce("fixed.turns", F.lit(0)))
              .withColumn("inside", F.coalesce("fixed.e0", F.lit(False)) != (F.col("turned") % 2 == 1)))
    end = F.when(F.col("inside"), F.col("e1")).otherwise(F.col("e0"))
    head = F.when(F.col("inside"), F.col("head_in")).otherwise(F.col("head_out"))
    blocks = (blocks.withColumn("end", end).withColumn("open", F.when(F.col("end") & (head >= 0), head))
              .withColumn("open", F.last("open", True).over(before)))
    wrong = blocks.groupBy("file").agg(F.max_by("end", "block").alias("end")).where("end").first()
    if wrong:
        raise ValueError(f"{wrong.file}: the file ends inside a quoted value")
    # one row per block that begins inside a value, fewer than the blocks that the driver deals out
    lines = placed.join(F.broadcast(blocks.where("inside").select("file", "block", "open")), ["file", "block"], "left")
    inside = F.when(F.col("open").isNull(), F.col("in_out")).otherwise(F.col("in_in"))
    head = F.when(F.col("open").isNull(), F.col("head_out")).when(F.col("head_in") >= 0, F.col("head_in")).otherwise(F.col("open"))
    lines = lines.select("file", "block", "at", "value", inside.alias("inside"), head.alias("head"),
                         F.when(inside, F.col("stays")).otherwise(F.col("opens")).alias("goes_on"))
    parts = lines.where("inside OR goes_on").groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("l"))
    parts = parts.select("file", F.col("l")[0]["block"].alias("block"), F.col("head").alias("at"),
                         F.array_join(F.col("l.value"), "\n").alias("value"))
    return lines.where("NOT inside AND NOT goes_on").select("file", "block", "at", "value").unionByName(parts)


def csv_records(spark: SparkSession, folder: str, marker: str = ".csv") -> tuple[DataFrame, DataFrame] | None:
    """Records of every file whose name contains ``marker`` (``file, block, at, value``), and
    each file's first one (``file, at, header``); None when there is no line.  A record
    ends at a line feed (a carriage return before it goes) outside quoted values.  A value is quoted if it begins
    with a quote; quotes inside are doubled.  A file that ends inside a value is an error."""
    lines = (spark.read.option("pathGlobFilter", f"*{marker}*").option("lineSep", "\n").text(folder)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("at"), "value"))
    quoted, line = F.col("value").contains('"'), F.rtrim(F.col("value"), F.lit("\r"))
    lines = lines.withColumn("opens", quoted & line.rlike(OPENS)).withColumn("stays", ~quoted | line.rlike(STAYS))
    files = lines.groupBy("file").agg(F.max("opens").alias("joins"), F.min(F.when(F.col("block") == 0, F.struct("at", "value"))).alias("h"))
    files = checkpoint(files)
    if not files.first():
        return None
    heads = files.select("file", "h.at", F.col("h.value").alias("header"))
    records = lines.select("file", "block", "at", "value")
    if files.where("joins").first():  # a line that opens a value somewhere
        # written once, as headers, types and rows are read from them
        records = written(_joined_records(lines.select("file", "block", "at", "value", "opens", "stays")), "csv-records")
        first = records.where("block = 0").groupBy("file").agg(F.min(F.struct("at", "value")).alias("h"))
        heads = checkpoint(first.select("file", "h.at", F.col("h.value").alias("header")))
    strip = lambda c: F.regexp_replace(c, "\r$", "")
    return records.withColumn("value", strip("value")), heads.withColumn("header", strip("header"))


def _cells(value: Column, width: int) -> Column:
    """Cells ``c0``, ``c1``, ... of a record.  They stay a struct: an array of them would be
    folded into its readers, each of which would parse the record again."""
    return F.from_csv(value, F.lit(", ".join(f"c{i} string" for i in range(width))),
                      {"mode": "PERMISSIVE", "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})


def _fits(text: Column, kind: str) -> Column:
    """Whether a text can be cast to a type of ``TYPES``; true for null."""
    return F.when(text.rlike(TYPES[kind]), text.try_cast(kind).isNotNull()).otherwise(text.isNull())


def scan_csv_union(spark: SparkSession, folder: str, marker: str = ".csv") -> DataFrame | None:
    """Every file of a folder whose name contains ``marker``: cells aligned by the
    column names of each file's first record (a missing column is null), words of
    ``MISSING`` null, one type per column over the whole folder (integer, number,
    truth value, timestamp, else text).  Quoted values may hold line feeds; rows that equal the header
    are rows.  Null when no file matches.

    Records, headers and types are read by Spark; the driver gets the headers
    that differ from one another and one row of type flags."""
    if not exists(spark, folder):
        return None
    found = csv_records(spark, folder, marker)
    if found is None:
        return None
    records, heads = found
    kinds = [r.header for r in heads.select("header").distinct().collect()]  # as many as distinct headers
    names_of = {k: next(csv.reader([k]), []) if "\n" not in k else next(csv.reader(k.splitlines(True))) for k in kinds}
    names = list(dict.fromkeys(n for k in sorted(kinds) for n in names_of[k]))
    width = max(map(len, names_of.values()))
    if not width:
        return None
    # the header is known by its place, so rows that equal it stay; one small row per file, as in the
    # listing that the driver holds (a shuffle by file would read all records of a file in one task)
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("header"))
    files = heads.select("file", F.col("at").alias("head_at"), number.alias("kind"))
    body = (records.join(F.broadcast(files), "file")
            .where((F.col("at") != F.col("head_at")) & (F.col("value") != "")))
    rows = body.withColumn("cells", _cells(F.col("value"), width))
    place = {n: [(k, names_of[h].index(n)) for k, h in enumerate(kinds, 1) if n in names_of[h]] for n in names}
    cols = []
    for n in names:
        cell = None
        for k, i in place[n]:
            cond, val = F.col("kind") == k, F.col("cells")[f"c{i}"]
            cell = F.when(cond, val) if cell is None else cell.when(cond, val)
        cols.append(F.when(~cell.isin(*MISSING), cell).alias(n))
    texts = rows.select(*cols)
    flags = [F.coalesce(F.min(_fits(F.col(f"`{n}`"), t)), F.lit(False)).alias(f"f{i}_{j}")
             for i, n in enumerate(names) for j, t in enumerate(TYPES)]
    some = [F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)]
    fits = texts.agg(*flags, *some).first()
    out = []
    for i, n in enumerate(names):
        kind = next((t for j, t in enumerate(TYPES) if fits[f"f{i}_{j}"]), "string") if fits[f"n{i}"] else "string"
        out.append(F.col(f"`{n}`").cast(kind).alias(n))
    return texts.select(*out)


def source_precedence(sources: DataFrame, dataset_col: str = "dataset",
                      priority_col: str = "priority") -> DataFrame:
    """Keep, per dataset, only the rows of its highest-priority source kind
    (a later kind replaces an earlier one instead of being appended)."""
    best = sources.groupBy(dataset_col).agg(F.max(priority_col).alias(priority_col))
    # one row per dataset: AQE broadcasts it on its measured size
    return sources.join(best, [dataset_col, priority_col], "left_semi")


def dataset_description(exports: DataFrame, json_col: str = "export") -> DataFrame:
    """Title and description of a dataset-export document, and
    ``title + ". " + description``."""
    d = F.col(json_col)
    title = F.get_json_object(d, "$['ore:describes']['title']")
    desc = F.get_json_object(d, "$['ore:describes']['citation:dsDescription']['citation:dsDescriptionValue']")
    return exports.select("*", title.alias("title"), desc.alias("description")) \
        .withColumn("text", F.concat_ws(". ", "title", "description")).drop(json_col)


BINDING = "struct<type:string, value:string, `xml:lang`:string>"


def bindings_flatten(results: DataFrame, id_col: str = "result_id", json_col: str = "result") -> DataFrame:
    """Query-service JSON results to rows ``(id, row_ix, var, value, lang)``."""
    j = F.from_json(F.col(json_col), f"struct<results:struct<bindings:array<map<string,{BINDING}>>>>")
    rows = results.select(id_col, F.posexplode_outer(j["results"]["bindings"]).alias("row_ix", "b")) \
        .where(F.col("row_ix").isNotNull())
    return rows.select(id_col, F.col("row_ix").cast("bigint").alias("row_ix"),
                       F.explode("b").alias("var", "cell")) \
        .select(id_col, "row_ix", "var", F.col("cell.value").alias("value"),
                F.col("cell.`xml:lang`").alias("lang"))


def bindings_shaped(flat: DataFrame, id_col: str = "result_id", name_var: str = "cityLabel",
                    number_var: str = "population") -> DataFrame:
    """``(name, population)`` per result row; the number is cast when it can be."""
    return flat.groupBy(id_col, "row_ix").agg(
        F.max(F.when(F.col("var") == name_var, F.col("value"))).alias("name"),
        F.max(F.when(F.col("var") == number_var, F.col("value"))).try_cast("bigint").alias("population"))
