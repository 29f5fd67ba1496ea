"""Prompt rendering, table descriptions and the table-question surface.

Prompt jobs are configuration (a few strings per job), read on the driver and
used as literals, so rendering is a projection over the data rows: no join
with a jobs table.  Questions and profiles are single-pass aggregations.
"""

from __future__ import annotations

import configparser
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

JOB_FIELDS = ("action", "instruction", "template", "query")


# --- prompt jobs -------------------------------------------------------------

def load_jobs(path: str | None = None) -> dict[str, dict[str, str]]:
    """Job catalogue ``job -> {action, instruction, template, query}``."""
    text = (open(path, encoding="utf-8").read() if path else
            resources.files("graphwright.resources").joinpath("jobs.conf").read_text("utf-8"))
    cp = configparser.ConfigParser(interpolation=None)
    cp.read_string(text)
    return {s: {k: cp[s].get(k) for k in JOB_FIELDS} for s in cp.sections()}


def jobs_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The catalogue as a small DataFrame ``(job, action, instruction, template, query)``."""
    jobs = load_jobs(path)
    return spark.createDataFrame([(j, *[v[k] for k in JOB_FIELDS]) for j, v in jobs.items()],
                                 "job string, action string, instruction string, template string, query string")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A job catalogue on shared storage read by Spark: whole-file text, one
    row per ``[section]``, fields by ``key = value`` lines."""
    text = spark.read.text(path, wholetext=True)
    sections = F.filter(F.split(F.col("value"), r"\n(?=\[)"), lambda x: F.trim(x).startswith("["))
    sec = text.select(F.explode(sections).alias("sec"))

    def field(k):
        v = F.regexp_extract("sec", rf"(?m)^{k}[ \t]*=[ \t]*([^\n]*)$", 1)
        return F.when(v != "", v).alias(k)

    return sec.select(F.regexp_extract("sec", r"^\s*\[([^\]]+)\]", 1).alias("job"),
                      *[field(k) for k in JOB_FIELDS])


def fill_first(template: Column, value: Column) -> Column:
    """Fill the first ``{}`` slot of a template (positional ``str.format``)."""
    i = F.instr(template, "{}")
    return F.when(i > 0, F.concat(F.substr(template, F.lit(1), i - 1), value,
                                  F.substr(template, i + 2))).otherwise(template)


def prompt_table(ddl: DataFrame, job: dict, question: str | None = None) -> DataFrame:
    """System prompt with table name and column list, user prompt with the
    question (the custom question when given, else the job's own)."""
    system = fill_first(fill_first(F.lit(job["instruction"]), F.col("table_name")), F.col("ddl"))
    q = question if question is not None else job.get("query")
    user = fill_first(F.lit(job["template"]), F.lit(q if q is not None else "None"))
    return ddl.select("table_name", system.alias("system"), user.alias("user"))


def read_prompt(spark: SparkSession, path: str) -> str:
    """The text of a prompt file on shared storage (blanks at its ends removed)."""
    return spark.read.option("wholetext", True).text(path).first()[0].strip()


def prompt_text(rows: DataFrame, job: dict, context_col: str = "context",
                query_col: str = "concept", direct: bool = False,
                custom_prompt: str | None = None) -> DataFrame:
    """Text-form prompts: instruction filled with (context, request), template
    with the job query (``None`` when absent).  ``direct``: both texts are the
    request.  ``custom_prompt``: a system prompt from a file replaces the
    instruction and the user text is the raw request."""
    req = F.col(query_col)
    if custom_prompt is not None:
        system, user = F.lit(custom_prompt), req
    elif direct:
        system, user = req, req
    else:
        system = fill_first(fill_first(F.lit(job["instruction"]), F.col(context_col)), req)
        q = job.get("query")
        user = fill_first(F.lit(job["template"]), F.lit(q if q is not None else "None"))
    return rows.select(query_col, system.alias("system"), user.alias("user"))


def prompt_messages(prompts: DataFrame) -> DataFrame:
    """Chat array ``[{role: system}, {role: user}]``."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("user").alias("content")))
    return prompts.select(*[c for c in prompts.columns if c not in ("system", "user")],
                          msgs.alias("messages"))


# --- table description -------------------------------------------------------

def sql_type(dt) -> str:
    """Spark type -> the SQL type names used in table descriptions."""
    s = dt.simpleString()
    simple = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
              "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
              "binary": "BLOB"}
    if s in simple:
        return simple[s]
    if s.startswith("decimal"):
        return s.upper()
    if s.startswith("array<"):
        return sql_type(dt.elementType) + "[]"
    return s.upper()


def table_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, pos, column_name, column_type)`` from table schemas."""
    rows = [(name, i, f.name, sql_type(f.dataType))
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, pos int, column_name string, column_type string")


def table_ddl(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows, ddl``: ``name TYPE, name TYPE, ...`` in column order; a
    column is ``NOT NULL`` if no row of the table lacks it (one pass per table)."""
    def one(name: str, df: DataFrame) -> DataFrame:
        parts = [F.concat(F.lit(f"{f.name} {sql_type(f.dataType)}"),
                          F.when(F.count(F.col(f"`{f.name}`")) == F.count(F.lit(1)), F.lit(" NOT NULL")).otherwise(F.lit("")))
                 for f in df.schema.fields]
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(", ", *parts).alias("ddl")).select(
            F.lit(name).alias("table_name"), "n_rows", "ddl")
    return union_all([one(n, df) for n, df in tables.items()])


# --- profiles and questions --------------------------------------------------

NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def _is_num(dt) -> bool:
    return dt.simpleString() in NUMERIC or dt.simpleString().startswith("decimal")


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One pass over the table: per column rows, nulls, distinct values
    (HyperLogLog; ``exact=True`` counts the groups of column and value), min, max and mean.

    All per-column aggregates run in one ``agg`` (partial aggregation), the
    single result row is then turned into one row per column."""
    aggs, specs = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        num = _is_num(f.dataType)
        dist = F.lit(None).cast("bigint") if exact else F.approx_count_distinct(c)
        aggs += [F.count(c).alias(f"n{i}"), dist.alias(f"d{i}"),
                 (F.min(c).cast("double") if num else F.lit(None).cast("double")).alias(f"mn{i}"),
                 (F.max(c).cast("double") if num else F.lit(None).cast("double")).alias(f"mx{i}"),
                 (F.round(F.avg(c), 4) if num else F.lit(None).cast("double")).alias(f"av{i}"),
                 (F.lit(None).cast("string") if num else F.min(c).cast("string")).alias(f"ms{i}"),
                 (F.lit(None).cast("string") if num else F.max(c).cast("string")).alias(f"xs{i}")]
        specs.append((i, f))
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    structs = [F.struct(F.lit(f.name).alias("column_name"), F.lit(sql_type(f.dataType)).alias("column_type"),
                        F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"n{i}")).alias("n_nulls"),
                        F.col(f"d{i}").cast("bigint").alias("n_distinct"), F.col(f"mn{i}").alias("min_num"),
                        F.col(f"mx{i}").alias("max_num"), F.col(f"av{i}").alias("avg_num"),
                        F.col(f"ms{i}").alias("min_str"), F.col(f"xs{i}").alias("max_str"))
               for i, f in specs]
    rows = one.select(F.inline(F.array(*structs)))
    if not exact:
        return rows
    columns = rows.columns
    n = value_counts(df, df.columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    rows = rows.drop("n_distinct").join(n, "column_name", "left")
    return rows.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint"))).select(*columns)


def value_counts(df: DataFrame, columns) -> DataFrame:
    """``column_name, value, n`` of the values (as texts) of some columns: one partial
    aggregate, so a hot value is combined map-side."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def question_answers(df: DataFrame) -> DataFrame:
    """Questions the table can answer, each with its answer.

    Numeric columns: average and maximum; text columns: most common value
    (ties: smallest) and number of different values.  Averages and maxima
    come from one aggregation; modes and numbers of values from one grouped count over the text
    columns in long form and a ``min(struct(-n, value))`` per column (a
    partial aggregate, so a hot value is combined map-side)."""
    fields = df.schema.fields
    nums = [f.name for f in fields if _is_num(f.dataType)]
    texts = [f.name for f in fields if f.dataType.simpleString() == "string"]
    aggs = []
    for c in nums:
        aggs += [F.round(F.avg(F.col(c)), 4).alias(f"avg_{c}"), F.max(F.col(c)).cast("double").alias(f"max_{c}")]
    one = df.agg(*aggs or [F.lit(0)])
    qs = []
    for c in nums:
        qs.append(F.struct(F.lit(c).alias("column_name"), F.lit(f"What is the average {c}?").alias("question"),
                           F.col(f"avg_{c}").alias("answer_num"), F.lit(None).cast("string").alias("answer_text")))
        qs.append(F.struct(F.lit(c).alias("column_name"), F.lit(f"What is the maximum {c}?").alias("question"),
                           F.col(f"max_{c}").alias("answer_num"), F.lit(None).cast("string").alias("answer_text")))
    question = lambda *parts: F.concat(*(F.col(p) if p == "column_name" else F.lit(p) for p in parts))
    none = lambda t: F.lit(None).cast(t)
    parts = [one.select(F.inline(F.array(*qs)))] if qs else []
    if texts:
        stats = value_counts(df, texts).groupBy("column_name").agg(
            F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("m"), F.count(F.lit(1)).cast("double").alias("nd"))
        # a column without a value has no most common one
        every = F.explode(F.array(*(F.lit(c) for c in texts))).alias("column_name")
        stats = df.sparkSession.range(1).select(every).join(stats, "column_name", "left")
        parts.append(stats.select("column_name", question("How many different ", "column_name", " are there?").alias("question"),
                                  F.coalesce("nd", F.lit(0.0)).alias("answer_num"), none("string").alias("answer_text")))
        parts.append(stats.where("m IS NOT NULL").select("column_name", question("What is the most common ", "column_name", "?").alias("question"),
                                                         none("double").alias("answer_num"), F.col("m.value").alias("answer_text")))
    return union_all(parts)


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)
