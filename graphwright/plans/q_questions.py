"""Table questions, profiles, descriptions and prompt rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P, questions as Q, relations as R
from ..session import scratch_path
from ..sources.fixtures import fixture
from ..sources.tables import TABLES, table
from . import duck as D
from .registry import register

JOBS = Q.load_jobs()


def _lit(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _fill_sql(t: str, v: str) -> str:
    return (f"CASE WHEN strpos({t}, '{{}}') > 0 THEN substr({t}, 1, strpos({t}, '{{}}') - 1) || {v} || "
            f"substr({t}, strpos({t}, '{{}}') + 2) ELSE {t} END")


# --- documented questions (Q1-Q9) --------------------------------------------

@register("q_count_eq", """SELECT count(*) AS n FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def q_count_eq(spark, sf):
    o = table(spark, sf, "orders")
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")) \
        .agg(F.count("*").alias("n"))


@register("q_after_space", "SELECT * FROM part WHERE substr(p_name, strpos(p_name, ' ') + 1) = 'ring'")
def q_after_space(spark, sf):
    p = table(spark, sf, "part")
    return p.where(F.substr("p_name", F.instr("p_name", " ") + 1) == "ring")


@register("q_avg_filter", """SELECT round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS avg_one,
  round(avg(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice END), 4) AS avg_two
FROM orders""")
def q_avg_filter(spark, sf):
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus") == "O"
    return o.agg(F.round(F.avg(F.when(st, F.col("o_totalprice"))), 4).alias("avg_one"),
                 F.round(F.avg(F.when(st & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_totalprice"))), 4)
                 .alias("avg_two"))


@register("q_count_cmp", """SELECT count(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 1 END) AS n_cmp,
  count(CASE WHEN l_tax = l_discount THEN 1 END) AS n_same FROM lineitem""")
def q_count_cmp(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.agg(F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), 1)).alias("n_cmp"),
                 F.count(F.when(F.col("l_tax") == F.col("l_discount"), 1)).alias("n_same"))


@register("q_mode", """SELECT n_name, m.value AS c_mktsegment, -m.k AS n FROM (
  SELECT n_name, min({'k': -n, 'value': c_mktsegment}) AS m FROM (
    SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL) GROUP BY n_name)""")
def q_mode(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    counts = c.join(F.broadcast(n), "c_nationkey").groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))
    m = counts.groupBy("n_name").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("c_mktsegment")
                                                    .alias("value"))).alias("m"))
    return m.select("n_name", F.col("m.value").alias("c_mktsegment"), (-F.col("m.k")).alias("n"))


@register("q_count_avg", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_acctbal
FROM customer GROUP BY c_mktsegment""")
def q_count_avg(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_acctbal"))


@register("q_max_filter", "SELECT max(o_totalprice) AS max_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_max_filter(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT") \
        .agg(F.max("o_totalprice").alias("max_totalprice"))


@register("q_total_eq", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_total_eq(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").agg(F.count("*").alias("n"))


@register("q_range_count", """SELECT count(*) AS n FROM orders
WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'O'""")
def q_range_count(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_totalprice").between(100000, 200000)
                                            & (F.col("o_orderstatus") == "O")).agg(F.count("*").alias("n"))


# --- profile and question list (Q10, Q11) ------------------------------------

def _profile_sql(t: str, cols) -> str:
    parts = []
    for name, typ, num in cols:
        mn = f"CAST(min({name}) AS DOUBLE)" if num else "NULL::DOUBLE"
        mx = f"CAST(max({name}) AS DOUBLE)" if num else "NULL::DOUBLE"
        av = f"round(avg({name}), 4)" if num else "NULL::DOUBLE"
        ms = "NULL::VARCHAR" if num else f"CAST(min({name}) AS VARCHAR)"
        xs = "NULL::VARCHAR" if num else f"CAST(max({name}) AS VARCHAR)"
        parts.append(f"SELECT '{name}' AS column_name, '{typ}' AS column_type, count(*) AS n_rows, "
                     f"count(*) - count({name}) AS n_nulls, count(DISTINCT {name}) AS n_distinct, {mn} AS min_num, "
                     f"{mx} AS max_num, {av} AS avg_num, {ms} AS min_str, {xs} AS max_str FROM {t}")
    return "\nUNION ALL ".join(parts)


_CUSTOMER = [("c_custkey", "BIGINT", True), ("c_name", "VARCHAR", False), ("c_nationkey", "INTEGER", True),
             ("c_acctbal", "DOUBLE", True), ("c_mktsegment", "VARCHAR", False)]


@register("table_profile", _profile_sql("customer", _CUSTOMER))
def q_table_profile(spark, sf):
    return Q.table_profile(table(spark, sf, "customer"), exact=True)


_LINEITEM = [tuple(c.split(" ")) for c in
             "l_orderkey BIGINT, l_quantity DOUBLE, l_linestatus VARCHAR, l_shipdate TIMESTAMP".split(", ")]


@register("profile_states", "\nUNION ALL ".join(f"""SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) AS n_rows,
  count(*) - count({c}) AS n_nulls, {f'CAST(min({c}) AS DOUBLE)' if n else 'NULL::DOUBLE'} AS min_num,
  {f'CAST(max({c}) AS DOUBLE)' if n else 'NULL::DOUBLE'} AS max_num,
  {'NULL' if n else f'CAST(min({c}) AS VARCHAR)'} AS min_str, {'NULL' if n else f'CAST(max({c}) AS VARCHAR)'} AS max_str,
  true AS near FROM lineitem""" for c, t in _LINEITEM for n in (t in ("BIGINT", "DOUBLE"),)))
def q_profile_states(spark, sf):
    """States of the parts of a table, merged; ``near``: the number of distinct values is
    within three standard errors."""
    li = table(spark, sf, "lineitem").select("l_returnflag", *(c for c, _ in _LINEITEM))
    found = P.profile(P.column_states(li, "l_returnflag"))
    n = Q.value_counts(li, [c for c, _ in _LINEITEM]).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    near = F.abs(F.col("n_distinct") - F.col("n")) <= 3 * 1.04 / 64 * F.col("n") + 1
    return found.join(n, "column_name").select("column_name", "column_type", "n_rows", "n_nulls", "min_num", "max_num", "min_str", "max_str", near.alias("near"))


def _qa_sql():
    parts = []
    for name, _, num in _CUSTOMER:
        if num:
            parts.append(f"SELECT '{name}' AS column_name, 'What is the average {name}?' AS question, "
                         f"round(avg({name}), 4) AS answer_num, NULL::VARCHAR AS answer_text FROM customer")
            parts.append(f"SELECT '{name}', 'What is the maximum {name}?', CAST(max({name}) AS DOUBLE), NULL FROM customer")
        else:
            parts.append(f"SELECT '{name}', 'How many different {name} are there?', "
                         f"CAST(count(DISTINCT {name}) AS DOUBLE), NULL FROM customer")
            parts.append(f"SELECT '{name}', 'What is the most common {name}?', NULL, m.value FROM ("
                         f"SELECT min({{'k': -n, 'value': v}}) AS m FROM (SELECT {name} AS v, count(*) AS n "
                         f"FROM customer WHERE {name} IS NOT NULL GROUP BY 1))")
    return "\nUNION ALL ".join(parts)


@register("question_answers", _qa_sql())
def q_question_answers(spark, sf):
    return Q.question_answers(table(spark, sf, "customer"))


# --- table description and prompts (T15-T19, S4) ----------------------------

# Columns of the given tables, for the second engine.
_TABLES = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
              "o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}


def _ddl_sql(t: str, cols) -> str:
    parts = " || ', ' || ".join(f"'{c[0]} {c[1]}' || CASE WHEN count({c[0]}) = count(*) THEN ' NOT NULL' ELSE '' END" for c in cols)
    return f"SELECT '{t}' AS table_name, count(*) AS n_rows, {parts} AS ddl FROM {t}"


_DDL_SQL = "\nUNION ALL ".join(_ddl_sql(t, [c.split(" ") for c in cols.split(", ")]) for t, cols in _TABLES.items())


def _ddl(spark, sf):
    return Q.table_ddl({t: table(spark, sf, t) for t in TABLES})


@register("table_ddl", _DDL_SQL)
def q_table_ddl(spark, sf):
    return _ddl(spark, sf)


_SQLJOB = JOBS["sql_generator"]


@register("prompt_table", f"""SELECT table_name, {_fill_sql(_fill_sql(_lit(_SQLJOB['instruction']), 'table_name'), 'ddl')}
  AS system, {_fill_sql(_lit(_SQLJOB['template']), _lit(_SQLJOB['query']))} AS user FROM ({_DDL_SQL})""")
def q_prompt_table(spark, sf):
    return Q.prompt_table(_ddl(spark, sf), _SQLJOB)


_TR = JOBS["translate"]
_WORK = D.atoms_ctes() + """,
work AS (SELECT concept, f.sentence AS context FROM (
  SELECT concept, min({'doc_id': doc_id, 'uid': uid, 'atom_ix': atom_ix, 'side': side, 'sentence': sentence}) AS f
  FROM (SELECT concept1 AS concept, 0 AS side, doc_id, uid, atom_ix, sentence FROM atoms WHERE """ + D.COMPLETE + """
        UNION ALL SELECT concept2, 1, doc_id, uid, atom_ix, sentence FROM atoms WHERE """ + D.COMPLETE + """)
  GROUP BY concept))"""


def _work(spark, sf):
    return R.concept_worklist(R.atoms(fixture(spark, sf, "responses")))


@register("prompt_text", D.wf(["responses"], f"""
SELECT concept, {_fill_sql(_fill_sql(_lit(_TR['instruction']), 'context'), 'concept')} AS system,
       {_fill_sql(_lit(_TR['template']), _lit('None' if _TR['query'] is None else _TR['query']))} AS user
FROM work""", _WORK))
def q_prompt_text(spark, sf):
    return Q.prompt_text(_work(spark, sf), _TR)


@register("prompt_direct", D.wf(["responses"], "SELECT concept, concept AS system, concept AS user FROM work", _WORK))
def q_prompt_direct(spark, sf):
    return Q.prompt_text(_work(spark, sf), _TR, direct=True)


CUSTOM_PROMPT = "You extract concepts and their relations from a sentence and answer in JSON."


def _prompt_file(spark) -> str:
    """A custom prompt in a file of the shared folder."""
    path = scratch_path(spark, "custom-prompt")
    spark.range(1).select(F.lit(CUSTOM_PROMPT).alias("value")).coalesce(1).write.text(path)
    return path


@register("custom_prompt_override", D.wf(["responses"], f"SELECT concept, {_lit(CUSTOM_PROMPT)} AS system, "
                                                         "concept AS user FROM work", _WORK))
def q_custom_prompt_override(spark, sf):
    return Q.prompt_text(_work(spark, sf), _TR, custom_prompt=Q.read_prompt(spark, _prompt_file(spark)))


@register("prompt_messages", D.wf(["responses"], f"""
SELECT concept, pos, role, content FROM (
  SELECT concept, 0 AS pos, 'system' AS role, {_fill_sql(_fill_sql(_lit(_TR['instruction']), 'context'), 'concept')} AS content FROM work
  UNION ALL SELECT concept, 1, 'user', {_fill_sql(_lit(_TR['template']), _lit('None' if _TR['query'] is None else _TR['query']))}
  FROM work)""", _WORK))
def q_prompt_messages(spark, sf):
    """The messages of every chat array, one row each."""
    chat = Q.prompt_messages(Q.prompt_text(_work(spark, sf), _TR))
    return chat.select("concept", F.posexplode("messages").alias("pos", "m")).select("concept", "pos", "m.role", "m.content")
