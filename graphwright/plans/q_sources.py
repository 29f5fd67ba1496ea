"""Sources: CSV folders, source precedence, JSON documents, local time text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.timefmt import local_time_text
from ..session import scratch_path
from ..sources import files as S
from ..sources.fixtures import fixture
from ..sources.tables import table
from . import duck as D
from .registry import register


@register("scan_csv_union", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL::VARCHAR AS c_note,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS c_ref, CAST(c_custkey AS VARCHAR) AS c_mixed FROM customer
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULL, 'second, "export"' || CASE WHEN c_custkey % 7 = 0 THEN chr(10) || ',x' || chr(10) || '"c_name"' ELSE '' END, NULL, 'no ' || CAST(c_custkey AS VARCHAR) FROM customer""")
def q_scan_csv_union(spark, sf):
    """Write the customer table as two CSV folders with different headers
    (shared scratch folder), then read the folder back aligned by name."""
    base = scratch_path(spark, "csv-parts")
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    first = (c.withColumn("c_ref", F.when(F.col("c_custkey") % 5 == 0, F.lit("N/A")).otherwise(key))
             .withColumn("c_mixed", key))  # numbers here, text in the second export
    opts = {"header": True, "escape": '"'}
    first.write.options(**opts).csv(base)
    # a value of three lines in some rows
    lines = F.when(F.col("c_custkey") % 7 == 0, F.lit('\n,x\n"c_name"')).otherwise("")
    second = c.drop("c_mktsegment").withColumn("c_note", F.concat(F.lit('second, "export"'), lines)).withColumn("c_mixed", F.concat(F.lit("no "), key))
    second.write.mode("append").options(**opts).csv(base)
    return S.scan_csv_union(spark, base)


@register("source_precedence", D.wf(["source_rows"], """
SELECT s.* FROM source_rows s JOIN (SELECT dataset, max(priority) AS priority FROM source_rows GROUP BY 1) b
  ON s.dataset = b.dataset AND s.priority = b.priority"""))
def q_source_precedence(spark, sf):
    return S.source_precedence(fixture(spark, sf, "source_rows"))


@register("dataset_description", D.wf(["dataset_exports"], """
SELECT dataset_id, title, description, concat_ws('. ', title, description) AS text FROM (
  SELECT dataset_id, json_extract_string(export, '$."ore:describes".title') AS title,
    json_extract_string(export, '$."ore:describes"."citation:dsDescription"."citation:dsDescriptionValue"') AS description
  FROM dataset_exports)"""))
def q_dataset_description(spark, sf):
    return S.dataset_description(fixture(spark, sf, "dataset_exports"))


_FLAT = """flat AS (SELECT result_id, CAST(row_ix AS BIGINT) AS row_ix, var,
    json_extract_string(b, '$."' || var || '".value') AS value,
    json_extract_string(b, '$."' || var || '"."xml:lang"') AS lang FROM (
  SELECT result_id, row_ix, b, unnest(json_keys(b)) AS var FROM (
    SELECT result_id, unnest(json_extract(result, '$.results.bindings[*]')) AS b,
           unnest(range(len(json_extract(result, '$.results.bindings[*]')))) AS row_ix FROM sparql_results)))"""


@register("bindings_flatten", D.wf(["sparql_results"], "SELECT * FROM flat", _FLAT))
def q_bindings_flatten(spark, sf):
    return S.bindings_flatten(fixture(spark, sf, "sparql_results"))


@register("bindings_shaped", D.wf(["sparql_results"], """
SELECT result_id, row_ix, max(CASE WHEN var = 'cityLabel' THEN value END) AS name,
       TRY_CAST(max(CASE WHEN var = 'population' THEN value END) AS BIGINT) AS population
FROM flat GROUP BY 1, 2""", _FLAT))
def q_bindings_shaped(spark, sf):
    return S.bindings_shaped(S.bindings_flatten(fixture(spark, sf, "sparql_results")))


@register("local_time_text", f"""
SELECT event_id, strftime(loc, '%a, %d %b %Y %H:%M:%S') || ' ' ||
       CASE WHEN date_diff('minute', ts, loc) = 120 THEN 'CEST' ELSE 'CET' END AS local_text FROM (
  SELECT event_id, ts, timezone('{C.LOCAL_TIME_ZONE}', timezone('UTC', ts)) AS loc FROM events)""")
def q_local_time_text(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", local_time_text(F.col("ts")).alias("local_text"))
