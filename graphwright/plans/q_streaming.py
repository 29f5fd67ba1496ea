"""Streaming jobs run to completion over Parquet parts derived from the tables.

The final state of each job equals a batch result, so the batch oracle text
is reused for the check."""

from __future__ import annotations

from ..session import scratch_path
from ..sources.fixtures import fixture
from ..streaming import jobs as J
from . import duck as D
from .q_entities import _IDV
from .registry import register

def _stage(spark, sf, name):
    """Write a fixture as Parquet parts (the arriving files) to the shared folder."""
    df = fixture(spark, sf, name)
    base = scratch_path(spark, f"stream-{name}")
    df.write.parquet(f"{base}/in")  # a file for each part of the fixture
    return df.schema, base


@register("stream_identifier_stats", D.wf(["json_values"], "SELECT value, count(*) AS n FROM idv GROUP BY value",
                                          _IDV))
def q_stream_identifier_stats(spark, sf):
    schema, base = _stage(spark, sf, "json_values")
    return J.stream_identifier_stats(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", schema)


@register("stream_concept_worklist", D.wf(["responses"], """
SELECT concept, f.doc_id AS doc_id, f.uid AS uid, f.sentence AS context FROM (
  SELECT concept, min({'doc_id': doc_id, 'uid': uid, 'atom_ix': atom_ix, 'side': side, 'sentence': sentence}) AS f
  FROM (SELECT concept1 AS concept, 0 AS side, doc_id, uid, atom_ix, sentence FROM atoms WHERE """ + D.COMPLETE + """
        UNION ALL SELECT concept2, 1, doc_id, uid, atom_ix, sentence FROM atoms WHERE """ + D.COMPLETE + """)
  GROUP BY concept)""", D.atoms_ctes()))
def q_stream_concept_worklist(spark, sf):
    schema, base = _stage(spark, sf, "responses")
    return J.stream_concept_worklist(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", schema)


@register("stream_ingest", D.wf(["responses"], "SELECT * FROM " + D.skos_sql(True), D.atoms_ctes()))
def q_stream_ingest(spark, sf):
    schema, base = _stage(spark, sf, "responses")
    return J.stream_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", schema)
