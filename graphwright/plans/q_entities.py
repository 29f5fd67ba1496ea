"""Identifier statistics, NER metadata, JSON-LD, cache records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import cache as K, entities as E, relations as R
from ..sources.fixtures import fixture
from ..sources.tables import table
from . import duck as D
from .q_relations import _FACT_ROWS, _FIELDS
from .registry import register

_IDV = """idv AS (SELECT record_id, value FROM (
  SELECT record_id, json_extract_string(t.value, '$') AS value FROM json_values, json_tree(json_values.data) t
  WHERE t.type = 'VARCHAR' AND t.key IS NOT NULL AND NOT t.fullkey LIKE '%]')
  WHERE value <> '' AND contains(value, '_') AND NOT contains(value, '/'))"""
_STATS = "stats AS (SELECT value, count(*) AS n, min(record_id) AS first_record FROM idv GROUP BY value)"


def _idv(spark, sf):
    return E.identifier_values(fixture(spark, sf, "json_values"))


@register("identifier_stats", D.wf(["json_values"], "SELECT * FROM stats", _IDV + ",\n" + _STATS))
def q_identifier_stats(spark, sf):
    return E.identifier_stats(_idv(spark, sf))


@register("top_identifier", D.wf(["json_values"], """
SELECT b.value AS identifier, 'https://en.wikipedia.org/wiki/' || b.value AS wiki FROM (
  SELECT min({'k': -n, 'r': first_record, 'value': value}) AS b FROM stats)""", _IDV + ",\n" + _STATS))
def q_top_identifier(spark, sf):
    return E.top_identifier(E.identifier_stats(_idv(spark, sf)))


_CTX = D.case_sql("field", C.NER_CONTEXT, "NULL")
_META = f"""p AS (SELECT payload_id, payload, json_keys(payload) AS keys,
    md5(coalesce(json_extract_string(payload, '$.title'), '') || coalesce(json_extract_string(payload, '$.text'), '')) AS md5
  FROM ner_payloads),
meta0 AS (
  SELECT payload_id, md5, 'lang' AS field, CAST(0 AS BIGINT) AS pos, json_extract_string(payload, '$.lang') AS value
  FROM p WHERE list_contains(keys, 'lang')
  UNION ALL SELECT payload_id, md5, json_extract_string(e, '$.label'), CAST(pos AS BIGINT), json_extract_string(e, '$.entity')
  FROM (SELECT payload_id, md5, keys, unnest(json_extract(payload, '$.original_entities[*]')) AS e,
               unnest(range(len(json_extract(payload, '$.original_entities[*]')))) AS pos FROM p)
  WHERE list_contains(keys, 'entities') AND length(json_extract_string(e, '$.entity')) > 0
  UNION ALL SELECT payload_id, md5, 'type', 0, 'entities' FROM p WHERE list_contains(keys, 'entities')),
meta AS (SELECT *, {_CTX} AS context FROM meta0)"""


@register("ner_metadata", D.wf(["ner_payloads"], "SELECT * FROM meta", _META))
def q_ner_metadata(spark, sf):
    return E.ner_metadata(fixture(spark, sf, "ner_payloads"))


@register("jsonld_triples", D.wf(["ner_payloads"], f"""
SELECT DISTINCT * FROM (
  SELECT 'urn:uuid:' || md5 AS s, '{C.RDF_TYPE}' AS p, '{C.SCHEMA}entities' AS o, 'iri' AS o_kind, '' AS lang FROM p
  UNION ALL SELECT 'urn:uuid:' || md5, context, value, 'lit', '' FROM meta WHERE context IS NOT NULL)""", _META))
def q_jsonld_triples(spark, sf):
    return E.jsonld_triples(fixture(spark, sf, "ner_payloads"))


AS_OF = "2024-06-30 12:00:00"


@register("cache_resource", D.wf(["json_values"], f"""
SELECT j.record_id, md5(j.name) AS md5, 'resource' AS type, j.name, NULL::VARCHAR AS url, j.data,
       TIMESTAMP '{AS_OF}' AS date, CAST(coalesce(c.n, 0) AS BIGINT) AS n_identifiers
FROM json_values j LEFT JOIN (SELECT record_id, count(*) AS n FROM idv GROUP BY 1) c USING (record_id)""", _IDV))
def q_cache_resource(spark, sf):
    return _resources(spark, sf).drop("identifiers", "parsed")


def _resources(spark, sf):
    recs = fixture(spark, sf, "json_values")
    return K.cache_resource(recs, E.identifier_values(recs), as_of=F.lit(AS_OF).cast("timestamp_ntz"))


@register("cache_resource_identifiers", D.wf(["json_values"], """
SELECT md5(j.name) AS md5, j.name, idv.value, count(*) AS n FROM json_values j JOIN idv USING (record_id)
GROUP BY j.record_id, j.name, idv.value""", _IDV))
def q_cache_resource_identifiers(spark, sf):
    return K.resource_identifiers(_resources(spark, sf))


@register("cache_resource_fields", D.wf(["json_values"], """
SELECT md5(name) AS md5, k AS key, CAST(json_extract(data, '$.' || k) AS VARCHAR) AS value
FROM (SELECT name, data, unnest(json_keys(data)) AS k FROM json_values) WHERE k IN ('a', 'f', 'n')"""))
def q_cache_resource_fields(spark, sf):
    """Scalar members of the parsed data, as JSON."""
    r = _resources(spark, sf).select("md5", F.explode(F.expr("variant_get(parsed, '$', 'map<string,variant>')")).alias("key", "v"))
    return r.where(F.col("key").isin("a", "f", "n")).select("md5", "key", F.to_json("v").alias("value"))


@register("cache_relationship", D.wf(["responses"], """
SELECT g.doc_id, g.uid, md5(g.sentence) AS md5, 'https://example.org/doc/' || CAST(g.doc_id AS VARCHAR) AS url,
       'relationship' AS type, CAST(coalesce(a.n_atoms, 0) AS BIGINT) AS n_atoms,
       CAST(coalesce(a.n_facts, 0) AS BIGINT) AS n_facts
FROM atoms_g g LEFT JOIN (
  SELECT doc_id, uid, count(*) AS n_atoms,
         count(CASE WHEN relationship IS NOT NULL AND concept1 IS NOT NULL AND concept2 IS NOT NULL
                     AND entity IS NOT NULL THEN 1 END) AS n_facts FROM atoms GROUP BY 1, 2) a
  ON a.doc_id = g.doc_id AND a.uid = g.uid""", D.atoms_ctes()))
def q_cache_relationship(spark, sf):
    return _relationships(spark, sf).drop("source", "facts", "graph")


def _relationships(spark, sf):
    url = F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string"))
    return K.cache_relationship(R.artefacts(fixture(spark, sf, "responses")), url)


@register("cache_relationship_atoms", D.wf(["responses"], """
SELECT f.doc_id, f.uid, md5(g.sentence) AS md5, g.sentence AS source, CAST(f.atom_ix AS BIGINT) AS atom_ix, f.key, f.value
FROM (""" + _FIELDS + """) f JOIN atoms_g g ON g.doc_id = f.doc_id AND g.uid = f.uid""", D.atoms_ctes()))
def q_cache_relationship_atoms(spark, sf):
    return K.relationship_atoms(_relationships(spark, sf))


@register("cache_relationship_facts", D.wf(["responses"], """
SELECT f.doc_id, f.uid, md5(g.sentence) AS md5, f.ix AS pos, f.fact FROM (""" + _FACT_ROWS + """) f
JOIN atoms_g g ON g.doc_id = f.doc_id AND g.uid = f.uid""", D.atoms_ctes()))
def q_cache_relationship_facts(spark, sf):
    return K.relationship_facts(_relationships(spark, sf))


@register("cache_pending", D.wf(["responses"], """
SELECT w.concept, md5(w.concept) AS md5, w.context FROM (
  SELECT concept, f.sentence AS context FROM (
    SELECT concept, min({'doc_id': doc_id, 'uid': uid, 'atom_ix': atom_ix, 'side': side, 'sentence': sentence}) AS f
    FROM (SELECT concept1 AS concept, 0 AS side, doc_id, uid, atom_ix, sentence FROM atoms WHERE """ + D.COMPLETE + """
          UNION ALL SELECT concept2, 1, doc_id, uid, atom_ix, sentence FROM atoms WHERE """ + D.COMPLETE + """)
    GROUP BY concept)) w
WHERE md5(w.concept) NOT IN (SELECT md5(p_brand) FROM part)""", D.atoms_ctes()))
def q_cache_pending(spark, sf):
    work = R.concept_worklist(R.atoms(fixture(spark, sf, "responses")))
    new = work.select("concept", F.md5("concept").alias("md5"), "context")
    cached = table(spark, sf, "part").select(F.md5("p_brand").alias("md5"))
    return K.cache_pending(new, cached)


@register("cache_latest", """
SELECT md5, r.date AS date, r.event_id AS event_id, r.data AS data FROM (
  SELECT md5(CAST(user_id AS VARCHAR)) AS md5, max({'date': ts, 'event_id': event_id, 'data': props}) AS r
  FROM events GROUP BY 1)""")
def q_cache_latest(spark, sf):
    ev = table(spark, sf, "events").select(F.md5(F.col("user_id").cast("string")).alias("md5"),
                                           F.col("ts").alias("date"), "event_id",
                                           F.col("props").alias("data"))
    return K.cache_latest(ev)
