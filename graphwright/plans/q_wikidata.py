"""Knowledge-base shaped queries over the entity triple fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wikidata as W
from ..operators.store import TripleStore, build
from ..sources.fixtures import fixture
from ..sources.tables import table
from . import duck as D
from .registry import register


def _t(spark, sf):
    """The triple store.  Every slice of it filters by predicate, which prunes the
    branches of the union that hold other predicates."""
    return fixture(spark, sf, "entity_triples")


_STORES: dict[tuple[str, str], TripleStore] = {}


def _store(spark, sf) -> TripleStore:
    """The store of a folder of tables, built once for the application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        _STORES[key] = build(_t(spark, sf))
    return _STORES[key]


def _lab_sql(langs, name="lab") -> str:
    rank = " ".join(f"WHEN lang = '{l}' THEN {i}" for i, l in enumerate(langs))
    inl = ", ".join(f"'{l}'" for l in langs)
    return f"""{name} AS (SELECT entity, f.label AS label FROM (
  SELECT s AS entity, min({{'rank': CASE {rank} END, 'label': o}}) AS f FROM entity_triples
  WHERE p = 'rdfs:label' AND lang IN ({inl}) GROUP BY s))"""


_CLOSURE = """sub AS (SELECT DISTINCT s AS cls, o AS anc FROM entity_triples WHERE p = 'wdt:P279'),
clo(cls, anc) AS (SELECT cls, anc FROM sub UNION SELECT c.cls, s.anc FROM clo c JOIN sub s ON c.anc = s.cls),
members AS (SELECT DISTINCT item, class_id FROM (
  SELECT s AS item, o AS class_id FROM entity_triples WHERE p = 'wdt:P31'
  UNION ALL SELECT t.s, c.anc FROM entity_triples t JOIN clo c ON t.o = c.cls WHERE t.p = 'wdt:P31'))"""


def _rec(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("subclass_closure", _rec(D.wf(["entity_triples"], "SELECT * FROM members", _CLOSURE)))
def q_subclass_closure(spark, sf):
    return _store(spark, sf).class_members()


@register("class_members_top", _rec(D.wf(["entity_triples"], """
SELECT city_label, population, gps FROM (
  SELECT DISTINCT coalesce(l.label, m.item) AS city_label, TRY_CAST(p.o AS BIGINT) AS population, g.o AS gps
  FROM (SELECT DISTINCT item FROM members WHERE class_id = 'wd:Q515') m
  JOIN entity_triples p ON p.s = m.item AND p.p = 'wdt:P1082'
  JOIN entity_triples g ON g.s = m.item AND g.p = 'wdt:P625'
  LEFT JOIN lab l ON l.entity = m.item)
ORDER BY population DESC NULLS LAST, city_label, gps LIMIT 100""", _CLOSURE + ",\n" + _lab_sql(["en"]))))
def q_class_members_top(spark, sf):
    return _store(spark, sf).class_members_top("wd:Q515")


@register("label_fallback", D.wf(["entity_triples"], """
SELECT e.entity, coalesce(l.label, e.entity) AS label FROM (SELECT DISTINCT s AS entity FROM entity_triples) e
LEFT JOIN lab l ON l.entity = e.entity""", _lab_sql(["de", "en"])))
def q_label_fallback(spark, sf):
    return _store(spark, sf).label_fallback(("de", "en"))


_DESCRIBE = """
SELECT t.s AS entity, t.p AS property, t.o AS value, coalesce(t.lang, '') AS lang,
       coalesce(lp.label, t.p) AS property_label, coalesce(lv.label, t.o) AS value_label
FROM entity_triples t LEFT JOIN lab lp ON lp.entity = t.p LEFT JOIN lab lv ON lv.entity = t.o
WHERE t.s IN (SELECT 'wd:S' || CAST(s_suppkey AS VARCHAR) FROM supplier)"""


def _classes(spark, sf):
    """The classes of the tree, one per supplier."""
    return table(spark, sf, "supplier").select(F.concat(F.lit("wd:S"), F.col("s_suppkey").cast("string")).alias("entity"))


@register("entity_describe", D.wf(["entity_triples"], _DESCRIBE, _lab_sql(["en"])))
def q_entity_describe(spark, sf):
    return _store(spark, sf).describe(_classes(spark, sf))


@register("lang_default", D.wf(["entity_triples"], "SELECT property, value, lang FROM (" + _DESCRIBE + ")",
                               _lab_sql(["en"])))
def q_lang_default(spark, sf):
    return _store(spark, sf).property_values(_classes(spark, sf))


@register("external_id_reverse", D.wf(["entity_triples"], """
SELECT h.entity, h.value, a.p AS property, coalesce(l.label, a.p) AS property_label
FROM (SELECT DISTINCT s AS entity, o AS value FROM entity_triples WHERE p = 'wdtn:P214') h
JOIN entity_triples a ON a.s = h.entity AND a.o = h.value
LEFT JOIN lab l ON l.entity = a.p""", _lab_sql(["en"])))
def q_external_id_reverse(spark, sf):
    return _store(spark, sf).external_id_reverse()


@register("external_id_describe", D.wf(["entity_triples"], """
SELECT h.s AS person, h.o AS person_id, a.p AS property, a.o AS value,
       coalesce(lp.label, h.s) AS person_label, coalesce(lq.label, a.p) AS property_label
FROM entity_triples h JOIN entity_triples a ON a.s = h.s
LEFT JOIN lab lp ON lp.entity = h.s LEFT JOIN lab lq ON lq.entity = a.p
WHERE h.p = 'wdt:P214'""", _lab_sql(["en"])))
def q_external_id_describe(spark, sf):
    return _store(spark, sf).external_id_describe()
