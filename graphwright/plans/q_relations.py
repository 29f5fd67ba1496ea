"""Replies -> atoms -> facts -> triples (sentence-level relation records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R, triples as T
from ..sources.fixtures import fixture
from . import duck as D
from .registry import register

ATOM_COLS = ["doc_id", "uid", "sentence", "atom_ix", "concept1", "concept2", "entity",
             "relationship", "importance", "n_keys", "relationship_raw"]


def _atoms(spark, sf):
    return R.atoms(fixture(spark, sf, "responses"))


AT = D.atoms_ctes()


@register("atoms", D.wf(["responses"], "SELECT * FROM atoms", AT))
def q_atoms(spark, sf):
    return _atoms(spark, sf).select(*ATOM_COLS)


@register("relation_normalize", D.wf(["responses"], """
SELECT relationship_raw, relationship, count(*) AS n FROM atoms
WHERE relationship_raw IS NOT NULL GROUP BY ALL""", AT))
def q_relation_normalize(spark, sf):
    return R.relation_normalize(_atoms(spark, sf))


@register("facts", D.wf(["responses"], """
SELECT doc_id, uid, atom_ix,
  CASE WHEN contains(relationship, 'is part of')
       THEN concept2 || ' ' || entity || ' (' || relationship || ') ' || concept1
       ELSE concept1 || ' ' || entity || '(' || relationship || ') ' || concept2 END AS fact
FROM atoms WHERE relationship IS NOT NULL AND concept1 IS NOT NULL AND concept2 IS NOT NULL
  AND entity IS NOT NULL""", AT))
def q_facts(spark, sf):
    return R.facts(_atoms(spark, sf))


@register("facts_starred", D.wf(["responses"], """
SELECT doc_id, uid, atom_ix, concept1 || ' *' || relationship_raw || '* ' || concept2 AS fact
FROM atomsq WHERE concept1 IS NOT NULL AND relationship_raw IS NOT NULL AND concept2 IS NOT NULL""",
                                  D.atoms_ctes(strip_quotes=False, name="atomsq")))
def q_facts_starred(spark, sf):
    return R.facts_starred(fixture(spark, sf, "responses"))


# every key of a reply record with its last value
_FIELDS = """SELECT doc_id, uid, atom_ix, key, arg_max(value, pos) AS value FROM (
  SELECT doc_id, uid, atom_ix, unnest(list_transform(kv, lambda x: x.k)) AS key,
         unnest(list_transform(kv, lambda x: x.v)) AS value, unnest(range(len(kv))) AS pos
  FROM atoms_k WHERE len(kv) > 0) GROUP BY doc_id, uid, atom_ix, key"""
_FACT_ROWS = """SELECT doc_id, uid, atom_ix, row_number() OVER (PARTITION BY doc_id, uid ORDER BY atom_ix) - 1 AS ix,
  CASE WHEN contains(relationship, 'is part of')
       THEN concept2 || ' ' || entity || ' (' || relationship || ') ' || concept1
       ELSE concept1 || ' ' || entity || '(' || relationship || ') ' || concept2 END AS fact
FROM atoms WHERE relationship IS NOT NULL AND concept1 IS NOT NULL AND concept2 IS NOT NULL AND entity IS NOT NULL"""


@register("atom_fields", D.wf(["responses"], _FIELDS, AT))
def q_atom_fields(spark, sf):
    return R.atom_fields(_atoms(spark, sf))


@register("artefacts", D.wf(["responses"], f"""
SELECT r.doc_id, r.uid, CASE WHEN g.doc_id IS NOT NULL THEN md5(r.sentence) END AS md5,
       CASE WHEN g.doc_id IS NOT NULL THEN r.sentence END AS source,
       coalesce(x.kind, 'none') AS kind, x.ix, x.key, x.value
FROM responses r LEFT JOIN atoms_g g ON g.doc_id = r.doc_id AND g.uid = r.uid
LEFT JOIN (SELECT doc_id, uid, 'fact' AS kind, ix, NULL::VARCHAR AS key, fact AS value FROM ({_FACT_ROWS})
  UNION ALL SELECT doc_id, uid, 'atom', CAST(atom_ix AS BIGINT), key, value FROM ({_FIELDS})) x
ON x.doc_id = g.doc_id AND x.uid = g.uid""", AT))
def q_artefacts(spark, sf):
    """The sentence artefacts in long form."""
    return R.artefact_fields(R.artefacts(fixture(spark, sf, "responses")))


@register("atoms_quarantine", D.wf(["responses"], """
SELECT doc_id, uid, atom_ix, concat_ws(',',
  CASE WHEN concept1 IS NULL THEN 'concept1' END, CASE WHEN concept2 IS NULL THEN 'concept2' END,
  CASE WHEN relationship IS NULL THEN 'relationship' END,
  CASE WHEN importance IS NULL THEN 'importance' END) AS missing
FROM atoms WHERE NOT (""" + D.COMPLETE + ")", AT))
def q_atoms_quarantine(spark, sf):
    return R.atoms_quarantine(_atoms(spark, sf))


@register("concept_worklist", D.wf(["responses"], """
SELECT concept, f.doc_id AS doc_id, f.uid AS uid, f.sentence AS context FROM (
  SELECT concept, min({'doc_id': doc_id, 'uid': uid, 'atom_ix': atom_ix, 'side': side,
                       'sentence': sentence}) AS f
  FROM (SELECT concept1 AS concept, 0 AS side, doc_id, uid, atom_ix, sentence FROM atoms WHERE """
    + D.COMPLETE + """
        UNION ALL SELECT concept2, 1, doc_id, uid, atom_ix, sentence FROM atoms WHERE """
    + D.COMPLETE + """) GROUP BY concept)""", AT))
def q_concept_worklist(spark, sf):
    return R.concept_worklist(_atoms(spark, sf))


@register("kg_plain", D.wf(["responses"], "SELECT * FROM " + D.plain_sql(), AT))
def q_kg_plain(spark, sf):
    return T.kg_plain(_atoms(spark, sf))


@register("kg_skos", D.wf(["responses"], "SELECT * FROM " + D.skos_sql(True), AT))
def q_kg_skos(spark, sf):
    return T.kg_skos(_atoms(spark, sf), strict_case=True)


@register("kg_skos_intent", D.wf(["responses"], "SELECT * FROM " + D.skos_sql(False), AT))
def q_kg_skos_intent(spark, sf):
    return T.kg_skos(_atoms(spark, sf), strict_case=False)


@register("kg_skos_counts", D.wf(["responses"], """
SELECT p, o_kind, count(*) AS n FROM """ + D.skos_sql(True) + " GROUP BY ALL", AT))
def q_kg_skos_counts(spark, sf):
    return T.kg_skos(_atoms(spark, sf)).groupBy("p", "o_kind").agg(F.count("*").alias("n"))


@register("ntriples_lines", D.wf(["responses"], """
SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>'
  ELSE """ + D.nt_literal_sql() + " END || ' .' AS line FROM " + D.skos_sql(True), AT))
def q_ntriples_lines(spark, sf):
    return T.ntriples_lines(T.kg_skos(_atoms(spark, sf)))


@register("graph_union", D.wf(["responses"], "SELECT DISTINCT * FROM (SELECT * FROM "
                              + D.skos_sql(True) + " UNION ALL SELECT * FROM " + D.plain_sql()
                              + " UNION ALL SELECT * FROM " + D.skos_sql(True) + ")", AT))
def q_graph_union(spark, sf):
    return T.kg_both(_atoms(spark, sf))


@register("seed_graph", D.wf(["responses", "authority_triples"], """
SELECT DISTINCT * FROM (
  SELECT s, p, o, CASE WHEN regexp_matches(o, '^(https?|urn):') THEN 'iri' ELSE 'lit' END AS o_kind,
         '' AS lang FROM authority_triples
  UNION ALL SELECT * FROM """ + D.plain_sql() + ")", AT))
def q_seed_graph(spark, sf):
    seed = T.as_triples(fixture(spark, sf, "authority_triples"))
    return T.seed_graph(seed, T.kg_plain(_atoms(spark, sf), distinct=False))


@register("artefact_summary", D.wf(["responses"], """
SELECT g.doc_id, g.uid, md5(g.sentence) AS md5, g.sentence AS source,
       CAST(coalesce(a.n_atoms, 0) AS BIGINT) AS n_atoms, CAST(coalesce(f.n_facts, 0) AS BIGINT) AS n_facts,
       coalesce(f.facts_text, '') AS facts_text
FROM atoms_g g
LEFT JOIN (SELECT doc_id, uid, count(*) AS n_atoms FROM atoms GROUP BY 1, 2) a
  ON a.doc_id = g.doc_id AND a.uid = g.uid
LEFT JOIN (SELECT doc_id, uid, count(*) AS n_facts, string_agg(fact, chr(10) ORDER BY atom_ix) AS facts_text FROM (
    SELECT doc_id, uid, atom_ix,
      CASE WHEN contains(relationship, 'is part of')
           THEN concept2 || ' ' || entity || ' (' || relationship || ') ' || concept1
           ELSE concept1 || ' ' || entity || '(' || relationship || ') ' || concept2 END AS fact
    FROM atoms WHERE relationship IS NOT NULL AND concept1 IS NOT NULL AND concept2 IS NOT NULL
      AND entity IS NOT NULL) GROUP BY 1, 2) f
  ON f.doc_id = g.doc_id AND f.uid = g.uid""", AT))
def q_artefact_summary(spark, sf):
    """Flat view of the sentence artefacts (records that have data)."""
    a = R.artefacts(fixture(spark, sf, "responses")).where(F.col("data").isNotNull())
    return a.select("doc_id", "uid", "md5", F.col("data.source").alias("source"),
                    F.size("data.graph").cast("bigint").alias("n_atoms"),
                    F.size("data.facts").cast("bigint").alias("n_facts"),
                    F.array_join("data.facts", "\n").alias("facts_text"))
