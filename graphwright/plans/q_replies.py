"""Translation replies -> key/value records -> SKOS vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import relations as R, replies as P, text as X, triples as T
from ..sources.fixtures import fixture
from ..sources.tables import spread, table
from . import duck as D
from .q_text import _LANG_DETECT, lang_model
from .registry import register

_KV = r"""kv AS (SELECT reply_id, key, arg_max(value, pos) AS value FROM (
  SELECT reply_id, pos,
    CASE WHEN k <> '' THEN replace(replace(k, 'User' || chr(39) || 's request in ', ''), 'Description', 'Short description')
         ELSE 'summary' END AS key,
    CASE WHEN k <> '' THEN regexp_extract(item, '(?s)^(.+?):\s*(.+)$', 2) ELSE item END AS value FROM (
      SELECT reply_id, pos, item, regexp_extract(item, '(?s)^(.+?):\s*(.+)$', 1) AS k FROM (
        SELECT reply_id, unnest(parts) AS item, unnest(range(len(parts))) AS pos FROM (
          SELECT reply_id, string_split(regexp_replace(replace(response, chr(10), '<br>'),
                   '(?s)^.+<\|assistant\|>', ''), '<br>') AS parts FROM replies))
      WHERE item <> '')) GROUP BY ALL)"""
_REC = """rec AS (SELECT r.reply_id, r.concept, md5(r.concept) AS md5,
    md5(r.concept || ' ' || coalesce(d.text, 'nocontext')) AS md5context, d.lang, kv.key, kv.value
  FROM replies r LEFT JOIN documents d ON d.doc_id = r.reply_id JOIN kv ON kv.reply_id = r.reply_id)"""
_CODES = "codes(key, code) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in C.LANGUAGE_CODES.items()) + ")"
_VOCAB = f"""vocab AS (SELECT DISTINCT * FROM (
  SELECT '{C.NS_ID}' || md5 AS s, '{C.SKOS}scopeNote' AS p, value AS o, 'lit' AS o_kind, '' AS lang
    FROM rec WHERE contains(key, 'description')
  UNION ALL SELECT '{C.NS_ID}' || md5, '{C.RDF_TYPE}', '{C.SKOS}Concept', 'iri', '' FROM rec WHERE contains(key, 'description')
  UNION ALL SELECT '{C.NS_ID}' || md5, '{C.DCTERMS_IDENTIFIER}', 'DID', 'lit', '' FROM rec WHERE contains(key, 'description')
  UNION ALL SELECT '{C.NS_ID}' || md5, '{C.SKOS}prefLabel', replace(value, chr(34), ''), 'lit', c.code
    FROM rec JOIN codes c USING (key) WHERE NOT contains(key, 'description')))"""
_ALL = ",\n".join([_KV, _REC, _CODES, _VOCAB])


def _replies(spark, sf):
    return fixture(spark, sf, "replies")


def _records(spark, sf):
    rp = _replies(spark, sf)
    ctx = table(spark, sf, "documents").select(F.col("doc_id").alias("reply_id"),
                                               F.col("text").alias("context"), "lang")
    return P.translation_record(rp, P.reply_kv(rp), ctx)


@register("reply_kv", D.wf(["replies"], "SELECT * FROM kv", _KV))
def q_reply_kv(spark, sf):
    return P.reply_kv(_replies(spark, sf))


@register("keywords", D.wf(["keyword_replies"], r"""
SELECT reply_id, CAST(pos AS BIGINT) AS pos, keyword FROM (
  SELECT reply_id, unnest(w) AS keyword, unnest(range(len(w))) AS pos FROM (
    SELECT reply_id, list_filter(regexp_extract_all(replace(response, '<br>', chr(10)), '"([^\n]+?)"', 1),
                                 lambda x: x <> 'keywords') AS w FROM keyword_replies))"""))
def q_keywords(spark, sf):
    return P.keywords(fixture(spark, sf, "keyword_replies"))


@register("translation_record", D.wf(["replies"], """
SELECT rec.* REPLACE (l.lang_detected AS lang) FROM rec LEFT JOIN (""" + _LANG_DETECT.strip() + """) l ON l.doc_id = rec.reply_id""",
                                     _KV + ",\n" + _REC))
def q_translation_record(spark, sf):
    """Records with the language that is detected in the context."""
    rp = _replies(spark, sf)
    ctx = table(spark, sf, "documents").select(F.col("doc_id").alias("reply_id"), F.col("text").alias("context"))
    # only texts that are a context are scored
    ctx = spread(ctx.join(rp.select("reply_id").hint("merge"), "reply_id", "left_semi"))
    return P.translation_record(rp, P.reply_kv(rp), X.lang_detect(ctx, lang_model(spark, sf), "context", "lang"))


@register("lang_code", D.wf(["replies"], "SELECT rec.*, c.code FROM rec JOIN codes c USING (key)",
                            _KV + ",\n" + _REC + ",\n" + _CODES))
def q_lang_code(spark, sf):
    return P.lang_code(_records(spark, sf))


@register("lang_code_quarantine", D.wf(["replies"], """
SELECT key, count(*) AS n FROM rec WHERE key NOT IN (SELECT key FROM codes) AND NOT contains(lower(key), 'description')
AND key <> 'summary' GROUP BY key""", _KV + ",\n" + _REC + ",\n" + _CODES))
def q_lang_code_quarantine(spark, sf):
    return P.lang_code_quarantine(_records(spark, sf))


@register("vocab_skos", D.wf(["replies"], "SELECT * FROM vocab", _ALL))
def q_vocab_skos(spark, sf):
    return P.vocab_skos(_records(spark, sf))


_PIVOT = ", ".join(f"min(CASE WHEN lang = '{c}' THEN o END) AS {c}" for c in C.LANGUAGE_CODES.values())


@register("vocab_pivot", D.wf(["replies"], f"""
SELECT s AS concept_id, {_PIVOT} FROM vocab WHERE p = '{C.SKOS}prefLabel' GROUP BY s""", _ALL))
def q_vocab_pivot(spark, sf):
    return P.vocab_pivot(P.vocab_skos(_records(spark, sf)))


@register("vocab_merge", D.wf(["replies", "responses"], "SELECT DISTINCT * FROM (SELECT * FROM vocab UNION ALL "
                                                         "SELECT * FROM " + D.skos_sql(True) + ")",
                              _ALL + ",\n" + D.atoms_ctes()))
def q_vocab_merge(spark, sf):
    existing = T.kg_skos(R.atoms(fixture(spark, sf, "responses")))
    return P.vocab_merge(existing, P.vocab_skos(_records(spark, sf)), mode="merge")


@register("cache_concept", D.wf(["replies"], """
SELECT reply_id, md5, md5context, lang, 'concept' AS type, concept AS name, NULL::VARCHAR AS url,
       count(*) AS n_fields FROM rec GROUP BY reply_id, concept, md5, md5context, lang""", _KV + ",\n" + _REC))
def q_cache_concept(spark, sf):
    return P.cache_concept(_records(spark, sf)).drop("fields")


@register("cache_concept_fields", D.wf(["replies"], "SELECT reply_id, md5, md5context, concept AS name, key, value FROM rec",
                                       _KV + ",\n" + _REC))
def q_cache_concept_fields(spark, sf):
    return P.concept_fields(P.cache_concept(_records(spark, sf)))


@register("link_terms", D.wf(["replies"], f"""
SELECT t.column_name, t.term, l.concept_id, l.label_lang FROM (
  SELECT DISTINCT 'n_name' AS column_name, n_name AS term FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer) t
LEFT JOIN (SELECT DISTINCT lower(trim(o)) AS norm, s AS concept_id, lang AS label_lang FROM vocab
           WHERE p = '{C.SKOS}prefLabel') l ON lower(trim(t.term)) = l.norm""", _ALL))
def q_link_terms(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    names = c.join(F.broadcast(n), "c_nationkey").select(F.lit("n_name").alias("column_name"),
                                                         F.col("n_name").alias("term")).distinct()
    segs = c.select(F.lit("c_mktsegment").alias("column_name"), F.col("c_mktsegment").alias("term")).distinct()
    return P.link_terms(names.unionByName(segs), P.vocab_skos(_records(spark, sf)))
