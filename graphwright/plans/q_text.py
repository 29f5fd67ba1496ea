"""Text operators over whole documents and JSON payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.lineage import checkpoint
from ..operators import extract as E, text as X
from ..session import scratch_path
from ..sources.fixtures import fixture
from ..sources.tables import spread, table
from . import duck as D
from .registry import register

_SPLIT = r"'([.!?])[ \t\n\r\f]+'"
_SENTS = f"""sents AS (SELECT doc_id, CAST(uid AS BIGINT) AS uid, sentence,
    CAST(length(sentence) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, unnest(string_split(m, chr(1))) AS sentence, unnest(range(len(string_split(m, chr(1))))) AS uid
  FROM (SELECT doc_id, regexp_replace(trim(text), {_SPLIT}, '\\1' || chr(1), 'g') AS m FROM documents))
  WHERE sentence <> '')"""


def _sents(spark, sf):
    return X.sentences(table(spark, sf, "documents").select("doc_id", "text"))


@register("sentences", D.wf([], "SELECT * FROM sents", _SENTS))
def q_sentences(spark, sf):
    return _sents(spark, sf)


@register("sentence_gate", D.wf([], "SELECT doc_id, uid, length(sentence) > 10 AS has_data FROM sents",
                                _SENTS))
def q_sentence_gate(spark, sf):
    return X.sentence_gate(_sents(spark, sf)).select("doc_id", "uid", "has_data")


@register("md5_ids", D.wf([], "SELECT doc_id, uid, md5(sentence) AS md5 FROM sents", _SENTS))
def q_md5_ids(spark, sf):
    return X.md5_ids(_sents(spark, sf))


@register("paragraphs", D.wf([], f"""
SELECT doc_id, CAST(para_ix AS BIGINT) AS para_ix, paragraph FROM (
  SELECT doc_id, para_ix, trim(regexp_replace(p, {_SPLIT}, '\\1 ', 'g')) AS paragraph FROM (
    SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS para_ix FROM (
      SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS ps FROM documents)))
WHERE paragraph <> ''"""))
def q_paragraphs(spark, sf):
    return X.paragraphs(table(spark, sf, "documents").select("doc_id", "text"))


@register("payload_fields", D.wf(["payloads"], """
SELECT payload_id, CAST(pos AS BIGINT) AS pos, key,
       json_extract_string(payload, '$."' || key || '"') AS value FROM (
  SELECT payload_id, payload, unnest(json_keys(payload)) AS key,
         unnest(range(len(json_keys(payload)))) AS pos FROM payloads)"""))
def q_payload_fields(spark, sf):
    return X.payload_fields(fixture(spark, sf, "payloads"))


@register("payload_text", D.wf(["payloads"], """
SELECT payload_id, '. ' || array_to_string(list_transform(json_keys(payload),
    lambda k: json_extract_string(payload, '$."' || k || '"')), '. ') AS text FROM payloads"""))
def q_payload_text(spark, sf):
    return X.payload_text(fixture(spark, sf, "payloads"))


def _buckets(text: str) -> str:
    """List of the trigram buckets of a text (DuckDB)."""
    plain = f"' ' || trim(regexp_replace(lower({text}), '{X.LETTERS}', ' ', 'g')) || ' '"
    points = f"list_transform(string_split({plain}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    k = X._TRIGRAM
    return (f"list_transform(list_transform([{points}], lambda p: list_transform(range(1, len(p) - 1), "
            f"lambda i: ((p[i] * {k} + p[i + 1]) * {k} + p[i + 2]) % {X.LANG_BUCKETS})), lambda l: l)[1]")


@register("lang_profile", f"""
SELECT lang, bucket, count(*) AS n FROM (SELECT lang, unnest({_buckets('text')}) AS bucket FROM documents)
WHERE lang IS NOT NULL GROUP BY ALL""")
def q_lang_profile(spark, sf):
    return X.lang_profile(spread(table(spark, sf, "documents").select("text", "lang")))


# three sixteenths of the documents are held out of the profile, by a hash of the id
_HELD = "substr(md5(CAST(doc_id AS {S})), 1, 1) IN ('0', '1', '2')"

_LANG_DETECT = f"""
WITH t AS MATERIALIZED (SELECT doc_id, lang, unnest({_buckets('text')}) AS bucket FROM documents),
profile AS (SELECT lang, bucket, count(*) AS n FROM t WHERE lang IS NOT NULL AND NOT """ + _HELD.replace("{S}", "VARCHAR") + f""" GROUP BY ALL),
total AS (SELECT lang, sum(n) AS total FROM profile GROUP BY lang),
sc AS (SELECT t.doc_id, total.lang, sum(CAST(floor(1000 * ln((coalesce(p.n, 0) + 1) / (total + {X.LANG_BUCKETS}))) AS BIGINT)) AS score
       FROM t CROSS JOIN total LEFT JOIN profile p ON p.lang = total.lang AND p.bucket = t.bucket GROUP BY ALL),
first AS (SELECT doc_id, lang FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
SELECT d.doc_id, """ + _HELD.replace("{S}", "VARCHAR") + """ AS held_out, first.lang AS lang_detected FROM documents d
LEFT JOIN first USING (doc_id)"""


def lang_model(spark, sf):
    """Trained on the labelled documents that are not held out; written once (reliable
    checkpoint in the shared folder), as a row of fixed size."""
    docs = spread(table(spark, sf, "documents").where(~F.expr(_HELD.replace("{S}", "STRING"))).select("text", "lang"))
    return checkpoint(X.lang_model(X.lang_profile(docs)))


@register("lang_detect", _LANG_DETECT)
def q_lang_detect(spark, sf):
    """Score every document (whole texts); null where a text has no letter."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return X.lang_detect(docs, lang_model(spark, sf)).select(
        "doc_id", F.expr(_HELD.replace("{S}", "STRING")).alias("held_out"), "lang_detected")


def _first_and_last():
    """An extractor without a model: relates the first and the last word."""
    def answer(sentences):
        if any("%" in s for s in sentences):
            raise ValueError("a share")
        words = [s.split(" ") for s in sentences]
        return [f'{{\n"concept1": "{w[0]}",\n"concept2": "{w[-1]}",\n"relationship": "related"\n}}' for w in words]

    return answer


@register("extract_replies", f"""WITH {_SENTS}
SELECT doc_id, uid, CASE WHEN n_chars > {C.MIN_SENTENCE_SIZE} AND NOT contains(sentence, '%') THEN
         '{{' || chr(10) || '"concept1": "' || string_split(sentence, ' ')[1] || '",' || chr(10) || '"concept2": "'
         || string_split(sentence, ' ')[-1] || '",' || chr(10) || '"relationship": "related"' || chr(10) || '}}' END AS response,
       CASE WHEN n_chars > {C.MIN_SENTENCE_SIZE} AND contains(sentence, '%') THEN 'ValueError: a share' END AS error
FROM sents""")
def q_extract_replies(spark, sf):
    """The extractor step over all sentences of the documents."""
    sentences = X.sentences(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "uid", "sentence")
    rows = E.extract(sentences, _first_and_last, scratch_path(spark, "replies"), batch_size=1000)
    return rows.select("doc_id", "uid", "response", "error")
