"""Chat-model replies: key/value records, keywords, translation records and
the multilingual SKOS vocabulary built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import constants as C
from ..functions.joins import fixed_table, join_fixed

KV_LINE = r"(?s)^(.+?):\s*(.+)$"


def reply_kv(replies: DataFrame, id_col: str = "reply_id", text_col: str = "response") -> DataFrame:
    """``(id, key, value)`` of a key/value reply.

    Newlines become ``<br>``; everything up to the last assistant marker is
    dropped; each non-empty piece is ``key: value`` (key loses "User's request
    in ", "Description" becomes "Short description"), a piece without a match
    is stored as ``summary``; a repeated key keeps its last value."""
    r = F.regexp_replace(F.replace(F.col(text_col), F.lit("\n"), F.lit("<br>")),
                         r"(?s)^.+<\|assistant\|>", "")
    items = replies.select(id_col, F.posexplode_outer(F.split(r, "<br>")).alias("pos", "item")) \
        .where(F.col("item") != "")
    k = F.regexp_extract("item", KV_LINE, 1)
    key = F.when(k != "", F.replace(F.replace(k, F.lit("User's request in "), F.lit("")),
                                    F.lit("Description"), F.lit("Short description"))) \
        .otherwise(F.lit("summary"))
    val = F.when(k != "", F.regexp_extract("item", KV_LINE, 2)).otherwise(F.col("item"))
    kv = items.select(id_col, "pos", key.alias("key"), val.alias("value"))
    return kv.groupBy(id_col, "key").agg(F.max_by("value", "pos").alias("value"))


def keywords(replies: DataFrame, id_col: str = "reply_id", text_col: str = "response") -> DataFrame:
    """Every quoted word of a reply except the word ``keywords``, in order."""
    r = F.replace(F.col(text_col), F.lit("<br>"), F.lit("\n"))
    words = F.filter(F.regexp_extract_all(r, F.lit(r'"([^\n]+?)"'), 1), lambda w: w != "keywords")
    return replies.select(id_col, F.posexplode_outer(words).alias("pos", "keyword")) \
        .where(F.col("pos").isNotNull()) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def translation_record(replies: DataFrame, kv: DataFrame, contexts: DataFrame,
                       id_col: str = "reply_id") -> DataFrame:
    """Reply fields plus ``concept``, ``md5(concept)``,
    ``md5(concept + ' ' + context)`` and the context language; a missing
    context is ``nocontext``.

    Both joins are sort-merge joins by hint: a broadcast is chosen by the size of the files that
    a side is read from, but the pieces of the replies are many times that, and
    the adaptive plan keeps a broadcast that saves an exchange."""
    base = replies.select(id_col, "concept").join(contexts.hint("merge"), id_col, "left")
    ctx = F.coalesce(F.col("context"), F.lit(C.DEFAULT_CONTEXT))
    rec = base.select(id_col, "concept", F.md5("concept").alias("md5"),
                      F.md5(F.concat(F.col("concept"), F.lit(" "), ctx)).alias("md5context"),
                      F.col("lang"))
    return rec.join(kv.hint("merge"), id_col)


def language_codes(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, C.LANGUAGE_CODES.items(), "key string, code string")


def lang_code(records: DataFrame) -> DataFrame:
    """Language-name keys -> codes (16 fixed names; unknown keys skipped)."""
    return join_fixed(records, language_codes(records.sparkSession), "key")


def lang_code_quarantine(records: DataFrame) -> DataFrame:
    """Records whose key is no known language name and no description or summary:
    ``(key, n)`` with the number of records, so that no name vanishes silently."""
    known = language_codes(records.sparkSession).select("key")
    rest = records.join(F.broadcast(known), "key", "left_anti")
    rest = rest.where(~F.lower("key").contains("description") & (F.col("key") != "summary"))
    return rest.groupBy("key").agg(F.count("*").alias("n"))


def vocab_skos(records: DataFrame) -> DataFrame:
    """SKOS vocabulary from translation records (long form).

    A key containing ``description`` gives scopeNote, type Concept and the
    identifier literal ``DID``; a language-name key gives a prefLabel with its
    language tag (quotes removed); other keys are skipped."""
    q = F.concat(F.lit(C.NS_ID), F.col("md5"))
    codes = language_codes(records.sparkSession).withColumnRenamed("code", "_code")
    r = records.join(F.broadcast(codes), "key", "left")
    desc = F.col("key").contains("description")
    t = lambda s, p, o, k, l: F.struct(s.alias("s"), p.alias("p"), o.alias("o"),
                                       F.lit(k).alias("o_kind"), l.alias("lang"))
    arr = (F.when(desc, F.array(
        t(q, F.lit(C.SKOS + "scopeNote"), F.col("value"), "lit", F.lit("")),
        t(q, F.lit(C.RDF_TYPE), F.lit(C.SKOS + "Concept"), "iri", F.lit("")),
        t(q, F.lit(C.DCTERMS_IDENTIFIER), F.lit("DID"), "lit", F.lit(""))))
        .when(F.col("_code").isNotNull(), F.array(
            t(q, F.lit(C.SKOS + "prefLabel"), F.replace(F.col("value"), F.lit('"'), F.lit("")), "lit",
              F.col("_code"))))
        .otherwise(F.array()))
    return r.select(F.inline(arr)).distinct()


def vocab_pivot(vocab: DataFrame) -> DataFrame:
    """One row per concept, one column per language code (prefLabel)."""
    codes = list(C.LANGUAGE_CODES.values())
    labels = vocab.where(F.col("p") == C.SKOS + "prefLabel").select(
        F.col("s").alias("concept_id"), "lang", F.col("o").alias("label"))
    return labels.groupBy("concept_id").pivot("lang", codes).agg(F.min("label"))


def vocab_merge(existing: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """``merge`` (default): set union; ``replace``: the new graph only."""
    from .triples import graph_union
    if mode == "replace":
        return graph_union(new)
    return graph_union(existing, new)


def cache_concept(records: DataFrame, url: Column | None = None, id_col: str = "reply_id") -> DataFrame:
    """Concept cache records: one per translated concept, with all its fields
    (``fields`` map and ``n_fields``).  Replies without any field are left out (they
    go to quarantine upstream)."""
    per = records.groupBy(id_col, "concept", "md5", "md5context", "lang") \
        .agg(F.count("*").alias("n_fields"), F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
    return per.select(id_col, "md5", "md5context", "lang", F.lit("concept").alias("type"),
                      F.col("concept").alias("name"),
                      (url if url is not None else F.lit(None).cast("string")).alias("url"), "n_fields", "fields")


def concept_fields(cached: DataFrame, id_col: str = "reply_id") -> DataFrame:
    """Long form of the concept cache: ``(id, md5, md5context, name, key, value)``."""
    return cached.select(id_col, "md5", "md5context", "name", F.explode("fields").alias("key", "value"))


def link_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Link table terms ``(column_name, term)`` to vocabulary concepts whose
    preferred label matches after ``lower(trim())``; unmatched terms are kept
    with a null concept."""
    labels = vocab.where(F.col("p") == C.SKOS + "prefLabel").select(
        F.lower(F.trim("o")).alias("norm"), F.col("s").alias("concept_id"), F.col("lang").alias("label_lang")) \
        .distinct()
    t = terms.withColumn("norm", F.lower(F.trim("term")))
    return t.join(labels, "norm", "left").drop("norm")
