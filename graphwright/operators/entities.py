"""Identifier statistics over nested JSON, NER metadata, JSON-LD triples."""

from __future__ import annotations

from ..functions.lineage import checkpoint
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.text import case_map


def _m():
    return F.expr("try_variant_get(v, '$', 'map<string,variant>')")


def _a():
    return F.expr("try_variant_get(v, '$', 'array<variant>')")


def _open_levels(cur: DataFrame, levels: int) -> DataFrame:
    """Open ``levels`` JSON levels: an object/array row is replaced by its
    children (object members keep their key, array elements get none); a
    scalar row passes through unchanged.  One generator per level, no union."""
    for _ in range(levels):
        m, a = _m(), _a()
        scalar = m.isNull() & a.isNull()
        kids = F.when(scalar, F.array(F.struct(F.col("key"), F.col("v")))).otherwise(F.concat(
            F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(
                e["key"].alias("key"), e["value"].alias("v"))), F.array()),
            F.coalesce(F.transform(a, lambda x: F.struct(
                F.lit(None).cast("string").alias("key"), x.alias("v"))), F.array())))
        cur = cur.select("_id", F.inline_outer(kids)).where(F.col("v").isNotNull())
    return cur


def _start(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return records.select(F.col(id_col).alias("_id"), F.lit(None).cast("string").alias("key"),
                          F.expr(f"try_parse_json({json_col})").alias("v"))


def _string_leaves(cur: DataFrame, id_col: str) -> DataFrame:
    return (cur.where(F.col("key").isNotNull() & (F.expr("schema_of_variant(v)") == "STRING"))
            .select(F.col("_id").alias(id_col), "key", F.expr("variant_get(v, '$', 'string')").alias("value")))


def json_string_leaves(records: DataFrame, id_col: str, json_col: str,
                       levels_per_pass: int = 8) -> DataFrame:
    """``(id, key, value)`` for every JSON string that sits under an object key,
    at any depth (strings directly inside arrays are not under a key).

    Objects and arrays are opened with ``try_variant_get(v, '$',
    'map<string,variant>' | 'array<variant>')``, ``levels_per_pass`` levels in
    one plan.  Each pass is written once and holds the strings that it found
    and the containers that are left; passes go on until none are left."""
    cur, found = _start(records, id_col, json_col), None
    while True:
        cur = _open_levels(cur, levels_per_pass)
        rest = _m().isNotNull() | _a().isNotNull()
        leaf = F.col("key").isNotNull() & (F.expr("schema_of_variant(v)") == "STRING")
        done = checkpoint(cur.where(rest | leaf).withColumn("rest", rest))
        part = _string_leaves(done.where(~F.col("rest")), id_col)
        found = part if found is None else found.unionByName(part)
        cur = done.where("rest").select("_id", "key", "v")
        if cur.isEmpty():
            return found


def identifier_values(records: DataFrame, id_col: str = "record_id", json_col: str = "data",
                      separator: str = C.ID_SEPARATOR, forbidden: str = C.ID_FORBIDDEN) -> DataFrame:
    """Identifier-like strings: non-empty, contain ``separator``, not ``forbidden``."""
    v = F.col("value")
    return json_string_leaves(records, id_col, json_col).where(
        (v != "") & v.contains(separator) & ~v.contains(forbidden))


# a string after a key (group 1 with its quotes), or any other string or key
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
_KEYED = rf"(?s){_JSON_STRING}\s*+:\s*+({_JSON_STRING})|{_JSON_STRING}"


def keyed_strings(json: Column) -> Column:
    """Every JSON string that sits under an object key, at any depth, in the order of
    the document: one pass over its text, so it runs in a projection (and in a stream).
    Null for a text that is no JSON."""
    quoted = F.filter(F.regexp_extract_all(json, F.lit(_KEYED), 1), lambda x: x != "")
    values = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return F.when(F.try_parse_json(json).isNotNull(), values)


def keyed_identifiers(records: DataFrame, json_col: str = "data", separator: str = C.ID_SEPARATOR,
                      forbidden: str = C.ID_FORBIDDEN) -> DataFrame:
    """The values of ``identifier_values`` in one narrow projection."""
    v = F.col("value")
    return (records.select(F.explode_outer(keyed_strings(F.col(json_col))).alias("value"))
            .where(v.isNotNull() & (v != "") & v.contains(separator) & ~v.contains(forbidden)))


def identifier_stats(values: DataFrame, id_col: str = "record_id") -> DataFrame:
    """``(value, n, first_record)``: a partial aggregate (hot values combine
    map-side)."""
    return values.groupBy("value").agg(F.count("*").alias("n"),
                                       F.min(id_col).alias("first_record"))


def top_identifier(stats: DataFrame, language: str = "en") -> DataFrame:
    """Most frequent identifier (ties: first seen) and its wiki page; one row,
    nulls when there is none."""
    best = stats.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("first_record"),
                                    F.col("value"))).alias("b"))
    ident = F.col("b.value")
    return best.select(ident.alias("identifier"),
                       F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), ident).alias("wiki"))


NER_SCHEMA = ("lang string, original_entities array<struct<entity:string,label:string>>, "
              "title string, text string")


def ner_md5(json_col: str):
    """md5 of a payload's title and text."""
    j = F.from_json(F.col(json_col), "title string, text string")
    return F.md5(F.concat(F.coalesce(j["title"], F.lit("")), F.coalesce(j["text"], F.lit(""))))


def ner_metadata(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "payload") -> DataFrame:
    """Long form of the entity record: ``(id, md5, field, pos, value, context)``.

    Fields: ``lang``, one per NER label (its entity texts, empty ones skipped,
    ``pos`` = position in the payload list), ``type``; ``context`` is the
    schema.org term of a known field."""
    j = F.from_json(F.col(json_col), NER_SCHEMA)
    keys = F.json_object_keys(F.col(json_col))
    has_ent = F.array_contains(keys, "entities")
    item = lambda f, p, v: F.struct(f.alias("field"), p.cast("bigint").alias("pos"), v.alias("value"))
    lang_arr = F.when(F.array_contains(keys, "lang"),
                      F.array(item(F.lit("lang"), F.lit(0), j["lang"]))).otherwise(F.array())
    ents = F.filter(F.transform(j["original_entities"], lambda e, i: item(e["label"], i, e["entity"])),
                    lambda x: F.length(x["value"]) > 0)
    ent_arr = F.when(has_ent, F.coalesce(ents, F.array())).otherwise(F.array())
    type_arr = F.when(has_ent, F.array(item(F.lit("type"), F.lit(0), F.lit("entities")))) \
        .otherwise(F.array())
    rows = payloads.select(id_col, ner_md5(json_col).alias("md5"),
                           F.inline_outer(F.concat(lang_arr, ent_arr, type_arr))) \
        .where(F.col("field").isNotNull())
    return rows.withColumn("context", case_map(F.col("field"), C.NER_CONTEXT, F.lit(None)))


def jsonld_triples(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "payload") -> DataFrame:
    """``urn:uuid:<md5> rdf:type schema:entities`` for every payload, with or without
    fields, plus one literal per value of every field that has a context term."""
    typ = payloads.select(F.concat(F.lit("urn:uuid:"), ner_md5(json_col)).alias("s"), F.lit(C.RDF_TYPE).alias("p"),
                          F.lit(C.SCHEMA + "entities").alias("o"), F.lit("iri").alias("o_kind"),
                          F.lit("").alias("lang"))
    meta = ner_metadata(payloads, id_col, json_col)
    lits = meta.where(F.col("context").isNotNull()).select(
        F.concat(F.lit("urn:uuid:"), F.col("md5")).alias("s"), F.col("context").alias("p"), F.col("value").alias("o"),
        F.lit("lit").alias("o_kind"), F.lit("").alias("lang"))
    return typ.unionByName(lits).distinct()
