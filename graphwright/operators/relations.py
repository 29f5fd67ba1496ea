"""Model replies -> atoms, facts and artefacts (one row per sentence in, narrow).

A reply holds relation records ``{ "key": value, ... }``.  It is cut at every
``}``; each block is cut into lines; the first ``"key": value`` match of a line
is kept; a value loses all commas and quotes; a repeated key keeps its last
value; blocks without a match are dropped.  Everything runs as higher-order
functions inside one projection, so parsing needs no shuffle at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import END_MARKER, KV_PATTERN, MIN_SENTENCE_SIZE, RELATION_MAP
from ..functions.text import case_map

ATOM_KEYS = ("concept1", "concept2", "entity", "relationship", "importance")


def gate(responses: DataFrame, min_size: int = MIN_SENTENCE_SIZE) -> DataFrame:
    """Strip the end marker; ``has_data`` when sentence and reply pass the
    length gate (strictly longer than ``min_size``).  Rows are kept."""
    reply = F.replace(F.col("response"), F.lit(END_MARKER), F.lit(""))
    return (responses.withColumn("reply", reply)
            .withColumn("has_data", (F.length("sentence") > min_size) &
                        (F.length("reply") > min_size)))


def _kv_array(block: Column, strip_quotes: bool) -> Column:
    lines = F.split(block, "\n")
    kv = F.transform(lines, lambda l: F.struct(
        F.regexp_extract(l, KV_PATTERN, 1).alias("k"),
        F.translate(F.regexp_extract(l, KV_PATTERN, 2), ',"' if strip_quotes else ",", "")
        .alias("v")))
    return F.filter(kv, lambda x: x["k"] != "")


def _last(kv: Column, key: str) -> Column:
    return F.try_element_at(F.filter(kv, lambda x: x["k"] == key), F.lit(-1))["v"]


def atom_array(reply: Column, strip_quotes: bool = True) -> Column:
    """``array<struct<atom_ix, concept1, ..., importance, n_keys>>`` of a reply.

    Two passes: the first runs the line regex once per block and binds the
    ``(k, v)`` array to a lambda variable; the second only reads that array
    (Spark does not share sub-expressions inside lambdas, so extracting the
    five keys straight from the regex pass would run it six times)."""
    blocks = F.split(reply, r"\}")
    parsed = F.transform(blocks, lambda b, i: F.struct(i.cast("bigint").alias("atom_ix"),
                                                       _kv_array(b, strip_quotes).alias("kv")))

    def one(x):
        kv = x["kv"]
        fields = [x["atom_ix"].alias("atom_ix")]
        fields += [_last(kv, k).alias(k) for k in ATOM_KEYS]
        fields.append(F.size(F.array_distinct(F.transform(kv, lambda e: e["k"])))
                      .cast("bigint").alias("n_keys"))
        # every key of the record, whatever its name, with its last value
        keys = F.array_distinct(F.transform(kv, lambda e: e["k"]))
        fields.append(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
            F.filter(kv, lambda e: e["k"] == k), -1)["v"])).alias("fields"))
        return F.struct(*fields)

    return F.transform(F.filter(parsed, lambda x: F.size(x["kv"]) > 0), one)


def normalize_relationship(rel: Column) -> Column:
    return case_map(rel, RELATION_MAP)


def atoms(responses: DataFrame, min_size: int = MIN_SENTENCE_SIZE) -> DataFrame:
    """One row per atom of every gated reply; ``relationship`` normalised,
    ``relationship_raw`` as parsed."""
    g = gate(responses, min_size).where("has_data")
    # *_outer + null filter: an inner generator makes Catalyst add a
    # size(array) > 0 filter that would run the whole parse a second time
    a = (g.select("doc_id", "uid", "sentence", F.inline_outer(atom_array(F.col("reply"))))
         .where(F.col("atom_ix").isNotNull()))
    return (a.withColumn("relationship_raw", F.col("relationship"))
            .withColumn("relationship", normalize_relationship(F.col("relationship"))))


def atom_fields(atoms_df: DataFrame) -> DataFrame:
    """Long form: ``(doc_id, uid, atom_ix, key, value)`` of every key of every atom."""
    return atoms_df.select("doc_id", "uid", "atom_ix", F.explode("fields").alias("key", "value"))


def artefact_fields(artefacts_df: DataFrame) -> DataFrame:
    """Long form of the artefacts: ``(doc_id, uid, md5, source, kind, ix, key, value)`` with
    a row per fact and per atom key, and one row of kind ``none`` for a sentence
    without any."""
    item = "struct<kind:string,ix:bigint,key:string,value:string>"
    null = F.lit(None).cast("string")
    facts_ = F.transform("data.facts", lambda f, i: F.struct(F.lit("fact").alias("kind"), i.cast("bigint").alias("ix"),
                                                             null.alias("key"), f.alias("value")))
    atoms_ = F.flatten(F.transform("data.graph", lambda a: F.transform(F.map_entries(a["fields"]), lambda e: F.struct(
        F.lit("atom").alias("kind"), a["atom_ix"].alias("ix"), e["key"].alias("key"), e["value"].alias("value")))))
    rows = F.coalesce(F.concat(facts_.cast(f"array<{item}>"), atoms_.cast(f"array<{item}>")), F.array().cast(f"array<{item}>"))
    some = F.when(F.size(rows) > 0, rows).otherwise(F.array(F.struct(
        F.lit("none").alias("kind"), F.lit(None).cast("bigint").alias("ix"), null.alias("key"), null.alias("value"))))
    return artefacts_df.select("doc_id", "uid", "md5", F.col("data.source").alias("source"), F.inline(some))


def relation_normalize(atoms_df: DataFrame) -> DataFrame:
    return (atoms_df.where(F.col("relationship_raw").isNotNull())
            .groupBy("relationship_raw", "relationship").agg(F.count("*").alias("n")))


def fact_text(c1: Column, c2: Column, entity: Column, rel: Column) -> Column:
    swapped = F.concat_ws(" ", c2, entity, F.concat(F.lit("("), rel, F.lit(")")), c1)
    plain = F.concat(c1, F.lit(" "), entity, F.lit("("), rel, F.lit(") "), c2)
    return F.when(rel.contains("is part of"), swapped).otherwise(plain)


def _has(*keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def facts(atoms_df: DataFrame) -> DataFrame:
    """Fact strings of atoms that carry a relationship (and the keys it needs)."""
    return (atoms_df.where(_has("relationship", "concept1", "concept2", "entity"))
            .select("doc_id", "uid", "atom_ix",
                    fact_text(F.col("concept1"), F.col("concept2"), F.col("entity"),
                              F.col("relationship")).alias("fact")))


def facts_starred(responses: DataFrame, min_size: int = MIN_SENTENCE_SIZE) -> DataFrame:
    """Older reader: commas removed (quotes stay), no normalisation,
    ``c1 *rel* c2``; atoms without the three keys are skipped."""
    g = gate(responses, min_size).where("has_data")
    a = g.select("doc_id", "uid", F.inline_outer(atom_array(F.col("reply"), strip_quotes=False))) \
        .where(F.col("atom_ix").isNotNull())
    return (a.where(_has("concept1", "relationship", "concept2"))
            .select("doc_id", "uid", "atom_ix",
                    F.concat(F.col("concept1"), F.lit(" *"), F.col("relationship"),
                             F.lit("* "), F.col("concept2")).alias("fact")))


def artefacts(responses: DataFrame, min_size: int = MIN_SENTENCE_SIZE) -> DataFrame:
    """Per sentence record ``{uid, md5, data{source, facts[], graph[]}}``.

    All atoms of a sentence come from one reply row, so the artefact is a
    projection of that row (no group-by)."""
    g = gate(responses, min_size)
    arr = F.transform(atom_array(F.col("reply")), lambda a: a.withField(
        "relationship", normalize_relationship(a["relationship"])))
    fact_arr = F.transform(
        F.filter(arr, lambda a: a["relationship"].isNotNull() & a["concept1"].isNotNull()
                 & a["concept2"].isNotNull() & a["entity"].isNotNull()),
        lambda a: fact_text(a["concept1"], a["concept2"], a["entity"], a["relationship"]))
    data = F.struct(F.col("sentence").alias("source"), fact_arr.alias("facts"),
                    arr.alias("graph"))
    return g.select("doc_id", "uid",
                    F.when(F.col("has_data"), F.md5("sentence")).alias("md5"),
                    F.when(F.col("has_data"), data).alias("data"))


def complete_atoms(atoms_df: DataFrame, keys=("concept1", "concept2", "relationship",
                                               "importance")) -> DataFrame:
    return atoms_df.where(_has(*keys))


def atoms_quarantine(atoms_df: DataFrame, keys=("concept1", "concept2", "relationship",
                                                 "importance")) -> DataFrame:
    """Atoms the graph builders cannot use, with the missing key names."""
    missing = F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    return (atoms_df.where(~_has(*keys))
            .select("doc_id", "uid", "atom_ix", missing.alias("missing")))


def concept_worklist(atoms_df: DataFrame) -> DataFrame:
    """First context (sentence) per concept: concept1 before concept2, first
    sentence wins.  ``min(struct)`` is a partial aggregate, so a hot concept is
    combined map-side instead of being sorted in one task."""
    a = complete_atoms(atoms_df, ("concept1", "concept2", "relationship", "importance"))
    stacked = a.select(F.inline(F.array(
        F.struct(F.col("concept1").alias("concept"), F.lit(0).alias("side"),
                 "doc_id", "uid", "atom_ix", "sentence"),
        F.struct(F.col("concept2").alias("concept"), F.lit(1).alias("side"),
                 "doc_id", "uid", "atom_ix", "sentence"))))
    first = stacked.groupBy("concept").agg(
        F.min(F.struct("doc_id", "uid", "atom_ix", "side", "sentence")).alias("f"))
    return first.select("concept", F.col("f.doc_id").alias("doc_id"),
                        F.col("f.uid").alias("uid"), F.col("f.sentence").alias("context"))
