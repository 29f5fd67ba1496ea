"""md5-keyed cache records and idempotent cache maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C


def cache_resource(records: DataFrame, ident_values: DataFrame, id_col: str = "record_id",
                   name_col: str = "name", data_col: str = "data", url: Column | None = None,
                   type_: str = C.DEFAULT_CACHE_TYPE, as_of: Column | None = None) -> DataFrame:
    """Resource record: md5 of the name, type, name, url, JSON data (text and
    parsed), date and the identifier values found in the data with their counts."""
    per = ident_values.groupBy(id_col, "value").agg(F.count("*").alias("n"))
    # the identifiers of one record are bounded by its own data
    counts = per.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("identifiers"),
                                     F.sum("n").alias("n_identifiers"))
    r = records.join(counts, id_col, "left")
    return r.select(id_col, F.md5(name_col).alias("md5"), F.lit(type_).alias("type"),
                    F.col(name_col).alias("name"),
                    (url if url is not None else F.lit(None).cast("string")).alias("url"),
                    F.col(data_col).alias("data"), F.expr(f"try_parse_json(`{data_col}`)").alias("parsed"),
                    F.coalesce("identifiers", F.create_map().cast("map<string,bigint>")).alias("identifiers"),
                    (as_of if as_of is not None else F.current_timestamp()).alias("date"),
                    F.coalesce("n_identifiers", F.lit(0)).cast("bigint").alias("n_identifiers"))


def cache_relationship(artefacts: DataFrame, url: Column) -> DataFrame:
    """Sentence records that have data, tagged ``relationship`` with a url."""
    return (artefacts.where(F.col("data").isNotNull())
            .select("doc_id", "uid", "md5", url.alias("url"), F.lit("relationship").alias("type"),
                    F.col("data.source").alias("source"), F.col("data.facts").alias("facts"),
                    F.col("data.graph").alias("graph"),
                    F.size("data.graph").cast("bigint").alias("n_atoms"),
                    F.size("data.facts").cast("bigint").alias("n_facts")))


def resource_identifiers(cached: DataFrame) -> DataFrame:
    """Long form of the identifier counts: ``(md5, name, value, n)``."""
    return cached.select("md5", "name", F.explode("identifiers").alias("value", "n"))


def relationship_atoms(cached: DataFrame) -> DataFrame:
    """Long form of the atoms: ``(doc_id, uid, md5, source, atom_ix, key, value)``, every key."""
    a = cached.select("doc_id", "uid", "md5", "source", F.explode("graph").alias("a"))
    return a.select("doc_id", "uid", "md5", "source", F.col("a.atom_ix").alias("atom_ix"), F.explode("a.fields").alias("key", "value"))


def relationship_facts(cached: DataFrame) -> DataFrame:
    """Long form of the facts: ``(doc_id, uid, md5, pos, fact)``."""
    return (cached.select("doc_id", "uid", "md5", F.posexplode("facts").alias("pos", "fact"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def write_cache(records: DataFrame, path: str) -> None:
    """Append records to the Parquet cache, one folder per ``type``."""
    records.write.mode("append").partitionBy("type").parquet(path)


def cache_pending(new: DataFrame, cached: DataFrame, key: str = "md5") -> DataFrame:
    """Records whose key is not cached yet (anti join; re-running adds nothing)."""
    return new.join(cached.select(key).distinct(), key, "left_anti")


def cache_latest(records: DataFrame, key: str = "md5", date_col: str = "date") -> DataFrame:
    """Newest record per key (``max_by`` over the date, a partial aggregate;
    ties broken by the whole record)."""
    cols = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.max(F.struct(date_col, *[c for c in cols if c != date_col]))
                                    .alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])
