"""Corpus pipeline: five stages over ``documents``, each by one training-data operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``:

* ``toxicity``: documents that are predicted toxic go (labels of the training part only);
* ``jaccard_join``: one document of each near-duplicate class stays, the smallest ``doc_id``;
* ``decontamination``: documents that hold a benchmark item go;
* ``mixing``: every document stays; sources with little text are repeated, so a
  ``doc_id`` may occur as often as its source is given;
* ``token_blocks``: the ids of every row in token blocks, read back as
  ``doc_id, start, n_tokens, ids_crc32``.

Null and empty texts pass all filters.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwright.llm import decontamination, jaccard_join, mixing, token_blocks, toxicity
from graphwright.llm.common import materialise, read_table, ship_package
from graphwright.session import scratch_path


# The stages share their executors' Python workers, so the last one's memo is small.
MEMO_WORDS = 250_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.keep(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontamination.keep(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*(f"`{c}`" for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = scratch_path(spark, "token-blocks")
    token_blocks.write_blocks(docs, path, memo_words=MEMO_WORDS)
    return token_blocks.read_summary(spark, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_blocks", token_stage),
]

# Learned models, hashes of signatures and encoded ids are not expressible in SQL;
# tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
