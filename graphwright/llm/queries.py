"""Registered queries of the training-data operators: key -> (callable, oracle or None)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..session import scratch_path
from .common import read_table, ship_package
from . import (decontamination, filter_audit, fingerprints, jaccard_join, licences, line_dedup, mixing, ranked_search, suffix_dedup,
               token_attribution, token_blocks, toxicity, warc_zstd)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_attribution(spark, sf_dir):
    return token_attribution.attribute(read_table(spark, sf_dir, "documents"))


@query
def op3_token_blocks(spark, sf_dir):
    path = scratch_path(spark, "token-blocks")
    token_blocks.write_blocks(read_table(spark, sf_dir, "documents"), path)
    return token_blocks.read_summary(spark, path)


def toxicity_model(spark, sf_dir, docs):
    """Learned from the labels of rows whose crc32 leaves them in the training part."""
    return toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())


@query
def op9_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_model(spark, sf_dir, docs))


@query
def op2_decontamination(spark, sf_dir):
    return decontamination.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


@query
def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix_epoch", "mix_place", "mix_weight")


@query
def op7_line_dedup(spark, sf_dir):
    d = line_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("kept")


@query
def op10_licences(spark, sf_dir):
    return licences.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filter_audit.ORACLE


@query
def op12_warc_zstd(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc_zstd.write(read_table(spark, sf_dir, "pages"), path)
    return warc_zstd.valid(warc_zstd.read(spark, path, payloads=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op12_warc_zstd"] = warc_zstd.ORACLE


@query
def op13_ranked_search(spark, sf_dir):
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = ranked_search.ORACLE
