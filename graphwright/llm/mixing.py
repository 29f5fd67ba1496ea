"""Mixing sources to target weights: temperature mixing.

A source with the token share p gets the weight ``p**a / sum(p**a)``.  The
exponent a in [0, 1] (1: shares as they are, 0: equal weights) is bisected:

* ``target_entropy``: a with that entropy of the weights, as a part of the
  largest one, log(sources); or the nearest a that the limit admits;
* ``max_repeats``: no source is given more than this many times its tokens; the
  flattest weights within it are taken when no entropy is given.

``budget`` is the number of tokens to give; without it, the least budget that
gives every source at least once, so that no document is left out.  A source's
share of the budget is realised by block permutations: documents are dealt to
blocks by a hash, and each epoch gives the blocks of a source in an order of
its own (a hash of seed, epoch and block).  The last epoch stops at the block
where the share is met, to the nearest block.  A source has between
``MIN_BLOCKS`` and ``MAX_BLOCKS`` blocks, so what one task orders is bounded.

Tokens are white-space-separated words unless ``tokens`` (a Column) is given.

Rows: null and empty texts have no tokens and go with their block.  Null is a
source like any other.  A source without tokens has no weight and is given
once.  Repeated rows are separate documents.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import fresh, materialise, text_or_empty

MAX_REPEATS = 2.0
SEED = 1
BLOCK_TOKENS, MIN_BLOCKS, MAX_BLOCKS = 1 << 16, 64, 1 << 16
SECTIONS, ROUNDS = 16, 10


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def shares(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``source, n_docs, n_tokens, share`` (share null for a source without tokens)."""
    count = (word_count(text_or_empty()) if tokens is None else tokens).cast("bigint")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(count, F.lit(0))).alias("n_tokens"))
    per = materialise(per, "sources")
    total = per.agg(F.sum("n_tokens")).first()[0] or 0
    return per.withColumn("share", F.when(F.col("n_tokens") > 0, F.col("n_tokens") / F.lit(float(max(total, 1)))))


def _measures(shared: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of p**a, sum of p**a * ln p) for each exponent, in one aggregate."""
    p = F.col("share")
    cols = [F.sum(F.pow(p, F.lit(a))) for a in exponents] + [F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in exponents]
    row = shared.where("share IS NOT NULL").agg(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
    return list(zip(row[:len(exponents)], row[len(exponents):]))


def _bisect(shared: DataFrame, above) -> float:
    """The exponent in [0, 1] where ``above(a, sums)`` (monotone) turns true; 1 if it never does.
    Each round evaluates ``SECTIONS`` - 1 points, that is four bisection steps, in one pass."""
    lo, hi = 0.0, 1.0
    if above(0.0, _measures(shared, [0.0])[0]):
        return 0.0
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * k / SECTIONS for k in range(1, SECTIONS)]
        flags = [above(a, m) for a, m in zip(points, _measures(shared, points))]
        k = flags.index(True) if True in flags else SECTIONS - 1
        lo, hi = (points[k - 1] if k else lo), (points[k] if k < SECTIONS - 1 else hi)
    return hi


def exponent(shared: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
             budget: float | None = None) -> float:
    """The exponent that meets the entropy or the limit; the limit has precedence."""
    edge = shared.where("share IS NOT NULL").agg(F.min("share"), F.max("share"), F.count(F.lit(1)), F.sum("n_tokens")).first()
    low, high, n, total = edge
    if not n or n == 1:
        return 1.0

    def within(a, m):  # largest number of repeats is at most the limit (it falls as a grows)
        most = low ** (a - 1)
        least = high ** (a - 1)
        return (most / least if budget is None else most / m[0] * budget / total) <= max_repeats * (1 + 1e-12)

    def calm(a, m):  # entropy has come down to the target
        return math.log(m[0]) - a * m[1] / m[0] <= target_entropy * math.log(n)

    limit = _bisect(shared, within) if max_repeats is not None else 0.0
    return max(limit, _bisect(shared, calm)) if target_entropy is not None else limit


def weights(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
            budget: float | None = None, tokens: Column | None = None) -> DataFrame:
    """``source, n_docs, n_tokens, share, weight, quota`` (tokens to give) and ``repeats``."""
    s = shares(docs, tokens)
    a = exponent(s, max_repeats, target_entropy, budget)
    norm, _ = _measures(s, [a])[0]
    s = s.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(norm or 1.0))
    if budget is None:
        budget = s.where("weight > 0").agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0.0
    quota = F.col("weight") * F.lit(float(budget))
    return (s.withColumn("quota", F.coalesce(quota, F.lit(0.0)))
            # no share is a rounding error away from a whole number of epochs
            .withColumn("repeats", F.coalesce(F.round(F.try_divide(F.col("quota"), F.col("n_tokens")), 9), F.lit(1.0))))


def _blocks(col_tokens: str = "n_tokens") -> Column:
    return F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(MIN_BLOCKS), F.ceil(F.col(col_tokens) / F.lit(BLOCK_TOKENS)))).cast("int")


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
        budget: float | None = None, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """``docs`` with their columns, a row for each time that a document is given, and
    ``mix_epoch, mix_place`` (order of its block in the epoch), ``mix_weight`` (of its source)."""
    count = F.coalesce((word_count(text_or_empty()) if tokens is None else tokens).cast("bigint"), F.lit(0))
    key, block, number = (fresh(docs, n) for n in ("_source", "_block", "_blocks"))
    mixed = materialise(weights(docs, max_repeats, target_entropy, budget, tokens), "weights")
    sources = mixed.select(F.struct("source").alias(key), _blocks().alias(number), "weight", "repeats",
                           F.col("n_tokens").alias("total"))
    dealt = (docs.withColumn(key, F.struct("source")).join(sources.select(key, number), key)
             .withColumn(block, F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col(number)).cast("int")).drop(number))
    sizes = materialise(dealt.groupBy(key, block).agg(F.sum(count).alias("tokens")), "blocks")
    epochs = (sizes.join(sources, key)
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("repeats").cast("int") - 1, F.lit(0))))))
    order = Window.partitionBy(key, "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", block), block)
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = (F.col("repeats") - F.col("epoch")) * F.col("total")  # tokens still to give in this epoch
    given = (epochs.withColumn("place", F.row_number().over(order)).withColumn("before", before)
             .where((F.col("repeats") >= F.col("epoch") + 1) | (F.col("total") == 0)
                    | (F.col("before") + F.col("tokens") / 2 <= rest))
             .select(F.struct(F.col(key), F.col(block)).alias("at"),
                     F.struct("epoch", "place", "weight").alias("given")))
    at, out = fresh(docs, "_at"), fresh(docs, "_given")
    given = given.withColumnsRenamed({"at": at, "given": out})
    return (dealt.withColumn(at, F.struct(key, block)).join(given, at)
            .select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{out}.epoch").alias("mix_epoch"),
                    F.col(f"{out}.place").alias("mix_place"), F.col(f"{out}.weight").alias("mix_weight")))
