"""Filter interaction audit: what each filter removes in each order of filters.

Every document gets a mask with one bit for each filter that it fails, and one
aggregate counts the documents of each ``(part, mask)``.  All that follows works on
the lattice of filter subsets: state ``S`` is the set of filters applied so far, an
edge ``(S, f)`` applies filter ``f`` next.  A forward pass counts the orders that reach
each state, a backward pass those that leave it, so an edge lies on ``reach(S) *
leave(S + f)`` orders.  The removals of an edge come from the masks alone; weighted
with its orders they sum up to the filter's Shapley total, and the step of an order is
read from the edge that the order takes there.  With ``k`` filters there are
``k * 2**(k - 1)`` edges, whatever the number of documents and orders.

Counts are of rows of documents.  Rows: a null ``part`` counts as the empty string; a
null text is empty; a condition that is null counts as passed.  The filter for copies
fails a row if a row of a smaller ``doc_id`` has the same text (held by SHA-256), so a
row without ``doc_id`` neither fails it nor makes others fail; rows that repeat the
smallest id of a text all pass.  Labels hold for an id if one of its rows says so; rows
without id have none.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

MAX_FILTERS = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on a text without nulls.  Words are maximal runs of anything
    but a space, tab, line feed, vertical tab, form feed or carriage return."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def lattice(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that take the edge) of every edge for ``k`` filters."""
    full = (1 << k) - 1
    edges = [(s, f) for s in range(full + 1) for f in range(k) if not s >> f & 1]
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s, f in edges:
        reach[s | 1 << f] += reach[s]
    for s, f in reversed(edges):
        leave[s] += leave[s | 1 << f]
    return [(s, f, reach[s] * leave[s | 1 << f]) for s, f in edges]


def masks(docs: DataFrame, conditions: dict[str, Column], copies: str | None, part: str) -> DataFrame:
    """``part, doc_id, mask`` of every row; bit ``i`` is the ``i``-th filter, copies last."""
    bits = [F.coalesce(c, F.lit(False)).cast("int") * F.lit(1 << i) for i, c in enumerate(conditions.values())]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("copy"), sum(bits, F.lit(0)).alias("mask"))
    if copies is None:
        return rows.drop("copy")
    rows = materialise(rows, "filter-masks")
    known = rows.where("doc_id IS NOT NULL")
    # joined by text and id: a text with many copies is no hot key
    first = known.groupBy("copy").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0))
    late = F.coalesce("first", F.lit(1 << len(conditions)))
    known = known.join(first, ["copy", "doc_id"], "left").select("part", "doc_id", (F.col("mask") + late).alias("mask"))
    return known.unionByName(rows.where("doc_id IS NULL").drop("copy"))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None,
          copies: str | None = "E", part: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the counts of that step for every order of the
    filters and every value of ``part``.

    ``conditions``: one-character name -> failure condition over ``docs``; the default
    is ``text_conditions`` of ``text``.  ``copies``: name of the filter for copies of
    smaller ids, None for none.  ``labels``: ``doc_id, quality, toxic``.  At most
    ``MAX_FILTERS`` filters, as the result has a row for each step of each order."""
    if conditions is None:
        conditions = text_conditions(F.coalesce("text", F.lit("")))
    names = [*conditions, *([copies] if copies else [])]
    if not 1 <= len(names) <= MAX_FILTERS or len(set(names)) < len(names) or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MAX_FILTERS} filters with different names of one character")
    spark = docs.sparkSession
    rows = masks(docs, conditions, copies, part)
    flags = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")))
    rows = (rows.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").drop("doc_id")
            .unionByName(rows.where("doc_id IS NULL").drop("doc_id"), allowMissingColumns=True))
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("bad").alias("n_toxic"))

    edges = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("bigint").alias("weight"))
                      for s, f, w in lattice(len(names))))
    on_edge = counts.select("*", F.inline(edges)).withColumn("bit", F.expr("shiftleft(1, filter)"))
    before, fails = F.expr("mask & state") == 0, F.expr("mask & bit") != 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0))
    on_edge = on_edge.groupBy("part", "state", "filter", "weight").agg(
        total(before & ~fails).alias("kept"), total(before & fails).alias("removed"), total(~before & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(before & fails, "n_good").alias("good_lost"), total(before & fails, "n_toxic").alias("toxic_lost"))
    on_edge = on_edge.withColumn("shapley", F.sum(F.expr("weight * removed")).over(Window.partitionBy("part", "filter")))

    steps = [(order, i + 1, sum(1 << names.index(x) for x in order[:i]), names.index(order[i]))
             for order in map("".join, permutations(names)) for i in range(len(names))]
    steps = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return on_edge.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# The same by plain enumeration of orders.
ORACLE = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
             [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
              100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_toxic FROM m GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS earlier FROM o, x),
r AS (SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, step, f,
             n, n_good, n_toxic, fails[f] AS fails_it, len(list_filter(earlier, lambda j: fails[j])) = 0 AS here,
             len(list_filter(fails, lambda v: v)) = 1 AS one FROM c, s),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN here AND NOT fails_it THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN here AND fails_it THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN NOT here AND fails_it THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails_it AND one THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN here AND fails_it THEN n_good ELSE 0 END) AS good_lost,
             sum(CASE WHEN here AND fails_it THEN n_toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g
"""
