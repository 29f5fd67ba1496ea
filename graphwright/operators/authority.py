"""Authority graph: 5-tuple rows from a triple table, nodes, topic links.

Rows: ``(locResource, property, viafResource, label, topic)``; edge rows carry
both resources, label rows a ``viafResource`` and its label, topic rows a
``locResource`` and its issued date.

Links: inside a topic every pair of known nodes is linked.  The pair list is
quadratic in the topic size (one topic may hold a third of all rows), so it is
never materialised: links are returned as topic membership
``(topic, id, topic_size)``; the link set is {(a, b) : same topic, a < b}, and
the link count per topic is ``topic_size * (topic_size - 1) / 2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.joins import skew_join

ROW_COLS = ["locResource", "property", "viafResource", "label", "topic"]


def _row(loc, prop, viaf, label, topic) -> Column:
    n = F.lit(None).cast("string")
    return F.struct(*[(c if c is not None else n).alias(name)
                      for c, name in zip((loc, prop, viaf, label, topic), ROW_COLS)])


def authority_rows(triples: DataFrame) -> DataFrame:
    """The four-branch union, in one scan of the triple table, DISTINCT."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    c1 = s.startswith(C.VIAF_PREFIX) & o.startswith(C.LOC_PREFIX)
    c2 = s.startswith(C.LOC_PREFIX) & o.startswith(C.VIAF_PREFIX)
    c3 = (p == C.RDFS_LABEL) & s.startswith(C.VIAF_LABEL_SCOPE)
    c4 = (p == C.XSD_ISSUED) & s.startswith(C.LOC_TOPIC_SCOPE)
    arr = F.filter(F.array(
        F.when(c1, _row(o, p, s, None, None)),
        F.when(c2, _row(s, p, o, None, None)),
        F.when(c3, _row(None, None, s, o, None)),
        F.when(c4, _row(s, None, None, None, o))), lambda x: x.isNotNull())
    return triples.where(c1 | c2 | c3 | c4).select(F.inline(arr)).distinct()


def _node_id(loc: Column) -> Column:
    return F.replace(loc, F.lit(C.LOC_ID_PREFIX), F.lit(""))


def authority_nodes(rows: DataFrame) -> DataFrame:
    """Nodes ``(id, user, description, link)`` from edge rows.

    Labels per viafResource and topics per locResource are last-wins maps in
    the reference with an undefined row order; the fixed rule here is
    ``max``.  First node per id: smallest ``(viafResource, property)``, done
    with ``min(struct)`` so a hot id is combined map-side.
    """
    edges = rows.where(F.col("locResource").isNotNull() & F.col("viafResource").isNotNull()
                       & F.col("property").isNotNull()) \
        .select("locResource", "property", "viafResource")
    labels = rows.where(F.col("label").isNotNull()).groupBy("viafResource") \
        .agg(F.max("label").alias("label"))
    topics = rows.where(F.col("topic").isNotNull()).groupBy("locResource") \
        .agg(F.max("topic").alias("topic"))
    # one viafResource may carry a large share of the edges: skew-split joins
    enriched = (skew_join(skew_join(edges, labels, "viafResource", "left"), topics, "locResource", "left", counted=edges)
                .withColumn("description", F.coalesce("topic", "label"))
                .where(F.col("description").isNotNull())
                .withColumn("id", _node_id(F.col("locResource"))))
    first = enriched.groupBy("id").agg(F.min(F.struct(
        "viafResource", "property", F.col("label").alias("user"), "description")).alias("n"))
    return first.select("id", F.col("n.user").alias("user"), F.col("n.description")
                        .alias("description"), F.col("n.viafResource").alias("link"))


def topic_members(rows: DataFrame) -> DataFrame:
    """``(topic, id)`` for every topic row (the reference's topic -> ids list)."""
    return rows.where(F.col("topic").isNotNull()).select(
        "topic", _node_id(F.col("locResource")).alias("id"))


def group_members(df: DataFrame, group_col: str, value_col: str, pos_col: str) -> DataFrame:
    """Distinct values per group with their first position and the group size.

    Pairs of the group are all ``(a, b)`` with ``a.first_pos < b.first_pos``
    and ``a.value != b.value`` (n·(n−1)/2 of them).  Both steps are partial
    aggregates; the size is joined back on the group key (AQE splits a hot
    group's partition)."""
    firsts = df.groupBy(group_col, value_col).agg(F.min(pos_col).alias("first_pos"))
    sizes = firsts.groupBy(group_col).agg(F.count("*").alias("group_size"))
    return skew_join(firsts, sizes, group_col, count_col="group_size")


def authority_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Topic membership of known nodes: ``(topic, id, topic_size)``.

    Members are reduced to known nodes (semi join) and de-duplicated before
    anything else, so the cost is linear in the topic rows."""
    members = topic_members(rows).join(nodes.select("id"), "id", "left_semi").distinct()
    sizes = members.groupBy("topic").agg(F.count("*").alias("topic_size"))
    return skew_join(members, sizes, "topic", count_col="topic_size").select("topic", "id", "topic_size")


def link_count(links: DataFrame) -> DataFrame:
    """Total number of node-link pairs implied by the membership form."""
    per_topic = links.select("topic", "topic_size").distinct()
    return per_topic.agg(F.sum(F.col("topic_size") * (F.col("topic_size") - 1) / 2)
                         .cast("bigint").alias("n_links"))


def nodelink_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """JSON lines of the node-link document: nodes, then topic memberships."""
    n = nodes.select(F.lit("node").alias("kind"),
                     F.to_json(F.struct("id", "user", "description", "link")).alias("json"))
    l = links.select(F.lit("link").alias("kind"),
                     F.to_json(F.struct("topic", "id", "topic_size")).alias("json"))
    return n.unionByName(l)


def write_nodelink(nodes: DataFrame, links: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")
