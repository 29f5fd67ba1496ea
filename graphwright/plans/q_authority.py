"""Authority graph queries: 5-tuple rows, nodes, topic links, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.lineage import written
from ..operators import authority as A
from ..sources.fixtures import fixture
from ..sources.tables import table
from . import duck as D
from .registry import register

_ROWS = "arows AS " + D.authority_rows_sql()
_NODES = "anodes AS " + D.authority_nodes_sql()


def _rows(spark, sf):
    return A.authority_rows(fixture(spark, sf, "authority_triples"))


def _stored(spark, sf):
    """The rows, written once: nodes and links read them several times."""
    return written(_rows(spark, sf), "authority-rows")


@register("authority_rows", D.wf(["authority_triples"], "SELECT * FROM arows", _ROWS))
def q_authority_rows(spark, sf):
    return _rows(spark, sf)


@register("authority_nodes", D.wf(["authority_triples"], "SELECT * FROM anodes",
                                  _ROWS + ",\n" + _NODES))
def q_authority_nodes(spark, sf):
    return A.authority_nodes(_stored(spark, sf))


@register("topic_members", D.wf(["authority_triples"], f"""
SELECT topic, replace(locResource, '{C.LOC_ID_PREFIX}', '') AS id FROM arows WHERE topic IS NOT NULL""",
                                _ROWS))
def q_topic_members(spark, sf):
    return A.topic_members(_rows(spark, sf))


_LINKS = f"""alinks AS (SELECT topic, id, count(*) OVER (PARTITION BY topic) AS topic_size FROM (
  SELECT DISTINCT topic, replace(locResource, '{C.LOC_ID_PREFIX}', '') AS id FROM arows
  WHERE topic IS NOT NULL) m WHERE id IN (SELECT id FROM anodes))"""


@register("authority_links", D.wf(["authority_triples"], "SELECT * FROM alinks",
                                  _ROWS + ",\n" + _NODES + ",\n" + _LINKS))
def q_authority_links(spark, sf):
    rows = _stored(spark, sf)
    return A.authority_links(rows, A.authority_nodes(rows))


@register("authority_link_count", D.wf(["authority_triples"], """
SELECT CAST(sum(topic_size * (topic_size - 1) / 2) AS BIGINT) AS n_links FROM (
  SELECT DISTINCT topic, topic_size FROM alinks)""", _ROWS + ",\n" + _NODES + ",\n" + _LINKS))
def q_authority_link_count(spark, sf):
    rows = _stored(spark, sf)
    return A.link_count(A.authority_links(rows, A.authority_nodes(rows)))


@register("pairs_in_group", D.wf([], """
SELECT l_orderkey, l_partkey, first_pos, count(*) OVER (PARTITION BY l_orderkey) AS group_size FROM (
  SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_pos FROM lineitem GROUP BY 1, 2)"""))
def q_pairs_in_group(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return A.group_members(li, "l_orderkey", "l_partkey", "l_linenumber") \
        .withColumnRenamed("first_pos", "first_pos")


@register("nodelink_json", D.wf(["authority_triples"], """
SELECT 'node' AS kind, id, user, description, link, NULL::VARCHAR AS topic, NULL::BIGINT AS topic_size FROM anodes
UNION ALL SELECT 'link', id, NULL, NULL, NULL, topic, topic_size FROM alinks""", _ROWS + ",\n" + _NODES + ",\n" + _LINKS))
def q_nodelink_json(spark, sf):
    """The JSON lines of the document, parsed back."""
    rows = _stored(spark, sf)
    nodes = written(A.authority_nodes(rows), "authority-nodes")  # lines and links
    lines = A.nodelink_json(nodes, A.authority_links(rows, nodes))
    fields = "id string, user string, description string, link string, topic string, topic_size bigint"
    return lines.select("kind", F.from_json("json", fields).alias("j")).select("kind", "j.*")

