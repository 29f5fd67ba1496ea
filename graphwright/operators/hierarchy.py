"""Reachability in a class graph by labels: "subclass of", any number of steps, without a
table of pairs.

Every class gets one parent, so classes form a forest once cycles of that choice are cut at
their least class.  A class's label is its path up to its root; a class is below another
in the forest if its path holds it.  Paths are built by doubling: round ``k`` joins the path of
``2**k`` steps of a class with that of the class where it ends, so a forest of depth ``d``
needs ``log2(d)`` rounds of one join each.  Edges outside the forest (further parents, cuts) are kept with the paths of
both their ends; what is below a target is the subtrees of the target and of
the lower ends of edges that lead into those subtrees, found edge by edge.  The result
is linear in the classes below the target; all pairs are made only by ``closure``.

Null ends and repeated edges are dropped; cycles end; the order of ids only affects which
edges are in the forest.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import checkpoint, written


@dataclass
class Hierarchy:
    paths: DataFrame    # cls, path: the class itself first, its root last
    across: DataFrame   # tail, tail_path, head_path of the edges outside the forest
    loops: DataFrame    # cls of the edges to itself

    def below(self, targets: DataFrame) -> DataFrame:
        """``cls``: the targets (column ``cls``) and every class below one of them."""
        known = frontier = written(targets.select("cls").distinct(), "classes")
        under = self.across.select("tail", "tail_path", F.explode("head_path").alias("cls"))
        while not frontier.isEmpty():
            hit = under.join(frontier, "cls", "left_semi").select("tail", "tail_path").distinct()
            inside = hit.select("tail", F.explode("tail_path").alias("cls")).join(known, "cls", "left_semi").select("tail")
            frontier = written(hit.join(inside, "tail", "left_anti").select(F.col("tail").alias("cls")).distinct(), "classes")
            known = known.unionByName(frontier)
        found = self.paths.select(F.col("cls").alias("c"), F.explode("path").alias("cls")).join(known, "cls", "left_semi")
        return found.select(F.col("c").alias("cls")).unionByName(targets.select("cls")).distinct()

    def closure(self) -> DataFrame:
        """``cls, anc`` for one or more steps: every pair, distinct."""
        tree = self.paths.select("cls", F.explode(F.slice("path", 2, F.size("path"))).alias("anc"))
        loops = self.loops.select("cls", F.col("cls").alias("anc"))
        if self.across.isEmpty():
            return tree.unionByName(loops).distinct()
        # from the lower end of an edge to those of other edges above its upper end
        tails = self.across.select(F.col("tail").alias("cls")).distinct()
        steps = self.across.select("tail", F.explode("head_path").alias("cls")).join(tails, "cls", "left_semi")
        reach = close_pairs(steps.select(F.col("tail").alias("cls"), F.col("cls").alias("anc")))
        reach = reach.unionByName(tails.select("cls", F.col("cls").alias("anc")))
        above = (reach.join(self.across.select(F.col("tail").alias("anc"), "head_path"), "anc")
                 .select(F.col("cls").alias("tail"), F.explode("head_path").alias("anc")).distinct())
        turned = self.paths.select("cls", F.explode("path").alias("tail")).join(above, "tail").select("cls", "anc")
        return tree.unionByName(loops).unionByName(turned).distinct()


def close_pairs(edges: DataFrame, checkpoint_every: int = 3) -> DataFrame:
    """Transitive closure ``cls, anc`` of a small graph (cycles are safe): semi-naive with
    path doubling, so paths of up to ``2**k`` steps are known after round ``k``.  Rounds are
    persisted; a reliable checkpoint every few rounds bounds the lineage."""
    edges = edges.distinct().persist()
    held, closure, delta = [edges], edges, edges
    for rnd in count(1):
        right = (delta.alias("d").join(closure.alias("c"), F.col("d.anc") == F.col("c.cls"))
                 .select(F.col("d.cls").alias("cls"), F.col("c.anc").alias("anc")))
        left = (closure.alias("c").join(delta.alias("d"), F.col("c.anc") == F.col("d.cls"))
                .select(F.col("c.cls").alias("cls"), F.col("d.anc").alias("anc")))
        delta = right.unionByName(left).distinct().join(closure, ["cls", "anc"], "left_anti")
        delta = checkpoint(delta) if rnd % checkpoint_every == 0 else delta.persist()
        held.append(delta)
        if delta.isEmpty():
            break
        closure = closure.unionByName(delta)
        if rnd % checkpoint_every == 0:
            closure = checkpoint(closure.repartition("cls"))
    closure = checkpoint(closure.repartition("cls"))
    for d in held:
        d.unpersist()
    return closure


def _cycle_minima(parents: DataFrame) -> DataFrame:
    """The least class of every cycle of ``cls, up`` (one parent each).  ``low`` is the least
    class on the next ``span`` steps; a class whose way ends is on no cycle and goes."""
    cur = parents.where("up IS NOT NULL").select("cls", "up", F.col("up").alias("low"))
    span, n = 1, cur.count()
    while 0 < n and span <= n:
        further = cur.select(F.col("cls").alias("up"), F.col("up").alias("next"), F.col("low").alias("low2"))
        cur = written(cur.join(further, "up").select("cls", F.col("next").alias("up"), F.least("low", "low2").alias("low")), "cycles")
        span, n = 2 * span, cur.count()
    return cur.where("low = cls").select("cls")


def build(edges: DataFrame) -> Hierarchy:
    """Labels of ``cls, anc`` (the class and one above it)."""
    edges = written(edges.where("cls IS NOT NULL AND anc IS NOT NULL").select("cls", "anc").distinct(), "class-edges")
    loops, edges = edges.where("cls = anc").select("cls"), edges.where("cls != anc")
    nodes = edges.select("cls").unionByName(edges.select(F.col("anc").alias("cls"))).unionByName(loops).distinct()
    parents = written(nodes.join(edges.groupBy("cls").agg(F.min("anc").alias("up")), "cls", "left"), "parents")
    cut = _cycle_minima(parents).withColumn("cut", F.lit(True))
    forest = parents.join(cut, "cls", "left").select("cls", F.when(F.col("cut").isNull(), F.col("up")).alias("up"))
    cur = written(forest.withColumn("path", F.array("cls")), "paths")
    tree = cur.select("cls", F.col("up").alias("anc"))
    while not cur.where("up IS NOT NULL").isEmpty():
        # both sides are read from tables, so AQE may split the children of one class
        further = cur.select(F.col("cls").alias("up"), F.col("path").alias("rest"), F.col("up").alias("next"))
        cur = written(cur.join(further, "up", "left").select(
            "cls", F.col("next").alias("up"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path")), "paths")
    paths = cur.select("cls", "path")
    across = edges.join(tree, ["cls", "anc"], "left_anti")
    across = (across.join(paths.withColumnRenamed("path", "tail_path"), "cls")
              .join(paths.select(F.col("cls").alias("anc"), F.col("path").alias("head_path")), "anc")
              .select(F.col("cls").alias("tail"), "tail_path", "head_path"))
    return Hierarchy(paths, written(across, "across"), loops)
