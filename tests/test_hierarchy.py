"""Labels of class graphs against a plain walk: trees, further parents, cycles, depth."""

import random

import pytest
from pyspark.sql import functions as F

from graphwright.operators import hierarchy as H


def closure(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        todo, seen = list(up[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def rng_edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


GRAPHS = {
    "tree": [(i, i // 2) for i in range(1, 60)],
    "chain": [(i, i + 1) for i in range(70)],
    "chain down": [(i + 1, i) for i in range(70)],
    "further parents": [(i, i // 2) for i in range(1, 40)] + [(i, (i * 7) % 13) for i in range(13, 40)],
    "cycles": [(i, i + 1) for i in range(9)] + [(9, 0), (20, 21), (21, 20), (21, 5), (30, 20), (31, 31), (32, 31), (40, 40)],
    "two-way chain": [(i, i + 1) for i in range(30)] + [(i + 1, i) for i in range(30)],
    "sparse": rng_edges(1, 60, 50), "dense": rng_edges(2, 25, 90), "critical": rng_edges(3, 50, 70),
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_labels_equal_a_walk(spark, name):
    edges = GRAPHS[name]
    rows = edges + edges[:3] + [(None, 1), (2, None)]
    h = H.build(spark.createDataFrame(rows, "cls long, anc long"))
    want = closure(edges)
    got = [tuple(r) for r in h.closure().select("cls", "anc").collect()]
    assert sorted(got) == sorted(want)
    nodes = {x for e in edges for x in e}
    targets = sorted(random.Random(name).sample(sorted(nodes), min(3, len(nodes)))) + [999]
    for some in [[t] for t in targets[:2]] + [targets]:
        below = [r.cls for r in h.below(spark.createDataFrame([(t,) for t in some], "cls long")).collect()]
        assert sorted(below) == sorted({a for a, b in want if b in some} | set(some))
    paths = {r.cls: r.path for r in h.paths.collect()}
    assert set(paths) == nodes and all(p[0] == c and len(p) == len(set(p)) for c, p in paths.items())


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    made = []
    monkeypatch.setattr(H, "written", lambda df, name, f=H.written: made.append(name) or f(df, name))
    H.build(spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(200)], "cls string, anc string"))
    assert made.count("paths") <= 10 and made.count("cycles") <= 9


def test_ids_of_any_type(spark):
    h = H.build(spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "cls string, anc string"))
    assert sorted(r.cls for r in h.below(spark.createDataFrame([("c",)], "cls string")).collect()) == ["a", "b", "c", "d"]
    assert h.closure().where(F.col("cls") == "d").count() == 3
