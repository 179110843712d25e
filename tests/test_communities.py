"""Leiden and Louvain: what a partition has to be, against local search node by node and against the rounds on Spark."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import communities as C
from lumenweave.plans import communities as P
from lumenweave.session import new_path
from tests.compare import DATA


def planted(seed, groups=4, size=8, inner=0.7, outer=0.05):
    rng = random.Random(seed)
    nodes = list(range(groups * size))
    return [(a, b, float(rng.randrange(1, 4))) for a, b in combinations(nodes, 2) if rng.random() < (inner if a // size == b // size else outer)]


def table(spark, graphs):
    return spark.createDataFrame([(g, a, b, w) for g, edges in graphs.items() for a, b, w in edges], "graph string, a long, b long, weight double")


def quality(edges, of, gamma=1.0):
    k, inner, twom = defaultdict(float), defaultdict(float), 2 * sum(w for *_, w in edges)
    for a, b, w in edges:
        k[a] += w
        k[b] += w
        if of[a] == of[b]:
            inner[of[a]] += 2 * w
    total = defaultdict(float)
    for n, x in k.items():
        total[of[n]] += x
    return sum(inner[c] / twom - gamma * (t / twom) ** 2 for c, t in total.items())


def local_search(edges, rng, gamma=1.0):
    """Nodes one after the other go where modularity rises most, until none does."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    of = {n: n for n in nodes}
    while True:
        moved = False
        for n in rng.sample(nodes, len(nodes)):
            best = max({of[m] for a, b, _ in edges for m in (a, b) if n in (a, b)}, key=lambda c: (quality(edges, of | {n: c}, gamma), c == of[n]))
            if quality(edges, of | {n: best}, gamma) > quality(edges, of, gamma) + 1e-12:
                of[n], moved = best, True
        if not moved:
            return quality(edges, of, gamma)


def memberships(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.graph, r.level][r.node] = r.community
    return out


def connected(edges, nodes):
    seen, todo = set(), [min(nodes)]
    while todo:
        n = todo.pop()
        seen.add(n)
        todo += [m for a, b, _ in edges for m in (a, b) if n in (a, b) and m in nodes and m not in seen]
    return seen == nodes


GRAPHS = {
    "planted": planted(1), "loose": planted(2, 3, 7, 0.4, 0.2), "star": [(0, i, 1.0) for i in range(1, 30)], "pair": [(5, 9, 0.25)],
    "ring": [(i, (i + 1) % 24, 1.0) for i in range(24)], "cliques": [(a + 10 * g, b + 10 * g, 1.0) for g in range(5) for a, b in combinations(range(6), 2)] + [(10 * g, 10 * g + 11, 1.0) for g in range(4)],
    "apart": [(1, 2, 1.0), (2, 3, 1.0), (11, 12, 5.0)], "heavy": [(0, 1, 1000.0), (1, 2, 1.0), (2, 3, 1000.0), (3, 0, 1.0)],
}


@pytest.fixture(scope="module")
def found(spark):
    edges = table(spark, GRAPHS)
    return memberships(C.leiden(edges, levels=2))


@pytest.mark.parametrize("name", GRAPHS)
def test_leiden_of_a_graph(found, name):
    edges, rng = GRAPHS[name], random.Random(0)
    nodes = {n for a, b, _ in edges for n in (a, b)}
    for level, gamma in ((0, 1.0), (1, 2.0)):
        of = found[name, level]
        assert set(of) == nodes
        groups = defaultdict(set)
        for n, c in of.items():
            groups[c].add(n)
        assert all(c == min(g) and connected(edges, g) for c, g in groups.items())
        components, rest = {}, set(nodes)
        while rest:
            low = min(rest)
            part = max((g for g in [{n for n in rest if _reaches(edges, low, n)}]), key=len)
            components |= dict.fromkeys(part, low)
            rest -= part
        got = quality(edges, of, gamma)
        assert got >= quality(edges, components, gamma) - 1e-12
        best = max(local_search(edges, rng, gamma) for _ in range(3))
        assert got >= best - 0.1 * abs(best) - 1e-12


def _reaches(edges, a, b):
    seen, todo = set(), [a]
    while todo:
        n = todo.pop()
        seen.add(n)
        todo += [m for x, y, _ in edges for m in (x, y) if n in (x, y) and m not in seen]
    return b in seen


def test_planted_groups_are_found(found):
    assert {n: c // 8 for n, c in found["planted", 0].items()} == {n: n // 8 for n in range(32)}
    assert {n: c // 10 for n, c in found["cliques", 0].items()} == {n: n // 10 for n in found["cliques", 0]}


def test_rounds_on_spark_are_those_in_numpy(spark):
    edges = table(spark, {g: GRAPHS[g] for g in ("apart", "heavy")} | {"small": planted(5, 3, 4, 0.9, 0.1)})
    for solve in (lambda e, **o: C.leiden(e, iterations=1, **o), C.louvain):
        near, far = solve(edges), solve(edges.repartition(7), most=0)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def test_louvain_levels_only_gain(spark):
    edges = table(spark, GRAPHS)
    tree = C.louvain(edges)
    path = new_path(spark, "tree")
    tree.write.parquet(path)
    tree = spark.read.parquet(path)
    rows = tree.collect()
    # a tree: one parent each, and a level's nodes are the communities of the one before
    assert len({(r.graph, r.level, r.node) for r in rows}) == len(rows)
    for g in GRAPHS:
        for level in range(2, 1 + max(r.level for r in rows if r.graph == g)):
            assert {r.node for r in rows if (r.graph, r.level) == (g, level)} == {r.community for r in rows if (r.graph, r.level) == (g, level - 1)}
    flat = C.flattened(tree)
    q = {(r.graph, r.level): r.modularity for r in C.modularity(edges, flat).collect()}
    for (g, level), of in memberships(flat).items():
        assert abs(quality(GRAPHS[g], of) - q[g, level]) < 1e-12
        assert level == 1 and q[g, 1] > quality(GRAPHS[g], {n: n for n in of}) or q[g, level] >= q[g, level - 1] - 1e-12


def test_edges_given_twice_loops_and_nothing(spark):
    once = [(1, 2, 2.0), (2, 3, 1.0), (3, 4, 2.0)]
    twice = [(2, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (4, 3, 2.0), (3, 3, 9.0), (1, 4, 0.0), (1, 4, -3.0)]
    rows = [memberships(C.leiden(table(spark, {"g": e})))["g", 0] for e in (once, twice)]
    assert rows[0] == rows[1] == {1: 1, 2: 1, 3: 3, 4: 3}
    none = table(spark, {}).where("a > 0")
    assert C.leiden(none).collect() == [] and C.louvain(none).collect() == [] and C.louvain(none, most=0).collect() == []


def test_same_communities_of_two_levels_count_once(spark):
    rows = [("g", 0, n, 1) for n in (1, 2, 3)] + [("g", 1, n, 1) for n in (1, 2, 3)] + [("g", 1, n, 4) for n in (4, 5, 6, 7)] + [("g", 0, 8, 8)]
    got = C.detected(spark.createDataFrame(rows, "graph string, level int, node long, community long"), least=3, most=2)
    assert sorted(map(tuple, got.collect())) == [("g", 1, 1, 4, 4), ("g", 2, 0, 1, 3)]


def test_queries(spark):
    edges = P.seen(spark, DATA).cache()
    leiden, tree = (q(spark, DATA) for q in (P.leiden_communities, P.louvain_hierarchy))
    by_graph = defaultdict(list)
    for r in edges.collect():
        by_graph[r.graph].append((r.a, r.b, float(r.weight)))
    of = memberships(leiden)
    assert {g for g, _ in of} == set(by_graph)
    for (g, level), own in of.items():
        groups = defaultdict(set)
        for n, c in own.items():
            groups[c].add(n)
        assert set(own) == {n for a, b, _ in by_graph[g] for n in (a, b)} and all(connected(by_graph[g], x) for x in groups.values())
        assert quality(by_graph[g], own, 2.0**level) >= quality(by_graph[g], dict.fromkeys(own, 0), 2.0**level) - 1e-12
    assert memberships(C.flattened(tree)).keys() >= {(g, 1) for g in by_graph}
    table_ = P.video_communities(spark, DATA).cache()
    assert table_.where(F.col("themes") == "of an earlier run").count() == 0 and table_.where("size < 3 OR rank > 20").count() == 0
