"""Communities of weighted graphs: Leiden and Louvain, many small graphs at once and large ones in rounds.

Both work by local moves in rounds. In a round, every community is by a bit of its
name's checksum either one that nodes may leave or one that they may enter, so what a
move gains doesn't depend on the other side's moves. Movers to one community, or out
of one, are taken in order of gain as long as their gain stands after the weight of
all before them is counted in. So modularity never falls, and nothing depends on how
the table is dealt. Graphs of up to ``most`` edges are solved each in one task, by the
same rounds in numpy; the edges of larger ones are joined and grouped, all at once,
with one write of the labels a round.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.graph import connected
from lumenweave.session import written

#: A move gains more than this share of the node's weight.
LEAST_GAIN = 1e-9
#: Bits of the checksum that take turns; so many turns without a move end the rounds.
BITS, IDLE = 31, 62


# one graph in numpy


class Graph:
    """Edges both ways between numbered nodes, the nodes' weights and the checksums of their names."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, nodes: np.ndarray, crc: np.ndarray) -> None:
        self.src, self.dst, self.w, self.k, self.nodes, self.crc = src, dst, w, k, nodes, crc
        self.twom = k.sum()

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph and its nodes' names in order."""
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        src, dst, w = at, np.concatenate([at[len(a) :], at[: len(a)]]), np.concatenate([w, w]).astype(float)
        crc = np.array([zlib.crc32(str(x).encode()) for x in names], "int64")
        return cls(src, dst, w, np.bincount(src, w, len(names)), np.arange(len(names)), crc), names

    def moved(self, label: np.ndarray, gamma: float, within: np.ndarray | None = None) -> np.ndarray:
        """Labels after all rounds, in which a node may also leave for a community of its own.

        With ``within``, only single nodes move, and only to communities of the same part.
        """
        n, label, idle, turn = len(self.crc), label.copy(), 0, 0
        src, dst, w = self.src, self.dst, self.w
        if within is not None:
            inside = within[src] == within[dst]
            src, dst, w = src[inside], dst[inside], w[inside]
        while idle < IDLE:
            total = np.bincount(label[self.nodes], self.k[self.nodes], n)
            size = np.bincount(label[self.nodes], minlength=n)
            pair, inverse = np.unique(src * n + label[dst], return_inverse=True)
            to_w = np.bincount(inverse, w, len(pair))
            node, to = pair // n, pair % n
            own = label[node] == to
            own_w = np.zeros(n)
            own_w[node[own]] = to_w[own]
            node, to, to_w = node[~own], to[~own], to_w[~own]
            if within is None:  # or alone, under its own name if that is free
                alone = self.nodes[size[self.nodes] == 0]
                node, to, to_w = np.concatenate([node, alone]), np.concatenate([to, alone]), np.concatenate([to_w, np.zeros(len(alone))])
            k, at = self.k[node], label[node]
            gain = (to_w - gamma * k * total[to] / self.twom) - (own_w[node] - gamma * k * (total[at] - k) / self.twom)
            good = gain > LEAST_GAIN * k
            if within is not None:
                good &= size[at] == 1
            if not good.any():
                break
            bit = self.crc >> turn % BITS & 1
            good &= (bit[to] == 1) & (bit[at] == 0)
            turn, idle = turn + 1, idle + 1
            if not good.any():
                continue
            node, to, at, k, gain = node[good], to[good], at[good], k[good], gain[good]
            order = np.lexsort((to, -gain, node))
            order = order[np.append(True, node[order][1:] != node[order][:-1])]
            node, to, at, k, gain = (x[order] for x in (node, to, at, k, gain))
            before = _before(to, node, k, gain) + _before(at, node, k, gain)
            taken = gain - gamma * k * before / self.twom > LEAST_GAIN * k
            label[node[taken]] = to[taken]
            idle = 0 if taken.any() else idle
        return label

    def contracted(self, label: np.ndarray) -> Graph:
        n = len(self.crc)
        a, b = label[self.src], label[self.dst]
        pair, inverse = np.unique((a * n + b)[a != b], return_inverse=True)
        k = np.bincount(label[self.nodes], self.k[self.nodes], n)
        return Graph(pair // n, pair % n, np.bincount(inverse, self.w[a != b], len(pair)), k, np.unique(label[self.nodes]), self.crc)


def _before(of: np.ndarray, node: np.ndarray, k: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """For each mover the weight of those before it, by gain and then name, in its group."""
    order = np.lexsort((node, -gain, of))
    sums = np.cumsum(k[order])
    first = np.append(True, of[order][1:] != of[order][:-1])
    starts = np.where(first, sums - k[order], 0.0)
    out = np.empty(len(k))
    out[order] = sums - k[order] - starts[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    return out


def _split(graph: Graph, label: np.ndarray) -> np.ndarray:
    """Connected parts of the communities, each named by its smallest node."""
    inside = label[graph.src] == label[graph.dst]
    src, dst, low = graph.src[inside], graph.dst[inside], np.arange(len(label))
    while True:
        new = low.copy()
        np.minimum.at(new, src, low[dst])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def leiden_of(whole: Graph, gamma: float, iterations: int = 2) -> np.ndarray:
    """The community of every node, named by its smallest node."""
    part = np.arange(len(whole.crc))
    for _ in range(iterations):
        graph, at = whole, np.arange(len(whole.crc))
        while True:
            part = graph.moved(part, gamma)
            if len(np.unique(part[graph.nodes])) == len(graph.nodes):
                break
            fine = graph.moved(np.arange(len(at)), gamma, within=part)
            if len(np.unique(fine[graph.nodes])) == len(graph.nodes):
                break
            lifted = part.copy()
            lifted[fine[graph.nodes]] = part[graph.nodes]
            graph, at, part = graph.contracted(fine), fine[at], lifted
        part = _split(whole, part[at])
    return part


def louvain_of(graph: Graph, gamma: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each level the nodes and their communities, which are the next level's nodes."""
    levels = []
    while True:
        label = graph.moved(np.arange(len(graph.crc)), gamma)
        if len(np.unique(label[graph.nodes])) == len(graph.nodes):
            return levels
        levels.append((graph.nodes, label[graph.nodes]))
        graph = graph.contracted(label)


# large graphs on Spark


def _weighted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges both ways (graph, src, dst, w) and nodes (graph, node, k, twom)."""
    both = written(edges.select("graph", F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(edges.select("graph", F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    nodes = both.groupBy("graph", F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    return both, written(nodes.join(nodes.groupBy("graph").agg(F.sum("k").alias("twom")), "graph"))


def _moved(edges: DataFrame, nodes: DataFrame, gamma: float, within: str | None = None) -> DataFrame:
    """``nodes`` with their last ``label``: the rounds of :meth:`Graph.moved`, as joins and groups."""
    if within:
        part = lambda side: nodes.select("graph", F.col("node").alias(side), F.col(within).alias(f"_{side}"))
        edges = written(edges.join(part("src"), ["graph", "src"]).join(part("dst"), ["graph", "dst"]).where("_src = _dst").select("graph", "src", "dst", "w"))
    cols, idle, turn = nodes.columns, 0, 0
    while idle < IDLE:
        total = nodes.groupBy("graph", "label").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
        to_w = edges.join(nodes.select("graph", F.col("node").alias("dst"), F.col("label").alias("to")), ["graph", "dst"]).groupBy("graph", F.col("src").alias("node"), "to").agg(F.sum("w").alias("to_w"))
        if not within:
            free = nodes.select("graph", "node").join(total.select("graph", F.col("label").alias("node")), ["graph", "node"], "left_anti")
            to_w = to_w.unionByName(free.select("graph", "node", F.col("node").alias("to"), F.lit(0.0).alias("to_w")))
        seen = to_w.join(nodes.select("graph", "node", "label", "k", "twom"), ["graph", "node"])
        seen = seen.withColumn("own_w", F.coalesce(F.max(F.when(F.col("to") == F.col("label"), F.col("to_w"))).over(Window.partitionBy("graph", "node")), F.lit(0.0))).where("to <> label")
        seen = seen.join(total.withColumnsRenamed({"total": "total_at", "size": "size_at"}), ["graph", "label"]).join(total.select("graph", F.col("label").alias("to"), F.col("total").alias("total_to")), ["graph", "to"], "left").withColumn("total_to", F.coalesce("total_to", F.lit(0.0)))
        k, twom = F.col("k"), F.col("twom")
        gain = (F.col("to_w") - gamma * k * F.col("total_to") / twom) - (F.col("own_w") - gamma * k * (F.col("total_at") - k) / twom)
        good = seen.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN * k)
        if within:
            good = good.where("size_at = 1")
        good = written(good.select("graph", "node", "to", "label", "k", "twom", "gain"))
        if good.isEmpty():
            break
        good = good.where((_bit("to", turn) == 1) & (_bit("label", turn) == 0))
        turn, idle = turn + 1, idle + 1
        best = good.groupBy("graph", "node", "label", "k", "twom").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("x")).select("graph", "node", "label", "k", "twom", "x.*")
        before = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy("graph", c).orderBy("loss", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        taken = best.withColumn("before", before("to")).withColumn("before", F.col("before") + before("label")).where(-F.col("loss") - gamma * k * F.col("before") / twom > LEAST_GAIN * k)
        taken = written(taken.select("graph", "node", F.col("to").alias("new")))
        if not taken.isEmpty():
            idle = 0
            nodes = written(nodes.join(taken, ["graph", "node"], "left").withColumn("label", F.coalesce("new", "label")).select(*cols))
    return nodes


def _bit(name: str, turn: int) -> Column:
    return F.shiftright(F.crc32(F.col(name).cast("string").cast("binary")), turn % BITS).bitwiseAND(1)


def _contracted(edges: DataFrame, nodes: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The graph of the labels; ``keep`` are columns on which the nodes of a label agree."""
    label = lambda side: nodes.select("graph", F.col("node").alias(side), F.col("label").alias(f"_{side}"))
    joined = edges.join(label("src"), ["graph", "src"]).join(label("dst"), ["graph", "dst"]).where("_src <> _dst")
    coarse = joined.groupBy("graph", F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w"))
    merged = nodes.groupBy("graph", F.col("label").alias("node"), "twom").agg(F.sum("k").alias("k"), *[F.min(c).alias(c) for c in keep])
    return written(coarse), written(merged)


def _shrunk(nodes: DataFrame) -> bool:
    """Whether any graph has fewer labels than nodes."""
    return nodes.groupBy("graph").agg(F.count("*").alias("n"), F.countDistinct("label").alias("m")).where("m < n").count() > 0


def _leiden_far(edges: DataFrame, gamma: float, iterations: int = 2) -> DataFrame:
    whole, every = _weighted(edges)
    found = every.select("graph", "node", F.col("node").alias("community"))
    for _ in range(iterations):
        edges, at = whole, every.select("graph", F.col("node").alias("first"), "node")
        nodes = every.join(found.withColumnRenamed("community", "label"), ["graph", "node"])
        while True:
            nodes = _moved(edges, nodes, gamma)
            if not _shrunk(nodes):
                break
            fine = _moved(edges, nodes.withColumnRenamed("label", "part").withColumn("label", F.col("node")), gamma, within="part")
            if not _shrunk(fine):
                break
            at = written(at.join(fine.select("graph", "node", "label"), ["graph", "node"]).select("graph", "first", F.col("label").alias("node")))
            edges, nodes = _contracted(edges, fine, keep=("part",))
            nodes = nodes.withColumnRenamed("part", "label")
        ends = written(at.join(nodes.select("graph", "node", "label"), ["graph", "node"]).select("graph", F.col("first").alias("node"), "label"))
        # connected parts, each named by its smallest node
        of = lambda side, ends=ends: ends.select("graph", F.col("node").alias(side), F.col("label").alias(f"_{side}"))
        inside = whole.join(of("src"), ["graph", "src"]).join(of("dst"), ["graph", "dst"]).where("_src = _dst")
        parts = connected(inside.select(F.struct("graph", "src").alias("a"), F.struct("graph", F.col("dst").alias("src")).alias("b")))
        parts = parts.select("node.graph", F.col("node.src").alias("node"), F.col("component.src").alias("community"))
        found = written(ends.join(parts, ["graph", "node"], "left").select("graph", "node", F.coalesce("community", "node").alias("community")))
    return found


def _louvain_far(edges: DataFrame, gamma: float) -> DataFrame:
    edges, nodes = _weighted(edges)
    levels, out = 0, None
    while True:
        nodes = _moved(edges, nodes.withColumn("label", F.col("node")), gamma)
        shrunk = nodes.groupBy("graph").agg(F.count("*").alias("n"), F.countDistinct("label").alias("m")).where("m < n").select("graph")
        rows = nodes.join(shrunk, "graph", "left_semi")  # graphs end at levels of their own
        if rows.isEmpty():
            return out
        levels += 1
        one = rows.select("graph", F.lit(levels).alias("level"), "node", F.col("label").alias("community"))
        out = one if out is None else out.unionByName(one)
        edges, nodes = _contracted(edges, nodes)


# the operators


def _edges(edges: DataFrame, graph: str, a: str, b: str, weight: str) -> DataFrame:
    """One row a pair: of edges given twice, or both ways, the weights add up; loops and weights of 0 or less are left out."""
    e = edges.select(F.col(graph).alias("graph"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).cast("double").alias("w")).where("a <> b AND w > 0")
    return written(e.groupBy("graph", "a", "b").agg(F.sum("w").alias("w")))


def _by_size(edges: DataFrame, most: int, near: Callable[[Graph, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]], far: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """``graph, level, node, community``: graphs of ``most`` edges in one task each, larger ones all over the cluster."""
    sizes = edges.groupBy("graph").count()
    kinds = dict(edges.dtypes)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        graph, names = Graph.of(rows.a.to_numpy(), rows.b.to_numpy(), rows.w.to_numpy())
        parts = [pd.DataFrame({"graph": key[0], "level": level, "node": names[node], "community": names[label]}) for level, node, label in near(graph, names)]
        return pd.concat(parts) if parts else pd.DataFrame({"graph": [], "level": [], "node": [], "community": []})

    small = edges.join(sizes.where(F.col("count") <= most), "graph", "left_semi")
    out = small.groupBy("graph").applyInPandas(solve, f"graph {kinds['graph']}, level int, node {kinds['a']}, community {kinds['a']}")
    if sizes.where(F.col("count") > most).isEmpty():
        return out
    more = far(written(edges.join(sizes.where(F.col("count") > most), "graph", "left_semi")))
    return out if more is None else out.unionByName(more.select("graph", "level", "node", "community"))


def leiden(edges: DataFrame, resolution: float = 1.0, levels: int = 1, graph: str = "graph", a: str = "a", b: str = "b", weight: str = "weight", most: int = 100_000, iterations: int = 2) -> DataFrame:
    """``graph, level, node, community``: level l has the communities at ``resolution * 2 ** l``, from l = 0.

    Local moves, then a refinement in which single nodes join a community of their part
    to which they have an edge, then the same on the graph of the refined communities,
    until nothing moves; all that ``iterations`` times, from what was found before. Every
    community is connected and named by its smallest node.
    Nodes without an edge don't appear; each graph has its own total weight.
    """
    e = _edges(edges, graph, a, b, weight)
    scales = [(level, resolution * 2.0**level) for level in range(levels)]
    near = lambda g, names: [(level, g.nodes, leiden_of(g, gamma, iterations)) for level, gamma in scales]

    def far(rest: DataFrame) -> DataFrame:
        out = None
        for level, gamma in scales:
            one = _leiden_far(rest, gamma, iterations).withColumn("level", F.lit(level))
            out = one if out is None else out.unionByName(one)
        return out

    return _by_size(e, most, near, far)


def louvain(edges: DataFrame, resolution: float = 1.0, graph: str = "graph", a: str = "a", b: str = "b", weight: str = "weight", most: int = 100_000) -> DataFrame:
    """``graph, level, node, community``: a tree. Level 1 has the nodes, level l + 1 the communities of level l.

    Local moves, then the same on the graph of the communities, until nothing moves. A
    community is named by one of the nodes. A graph in which no move gains has no level.
    """
    e = _edges(edges, graph, a, b, weight)
    near = lambda g, names: [(i + 1, node, label) for i, (node, label) in enumerate(louvain_of(g, resolution))]
    return _by_size(e, most, near, lambda rest: _louvain_far(rest, resolution))


def flattened(tree: DataFrame) -> DataFrame:
    """``graph, level, node, community`` of all first nodes at each level of a tree; a graph that ended before keeps its last."""
    top = tree.agg(F.max("level")).first()[0] or 0
    at = tree.where("level = 1").select("graph", F.col("node").alias("first"), F.col("community").alias("node"))
    out = at.withColumn("level", F.lit(1))
    for level in range(2, top + 1):
        step = tree.where(F.col("level") == level).select("graph", "node", F.col("community").alias("up"))
        at = at.join(step, ["graph", "node"], "left").select("graph", "first", F.coalesce("up", "node").alias("node"))
        out = out.unionByName(at.withColumn("level", F.lit(level)))
    return out.select("graph", "level", F.col("first").alias("node"), F.col("node").alias("community"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0, graph: str = "graph", a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """``graph, level, modularity`` of a membership (graph, level, node, community): inner weight less what chance would give."""
    e = _edges(edges, graph, a, b, weight)
    m = membership.select("graph", "level", "node", "community")
    of = lambda side: m.select("graph", "level", F.col("node").alias(side), F.col("community").alias(f"_{side}"))
    inner = e.join(of("a"), ["graph", "a"]).join(of("b"), ["graph", "level", "b"]).where("_a = _b").groupBy("graph", "level", F.col("_a").alias("community")).agg((2 * F.sum("w")).alias("inner"))
    k = e.select("graph", F.explode(F.array("a", "b")).alias("node"), "w").groupBy("graph", "node").agg(F.sum("w").alias("k"))
    total = k.join(m, ["graph", "node"]).groupBy("graph", "level", "community").agg(F.sum("k").alias("total"))
    twom = k.groupBy("graph").agg(F.sum("k").alias("twom"))
    each = total.join(inner, ["graph", "level", "community"], "left").join(twom, "graph")
    share = F.coalesce("inner", F.lit(0.0)) / F.col("twom") - resolution * F.pow(F.col("total") / F.col("twom"), 2)
    return each.groupBy("graph", "level").agg(F.sum(share).alias("modularity"))


def detected(membership: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """``graph, rank, level, community, size``: of each graph the largest ``most`` communities of ``least`` members or more.

    Communities that hold the same nodes at several levels count once, at the first;
    which they do is told by their size, smallest node and two sums of hashes.
    """
    hashed = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    each = membership.groupBy("graph", "level", "community").agg(F.count("*").alias("size"), F.min("node").alias("low"), *hashed).where(F.col("size") >= least)
    first = each.groupBy("graph", "size", "low", "h0", "h1").agg(F.min(F.struct("level", "community")).alias("x")).select("graph", "size", "x.*")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("size"), "level", "community")))
    return ranked.where(F.col("rank") <= most).select("graph", "rank", "level", "community", "size")
