"""An inverted file of vectors: trained cells, a few of them probed, exact scores, and an exact way for the rest.

Cells are centroids of a bounded sample; every vector is indexed in its nearest cell.
A query looks into the cells nearest to it first. What its k-th best reaches there, and
how far a cell's vectors lie from its centroid, tells which other cells may hold
anything better: those are looked into as well, so nothing is missed. With ``exact``
off only the first cells count; :meth:`VectorIndex.tuned` finds how many that takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.search import per_group
from lumenweave.session import written

#: Vectors that cells are trained on, and the most cells there are: the driver holds both.
SAMPLE, CELLS = 20_000, 4096
#: Rows of a block, and queries that meet them in one task.
ROWS = 20_000
#: Entries of a matrix of queries by cells or rows that is made at once.
ENTRIES = 2_000_000
#: Scores are rounded, so that equal vectors tie whatever block they stand in.
DIGITS = 9


def unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _parts(rows, width: int):
    """``rows`` some at a time, so that they times ``width`` are no more than :data:`ENTRIES`."""
    step = max(1, ENTRIES // max(width, 1))
    return [rows[lo : lo + step] for lo in range(0, len(rows), step)]


def _best(at: np.ndarray, to: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the best ``k`` of their ``at``; equal scores by the smaller name."""
    order = np.lexsort((names[to], -score, at))
    begins = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[nth < k]


def _trained(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` unit centroids at most: each vector's cell is the nearest by cosine."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        of = np.concatenate([(part @ c.T).argmax(axis=1) for part in _parts(x, k)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


@dataclass
class VectorIndex:
    """``rows``: block, cell, id, g, v. Of each cell its centroid, the angle of its farthest vector, its slices and the first slice's block.

    Cells are put together into blocks of about ``size`` vectors; a larger cell has a block for each slice.
    """

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    slices: np.ndarray
    blocks: np.ndarray
    size: int = ROWS

    @classmethod
    def build(cls, nodes: DataFrame, node: str = "node_id", v: str = "v", group: str | None = None, cells: int | None = None, sample: int = SAMPLE, rows: int = ROWS) -> VectorIndex:
        """The index of all ``nodes``. Null vectors are left out; ``group`` is a column by which searches may leave vectors out.

        There are as many cells as the square root of the vectors, :data:`CELLS` at most;
        they are trained on the ``sample`` vectors whose ids have the smallest hashes.
        """
        g = F.col(group).cast("string") if group else F.lit(None).cast("string")
        all_ = nodes.where(F.col(v).isNotNull()).select(F.col(node).alias("id"), g.alias("g"), F.col(v).cast("array<float>").alias("v"))
        n = all_.count()
        some = all_.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
        if not n:
            return cls(all_.withColumns({"cell": F.lit(0), "block": F.lit(0)}), np.zeros((0, 0)), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        centroids = _trained(unit(some.v), min(len(some), cells or min(CELLS, max(1, round(n**0.5)))))

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for f in _parts(frame, len(centroids)):
                    s = unit(f.v) @ centroids.T
                    yield f.assign(cell=s.argmax(axis=1).astype("int32"), near=s.max(axis=1))

        kind = dict(all_.dtypes)["id"]
        dealt = written(all_.mapInPandas(deal, f"id {kind}, g string, v array<float>, cell int, near double"))
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()
        reach, slices, blocks = np.full(len(centroids), -1.0), np.zeros(len(centroids), int), np.zeros(len(centroids), int)
        block = held = 0
        for r in sorted(sizes, key=lambda r: r.cell):
            if held and held + r.n > rows:
                block, held = block + 1, 0
            blocks[r.cell], held = block, held + r.n
            if held > rows:  # it stands alone
                block, held = block - (-r.n // rows), 0
            # floats are stored: a little is added to the angle
            reach[r.cell], slices[r.cell] = np.arccos(np.clip(r.near, -1, 1)) + 1e-6, -(-r.n // rows)
        lists = [F.array(*[F.lit(int(x)) for x in xs]) for xs in (np.maximum(slices, 1), blocks)]
        place = F.get(lists[1], F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(lists[0], F.col("cell")))
        return cls(dealt.withColumn("block", place.cast("int")).drop("near"), centroids, reach, slices, blocks, rows)

    def _routed(self, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
        """Queries (id, g, v, floor) with the blocks to look into and the cells there: the first ``probes`` cells, or those beyond that may reach the floor."""
        centroids, reach, slices, blocks = self.centroids, self.reach, self.slices, self.blocks

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in (part for frame in frames for part in _parts(frame, len(centroids))):
                s = np.where(reach >= 0, unit(f.v) @ centroids.T, -2.0)
                rank = np.empty(s.shape, int)
                np.put_along_axis(rank, np.argsort(-s, axis=1, kind="stable"), np.arange(s.shape[1])[None], axis=1)
                best = np.cos(np.maximum(np.arccos(np.clip(s, -1, 1)) - reach, 0))
                use = (reach >= 0) & ((rank >= probes) & (best >= f.floor.to_numpy()[:, None] - 2 * 10.0**-DIGITS) if beyond else rank < probes)
                at, cell = np.nonzero(use)
                times = slices[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, cell = np.repeat(at, times), np.repeat(cell, times)
                block = blocks[cell] + part
                order = np.lexsort((cell, block, at))
                at, block, cell = at[order], block[order], cell[order].astype("int32")
                begins = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(block) != 0)]) if len(at) else np.zeros(0, int)
                cells = np.empty(len(begins), object)
                cells[:] = np.split(cell, begins[1:]) if len(begins) else []
                for lo in range(0, len(begins), ROWS):
                    q = at[begins[lo : lo + ROWS]]
                    yield pd.DataFrame({"block": block[begins[lo : lo + ROWS]].astype("int32"), "cells": cells[lo : lo + ROWS], "id": f.id.to_numpy()[q], "g": f.g.to_numpy()[q], "v": f.v.to_numpy()[q]})

        return queries.mapInPandas(route, f"block int, cells array<int>, id {dict(queries.dtypes)['id']}, g string, v array<float>")

    def _met(self, routed: DataFrame, n: int, k: int, least: float, apart: bool) -> DataFrame:
        """The best ``k`` of each of ``n`` queries in each block that it looks into."""
        parts = max(1, -(-n // self.size))

        def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(x) and len(y):
                y = y.sort_values("cell", kind="stable")
                a, b, names = unit(x.v), unit(y.v), y.id.to_numpy()
                own, other = x.g.to_numpy(), y.g.to_numpy()
                cells, begins = np.unique(y.cell.to_numpy(), return_index=True)
                ends = np.r_[begins[1:], len(y)]
                for lo in range(0, len(a), 512):
                    wanted = x.cells.iloc[lo : lo + 512]
                    asks, cell = np.repeat(np.arange(len(wanted)), [len(c) for c in wanted]), np.concatenate(wanted.to_numpy())
                    floor = np.full(len(wanted), least - 10.0**-DIGITS)
                    at, to, score, fresh = np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0
                    for c, start, end in zip(cells, begins, ends, strict=True):
                        who = asks[cell == c]
                        for piece in _parts(np.arange(start, end), 512):
                            if not len(who):
                                break
                            s = np.round(a[lo + who] @ b[piece].T, DIGITS)
                            if apart:
                                s[own[lo + who, None] == other[None, piece]] = -2
                            row, col = np.nonzero((s >= floor[who, None]) & (s > -2))
                            at, to, score = np.r_[at, who[row]], np.r_[to, piece[col]], np.r_[score, s[row, col]]
                            fresh += len(row)
                            if fresh > 2 * k * len(wanted):
                                keep = _best(at, to, score, names, k)
                                at, to, score, fresh = at[keep], to[keep], score[keep], 0
                                full = np.flatnonzero(np.bincount(at, minlength=len(wanted)) >= k)
                                low = np.full(len(wanted), np.inf)
                                np.minimum.at(low, at, score)
                                floor[full] = np.maximum(floor[full], low[full])
                    keep = _best(at, to, score, names, k) if len(at) else []
                    out.append(pd.DataFrame({"query": x.id.to_numpy()[lo + at[keep]], "node": names[to[keep]], "score": score[keep]}))
            return pd.concat(out) if out else pd.DataFrame({"query": [], "node": [], "score": []})

        kinds = dict(routed.dtypes)["id"], dict(self.rows.dtypes)["id"]
        # so that no task has more than about ``size`` queries
        asked = routed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        held = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(best, f"query {kinds[0]}, node {kinds[1]}, score double").where(F.col("score") >= least)

    def search(self, queries: DataFrame, k: int, least: float = -1.0, node: str = "node_id", v: str = "v", group: str | None = None, probes: int = 8, exact: bool = True) -> DataFrame:
        """``query, node, score``: of each query the best ``k`` of ``least`` or more by cosine; equal scores by the smaller id.

        With ``group`` a query meets only vectors of other groups. Ids of queries are
        distinct. ``exact``: cells beyond the first ``probes`` are looked into where they
        may matter.
        """
        g = F.col(group).cast("string") if group else F.lit(None).cast("string")
        q = queries.where(F.col(v).isNotNull()).select(F.col(node).alias("id"), g.alias("g"), F.col(v).cast("array<float>").alias("v"), F.lit(least).alias("floor"))
        order = [F.desc("score"), F.col("node")]
        if not len(self.centroids):
            return q.join(self.rows.select(F.col("id").alias("node")), F.lit(False)).select(F.col("id").alias("query"), "node", F.lit(0.0).alias("score"))
        n = q.count()
        first = per_group(self._met(self._routed(q, probes, False), n, k, least, group is not None), "query", order, k)
        if not exact or probes >= int((self.reach >= 0).sum()):
            return first
        first = written(first)
        full = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
        again = q.join(full, q["id"] == full["query"], "left").select("id", "g", "v", F.greatest(F.lit(float(least)), F.coalesce("low", F.lit(-1.0))).alias("floor"))
        return per_group(first.unionByName(self._met(self._routed(again, probes, True), n, k, least, group is not None)), "query", order, k)

    def tuned(self, queries: DataFrame, k: int, least: float = -1.0, node: str = "node_id", v: str = "v", recall: float = 0.95, sample: int = 256) -> int:
        """The fewest probes, of powers of two and all cells, that find this share of the exact results of ``sample`` queries."""
        some = written(queries.orderBy(F.xxhash64(node), node).limit(sample))
        want = written(self.search(some, k, least, node, v))
        total, cells, probes = want.count(), len(self.centroids), 1
        while probes < cells:
            got = self.search(some, k, least, node, v, probes=probes, exact=False)
            if want.join(got, ["query", "node"], "left_semi").count() >= recall * total:
                return probes
            probes *= 2
        return max(cells, 1)
