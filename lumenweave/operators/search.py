"""Exact vector search, BM25 full text, and the fusion of both with graph and time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalar import PROFILES, cosine, degree_score, gaussian, unit
from lumenweave.session import cut, in_order, written

K1, B = 1.2, 0.75


def _blocks(queries: DataFrame, nodes: DataFrame, node: str, group: str | None, v: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, g, v) dealt by hash into blocks of about ``rows``, every block beside every block of the other side."""
    n_q, n_n = (F.lit(1 + df.count() // rows) for df in (queries, nodes))
    of = (lambda df: F.col(group).cast("string") if group in df.columns else F.lit(None).cast("string")) if group else (lambda df: F.lit(None).cast("string"))
    block = lambda n: F.pmod(F.xxhash64(node), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    q = queries.select(F.col(node).alias("id"), of(queries).alias("g"), F.col(v).cast("array<float>").alias("v"), block(n_q).alias("i"), every(n_n).alias("j"))
    n = nodes.select(F.col(node).alias("id"), of(nodes).alias("g"), F.col(v).cast("array<float>").alias("v"), every(n_q).alias("i"), block(n_n).alias("j"))
    return q, n


def _scores(x, y):
    """The unit vectors of two frames, 256 of the first at a time: (first row, products with all of the second)."""
    a, b = (np.stack(t.v.to_numpy()).astype(np.float64) for t in (x, y))
    a, b = (t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300) for t in (a, b))
    for lo in range(0, len(a), 256):
        yield lo, a[lo : lo + 256] @ b.T


def _best(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` of each row, with all that tie at the end."""
    last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -2.0)
    return np.nonzero((s >= last[:, None]) & (s >= least))


def nearest(queries: DataFrame, nodes: DataFrame, k: int, least: float, node: str = "node_id", group: str | None = None, v: str = "v", rows: int = 20_000) -> DataFrame:
    """``query, node, score``: of each query the best ``k`` by cosine, of other groups if ``group`` is given.

    For few nodes, or once: a task takes a block of each side and hands on the best
    ``k`` of each query. :class:`~lumenweave.operators.vectors.VectorIndex` is for many.
    """
    q, n = _blocks(queries, nodes, node, group, v, rows)
    kind = dict(q.dtypes)["id"]

    def best(x, y):
        import pandas as pd

        out = []
        if len(x) and len(y):
            own, other = x.g.to_numpy(), y.g.to_numpy()
            for lo, s in _scores(x, y):
                if group:
                    s[own[lo : lo + 256, None] == other[None]] = -2
                at, to = _best(s, k, least)
                out.append(pd.DataFrame({"query": x.id.to_numpy()[lo + at], "node": y.id.to_numpy()[to], "score": s[at, to]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "node": [], "score": []})

    met = q.groupBy("i", "j").cogroup(n.groupBy("i", "j")).applyInPandas(best, f"query {kind}, node {kind}, score double")
    return per_group(met, "query", [F.desc("score"), F.col("node")], k)


def nearest_each(queries: DataFrame, nodes: DataFrame, k: int, group: str, node: str = "node_id", v: str = "v", rows: int = 20_000) -> DataFrame:
    """``query, parent, node, score``: of each query the best ``k`` in each group of the nodes."""
    q, n = _blocks(queries, nodes, node, group, v, rows)
    kind, parent = dict(q.dtypes)["id"], dict(nodes.dtypes)[group]

    def best(x, y):
        import pandas as pd

        out = []
        if len(x) and len(y):
            for g, at_g in y.reset_index(drop=True).groupby("g", sort=False).groups.items():
                for lo, s in _scores(x, y.iloc[at_g]):
                    at, to = _best(s, k, -1.5)
                    out.append(pd.DataFrame({"query": x.id.to_numpy()[lo + at], "parent": g, "node": y.id.to_numpy()[at_g[to]], "score": s[at, to]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "parent": [], "node": [], "score": []})

    met = q.groupBy("i", "j").cogroup(n.groupBy("i", "j")).applyInPandas(best, f"query {kind}, parent string, node {kind}, score double")
    ranked = per_group(met.withColumn("_q", F.struct("query", "parent")), "_q", [F.desc("score"), F.col("node")], k)
    return ranked.select("query", F.col("parent").cast(parent).alias("parent"), "node", "score")


def children_search(parents: DataFrame, edges: DataFrame, nodes: DataFrame, query: Column | None, k: int) -> DataFrame:
    """``parent, node, score``: the best ``k`` children of each parent; without a query by the parent's own column ``q``."""
    kids = parents.join(edges, F.col("parent") == F.col("src")).select(*parents.columns, F.col("dst").alias("node")).join(nodes, "node")
    scored = kids.withColumn("score", cosine(F.col("v"), F.col("q") if query is None else query))
    keys = [c for c in parents.columns if c != "q"]
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "node")))
    return ranked.where(F.col("_n") <= k).select(*keys, "node", "score")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` and the same row of ``b``, added up in the vectors' order as :func:`cosine` does; 0 where either has no length."""
    x, y, xy = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y, xy = x + a[:, i] * a[:, i], y + b[:, i] * b[:, i], xy + a[:, i] * b[:, i]
    n = np.sqrt(x) * np.sqrt(y)
    return np.divide(xy, n, out=np.zeros(len(a)), where=n > 0)


def best_children(asks: DataFrame, kids: DataFrame, k: int, rows: int = 20_000) -> DataFrame:
    """``query, parent, node, score``: of each of ``asks`` (query, parent, q) the best ``k`` of ``kids`` (parent, node, v) by cosine.

    The vectors of a parent's queries and of its children meet in blocks of ``rows``, and
    a block hands on the best ``k`` of each query; no pair of vectors is written out.
    """
    kind, parent, node = dict(asks.dtypes)["query"], dict(asks.dtypes)["parent"], dict(kids.dtypes)["node"]
    sizes = asks.groupBy("parent").agg(F.count("*").alias("a")).join(kids.groupBy("parent").agg(F.count("*").alias("b")), "parent")
    sizes = written(sizes.select("parent", *[F.ceil(F.col(c) / rows).cast("int").alias(c) for c in ("a", "b")]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asks.join(sizes, "parent").select("parent", at("query", "a").alias("i"), every("b").alias("j"), "query", F.col("q").cast("array<float>").alias("v"))
    right = kids.join(sizes, "parent").select("parent", every("a").alias("i"), at("node", "b").alias("j"), "node", F.col("v").cast("array<float>").alias("v"))

    def best(x, y):
        import pandas as pd

        out = []
        if len(x) and len(y):
            size = max((len(v) for t in (x, y) for v in t.v if v is not None), default=1)
            a, b = (np.stack([np.zeros(size) if v is None else v for v in t.v]).astype(np.float64) for t in (x, y))
            unit_a, unit_b = (t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300) for t in (a, b))
            for lo in range(0, len(a), 256):
                s = unit_a[lo : lo + 256] @ unit_b.T
                last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -2.0
                # those that a product's rounding may have put behind come along
                row, to = np.nonzero(s >= last - 1e-9)
                exact = np.concatenate([_cosines(a[lo + row[at : at + 50_000]], b[to[at : at + 50_000]]) for at in range(0, len(row), 50_000)])
                names = y.node.to_numpy()[to]
                order = np.lexsort((names, -exact, row))
                first = np.searchsorted(row[order], np.arange(len(s)))
                keep = order[np.arange(len(order)) - first[row[order]] < k]
                out.append(pd.DataFrame({"query": x["query"].to_numpy()[lo + row[keep]], "parent": x.parent.iloc[0], "node": names[keep], "score": exact[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "parent": [], "node": [], "score": []})

    met = left.groupBy("parent", "i", "j").cogroup(right.groupBy("parent", "i", "j")).applyInPandas(best, f"query {kind}, parent {parent}, node {node}, score double")
    return per_group(met.withColumn("_q", F.struct("query", "parent")), "_q", [F.desc("score"), F.col("node")], k).drop("_q")


def drill_down(queries: DataFrame, levels: list[DataFrame], edges: DataFrame, k: int) -> DataFrame:
    """``query, path, score``: the best ``k`` nodes of the first level, of each its best ``k`` children, and so on.

    ``queries`` has query and q; a level has node and v; ``edges`` lead from a level to the next.
    """
    top = nearest(queries.select(F.col("query").alias("node"), F.col("q").alias("v")), levels[0], k, -1.0, node="node")
    path = written(top.select("query", F.array("node").alias("path"), "node", "score"))
    for level in levels[1:]:
        asks = path.select("query", F.col("node").alias("parent")).distinct().join(queries, "query")
        kids = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")).join(level, "node")
        found = best_children(asks, kids, k)
        path = written(path.select("query", "path", F.col("node").alias("parent")).join(found, ["query", "parent"]).select("query", F.array_append("path", F.col("node")).alias("path"), "node", "score"))
    return path.select("query", "path", "score")


def pool(members: DataFrame, key: str, v: str, weight: str | None = None, strategy: str = "mean") -> DataFrame:
    """``key, pooled``: the vectors' mean, weighted if there is a weight, or their largest entries, at unit length.

    Sums and maxima of whole vectors are aggregated, on the map side first.
    """
    if strategy not in ("mean", "max"):
        raise ValueError(f"strategy: {strategy}")
    one = array_to_vector(F.col(v).cast("array<double>"))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    whole = Summarizer.max(one) if strategy == "max" else Summarizer.mean(one, w)
    pooled = members.where(F.col(v).isNotNull()).groupBy(key).agg(vector_to_array(whole).alias("m"))
    return pooled.select(key, unit(F.col("m")).alias("pooled"))


def bm25(docs: DataFrame, query: list[str], node: str, text: str) -> DataFrame:
    """``node, score`` of every text with a query term; the corpus statistics cover all texts.

    A text is gone through once, for its length and how often each term stands in it.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def often(term: str) -> Column:
        return F.coalesce(F.size(F.filter("w", lambda x: x == term)), F.lit(0))

    said = docs.select(F.col(node), words.alias("w")).select(node, F.coalesce(F.size("w"), F.lit(0)).alias("len"), *[often(t).alias(f"t{i}") for i, t in enumerate(query)])
    said = cut(said)
    totals = said.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(query))])
    scored = said.where(F.greatest(*[F.col(f"t{i}") for i in range(len(query))], F.lit(0)) > 0).crossJoin(F.broadcast(totals))  # one row
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.select(node, sum((F.when(F.col(f"t{i}") > 0, part(i)).otherwise(0.0) for i in range(len(query))), F.lit(0.0)).alias("score"))


def fuse(vector: DataFrame, text: DataFrame, node: str = "node_id", extra: int = 20, by: str = "query") -> DataFrame:
    """``by, node, vector_score, fulltext_score``: of each query both lists together, text scores by their maximum, ``extra`` of those only in text."""
    t = text.withColumn("fulltext_score", F.col("score") / F.max("score").over(Window.partitionBy(by))).drop("score")
    hits = vector.select(by, node, F.col("score").alias("vector_score")).join(t, [by, node], "left").select(by, node, "vector_score", F.coalesce("fulltext_score", F.lit(0.0)).alias("fulltext_score"))
    more = per_group(t.join(vector, [by, node], "left_anti"), by, [F.desc("fulltext_score"), F.col(node)], extra)
    return hits.unionByName(more.select(by, node, F.lit(0.0).alias("vector_score"), "fulltext_score"))


def weigh(candidates: DataFrame, k: int, profile: str = "default", at: str = "ts", lo: float | None = None, hi: float | None = None, related: str = "related", node: str = "node_id", by: str = "query") -> DataFrame:
    """Candidates with ``graph_score, temporal_score, combined_score``, the best ``k`` of each query. Without a range a time counts .7, none .3."""
    wv, wt, wg, wm = PROFILES.get(profile, PROFILES["default"])
    if lo is not None and hi is not None:
        candidates = candidates.where(F.col(at).isNull() | F.col(at).between(lo, hi))
        temporal = gaussian(F.col(at), lo, hi)
    else:
        temporal = F.when(F.col(at).isNotNull(), 0.7).otherwise(0.3)
    scored = candidates.withColumns({"graph_score": degree_score(F.coalesce(related, F.lit(0))), "temporal_score": temporal})
    total = wv * F.col("vector_score") + wt * F.col("fulltext_score") + wg * F.col("graph_score") + wm * F.col("temporal_score")
    return per_group(scored.withColumn("combined_score", total), by, [F.desc("combined_score"), F.col(node)], k)


def rerank(candidates: DataFrame, related: DataFrame, terms: list[str], node: str = "node_id") -> DataFrame:
    """Scores times 1 + min(.2, mean over related texts of shared terms / terms / (distance + 1)), over the first ten that share any."""
    shared = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("text"), t)))
    first = related.withColumn("_n", F.row_number().over(Window.partitionBy(node).orderBy("distance", "related"))).where("_n <= 10").withColumn("_s", shared).where("_s > 0")
    boost = first.groupBy(node).agg(F.avg(F.col("_s") / len(terms) / (F.col("distance") + 1)).alias("_m"))
    return candidates.join(boost, node, "left").withColumn("combined_score", F.col("combined_score") * (1 + F.least(F.lit(0.2), F.coalesce("_m", F.lit(0.0))))).drop("_m")


def per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def within_budget(rows: DataFrame, key: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows in order until the next would exceed the budget."""
    run = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def _chosen(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], list], take: Callable[..., bool]) -> DataFrame:
    """The rows that ``take`` says yes to, asked in order, key by key.

    The rows of a key pass through one task; it holds what ``take`` keeps in the list
    that ``start`` makes for each key.
    """
    at = [rows.columns.index(c) for c in [key, *columns]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keep = []
            for i, (k, *values) in enumerate(zip(*(batch.column(c).to_pylist() for c in at), strict=True)):
                if now != (k,):
                    now, held = (k,), start()
                if take(held, *values):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return in_order(rows, key, *order).mapInArrow(fold, rows.schema)


def fitting(rows: DataFrame, key: str, order: list[str], size: str, budget: int, most: int) -> DataFrame:
    """Rows in order that still fit into the budget, ``most`` at most; one that doesn't is passed over."""

    def take(held: list, n: int | None) -> bool:
        if n is None or len(held) >= most or sum(held) + n > budget:
            return False
        held.append(n)
        return True

    return _chosen(rows.select(key, *order, F.col(size).alias("_size")), key, order, ["_size"], list, take).select(key, *order)


def pick_apart(rows: DataFrame, key: str, order: list[str], lo: str, hi: str, most: int) -> DataFrame:
    """``key, lo, hi``: spans taken in order if they overlap none taken before, ``most`` at most."""

    def take(held: list, a: float | None, b: float | None) -> bool:
        if a is None or b is None or len(held) >= most or any(a < y and b > x for x, y in held):
            return False
        held.append((a, b))
        return True

    spans = rows.select(key, *order, F.col(lo).cast("double").alias("_lo"), F.col(hi).cast("double").alias("_hi"))
    return _chosen(spans, key, order, ["_lo", "_hi"], list, take).select(key, F.col("_lo").alias(lo), F.col("_hi").alias(hi))
