"""MinHash near-dedup by an LSH forest.

A text is the set of its word shingles. Texts with equal sets are one node. A node
stands in several trees: sorted orders of its MinHash values, each tree with values
of its own. Its candidates are the neighbours in each order that share a prefix
with it. The orders are range-partitioned by sampled splitters, and what stands next
to a splitter is compared across it. Candidates are confirmed on the full sets: first
the most frequent of each node, then those that could still join two components.

Where more nodes share the shortest prefix than the neighbours reach, the region is
dense and the depth follows it by content in place of hashes: its nodes first meet
the region's leader, the node that stands in most dense regions (the hub of a star
does), and then whatever shares one of their rarest shingles, as many as two linked
sets can't avoid to share. Only shingles that nodes of different components share
are looked at, so a family that is already one component costs nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import keyed
from lumenweave.llm.components import components
from lumenweave.llm.memory import released
from lumenweave.session import cut, text_batches

#: Trees, values in a tree, and those of them that candidates share at least.
#: Two sets of similarity 0.8 share them in none of 24 trees, or in one alone, with probability below 1e-6.
TREES, DEPTH, SHORTEST = 24, 5, 3
#: Neighbours before it in an order with which a node is compared; where more share the prefix, the region is dense.
NEIGHBOURS = 16
#: Of its dense regions so many tell a node their leader, and so many trees its neighbour; the rarest shingles find the rest.
LEADERS, CHAINED = 6, 2
#: Counters of shingles, by hash, that order them by rarity; any order gives the same links.
COUNTERS = 1 << 18
#: Nodes under a shingle up to which their pairs are named and confirmed elsewhere; with more, their sets meet tile by tile.
NAMED = 256
#: Nodes and shingles in a tile, about; nodes that are compared at once, and shingles that are counted at once.
TILE_NODES, TILE_SHINGLES = 1024, 1 << 18
STRIPE, COUNTED = 256, 2048
#: Keys of texts up to which they are broadcast to pick those texts; beyond, texts and keys meet in a shuffle.
MOST_BROADCAST = 200_000
WORDS_KEPT = 400_000
DOCS = 256

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; A-Z lower-cased, words between ASCII white space.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _sign(k: int):
    head = np.arange(TREES, dtype=">u1")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From id, fp, text: id, fp, node, n, keys."""
        released()
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                sets = [shingles(t, k, hashes) for t in part.column(2).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys: list = [None] * len(sets)
                if len(full):
                    flat, starts = np.concatenate([sets[i] for i in full]), np.cumsum(sizes[full]) - sizes[full]
                    low = np.empty((len(full), TREES * DEPTH), ">u4")
                    for j, f in enumerate(FACTORS):
                        v = flat * f
                        low[:, j] = np.minimum.reduceat(((v >> np.uint64(32)) ^ v).astype(np.uint32), starts)
                    low = low.view(np.uint8).reshape(len(full), TREES, 4 * DEPTH)
                    for i, row in zip(full, low, strict=True):
                        keys[i] = [bytes([t]) + row[t].tobytes() for t in head.tolist()]
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.binary()))], ["id", "fp", "node", "n", "keys"])

    return sign


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, node in order: a, b, weight; the rows at either end of the partition as key, a; and dense ones as tree, region, a.

    A region is a prefix that more nodes share than are compared. It is left to
    ``_leaders`` and ``_rarest``; here, in the first trees, a node meets the one before it, which counts twice.
    """
    shared, window, first = 1 + 4 * SHORTEST, [], []
    a, b, weight, dense = [], [], [], []
    region, run = None, []

    def out(keys=()) -> pa.RecordBatch:
        none, zero = [None] * len(a), [0] * len(a)
        rows = [
            pa.array(none + [k for k, _ in keys] + [None] * len(dense), pa.binary()), pa.array(a + [n for _, n in keys] + [n for _, n in dense], pa.binary()), pa.array(b + [None] * (len(keys) + len(dense)), pa.binary()),
            pa.array(weight + [0] * (len(keys) + len(dense)), pa.int32()), pa.array(zero + [0] * len(keys) + [p[0] for p, _ in dense], pa.int32()), pa.array(none + [None] * len(keys) + [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p, _ in dense], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(rows, ["key", "a", "b", "weight", "tree", "region"])

    for batch in batches:
        for key, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(first) < NEIGHBOURS:
                first.append((key, node))
            prefix = key[:shared]
            if prefix != region:
                region, run, crowded = prefix, [], False
            if not crowded and len(run) == NEIGHBOURS:
                crowded = True
                dense += [(prefix, n) for n in run]
            if crowded:
                dense.append((prefix, node))
            for other in (run[-1:] if key[0] < CHAINED else ()) if crowded else run:
                if other != node:
                    a.append(min(node, other))
                    b.append(max(node, other))
                    weight.append(2 if crowded else 1)
            run.append(node)
            window.append((key, node))
            if len(run) > NEIGHBOURS:
                run.pop(0)
            if len(window) > NEIGHBOURS:
                window.pop(0)
        if len(a) + len(dense) > 50_000:
            yield out()
            a, b, weight, dense = [], [], [], []
    yield out(first + window)


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, weight``: neighbours in two orders or more, or in a dense region; and ``tree, region, node`` of the dense regions."""
    schema = "key binary, a binary, b binary, weight int, tree int, region long"
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    found = cut(rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_neighbours, schema))
    # the ends of the partitions: a fixed number of rows of each, compared with each other
    ends = found.where("key IS NOT NULL").select("key", F.col("a").alias("node")).distinct()
    across = cut(ends.coalesce(1).sortWithinPartitions("key").mapInArrow(_neighbours, schema))
    every = found.unionByName(across)
    pairs = cut(every.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("weight").cast("int").alias("weight")).where("weight >= 2"))
    return pairs, every.where("region IS NOT NULL").select("tree", "region", F.col("a").alias("node")).distinct()


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of ``x`` with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = [np.concatenate(s) for s in (x, y)]
    row = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    both = np.intersect1d(*flat)
    if len(both):
        at = [np.searchsorted(both, f) for f in flat]
        held = [both[np.minimum(i, len(both) - 1)] == f for i, f in zip(at, flat, strict=True)]
        at, row = ([v[h] for v, h in zip(vs, held, strict=True)] for vs in (at, row))
        for lo in range(0, len(both), COUNTED):
            side = []
            for i, r, s in zip(at, row, (x, y), strict=True):
                here = (i >= lo) & (i < lo + COUNTED)
                m = np.zeros((len(s), min(COUNTED, len(both) - lo)), np.float32)
                m[r[here], i[here] - lo] = 1
                side.append(m)
            out += side[0] @ side[1].T
    return out


def _leaders(dense: DataFrame) -> DataFrame:
    """``a, b``: nodes of dense regions and the leaders of some of these: who stands in most dense regions."""
    own = cut(dense.groupBy("node").agg(F.collect_set(F.struct("tree", "region")).alias("regions")))  # as many as trees at most
    score = F.struct(F.size("regions"), "node")
    leader = own.select("node", score.alias("score"), F.explode("regions").alias("at")).groupBy("at").agg(F.max_by("node", "score").alias("leader"))
    some = F.expr(f"slice(array_sort(transform(regions, r -> struct(xxhash64(node, r.tree), r as at))), 1, {LEADERS})")
    asked = own.select("node", F.explode(some).alias("x")).select("node", "x.at")
    met = asked.join(_bounded(cut(leader)), "at").where("node <> leader")
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _bounded(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side


def _bins(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From s: bin, n."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for v in batch.column(0):
            np.add.at(counts, _bins(np.frombuffer(v.as_buffer(), np.uint64)), 1)
    at = np.flatnonzero(counts)
    for lo in range(0, len(at), 10_000):
        part = at[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["bin", "n"])


def _prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set: a set that is linked with it has one of them among its own rarest."""
    n = len(s)
    size = n - -(-percent * n // 100) + 1
    return s[np.lexsort((s, counts[_bins(s)]))[:size]]


def _may(x, y, px, py, percent: int):
    """Whether sets of sizes x, y that share their rarest at px, py may be linked: that one and the less rare are all they may share."""
    most = np.minimum(x - px, y - py)
    return 100 * most >= percent * (x + y - most)


def _name(percent: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From shingle, node, root, n, at in order of the shingle: a, b, nodes of different roots that may be linked."""
        rest = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            shingle, n, at = (t.column(i).to_numpy() for i in (0, 3, 4))
            nodes = t.column(1).to_pylist()
            number: dict = {}
            root = np.array([number.setdefault(r, len(number)) for r in t.column(2).to_pylist()])
            first = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] - 1))
            found = set()
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(shingle)], strict=True):
                r, x, p = root[lo:hi], n[lo:hi], at[lo:hi]
                ok = np.triu((r[:, None] != r) & _may(x[:, None], x, p[:, None], p, percent), 1)
                found.update((min(nodes[lo + i], nodes[lo + j]), max(nodes[lo + i], nodes[lo + j])) for i, j in zip(*(v.tolist() for v in np.nonzero(ok)), strict=True))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            shingle = t.column(0).to_numpy()
            done = int(np.searchsorted(shingle, shingle[-1])) if len(shingle) else 0
            if done:
                yield from pairs(t.slice(0, done))
            rest = t.slice(done)
        if rest is not None and len(rest):
            yield from pairs(rest)

    return name


def _share(percent: int):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the members of two tiles (root, at, s): a, b, roots that links join, each tile's as a forest."""
        for batch in batches:
            for i in range(batch.num_rows):
                up: dict = {}

                def find(x, up=up):
                    while up.setdefault(x, x) != x:
                        up[x] = x = up[up[x]]
                    return x

                sides = []
                for c in (0, 1):
                    v = batch.column(c)[i].as_py() or batch.column(0)[i].as_py()  # a tile that meets itself is sent once
                    sets = [np.frombuffer(m["s"], np.uint64) for m in v]
                    sides.append(([m["root"] for m in v], sets, np.array([len(s) for s in sets]), np.array([m["at"] for m in v])))
                (rx, sx, nx, px), (ry, sy, ny, py) = sides
                number = {r: j for j, r in enumerate(dict.fromkeys(rx + ry))}
                ix, iy = (np.array([number[r] for r in rs]) for rs in (rx, ry))
                links = set()
                for p in range(0, len(rx), STRIPE):
                    for q in range(0, len(ry), STRIPE):
                        p_, q_ = slice(p, p + STRIPE), slice(q, q + STRIPE)
                        x, y = nx[p_, None], ny[None, q_]
                        open_ = (ix[p_, None] != iy[None, q_]) & _may(x, y, px[p_, None], py[None, q_], percent)
                        if not open_.any():
                            continue
                        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
                        both = _common([sx[p + j] for j in rows], [sy[q + j] for j in columns]).astype(np.int64)
                        x, y = x[rows], y[:, columns]
                        u, v = np.nonzero(open_[np.ix_(rows, columns)] & (100 * both >= percent * (x + y - both)))
                        for g, h in zip(ix[p + rows[u]].tolist(), iy[q + columns[v]].tolist(), strict=True):
                            g2, h2 = find(g), find(h)
                            if g2 != h2:
                                up[g2] = h2
                                links.add((g, h))
                if links:
                    name = list(number)
                    yield pa.RecordBatch.from_arrays([pa.array([name[g] for g, _ in links], pa.binary()), pa.array([name[h] for _, h in links], pa.binary())], ["a", "b"])

    return share


def _rarest(docs: DataFrame, dense: DataFrame, reps: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: roots that a link between two nodes of dense regions joins.

    A prefix filter: a node stands under its rarest shingles. Under a shingle that
    nodes of several components share, those of different components are compared
    on full sets; a shingle with many nodes is dealt over tiles by hash, and each
    tile meets the others.
    """
    spark = docs.sparkSession
    nodes = dense.select("node").distinct().join(reps, "node").join(roots, "node", "left").select("node", "id", "fp", F.coalesce("root", "node").alias("root"))
    nodes = cut(nodes)
    wanted = _bounded(nodes.select("id", "fp"))
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["fp"] == wanted["fp"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(k), "node binary, s binary").groupBy("node").agg(F.first("s").alias("s"))
    sets = cut(sets.join(nodes.select("node", "root"), "node"))
    counts = np.zeros(COUNTERS, np.int64)
    got = sets.select("s").mapInArrow(_count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From node, root, s: shingle, node, root, n, at."""
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                part = batch.slice(lo, DOCS)
                each = [_prefix(np.frombuffer(v.as_buffer(), np.uint64), shared.value, percent) for v in part.column(2)]
                if not each:
                    continue
                take = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
                sizes = pa.array([len(v.as_buffer()) // 8 for v in part.column(2)], pa.int64()).take(take)
                at = pa.array(np.concatenate([np.arange(len(x)) for x in each]).astype(np.int32))
                rows = pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), part.column(0).take(take), part.column(1).take(take), sizes, at], ["shingle", "node", "root", "n", "at"])
                for a in range(0, rows.num_rows, 20_000):
                    yield rows.slice(a, 20_000)

    rows = cut(sets.select("node", "root", "s").mapInArrow(rare, "shingle long, node binary, root binary, n long, at int"))
    tiles = F.greatest(F.ceil(F.count("*") / TILE_NODES), F.ceil(F.sum("n") / TILE_SHINGLES))
    mixed = cut(rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), tiles.alias("tiles")).where("lo <> hi"))
    few = rows.join(_bounded(mixed.where(F.col("c") <= NAMED).select("shingle")), "shingle").select("shingle", "node", "root", "n", "at")
    pairs = cut(few.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_name(percent), "a binary, b binary").distinct())
    root = lambda side: nodes.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    named = _confirm_few(docs, pairs, reps, k, percent).join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    many = _bounded(mixed.where(F.col("c") > NAMED).select("shingle", "tiles"))
    placed = cut(rows.join(many, "shingle").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).select("shingle", "tile", "node", "root", "at"))
    tile = placed.groupBy("shingle", "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    side = lambda x: tile.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("tile", "lo", "hi")))
    next_ = "x_tile <= y_tile AND NOT (x_lo = x_hi AND y_lo = y_hi AND x_lo = y_lo)"
    both = cut(side("x").join(side("y"), "shingle").where(next_).select("shingle", "x_tile", "y_tile"))
    # nodes are told which tiles meet; their sets then move to each meeting once
    told = lambda x, rows: rows.withColumn("tile", F.col(f"{x}_tile")).join(placed, ["shingle", "tile"]).withColumn("side", F.lit(x))
    told = told("x", both).unionByName(told("y", both.where("x_tile < y_tile"))).drop("tile").join(sets.select("node", "s"), "node")
    members = lambda x: F.collect_list(F.when(F.col("side") == x, F.struct("root", "at", "s"))).alias(f"{x}_members")
    met = told.groupBy("shingle", "x_tile", "y_tile").agg(members("x"), members("y")).select("x_members", "y_members")
    # a row holds two tiles of up to some MB: few go to Python at once
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        return cut(met.mapInArrow(_share(percent), "a binary, b binary").unionByName(named).distinct())
    finally:
        spark.conf.set(key, usual)


def _sets(k: int, kind: type = np.uint64):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                sets = [s for t in batch.slice(at, DOCS).column(0).to_pylist() if len(s := shingles(t, k, hashes))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array((s.astype(kind).tobytes() for s in sets), pa.binary())], ["node", "s"])

    return sets_of


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of whole sets whether they are linked."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _may_be_linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of the low bits of sets: whoever shares a shingle shares its bits, so sets that are linked never fail."""
    at = np.zeros(1 << 16, bool)
    at[y] = True
    most = int(at[x].sum())
    at[y], at[x] = False, True
    most = min(most, int(at[y].sum()))
    return 100 * most >= percent * (len(x) + len(y) - most)


def _sift(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int, kind: type, test) -> DataFrame:
    """The pairs whose sets pass a test, as shingles' hashes of some bits."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node").select("id", "fp"))
    few = wanted.count() <= MOST_BROADCAST
    texts = docs.join(F.broadcast(wanted) if few else wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["fp"] == wanted["fp"]), "left_semi").select("text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [test(*(np.frombuffer(v.as_buffer(), kind) for v in each), percent) for each in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = texts.mapInArrow(_sets(k, kind), "node binary, s binary")
    met = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return cut(met.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary").distinct())


def _confirm(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have a similarity of ``percent`` or more."""
    return _sift(docs, pairs, reps, k, percent, np.uint64, _linked)


def _confirm_few(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The same where few pairs are linked: the others are told by 16 bits of each shingle, and only what they leave moves in full."""
    return _confirm(docs, _sift(docs, pairs, reps, k, percent, np.uint16, _may_be_linked), reps, k, percent)


def _led(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after links between roots; a node without a row is its own root."""
    joined = cut(components(links)).select(F.col("node").alias("old"), F.col("root").alias("top"))
    alone = joined.select(F.col("old").alias("node"), F.col("old").alias("root")).join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(alone).join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept, text_hash, group``.

    Documents are linked whose sets of distinct ``words``-word shingles have
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    that links reach, and its document is kept. Null, empty and blank texts have
    no shingle and stand alone, under their own id. A null id is never the
    smallest; a document without an id is kept only if it stands alone. Rows that
    repeat an id and a text are returned each. Other columns are ignored.
    ``text_hash`` is the text's ``xxhash64``; ``group`` names the component also
    where no document of it has an id, and is null for a text without a shingle.
    """
    text_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    kind = dict(texts.dtypes)["id"]
    signed = cut(texts.select("id", "fp", "text").mapInArrow(_sign(words), f"id {kind}, fp long, node binary, n long, keys array<binary>"))
    some = signed.where("n > 0")
    # of the rows that share a node one stands for it; copies meet before the shuffle
    row = F.struct("id", "fp", "n", "keys")
    first = some.groupBy("node").agg(F.min("id").alias("low"), F.min_by(row, F.struct(F.col("id").isNull(), "id", "fp")).alias("rep"))
    nodes = cut(first.select("node", "low", "rep.id", "rep.fp", "rep.n", "rep.keys"))
    reps = nodes.drop("keys")
    pairs, dense = _candidates(nodes.select("node", "keys"))
    dense = cut(dense)

    places = reps.select("node", "id", "fp")
    # first the two most frequent of each node and the leaders; of the others only those that could still join two components
    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    best = each.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where("nth <= 2")
    likely = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowded = not dense.isEmpty()
    if crowded:
        likely = likely.unionByName(_leaders(dense))
    links = _confirm(texts, cut(likely.distinct()), places, words, percent)
    roots = cut(components(links))
    apart = pairs.select("a", "b")
    for side in ("a", "b"):
        apart = apart.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    rest = cut(apart.where("ra <> rb").select("a", "b", "ra", "rb"))
    if not rest.isEmpty():
        more = _confirm_few(texts, rest.select("a", "b"), places, words, percent).join(rest, ["a", "b"]).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        roots = cut(_led(roots, more))
    if crowded:
        roots = cut(_led(roots, _rarest(texts, dense, places, roots, words, percent)))

    labelled = reps.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component"))
    of_node = labelled.join(lowest, "root").select("node", "component", "root")
    rows = signed.select("id", "fp", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.encode(F.concat(F.lit("alone "), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8")).alias("node"))
    joined = rows.join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == component, F.col("n") == 0)
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), F.col("fp").alias("text_hash"), F.hex("root").alias("group"))
