"""Line dedup by a segment-partition edit join.

A line within ``threshold`` edits of another holds one of the other's
``threshold + 1`` segments unchanged, near the same place. So every distinct line
indexes its segments by hash, with its length and their number, and looks up the
substrings that may be a segment of a line of its length or a little less. Who meets
there and has nearly the same letters is compared by banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import keyed
from lumenweave.session import cut, new_path, text_batches

#: Buckets of letters in a line's bag, four bits each.
BUCKETS = 15
LINES_KEPT = 500_000
#: Keys of texts up to which they are broadcast to pick those texts; beyond, texts and keys meet in a shuffle.
MOST_BROADCAST = 200_000
BLOCK = 1 << 20
#: Entries under one segment up to which a task compares them itself; beyond, they are dealt over tiles of about TILE.
HOT, TILE = 8192, 4096


def normal(line: str) -> bytes:
    """What is compared of a line: without white space at its ends, A-Z lower-cased."""
    return line.encode("utf-8", "replace").strip().lower()


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Starts and lengths of ``parts`` segments of a line of ``n`` bytes; the last ones may be a byte longer."""
    short, longer = n // parts, n % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, size) of the substrings of a line of ``n`` bytes that may be a segment of a line not longer.

    If segment i is the first that is unchanged, at most i edits lie before it, and
    at most threshold - i behind it.
    """
    out = []
    for length in range(max(0, n - threshold), n + 1):
        delta = n - length
        for i, (at, size) in enumerate(segments(length, threshold + 1)):
            lo = max(0, at - i, at + delta - (threshold - i))
            hi = min(n - size, at + i, at + delta + (threshold - i))
            out += [(length, i, start, size) for start in range(lo, hi + 1)]
    return out


def distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance if it is at most ``most``, else ``most + 1``: bit vectors of a band around the diagonal, between the first and the last difference.

    A column of the band is a number of 2 * most + 1 bits. A cell that is no more than
    its upper left neighbour has its bit set, so the distance is counted along the
    diagonal that ends in the last cell.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    miss = np.flatnonzero(x[:n] != y[:n])
    if not len(miss):
        return abs(len(a) - len(b))
    head = int(miss[0])
    miss = np.flatnonzero(x[::-1][: n - head] != y[::-1][: n - head])
    tail = int(miss[0]) if len(miss) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    where: dict[int, int] = {}
    for i, c in enumerate(a, most):  # with room for the rows above the first
        where[c] = where.get(c, 0) | 1 << i
    band = (1 << 2 * most + 1) - 1
    last = 1 << len(a) - len(b) + most  # the diagonal's bit
    score = abs(len(a) - len(b))
    fall = (1 << most) - 1  # rows above the first fall, those from the first on rise
    rise = band ^ fall
    for j, c in enumerate(b):
        eq = where.get(c, 0) >> j & band
        same = ((eq & rise) + rise ^ rise | eq | fall) & band
        right_up, right_down = fall | ~(same | rise) & band, same & rise
        down = same >> 1
        fall, rise = down & right_up, (right_down | ~(down | right_up)) & band
        if j + len(a) - len(b) >= 0 and not same & last:
            score += 1
            if score > most:
                return score
    return score


def bags(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each line (``data`` up to its end) how often each bucket of letters occurs, modulo 16."""
    line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    counts = np.bincount(line * BUCKETS + data % BUCKETS, minlength=len(ends) * BUCKETS).reshape(-1, BUCKETS) & 15
    return (counts.astype(np.int64) << np.arange(0, 4 * BUCKETS, 4)).sum(1)


def bag(line: bytes) -> int:
    return int(bags(np.frombuffer(line, np.uint8), np.array([len(line)]))[0])


class Strings:
    """Hashes of any substrings of a stretch of bytes, from sums that are made once.

    A byte at place j weighs BASE ** -j, so a difference of two sums times BASE to
    the substring's start is the same wherever the substring stands.
    """

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Strings.up) <= len(data):
            n = 2 * len(data) + 1
            powers = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
            Strings.up, Strings.down = powers(Strings.BASE), powers(Strings.INVERSE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Strings.down[: len(data)], out=self.sums[1:])

    def hashes(self, lo: np.ndarray, hi: np.ndarray, tag: np.ndarray) -> np.ndarray:
        h = (self.sums[hi] - self.sums[lo]) * Strings.up[lo] + tag.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return h ^ (h >> np.uint64(29))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most how many letters more or fewer there are in bags: a lower bound of twice the edits."""
    total = np.zeros(len(x), np.int64)
    for shift in range(0, 4 * BUCKETS, 4):
        d = (x >> shift) - (y >> shift) & 15
        total += np.minimum(d, 16 - d)
    return total


def _hash(line: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From id, fp, text: h1, h2, id, fp, no of every line that isn't blank."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = [(i, no, _hash(n)) for i, text in enumerate(part.column(2).to_pylist()) for no, line in enumerate(text.split("\n")) if (n := normal(line))]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[2][0] for r in rows], pa.int64()), pa.array([r[2][1] for r in rows], pa.int64()), part.column(0).take(take), part.column(1).take(take), pa.array([r[1] for r in rows], pa.int32())], ["h1", "h2", "id", "fp", "no"])


def _index(threshold: int, least: int):
    plans: dict[int, np.ndarray] = {}

    def plan(n: int) -> np.ndarray:
        """Of a line of ``n`` bytes: side, tag (length and segment), start and end of its entries."""
        if n not in plans:
            rows = [(0, n * 64 + i, at, at + size) for i, (at, size) in enumerate(segments(n, threshold + 1))]
            rows += [(1, length * 64 + i, at, at + size) for length, i, at, size in probes(n, threshold)]
            plans[n] = np.array(rows, np.int64).T
        return plans[n]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From text: k, h1, bag; the lowest bit of k says that the line looks up."""
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                lines, hashes = [], []
                for text in batch.slice(at, 200).column(0).to_pylist():
                    for line in map(normal, text.split("\n")):
                        if len(line) >= least and (h := _hash(line)[0]) not in seen:
                            if len(seen) > LINES_KEPT:
                                seen.clear()
                            seen.add(h)
                            lines.append(line)
                            hashes.append(h)
                if not lines:
                    continue
                ends = np.cumsum([len(line) for line in lines])
                data = np.frombuffer(b"".join(lines), np.uint8)
                each = [plan(len(line)) for line in lines]
                side, tag, lo, hi = np.concatenate(each, axis=1)
                counts = [x.shape[1] for x in each]
                first = np.repeat(np.concatenate([[0], ends[:-1]]), counts)
                k = (Strings(data).hashes(lo + first, hi + first, tag) >> np.uint64(1)).astype(np.int64) & ~1 | side
                h1, own = np.repeat(np.array(hashes, np.int64), counts), np.repeat(bags(data, ends), counts)
                for a in range(0, len(k), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 20_000]) for x in (k, h1, own)], ["k", "h1", "bag"])

    return index


def _near(look: np.ndarray, hold: np.ndarray, counts: np.ndarray, h: np.ndarray, bags: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Pairs of different lines whose bags may be near, the smaller first: looker ``look[i]`` meets the ``counts[i]`` entries from ``hold[i]`` on, some BLOCK pairs at once."""
    out = []
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(look):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK)))
        n = counts[lo:hi]
        x = np.repeat(look[lo:hi], n)
        y = np.arange(len(x)) + np.repeat(hold[lo:hi] - (np.cumsum(n) - n), n)
        apart = h[x] != h[y]
        x, y = x[apart], y[apart]
        near = _apart(bags[x], bags[y]) <= 2 * threshold
        if near.any():
            x, y = h[x[near]], h[y[near]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        lo = hi
    return out


def _meet(threshold: int, hot: int):
    names = ["a", "b", "k", "bag"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From k, h1, bag in order of k and h1: pairs of lines a, b, the smaller first, that meet and may be near; and the entries of hot segments as a, k, bag."""
        rest, passing = [np.zeros(0, np.int64)] * 3, None

        def entries(k, h, bags) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(bags)], names)

        def pairs(k, h, bags) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            # a line that several tasks have seen is there several times
            new = np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]))
            k, h, bags = k[new], h[new], bags[new]
            group = k >> 1
            first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            size = np.diff(np.append(first, len(group)))
            lookers = np.add.reduceat(k & 1, first)
            # most segments are met by their own line alone
            mixed = (np.minimum.reduceat(h, first) != np.maximum.reduceat(h, first)) & (lookers > 0) & (lookers < size)
            for g in np.flatnonzero(mixed & (size > hot)).tolist():
                own = slice(first[g], first[g] + size[g])
                yield entries(k[own], h[own], bags[own])
            g = np.flatnonzero(mixed & (size <= hot))
            if not len(g):
                return
            n = lookers[g]
            look = np.arange(n.sum()) + np.repeat(first[g] + size[g] - n - (np.cumsum(n) - n), n)
            out = _near(look, np.repeat(first[g], n), np.repeat(size[g] - n, n), h, bags, threshold)
            if out:
                both = np.unique(np.concatenate(out, 1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int64()), pa.nulls(both.shape[1], pa.int64())], names)

        for batch in batches:
            k, h, bags = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True))
            if passing is not None:  # more of a hot segment, which was handed on so far
                n = int(np.searchsorted(k >> 1, passing, side="right"))
                if n:
                    yield entries(k[:n], h[:n], bags[:n])
                k, h, bags = k[n:], h[n:], bags[n:]
            rest = [np.zeros(0, np.int64)] * 3
            if not len(k):
                continue
            passing = None
            done = int(np.searchsorted(k >> 1, k[-1] >> 1))
            yield from pairs(k[:done], h[:done], bags[:done])
            rest = [k[done:], h[done:], bags[done:]]
            if len(rest[0]) > hot:
                yield entries(*rest)
                passing, rest = k[-1] >> 1, [np.zeros(0, np.int64)] * 3
        yield from pairs(*rest)

    return meet


def _tiles(entries: DataFrame, threshold: int, tile: int) -> DataFrame:
    """``a, b`` from the entries of hot segments: holders and lookers are dealt by hash, and each tile of the ones meets each of the others."""
    rows = entries.select(F.shiftright("k", 1).alias("g"), F.col("k").bitwiseAND(1).alias("side"), F.col("a").alias("h1"), "bag").distinct()
    sizes = rows.groupBy("g", "side").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = rows.join(F.broadcast(sizes), ["g", "side"]).withColumn("tile", F.pmod(F.xxhash64("h1"), "tiles"))  # two rows a hot segment
    packed = cut(dealt.groupBy("g", "side", "tile").agg(F.collect_list(F.struct("h1", "bag")).alias("x")).select("g", "side", "tile", F.col("x.h1").alias("h"), F.col("x.bag").alias("bag")))
    holders = packed.where("side = 0").select("g", F.col("tile").alias("t0"), F.col("h").alias("h0"), F.col("bag").alias("b0"))
    lookers = packed.where("side = 1").select("g", F.col("tile").alias("t1"), F.col("h").alias("h1"), F.col("bag").alias("b1"))
    met = holders.join(lookers, "g").repartition("g", "t0", "t1").select("h0", "b0", "h1", "b1")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h0, b0, h1, b1 = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                look = np.arange(len(h0), len(h0) + len(h1))
                out = _near(look, np.zeros(len(h1), np.int64), np.full(len(h1), len(h0)), np.concatenate([h0, h1]), np.concatenate([b0, b1]), threshold)
                if out:
                    both = np.unique(np.concatenate(out, 1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def _texts(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The texts under some keys and, if these are few enough to be broadcast, the others."""
    if keys.count() > MOST_BROADCAST:
        return texts, None
    same = texts["id"].eqNullSafe(F.col("k_id")) & (texts["fp"] == F.col("k_fp"))
    side = F.broadcast(keys.select(F.col("id").alias("k_id"), F.col("fp").alias("k_fp")))
    return texts.join(side, same, "left_semi"), texts.join(side, same, "left_anti")


def line_links(texts: DataFrame, firsts: DataFrame, threshold: int, least: int, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """``a, b``: pairs of distinct lines (structs h1, h2) within ``threshold`` edits."""
    entries = texts.select("text").mapInArrow(_index(threshold, least), "k long, h1 long, bag long")
    met = entries.repartition(F.shiftright("k", 1)).sortWithinPartitions("k", "h1").mapInArrow(_meet(threshold, hot), "a long, b long, k long, bag long")
    met = cut(met)
    entries = met.where("k IS NOT NULL")
    pairs = met.where("k IS NULL").select("a", "b")
    if not entries.isEmpty():
        pairs = pairs.unionByName(_tiles(entries, threshold, tile))
    pairs = cut(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct().join(firsts, "h1").select("h1", "h2", "first.id", "first.fp", "first.no")
    wanted = cut(ends.groupBy("id", "fp").agg(F.collect_list(F.struct("h1", "h2", "no")).alias("wanted")))
    some, _ = _texts(texts, wanted.select("id", "fp"))
    met = some.join(wanted.withColumnsRenamed({"id": "w_id", "fp": "w_fp"}), some["id"].eqNullSafe(F.col("w_id")) & (some["fp"] == F.col("w_fp")))
    lines = met.select(F.explode("wanted").alias("x"), F.element_at(F.split("text", "\n", -1), F.col("x.no") + 1).alias("line")).select("x.h1", "x.h2", "line")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [distance(normal(x), normal(y), threshold) <= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda x: lines.select(F.col("h1").alias(x), F.struct("h1", "h2").alias(f"{x}_line"), F.col("line").alias(f"{x}_text"))
    sides = pairs.join(side("a"), "a").join(side("b"), "b").select("a_line", "b_line", "a_text", "b_text")
    return sides.mapInArrow(check, "a struct<h1: long, h2: long>, b struct<h1: long, h2: long>").distinct()


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From id, text, gone: id, n_lines, n_dropped, kept_sha256, kept."""
    for batch in batches:
        rows = []
        for i, text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines, gone = text.split("\n"), set(gone or ())
            kept = "\n".join(line for no, line in enumerate(lines) if no not in gone)
            rows.append((i, len(lines), len(gone), hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest(), kept))
        if rows:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "n_lines", "n_dropped", "kept_sha256", "kept"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, least: int = 20) -> DataFrame:
    """One row per input row: ``id_col, n_lines, n_dropped, kept_sha256, kept`` (the text that remains).

    Lines are compared without white space at their ends and with A-Z lower-cased.
    Of equal lines the first in order of (id, line) stays; and a line goes
    if one within ``threshold`` edits (of bytes) first stands earlier. Lines under
    ``least`` bytes must be equal. Blank lines stay. A null or empty text is one
    blank line. Null ids come first. Rows that repeat an id and a text share their
    lines: each gets the result of the first. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col).select("id", "fp", "text")
    kind = dict(texts.dtypes)["id"]
    path = new_path(texts.sparkSession, "lines")
    texts.mapInArrow(_lines, f"h1 long, h2 long, id {kind}, fp long, no int").write.parquet(path)
    lines = texts.sparkSession.read.parquet(path)
    # null is the smallest field of a struct
    firsts = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "no", "fp")).alias("first"), F.count("*").alias("n")))
    links = cut(line_links(texts, firsts, threshold, least))
    order = firsts.select(F.struct("h1", "h2").alias("line"), "first")
    both = links.join(order.select(F.col("line").alias("a"), F.col("first").alias("fa")), "a").join(order.select(F.col("line").alias("b"), F.col("first").alias("fb")), "b")
    near = both.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("line")).distinct().select("line.h1", "line.h2", F.lit(True).alias("near"))
    verdict = firsts.join(near, ["h1", "h2"], "left").where("near OR n > 1")
    gone = lines.join(verdict, ["h1", "h2"]).where("near OR NOT (struct(id, no, fp) <=> first)").groupBy("id", "fp").agg(F.collect_set("no").alias("gone"))
    gone = cut(gone)
    some, others = _texts(texts, gone.select("id", "fp"))
    joined = some.join(gone.withColumnsRenamed({"id": "g_id", "fp": "g_fp"}), some["id"].eqNullSafe(F.col("g_id")) & (some["fp"] == F.col("g_fp")), "inner" if others is not None else "left").select("id", "text", "gone")
    out = joined.mapInArrow(_drop, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string, kept string")
    if others is not None:
        plain = others.select("id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
        out = out.unionByName(plain)
    return out.withColumnRenamed("id", id_col)
