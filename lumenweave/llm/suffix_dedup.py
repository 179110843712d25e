"""Removal of repeated byte strings by a sparse suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere.
Sorting every suffix would move every byte hundreds of times over. But of all the
suffixes that start in a window of ``length`` bytes one can be chosen by content
alone (the one whose leading token of TOKEN bytes has the smallest hash), so equal
windows choose equal suffixes: only those, one in some 75, are sorted. A suffix
stands with its context: the bytes of all consecutive windows that chose it.

Sampled splitters range-partition the suffixes by leading token and context; each
partition is sorted. Equal neighbours repeat in full and are settled there. Different
contexts behind one leading token, and whatever meets the edge of a partition or
batch, are compared byte by byte in a second pass that fetches the contexts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenweave.llm.common import keyed
from lumenweave.session import cut, new_path, text_batches

TOKEN = 48
#: Bytes looked at together; longer texts are cut into stretches that overlap by a window.
STRETCH = 1 << 20
#: Contexts of one leading token that a task compares in memory; with more, their windows are counted by Spark.
MOST_IN_MEMORY = 50_000
#: Keys of texts up to which they are broadcast to pick those texts; beyond, texts and keys meet in a shuffle.
MOST_BROADCAST = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION = np.int64((1 << 21) - 1)
#: Ranges that one context may be dealt over.
SLICES = 64


def _token_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the TOKEN bytes from each place on."""
    with np.errstate(over="ignore"):
        h, power, size = data.astype(np.uint64) + np.uint64(1), BASE, 1
        parts = {}
        while size < 32:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
            parts[size] = (h, power)
        (h16, p16), (h32, _) = parts[16], parts[32]
        n = len(data) - TOKEN + 1
        v = (h32[:n] * p16 + h16[32 : 32 + n]) * np.uint64(0xD6E8FEB86659FD93)
        return v ^ (v >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def suffixes(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The chosen suffixes of some texts in ``data``: text, leading token's hash, first window, context bytes, place in the context."""
    arr = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if len(arr) < length:
        return none, none, none, none, none
    hashes = _token_hashes(arr)
    low = _sliding_min((hashes >> np.uint64(1)).astype(np.int64) & ~POSITION | np.arange(len(hashes)), length - TOKEN + 1)
    counts = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    if not len(window):
        return none, none, none, none, none
    chosen = low[window] & POSITION
    first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(window)) - 1
    at = window[first]
    return text[first], hashes[chosen[first]].astype(np.int64), at, window[last] + length - at, chosen[first] - at


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """id, fp, bytes, and of each stretch of text its ends in the bytes and its place in the text."""
    ids, fps, parts, starts, ends, offsets, size = [], [], [], [], [], [], 0

    def out():
        return ids, fps, b"".join(parts), np.array(starts), np.array(ends), np.array(offsets)

    for batch in batches:
        for i, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8", "replace")
            for lo in range(0, max(1, len(data) - length + 1), STRETCH - length):
                part = data[lo : lo + STRETCH - 1]
                if size + len(part) > STRETCH and ids:
                    yield out()
                    ids, fps, parts, starts, ends, offsets, size = [], [], [], [], [], [], 0
                ids.append(i)
                fps.append(fp)
                parts.append(part)
                starts.append(size)
                size += len(part)
                ends.append(size)
                offsets.append(lo)
    if ids:
        yield out()


def _choose(length: int, id_type: pa.DataType):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From id, fp, text: key, ctx, id, fp, at, size, off."""
        for ids, fps, data, starts, ends, offsets in _pieces(batches, length):
            text, key, at, size, off = suffixes(data, starts, ends, length)
            view = memoryview(data)
            ctx = np.fromiter((xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)), np.uint64, len(at)).astype(np.int64)
            within = at - starts[text] + offsets[text] if len(at) else at
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), pa.array(ids, id_type).take(take), pa.array(fps, pa.int64()).take(take), pa.array(within, pa.int64()), pa.array(size, pa.int32()), pa.array(off, pa.int32())], ["key", "ctx", "id", "fp", "at", "size", "off"])

    return choose


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and ctx: spans that repeat in full (``off`` null), and one row of each context that is left to compare.

    ``full`` says that the row's span is among those already. What touches the edge
    of a batch is left to compare, as its neighbours may be in another.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, ctx, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 5))
        new_key = np.diff(key, prepend=key[0]) != 0
        new_key[0] = True
        new_run = new_key.copy()
        new_run[1:] |= (ctx[1:] != ctx[:-1]) | (size[1:] != size[:-1])
        run, group, firsts = np.cumsum(new_run) - 1, np.cumsum(new_key) - 1, np.flatnonzero(new_run)
        again = np.bincount(run) > 1
        open_ = np.bincount(group[firsts]) > 1
        open_[[0, -1]] = True
        spans, reps = np.flatnonzero(again[run]), firsts[open_[group[firsts]]]
        full = again[run[reps]]
        rows = pa.Table.from_batches([batch]).take(np.concatenate([spans, reps])).combine_chunks().to_batches()
        if rows:
            r, k = rows[0], len(spans)
            off = pa.array(r.column(6).to_numpy(zero_copy_only=False), mask=np.arange(r.num_rows) < k)
            yield pa.RecordBatch.from_arrays([r.column(0), *r.columns[2:6], off, pa.array(np.concatenate([np.ones(k, bool), full]))], ["key", "id", "fp", "at", "size", "off", "full"])


def _repeated(members: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """Of each context its spans of windows that others have at the same place; a member is its bytes and its suffix's place."""
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    if len(members) == 2:
        (a, i), (b, j) = members
        lo, hi = min(i, j), min(len(a) - i, len(b) - j)
        x, y = np.frombuffer(a, np.uint8)[i - lo : i + hi], np.frombuffer(b, np.uint8)[j - lo : j + hi]
        miss = np.flatnonzero(x != y)
        cut_ = int(np.searchsorted(miss, lo))
        left = int(miss[cut_ - 1]) + 1 if cut_ else 0
        right = int(miss[cut_]) if cut_ < len(miss) else lo + hi
        if right - left >= length:
            out[0].append((left + i - lo, right + i - lo))
            out[1].append((left + j - lo, right + j - lo))
        return out
    for lane in range(max(i for _, i in members) + 1):
        has = [(m, i - lane) for m, (b, i) in enumerate(members) if 0 <= i - lane <= len(b) - length]
        strings = [members[m][0][s : s + length] for m, s in has]
        seen = Counter(strings)
        if len(seen) < len(strings):
            for (m, s), string in zip(has, strings, strict=True):
                if seen[string] > 1:
                    # lanes go from the first place on to earlier ones
                    if out[m] and out[m][-1][0] == s + 1:
                        out[m][-1] = (s, out[m][-1][1])
                    else:
                        out[m].append((s, s + length))
    return out


def _compare(length: int, schema: list[str]):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts sorted by key (key, id, fp, at, off, full, text): id, fp, at, size of what repeats."""
        held: list[tuple] = []

        def settle() -> list[tuple]:
            if len(held) < 2:
                return []
            found = _repeated([(r[6], r[4]) for r in held], length)
            return [(r[1], r[2], r[3] + a, b - a) for r, spans in zip(held, found, strict=True) if not r[5] for a, b in spans]

        def out(rows: list[tuple], types) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema)

        rows, types = [], None
        for batch in batches:
            types = types or [batch.schema.field(1).type, pa.int64(), pa.int64(), pa.int32()]
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    rows += settle()
                    held.clear()
                held.append(r)
            if len(rows) > 10_000:
                yield out(rows, types)
                rows = []
        rows += settle()
        if rows:
            yield out(rows, types)

    return compare


def _texts(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The texts under some keys and, if these are few enough to be broadcast, the others."""
    if keys.count() > MOST_BROADCAST:
        return texts, None
    same = texts["id"].eqNullSafe(F.col("k_id")) & (texts["fp"] == F.col("k_fp"))
    side = F.broadcast(keys.select(F.col("id").alias("k_id"), F.col("fp").alias("k_fp")))
    return texts.join(side, same, "left_semi"), texts.join(side, same, "left_anti")


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """From id, fp, text: id, fp, at, size; every byte of a repeated string is in one."""
    spark = texts.sparkSession
    kind = dict(texts.dtypes)["id"]
    id_type = to_arrow_type(texts.schema["id"].dataType)
    place = f"id {kind}, fp long, at long, size int"
    chosen = new_path(spark, "suffixes")
    texts.select("id", "fp", "text").mapInArrow(_choose(length, id_type), f"key long, ctx long, {place}, off int").write.parquet(chosen)
    # a passage that many texts share is one key and one context: a slice lets splitters fall inside of it
    slice_ = F.pmod(F.xxhash64("id", "at"), F.lit(SLICES)).cast("int")
    ordered = spark.read.parquet(chosen).withColumn("slice", slice_).repartitionByRange("key", "ctx", "slice").sortWithinPartitions("key", "ctx", "size", "slice").drop("slice")
    settled = new_path(spark, "settled")
    ordered.mapInArrow(_settle, f"key long, {place}, off int, full boolean").write.parquet(settled)
    rows = spark.read.parquet(settled)
    spans, left = rows.where("off IS NULL").select("id", "fp", "at", "size"), rows.where("off IS NOT NULL")

    wanted = left.groupBy("id", "fp").agg(F.collect_list(F.struct("key", "at", "size", "off", "full")).alias("wanted"))
    some, _ = _texts(texts, cut(left.select("id", "fp").distinct()))
    met = some.join(wanted.withColumnsRenamed({"id": "w_id", "fp": "w_fp"}), some["id"].eqNullSafe(F.col("w_id")) & (some["fp"] == F.col("w_fp")))
    context = F.expr("substring(cast(text as binary), cast(x.at as int) + 1, x.size)")
    contexts = met.select("id", "fp", "text", F.explode("wanted").alias("x")).select("x.key", "id", "fp", "x.at", "x.off", "x.full", context.alias("text"))

    hot = cut(left.groupBy("key").count().where(F.col("count") > MOST_IN_MEMORY).select("key"))
    many = not hot.isEmpty()
    calm = contexts.join(hot, "key", "left_anti") if many else contexts
    compared = calm.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length, ["id", "fp", "at", "size"]), place)
    spans = spans.unionByName(compared)
    if many:
        windows = contexts.join(hot, "key", "left_semi").select("id", "fp", "at", "full", F.posexplode(F.expr(f"transform(sequence(0, length(text) - {length}), s -> sha2(substring(text, s + 1, {length}), 256))")).alias("s", "h"))
        again = windows.groupBy("h").count().where("count > 1").select("h")
        spans = spans.unionByName(windows.where("NOT full").join(again, "h", "left_semi").select("id", "fp", (F.col("at") + F.col("s")).alias("at"), F.lit(length).alias("size")))
    return spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From id, text, spans: id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    for batch in batches:
        rows = []
        for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8", "replace")
            kept, end, n, last = [], 0, 0, -1
            for s in sorted((x["at"], x["at"] + x["size"]) for x in spans.as_py() or ()):
                if s[0] > last:
                    n += 1
                    kept.append(data[end : s[0]])
                end = last = max(last, s[1])
            kept.append(data[end:])
            rest = b"".join(kept)
            rows.append((i, len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
        if rows:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that remain).

    A byte is removed if a string of ``length`` bytes over it starts anywhere else
    in the table, in the same text or another; matches never cross texts and
    are judged on the input. Null and short texts lose nothing. A row that repeats
    an id and a text is a text of its own: from ``length`` bytes on, both lose all.
    Other columns are ignored.
    """
    if length <= TOKEN:
        raise ValueError(f"length is over {TOKEN}")
    text_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    found = repeated_spans(texts, length)
    spans = cut(found.groupBy("id", "fp").agg(F.collect_set(F.struct("at", "size")).alias("spans")))
    some, others = _texts(texts, spans.select("id", "fp"))
    joined = some.join(spans.withColumnsRenamed({"id": "s_id", "fp": "s_fp"}), some["id"].eqNullSafe(F.col("s_id")) & (some["fp"] == F.col("s_fp")), "inner" if others is not None else "left").select("id", "text", "spans")
    kind = dict(texts.dtypes)["id"]
    out = joined.mapInArrow(_remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if others is not None:
        plain = others.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
        out = out.unionByName(plain)
    return out.withColumnRenamed("id", id_col)
