"""Ordered events and intervals: range, containment and as-of joins, sessions, chains, windows, scenes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.session import in_order

# What is said of a video's coverage.
ADVICE = [
    "Consider using DEEP_ANALYSIS or ADAPTIVE preset for better coverage",
    "Large gap detected (%.1fs) - use HYBRID extraction to fill gaps",
    "Low frame density - increase max_frames or reduce interval",
    "%d gaps over %.1fs - content may be missed",
    "Good coverage achieved",
    "No frames extracted",
]


def _binned(left: DataFrame, right: DataFrame, keys: list[str], l_lo: str, l_hi: str, r_lo: str, r_hi: str, width: int, match: Column) -> DataFrame:
    """An interval join by equality of key and bin: no row meets all others. Each pair meets in its first common bin only."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a = left.withColumn("_bin", bins(l_lo, l_hi))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rbin", bins(f"r_{r_lo}", f"r_{r_hi}"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"r_{k}") for k in keys], F.col("_bin") == F.col("_rbin"))
    once = F.col("_bin") == F.greatest(F.floor(F.col(l_lo) / width), F.floor(F.col(f"r_{r_lo}") / width))
    return a.join(b, same & match & once).drop("_bin", "_rbin", *[f"r_{k}" for k in keys])


def overlapping(windows: DataFrame, segments: DataFrame, keys: list[str], lo: str = "start_ms", hi: str = "end_ms", width: int = 60_000) -> DataFrame:
    """Pairs that overlap, strictly on both sides; the segment's columns get the prefix ``r_``."""
    return _binned(windows, segments, keys, lo, hi, lo, hi, width, (F.col(f"r_{lo}") < F.col(hi)) & (F.col(f"r_{hi}") > F.col(lo)))


def containing(outer: DataFrame, inner: DataFrame, keys: list[str], lo: str = "start_ms", hi: str = "end_ms", width: int = 60_000) -> DataFrame:
    """Pairs where the second lies within the first, edges included."""
    return _binned(outer, inner, keys, lo, hi, lo, hi, width, (F.col(f"r_{lo}") >= F.col(lo)) & (F.col(f"r_{hi}") <= F.col(hi)))


def points_in(windows: DataFrame, points: DataFrame, keys: list[str], at: str = "ts_ms", lo: str = "start_ms", hi: str = "end_ms", width: int = 60_000) -> DataFrame:
    """Pairs of a window and a point in it; the end is outside."""
    return _binned(windows, points, keys, lo, hi, at, at, width, (F.col(f"r_{at}") >= F.col(lo)) & (F.col(f"r_{at}") < F.col(hi)))


def nearest(targets: DataFrame, points: DataFrame, key: str, at: str, point_id: str, t: str = "t_ms") -> DataFrame:
    """``targets`` with the nearest point as ``near_id, near_at``: of equals the earlier, then the smaller id.

    One sort of both sides together finds the neighbours before and behind.
    """
    cols = targets.columns
    both = targets.withColumns({"_at": F.col(t), "_p": F.lit(None).cast("struct<at: bigint, id: bigint>"), "_side": F.lit(1)}).unionByName(
        points.select(F.col(key), F.col(at).cast("long").alias("_at"), F.struct(F.col(at).cast("long").alias("at"), F.col(point_id).cast("long").alias("id")).alias("_p"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key)
    low_first = w.orderBy("_at", "_side", F.desc("_p.id")).rowsBetween(Window.unboundedPreceding, 0)
    high_first = w.orderBy(F.desc("_at"), "_side", F.desc("_p.id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_before": F.last("_p", True).over(low_first), "_after": F.last("_p", True).over(high_first)}).where("_side = 1")
    far = lambda c: F.abs(F.col(f"{c}.at") - F.col("_at"))
    best = F.when(F.col("_after").isNull() | (far("_before") <= far("_after")), F.col("_before")).otherwise(F.col("_after"))
    return seen.withColumn("_best", best).select(*cols, F.col("_best.id").alias("near_id"), F.col("_best.at").alias("near_at"))


def chain(rows: DataFrame, key: str, order: list[str], node: str, kind: str) -> DataFrame:
    """``src, dst, rel_type`` from each row to the next."""
    nxt = F.lead(node).over(Window.partitionBy(key).orderBy(*order))
    return rows.select(F.col(node).alias("src"), nxt.alias("dst"), F.lit(kind).alias("rel_type")).where("dst IS NOT NULL")


def walk(rows: DataFrame, key: str, order: list[str], anchors: DataFrame, node: str, hops: int) -> DataFrame:
    """``anchor, node, hop``: the rows up to ``hops`` after each anchor in its chain."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    start = ranked.join(anchors.select(node), node).select(F.col(key), F.col(node).alias("anchor"), F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + hops)).alias("_n"), F.col("_n").alias("_from"))
    return start.join(ranked, [key, "_n"]).select("anchor", node, (F.col("_n") - F.col("_from")).alias("hop"))


def sessions(rows: DataFrame, key: str, at: str, gap: int, order: list[str]) -> DataFrame:
    """``rows`` with ``session``, from 1: a new one begins more than ``gap`` after the row before."""
    w = Window.partitionBy(key).orderBy(at, *order)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int")
    return rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w)).drop("_fresh")


def pauses(segments: DataFrame, key: str, gap: int, lo: str = "start_ms", hi: str = "end_ms") -> DataFrame:
    """Segments that start ``gap`` or more after the end of the row before."""
    before = F.lag(hi).over(Window.partitionBy(key).orderBy(lo, hi))
    return segments.withColumn("pause", F.col(lo) - before).where(F.col("pause") >= gap)


def sliding(spans: DataFrame, key: str, duration: str, length: int, overlap: int) -> DataFrame:
    """``key, n, start_ms, end_ms``: windows of ``length`` that overlap; the last ends with the duration."""
    step = length - overlap
    last = F.greatest(F.ceil((F.col(duration) - length) / step), F.lit(0))
    return spans.where(F.col(duration) > 0).select(key, duration, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n")).select(key, "n", (F.col("n") * step).alias("start_ms"), F.least(F.col(duration), F.col("n") * step + length).alias("end_ms"))


def midpoints(frames: DataFrame, key: str, at: str, order: list[str], duration: Column, digits: int = 3) -> DataFrame:
    """Of each frame the span to the middle between its neighbours; the first from 0, the last to the duration."""
    w = Window.partitionBy(key).orderBy(at, *order)
    prev, nxt = F.lag(at).over(w), F.lead(at).over(w)
    lo = F.when(prev.isNull(), 0.0).otherwise((prev + F.col(at)) / 2)
    hi = F.when(nxt.isNull(), F.greatest(duration, F.col(at) + 1)).otherwise((F.col(at) + nxt) / 2)
    return frames.withColumns({"lo": F.round(lo, digits), "hi": F.round(hi, digits)}).withColumn("hi", F.greatest("lo", "hi"))


def thin(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """``key, at`` of the rows kept when each must be ``gap`` or more from the last one kept.

    The rows of a key pass through one task in order; it remembers the last one kept.
    """
    some = rows.select(key, F.col(at).cast("long").alias(at))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for batch in batches:
            keep = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if t is not None and (now != (k,) or t - last >= gap):
                    now, last = (k,), t
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return in_order(some, key, at).mapInArrow(fold, some.schema)


def candidate_points(durations: DataFrame, frames: DataFrame, segments: DataFrame, key: str, gap: int, most: int) -> DataFrame:
    """``key, point, reason``: start, end, pauses, frames and a point every ``most``; a point may come for several reasons.

    Only what lies within a positive duration counts.
    """
    d = durations.where("duration > 0").select(key, "duration")
    at = lambda point, reason: F.struct(point.cast("long").alias("point"), F.lit(reason).alias("reason"))
    steps = F.when(F.col("duration") > most, F.sequence(F.lit(most).cast("long"), F.col("duration").cast("long") - 1, F.lit(most).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    fixed = F.concat(F.array(at(F.lit(0), "start"), at(F.col("duration"), "end")), F.transform(steps, lambda x: at(x, "max_scene_duration")))
    seen = pauses(segments, key, gap).select(key, F.col("start_ms").alias("point"), F.lit("transcript_gap").alias("reason")).union(frames.select(key, "ts_ms", F.lit("frame_anchor")))
    within = seen.where("point > 0").join(d, key).where("point < duration").select(key, F.col("point").cast("long").alias("point"), "reason")
    return d.select(key, F.inline(fixed)).union(within)


def boundary_points(durations: DataFrame, frames: DataFrame, segments: DataFrame, key: str, gap: int, most: int) -> DataFrame:
    """``key, point, reasons``: the points with all their reasons."""
    return candidate_points(durations, frames, segments, key, gap, most).groupBy(key, "point").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def scenes(points: DataFrame, key: str, least: int) -> DataFrame:
    """``key, n, start_ms, end_ms, reasons``: points closer than ``least`` to the scene's start are absorbed; the last point closes.

    A scene has the reasons of its start, of what it absorbed and of the point that
    closes it. ``points`` has ``reasons``, or a row for each ``reason``. The points of a
    key pass through one task in order, which remembers one scene; a null point is none.
    """
    which = "reasons" if "reasons" in points.columns else "reason"
    some = points.where("point IS NOT NULL").select(key, "point", which)
    schema = f"`{key}` {dict(some.dtypes)[key]}, n int, start_ms long, end_ms long, reasons array<string>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, out = None, None, []
        n = start = last = 0
        held, fresh = set(), set()  # reasons of the scene up to the last point but one, and of the last point

        def step(point: int | None) -> None:
            """The last point has all its reasons: it closes the scene, or is absorbed unless it is the key's last."""
            nonlocal n, start, held
            if last > start and (point is None or last - start >= least):
                out.append((now[0], n, start, last, sorted(held | fresh)))
                n, start, held = n + 1, last, set(fresh)
            else:
                held |= fresh

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = {r} if isinstance(r, str) else set(r or ())
                if now == (k,) and p == last:
                    fresh |= r
                    continue
                if now is not None:
                    step(p if now == (k,) else None)
                if now != (k,):
                    now, n, start, held = (k,), 0, p, set()
                last, fresh = p, r
            if out:
                yield _scene_batch(out, key, kind)
                out.clear()
        if now is not None:
            step(None)
            yield _scene_batch(out, key, kind)

    return in_order(some, key, "point").mapInArrow(fold, schema)


def _scene_batch(rows: list[tuple], name: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [name, "n", "start_ms", "end_ms", "reasons"])


def chunks(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``chunk``, from 0: runs of ``size`` in order."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("long"))


def every_nth(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    w = Window.partitionBy(key)
    n, total = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return rows.withColumns({"_n": n, "_step": F.ceil(total / limit)}).where("_n % _step = 0").drop("_n", "_step")


def after_last(segments: DataFrame, key: str, chunk: str) -> DataFrame:
    """Segments that don't start before the latest end of an earlier chunk's segments."""
    ends = segments.groupBy(key, chunk).agg(F.max("end_ms").alias("_end"))
    until = ends.withColumn("_until", F.max("_end").over(Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)))
    return segments.join(until.select(key, chunk, "_until"), [key, chunk]).where("_until IS NULL OR start_ms >= _until").drop("_until")


def adjacency_boost(rows: DataFrame, key: str, at: str, score: str, other: str, order: list[str], window: int = 15_000, weight: float = 0.15) -> DataFrame:
    """``boosted``: a neighbour within ``window`` lends (1 - gap / window) * weight of its ``other`` score, to 1 at most."""
    w = Window.partitionBy(key).orderBy(at, *order)
    lend = lambda f, gap: F.coalesce(F.when(gap <= window, (1 - gap / window) * weight * f(other).over(w)), F.lit(0.0))
    back, ahead = lend(F.lag, F.col(at) - F.lag(at).over(w)), lend(F.lead, F.lead(at).over(w) - F.col(at))
    return rows.withColumn("boosted", F.least(F.lit(1.0), F.least(F.lit(1.0), F.col(score) + back) + ahead))


def coverage(frames: DataFrame, key: str, at: str, durations: DataFrame) -> DataFrame:
    """How evenly frames cover a video: ``key, n, max_gap, avg_gap, problems, density, score, advice``; times in seconds.

    Gaps stand between frames and, over a second, at either end. ``density`` is frames a minute.
    """
    w = Window.partitionBy(key).orderBy(at)
    inner = frames.select(key, (F.lead(at).over(w) - F.col(at)).alias("gap")).where("gap IS NOT NULL")
    ends = frames.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).join(durations, key)
    edge = ends.select(key, F.explode(F.array(F.col("lo"), F.col("duration") - F.col("hi"))).alias("gap")).where("gap > 1")
    limit = F.when(F.col("duration") < 300, 10).when(F.col("duration") < 1800, 20).when(F.col("duration") < 3600, 30).otherwise(45)
    d = durations.withColumn("_limit", limit)
    gaps = inner.union(edge).join(d.select(key, "_limit"), key).groupBy(key).agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"), F.sum((F.col("gap") > F.col("_limit")).cast("long")).alias("problems"))
    n = frames.groupBy(key).agg(F.count("*").alias("n"))
    out = d.join(n, key, "left").join(gaps, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "max_gap": F.when(F.col("n").isNull(), F.col("duration")).otherwise(F.coalesce("max_gap", F.lit(0.0))), "problems": F.coalesce("problems", F.lit(0))})
    base = F.least(10 * F.coalesce(F.try_divide(F.col("n"), F.col("duration") / 60), F.lit(0.0)), F.lit(100.0)) - F.least(10.0 * F.col("problems"), F.lit(50.0))
    score = base - F.when(F.col("max_gap") > F.col("_limit"), F.least(20 * (F.col("max_gap") / F.col("_limit") - 1), F.lit(30.0))).otherwise(0.0)
    score = F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(score, F.lit(0.0)))
    density = F.coalesce(F.try_divide(F.col("n"), F.col("duration") / 60), F.lit(0.0))
    advice = F.array_compact(F.array(
        F.when(score < 50, ADVICE[0]), F.when(F.col("max_gap") > F.col("_limit") * 2, F.format_string(ADVICE[1], "max_gap")),
        F.when(density < 5, ADVICE[2]), F.when(F.col("problems") > 5, F.format_string(ADVICE[3], "problems", F.col("_limit").cast("double"))),
    ))
    advice = F.when(F.col("n") == 0, F.array(F.lit(ADVICE[5]))).when(F.size(advice) == 0, F.array(F.lit(ADVICE[4]))).otherwise(advice)
    return out.select(key, "n", F.round("max_gap", 2).alias("max_gap"), F.round(F.coalesce("avg_gap", F.lit(0.0)), 2).alias("avg_gap"), "problems", F.round(density, 2).alias("density"), F.round(score, 1).alias("score"), advice.alias("advice"))
