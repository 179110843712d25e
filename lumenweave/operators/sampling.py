"""Where to look in a video: chunks of audio, times of frames, uniform scenes, and clusters of like frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.session import in_order

# From so many seconds on, how a video's frames are chosen:
# (least seconds, method, interval, scene threshold, share of scenes, least gap that is filled, most frames)
ADAPTIVE = [
    (28800, "hybrid", 10.0, 0.15, 0.5, 60.0, 2000),
    (14400, "hybrid", 8.0, 0.2, 0.5, 45.0, 1500),
    (7200, "hybrid", 6.0, 0.25, 0.4, 30.0, 1200),
    (3600, "hybrid", 5.0, 0.3, 0.5, 20.0, 800),
    (1800, "hybrid", 4.0, 0.35, 0.6, 15.0, 600),
    (300, "interval", 3.0, None, None, None, 400),
    (0, "hybrid", 1.0, 0.35, 0.6, 3.0, 300),
]
#: Hashes have 64 bits, of which the highest is a sign.
MASK = (1 << 64) - 1
ADAPTIVE_TYPE = "struct<method: string, interval: double, threshold: double, share: double, gap: double, most: int>"


def adaptive(duration: Column) -> Column:
    """How to choose the frames of a video of so many seconds: struct (method, interval, threshold, share, gap, most)."""
    out = F
    for least, *how in ADAPTIVE:
        one = F.struct(*[F.lit(x) for x in how]).cast(ADAPTIVE_TYPE)
        out = out.when(duration >= least, one)
    return out.otherwise(F.struct(*[F.lit(x) for x in ADAPTIVE[-1][1:]]).cast(ADAPTIVE_TYPE))


def audio_chunks(videos: DataFrame, duration: str, target: float, overlap: float, least: float, most: int) -> DataFrame:
    """``videos`` with ``n, start, end``: overlapping chunks; a last one under ``least`` is left out, and ``most`` is the most.

    ``covered`` says whether the chunks reach the end. A video without duration has none.
    """
    d = F.col(duration)
    count = F.ceil(F.greatest(d - target, F.lit(0.0)) / (target - overlap)).cast("int") + 1
    each = videos.where(d > 0).withColumn("n", F.explode(F.sequence(F.lit(0), F.least(count, F.lit(most)) - 1)))
    each = each.withColumn("start", F.col("n") * (target - overlap)).withColumn("end", F.least(d, F.col("start") + target))
    each = each.where((F.col("n") == 0) | (F.col("end") - F.col("start") >= least))
    last = F.when(count - 1 < most, F.when((count == 1) | (d - (count - 1) * (target - overlap) >= least), d).otherwise((count - 2) * (target - overlap) + target)).otherwise((most - 1) * (target - overlap) + target)
    return each.withColumn("covered", last + 0.001 >= d).withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


def interval_times(duration: Column, interval: Column | float, most: Column | int) -> Column:
    """0, interval, ... before the end, ``most`` at most."""
    interval, most = (x if isinstance(x, Column) else F.lit(x) for x in (interval, most))
    count = F.least(F.ceil(duration / interval).cast("int"), most)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * interval)).otherwise(F.array().cast("array<double>"))


def uniform_times(duration: Column, n: int) -> Column:
    """``n`` times from the first to the last moment, which is a tenth of a second before the end; one is the middle."""
    last = F.greatest(duration - 0.1, F.lit(0.0))
    if n == 1:
        return F.array(F.least(duration / 2, last))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(i * (duration / (n - 1)), last))


def frame_times(duration: Column, method: Column, interval: float, fps: float, n: int, most: int) -> Column:
    """The times by one of the methods interval, fps, uniform and adaptive; other methods need the pictures and have none here."""
    how = adaptive(duration)
    found = (
        F.when(duration <= 0, F.array().cast("array<double>")).when(method == "fps", interval_times(duration, 1 / fps, most)).when(method == "interval", interval_times(duration, interval, most))
        .when(method == "uniform", uniform_times(duration, min(n, most))).when((method == "adaptive") & (how["method"] == "interval"), F.slice(interval_times(duration, how["interval"], how["most"]), 1, most))
    )
    return found.otherwise(F.array().cast("array<double>"))


def hybrid_times(scenes: DataFrame, videos: DataFrame, video: str, at: str, duration: str, gap: float, most: int) -> DataFrame:
    """``video, at``: scene changes, and between those over ``gap`` apart evenly spaced times in proportion to the gaps; both ends; ``most`` in all.

    A video without a scene change gets ``most`` times spread evenly.
    """
    w = Window.partitionBy(video)
    s = scenes.select(video, F.col(at).alias("t")).distinct().withColumns({"gap": F.lead("t").over(w.orderBy("t")) - F.col("t"), "count": F.count("*").over(w)})
    wide = F.when(F.col("gap") > gap, F.col("gap"))
    s = s.withColumn("fill", F.floor(wide / F.sum(wide).over(w) * (most - F.col("count"))).cast("int"))
    filled = s.where("fill > 0").select(video, F.explode(F.transform(F.sequence(F.lit(1), F.col("fill")), lambda j: F.col("t") + j * (F.col("gap") / (F.col("fill") + 1)))).alias("t"))
    some = s.select(video, "t").unionByName(filled)
    d = videos.select(video, F.col(duration).alias("d"))
    ends = d.join(some.select(video).distinct(), video, "left_semi")
    tail = ends.join(some.select(video, (F.col("t") + 0.5).alias("d")), [video, "d"], "left_anti")
    every = some.unionByName(ends.select(video, F.lit(0.0).alias("t"))).unionByName(tail.select(video, (F.col("d") - 0.1).alias("t"))).distinct()
    kept = every.withColumn("n", F.row_number().over(w.orderBy("t"))).where(F.col("n") <= most).select(video, "t")
    none = d.join(some.select(video).distinct(), video, "left_anti")
    even = none.select(video, F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i * (F.col("d") / max(most - 1, 1)))).alias("t"))
    return kept.unionByName(even).withColumnRenamed("t", at)


def uniform_scenes(videos: DataFrame, duration: str, least: float, most: float) -> DataFrame:
    """``videos`` with ``n, start``: scenes of a fifth of the video, but no shorter than ``least`` nor, unless that asks for it, longer than ``most``."""
    length = F.greatest(F.least(F.lit(float(most)), F.col(duration) / 5), F.lit(float(least)))
    count = F.ceil(F.col(duration) / length).cast("int")
    each = videos.where(F.col(duration) > 0).withColumn("n", F.explode(F.sequence(F.lit(0), count - 1)))
    return each.withColumn("start", F.col("n") * length)


def evenly(values: Column, k: int) -> Column:
    """``k`` elements of a list at even distances, with both ends; one is the middle; a list of no more as it is."""
    size = F.size(values)
    if k == 1:
        some = F.slice(values, F.floor(size / 2).cast("int") + 1, 1)
    else:
        at = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * ((size - 1) / (k - 1)), 0).cast("int"))))
        some = F.transform(at, lambda i: F.get(values, i))
    return F.when(size <= k, values).otherwise(some)


def keyframes(lo: Column, hi: Column, k: int) -> Column:
    """``k`` frame numbers within a scene; all of a scene that has no more."""
    step = (hi - lo) / (k + 1)
    inner = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.floor(lo + step * i).cast("long"))
    return F.when(hi <= lo, F.array().cast("array<bigint>")).when(hi - lo <= k, F.sequence(lo.cast("long"), hi.cast("long") - 1)).otherwise(inner)


def fallback_points(duration: Column) -> Column:
    return F.transform(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.85)), lambda x: x * duration)


def semantic_clusters(frames: DataFrame, video: str, order: list[str], v: str, least: float = 0.85) -> DataFrame:
    """``frames`` with ``cluster``, from 0: a frame stays while it is like the mean of the cluster's unit vectors so far.

    Each frame depends on the one before, so a video's frames pass through one task
    in order; it holds no more of them than the sum of the current cluster.
    """
    schema = T.StructType([*frames.schema.fields, T.StructField("cluster", T.IntegerType())])
    at_video, at_v = frames.columns.index(video), frames.columns.index(v)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n, cluster = None, None, 0, 0
        for batch in batches:
            out = []
            for key, x in zip(batch.column(at_video).to_pylist(), batch.column(at_v).to_pylist(), strict=True):
                x = np.array(x, float)
                x = x / (np.linalg.norm(x) + 1e-8)
                if now != (key,):
                    now, total, n, cluster = (key,), x, 1, 0
                elif x @ (total / n) >= least:
                    total, n = total + x, n + 1
                else:
                    total, n, cluster = x, 1, cluster + 1
                out.append(cluster)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "cluster"])

    return in_order(frames, video, *order).mapInArrow(fold, schema)


def distinct_frames(frames: DataFrame, key: str, order: list[str], hashed: str, most: int = 12) -> DataFrame:
    """The frames left when one goes whose perceptual hash differs in ``most`` bits or less from that of the last one left.

    So a slow drift keeps a frame whenever enough has changed. Frames of a key pass
    through one task in ``order``; it remembers one hash. A frame without a hash
    stays and is not compared with.
    """
    at_key, at_hash = frames.columns.index(key), frames.columns.index(hashed)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for i, (k, h) in enumerate(zip(batch.column(at_key).to_pylist(), batch.column(at_hash).to_pylist(), strict=True)):
                if now != (k,):
                    now, last = (k,), None
                if h is None or last is None or ((h ^ last) & MASK).bit_count() > most:
                    last = last if h is None else h
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return in_order(frames, key, *order).mapInArrow(fold, frames.schema)
