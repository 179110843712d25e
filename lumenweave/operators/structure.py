"""The structure of a video: boundaries of two kinds merged, scenes between them, chapters of scenes. Times are in ms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.sampling import keyframes, semantic_clusters
from lumenweave.operators.timeline import containing, points_in, thin
from lumenweave.session import in_order

#: What is known of a boundary that only a cluster of like frames shows.
SEMANTIC_CONFIDENCE = 0.7


def semantic_boundaries(frames: DataFrame, key: str, order: list[str], v: str, at: str, least: float = 0.85) -> DataFrame:
    """``key, t, number, confidence, method``: where a cluster of like frames begins; ``number`` is the frame's place, from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    clusters = semantic_clusters(frames.select(key, *dict.fromkeys([*order, at]), v), key, order, v, least).withColumn("number", F.row_number().over(w) - 1)
    fresh = F.coalesce(F.col("cluster") != F.lag("cluster").over(w), F.lit(True))
    return clusters.withColumn("_fresh", fresh).where("_fresh").select(key, F.col(at).cast("long").alias("t"), F.col("number").cast("long").alias("number"), F.lit(SEMANTIC_CONFIDENCE).alias("confidence"), F.lit("semantic").alias("method"))


def match_boundaries(visual: DataFrame, semantic: DataFrame, key: str, near: int) -> DataFrame:
    """``key, t, number, confidence, method, left``: visual boundaries, and with ``left`` the semantic ones that none has taken.

    In order of time each visual boundary takes the nearest semantic one less than
    ``near`` away that is still there, of two as near the earlier: both become one, of
    method ``merged``, at the mean of their times and confidences. The boundaries of
    a key pass through one task in order; it holds those of twice ``near``.
    """
    cols = [key, "t", "number", "confidence", "method"]
    both = visual.select(*cols, F.lit(0).alias("side")).unionByName(semantic.select(*cols, F.lit(1).alias("side")))
    both = both.select(key, F.col("t").cast("long").alias("t"), F.col("number").cast("long").alias("number"), F.col("confidence").cast("double").alias("confidence"), "method", "side").where("t IS NOT NULL")
    kind = dict(both.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, free, out = None, deque(), deque(), []

        def settle(until: float) -> None:
            while waiting and waiting[0][1] + near <= until:
                v = waiting.popleft()
                while free and free[0][1] <= v[1] - near:
                    out.append((*free.popleft()[:5], True))
                best = min((s for s in free if abs(s[1] - v[1]) < near), key=lambda s: abs(s[1] - v[1]), default=None)
                if best is None:
                    out.append((*v[:5], False))
                else:
                    free.remove(best)
                    out.append((v[0], (v[1] + best[1]) / 2, v[2], (v[3] + best[3]) / 2, "merged", False))
            while not waiting and free and free[0][1] + near <= until:
                out.append((*free.popleft()[:5], True))

        def told() -> pa.RecordBatch:
            names = [*cols, "left"]
            kinds = [key_type, pa.float64(), pa.int64(), pa.float64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

        key_type = pa.null()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row[0],):
                    settle(float("inf"))
                    now = (row[0],)
                settle(row[1])
                (free if row[5] else waiting).append(row)
            yield told()
            out.clear()
        settle(float("inf"))
        if out:
            yield told()

    return in_order(both, key, "t", "side", "number").mapInArrow(fold, f"`{key}` {kind}, t double, number long, confidence double, method string, left boolean")


def merge_boundaries(visual: DataFrame, semantic: DataFrame, key: str, near: int = 2000, apart: int = 2000) -> DataFrame:
    """``key, t, number, confidence, method`` of all boundaries (t, number, confidence, method) of both kinds.

    Near ones are matched; a semantic boundary that is left counts if it is ``apart``
    or more from every other boundary and from those before it that count.
    """
    found = match_boundaries(visual, semantic, key, near)
    w = Window.partitionBy(key)
    other = F.when(~F.col("left"), F.col("t"))
    before = F.last(other, ignorenulls=True).over(w.orderBy("t", F.col("left").cast("int")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(other, ignorenulls=True).over(w.orderBy(F.desc("t"), F.col("left").cast("int")).rowsBetween(Window.unboundedPreceding, 0))
    seen = found.withColumns({"_before": before, "_after": after})
    free = seen.where("left").where((F.coalesce(F.col("t") - F.col("_before"), F.lit(apart)) >= apart) & (F.coalesce(F.col("_after") - F.col("t"), F.lit(apart)) >= apart)).drop("_before", "_after", "left")
    first = free.groupBy(key, "t").agg(F.min(F.struct("number", "confidence", "method")).alias("_x")).select(key, "t", "_x.*")
    kept = first.join(thin(first, key, "t", apart).withColumn("t", F.col("t").cast("double")), [key, "t"], "left_semi")
    return found.where("NOT left").drop("left").unionByName(kept)


def scenes_between(boundaries: DataFrame, durations: DataFrame, key: str, fps: float, least: int = 2000, k: int = 3) -> DataFrame:
    """``key, scene_id, start_ms, end_ms, start_frame, end_frame, keyframes, confidence, method``.

    A scene goes from a boundary to the next, the last to the ``duration``; one shorter
    than ``least`` is left out unless it is the first.
    """
    w = Window.partitionBy(key).orderBy("t", "number", "method")
    spans = boundaries.join(durations.select(key, "duration"), key).withColumns({"end_ms": F.coalesce(F.lead("t").over(w), F.col("duration").cast("double")), "_i": F.row_number().over(w)})
    kept = spans.where((F.col("_i") == 1) | (F.col("end_ms") - F.col("t") >= least)).withColumn("scene_id", F.row_number().over(w) - 1)
    frame = lambda c: F.floor(F.col(c) * (fps / 1000)).cast("long")
    numbered = kept.select(key, "scene_id", F.col("t").alias("start_ms"), "end_ms", frame("t").alias("start_frame"), frame("end_ms").alias("end_frame"), "confidence", "method")
    return numbered.withColumn("keyframes", keyframes(F.col("start_frame"), F.col("end_frame"), k))


def described(scenes: DataFrame, frames: DataFrame, segments: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """``scenes`` with what their frames and segments say: ``description, objects, scene_type, transcript``.

    Of ``frames`` (frame_number, description, objects, scene_type) the first three
    descriptions, ten objects at most in order of their names, and the commonest type,
    of equals the one that comes first. Of ``segments`` (start_ms, end_ms, text) those
    that lie within. ``width``: frames that meet in one group of the join.
    """
    s = scenes.select(key, "scene_id", "start_frame", "end_frame", "start_ms", "end_ms")
    held = points_in(s, frames.select(key, "frame_number", "description", "objects", "scene_type"), [key], at="frame_number", lo="start_frame", hi="end_frame", width=width)
    by = [key, "scene_id"]
    said = held.where("r_description <> ''").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("r_frame_number", "r_description"))).where("_n <= 3")
    said = said.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "r_description"))), lambda x: x["r_description"]), " ").alias("description"))
    objects = held.select(*by, F.explode("r_objects").alias("o")).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).where("_n <= 10").groupBy(*by).agg(F.array_sort(F.collect_list("o")).alias("objects"))
    types = held.where("r_scene_type IS NOT NULL").groupBy(*by, "r_scene_type").agg(F.count("*").alias("n"), F.min("r_frame_number").alias("at"))
    types = types.groupBy(*by).agg(F.min_by("r_scene_type", F.struct(-F.col("n"), "at", "r_scene_type")).alias("scene_type"))
    text = containing(s, segments.select(key, "start_ms", "end_ms", "text"), [key]).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start_ms", "r_text"))), lambda x: x["r_text"]), " ").alias("transcript"))
    out = scenes
    for part in (said, objects, types, text):
        out = out.join(part, by, "left")
    return out.withColumn("objects", F.coalesce("objects", F.array().cast("array<string>")))


def chapters_of(scenes: DataFrame, key: str, size: int = 5) -> DataFrame:
    """``key, chapter_id, title, start_ms, end_ms, scene_ids``: runs of ``size`` scenes."""
    c = scenes.withColumn("chapter_id", F.floor(F.col("scene_id") / size).cast("int")).groupBy(key, "chapter_id")
    grouped = c.agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "scene_id").alias("end_ms"), F.array_sort(F.collect_list("scene_id")).alias("scene_ids"))
    return grouped.withColumn("title", F.concat(F.lit("Chapter "), F.col("chapter_id") + 1))


def analyse(visual: DataFrame, embedded: DataFrame | None, durations: DataFrame, frames: DataFrame, segments: DataFrame, key: str, fps: float, near: int = 2000, apart: int = 2000, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Scenes with what is seen and said in them, and chapters, of every video.

    ``visual``: boundaries; ``embedded``: frames (t, v), whose clusters add boundaries;
    without them the visual ones stand alone.
    """
    found = visual.select(key, F.col("t").cast("double").alias("t"), F.col("number").cast("long").alias("number"), F.col("confidence").cast("double").alias("confidence"), "method")
    if embedded is not None:
        found = merge_boundaries(visual, semantic_boundaries(embedded, key, ["t"], "v", "t", least), key, near, apart)
    scenes = scenes_between(found, durations, key, fps, apart)
    return described(scenes, frames, segments, key), chapters_of(scenes, key)
