"""What results look like to whoever asked: lists of scenes and chapters, hits in a video, paths with their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.scalar import clock
from lumenweave.functions.text import clean_generated


def _filled(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def scene_list(scenes: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """``key, scene_id, start_time, end_time, title, summary`` of scenes with a title or a description, or neither.

    Without a title it is the description's first sentence, 100 characters at most, or
    else "Scene n" from 1. The summary is the whole description without the
    ``prefixes`` of generated texts; null without one. Null times and numbers are 0.
    """
    clean = F.nullif(clean_generated(F.col("description"), prefixes), F.lit(""))
    number = F.coalesce(F.col("scene_id").cast("long"), F.lit(0))
    title = F.coalesce(F.nullif("title", F.lit("")), _filled(F.substring(F.split_part(clean, F.lit("."), F.lit(1)), 1, 100)), F.concat(F.lit("Scene "), number + 1))
    time = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return scenes.select(key, number.alias("scene_id"), time("start_time"), time("end_time"), title.alias("title"), clean.alias("summary"))


def chapters(scenes: DataFrame, key: str, size: int = 5) -> DataFrame:
    """Runs of ``size`` scenes of a list in their order: ``key, chapter_id, title, summary, start_time, end_time, duration, scene_count, scenes``.

    The title is the first scene's, 60 characters at most; the summary those of the
    scenes, 300 characters at most, null without any. ``scenes`` has each one's number,
    title and times. A chapter holds ``size`` scenes, so no group grows.
    """
    order = Window.partitionBy(key).orderBy("start_time", "scene_id", "end_time", "title")
    placed = scenes.withColumn("n", F.row_number().over(order) - 1).withColumn("chapter_id", F.floor(F.col("n") / size))
    span = F.concat(clock(F.col("start_time")), F.lit(" - "), clock(F.col("end_time")))
    one = F.struct("n", "scene_id", "title", span.alias("time_range"), "start_time", "end_time", "summary")
    c = placed.groupBy(key, "chapter_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    first, last = F.get("s", F.lit(0)), F.element_at("s", -1)
    said = F.filter(F.transform("s", lambda x: x["summary"]), lambda x: x.isNotNull() & (x != ""))
    return c.select(
        key, "chapter_id", F.substring(first["title"], 1, 60).alias("title"), F.nullif(F.substring(F.array_join(said, " "), 1, 300), F.lit("")).alias("summary"),
        first["start_time"].alias("start_time"), last["end_time"].alias("end_time"), F.greatest(F.lit(0.0), last["end_time"] - first["start_time"]).alias("duration"), F.size("s").alias("scene_count"),
        F.transform("s", lambda x: F.struct(x["scene_id"].alias("scene_id"), x["title"].alias("title"), x["time_range"].alias("time_range"))).alias("scenes"),
    )


def entries(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Scenes or chapters as numbered entries: ``key, number, title, start_time, start_formatted, end_time, end_formatted, summary``, and ``scenes`` if there.

    Without a title it is "Scene n", without a summary the title; without an end the start.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    start = F.coalesce(F.col("start_time").cast("double"), F.lit(0.0))
    end = F.coalesce(F.nullif(F.col("end_time").cast("double"), F.lit(0.0)), start)
    named = rows.withColumns({"number": number, "start_time": start, "end_time": end})
    named = named.withColumn("title", F.coalesce(_filled(F.col("title")), F.concat(F.lit("Scene "), F.col("number"))))
    out = [key, "number", "title", "start_time", clock(F.col("start_time")).alias("start_formatted"), "end_time", clock(F.col("end_time")).alias("end_formatted"), F.coalesce(_filled(F.col("summary")), F.col("title")).alias("summary")]
    return named.select(*out, *(["scenes"] if "scenes" in rows.columns else []))


def frame_hits(found: DataFrame, frames: DataFrame, by: str = "query") -> DataFrame:
    """Results of a search among frames as flat rows: ``by, rank, id, frame_number, timestamp, content, score``.

    ``found`` has node_id, combined_score and vector_score; the combined score counts
    unless it is null or 0. A result whose frame is not there stays, with zeros and no content.
    """
    score = F.coalesce(F.nullif(F.col("combined_score").cast("double"), F.lit(0.0)), F.col("vector_score").cast("double"), F.lit(0.0))
    rows = found.select(by, F.col("node_id").alias("id"), score.alias("score")).join(frames.select(F.col("frame_id").alias("id"), "frame_number", "timestamp", "description"), "id", "left")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return rows.select(by, rank.alias("rank"), "id", F.coalesce(F.col("frame_number").cast("long"), F.lit(0)).alias("frame_number"), F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0)).alias("timestamp"), F.coalesce("description", F.lit("")).alias("content"), "score")


def levels_of(paths: DataFrame, nodes: DataFrame, edges: DataFrame, by: str = "query") -> tuple[DataFrame, DataFrame]:
    """Paths of a drill-down with what their nodes are called: a row for each path, and one for each query.

    ``paths`` has an array of nodes, the root first; ``nodes`` node, level, title, summary,
    start_time and end_time; ``edges`` src and dst. A path's row has ``current``, ``path``
    (level, node, title) and ``has_more_levels``, whether anything lies below; a query's row
    has ``levels_traversed``, sorted, and ``total_results``. A node that is not there has
    nothing but its name.
    """
    steps = paths.select(by, F.col("path").alias("_path"), F.posexplode("path").alias("_at", "node")).join(nodes, "node", "left")
    # a path is as long as the hierarchy is deep
    step = F.struct("_at", "level", "node", "title", "summary", "start_time", "end_time")
    whole = steps.groupBy(by, "_path").agg(F.array_sort(F.collect_list(step)).alias("s")).withColumn("node", F.element_at("_path", -1))
    below = edges.select(F.col("src").alias("node"), F.lit(True).alias("_below")).distinct()
    current = F.element_at("s", -1)
    shaped = whole.join(below, "node", "left").select(
        by, current.dropFields("_at").alias("current"), F.transform("s", lambda x: F.struct(x["level"].alias("level"), x["node"].alias("node"), x["title"].alias("title"))).alias("path"), F.coalesce("_below", F.lit(False)).alias("has_more_levels"),
    )
    totals = steps.groupBy(by).agg(F.array_sort(F.collect_set("level")).alias("levels_traversed"), F.countDistinct("_path").alias("total_results"))
    return shaped, totals
