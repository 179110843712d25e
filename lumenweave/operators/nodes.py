"""Nodes and relationships of the graph, created in batches with their properties.

A batch is a DataFrame. A node is created if its video is there, and gets the video's
user where it names none; a relationship is created if both of its ends are there.
Whoever repeats a batch creates nothing twice: what has its id already is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.tables import add, read, version

# What nodes of each label have besides id, video_id, user_id and created_at.
PROPERTIES = {
    "Frame": "timestamp double, frame_number long, description string, perceptual_hash string, is_keyframe boolean",
    "AudioSegment": "start_time double, end_time double, text string, speaker string, confidence double",
    "Chapter": "start_time double, end_time double, chapter_index long, title string, summary string, topics array<string>",
    "Scene": "chapter_id string, start_time double, end_time double, scene_index long, description string",
    "Community": "community_id long, title string, summary string, themes array<string>, themes_text string, member_entity_ids array<string>, member_count long, time_span_start double, time_span_end double, level int",
}


def schema_of(label: str) -> str:
    return f"id string, video_id string, user_id string, {PROPERTIES[label]}, created_at timestamp"


def node_rows(rows: DataFrame, videos: DataFrame, label: str, created: Column) -> DataFrame:
    """The nodes of a batch under their label's schema.

    ``videos`` has video_id and user_id. Columns that a row lacks are null, others are
    left out; a null ``created_at`` is ``created``. Of rows with one id, one is taken;
    rows without an id or of an unknown video are not created.
    """
    if label == "Community" and "themes" in rows.columns:
        rows = rows.withColumn("themes_text", F.coalesce(F.array_join("themes", ", "), F.lit("")))
    empty = rows.sparkSession.createDataFrame([], schema_of(label))
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
    owners = videos.select(F.col("video_id").cast("string").alias("_video"), F.col("user_id").cast("string").alias("_user")).where("_video IS NOT NULL").dropDuplicates(["_video"])
    held = rows.select(*cast).where("id IS NOT NULL").dropDuplicates(["id"]).join(owners, F.col("video_id") == F.col("_video"))
    return held.withColumns({"user_id": F.coalesce("user_id", "_user"), "created_at": F.coalesce("created_at", created)}).select(*empty.columns)


def relationship_rows(rels: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``src, dst, rel_type`` of the relationships whose ends are both in ``nodes`` (id), each once."""
    ids = nodes.select(F.col("id").cast("string").alias("_id")).distinct()
    found = rels.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    for end in ("src", "dst"):
        found = found.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return found.withColumn("rel_type", F.lit(kind))


def _add_new(new: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the rows whose keys are not in the table, which is made if there is none; another writer meanwhile is a Conflict."""
    spark = new.sparkSession
    if not version(spark, path):
        add(new.where(F.lit(False)), path)
    since = version(spark, path)
    add(new.join(read(spark, path).select(*keys), keys, "left_anti").select(*new.columns), path, since)


def create_nodes(rows: DataFrame, videos: DataFrame, label: str, nodes: str, edges: str | None = None, created: Column | None = None, kind: str = "CONTAINS") -> None:
    """Adds a batch of nodes to the table at ``nodes`` and, with ``edges``, what leads to each from its video to that one.

    The two writes are not one: a batch that was lost in between is simply repeated.
    """
    new = node_rows(rows, videos, label, F.current_timestamp() if created is None else created)
    _add_new(new, nodes, ["id"])
    if edges is not None:
        _add_new(new.select(F.col("video_id").alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("rel_type")), edges, ["src", "dst", "rel_type"])


def create_relationships(rels: DataFrame, nodes: DataFrame, edges: str, kind: str) -> None:
    """Adds the relationships of a batch that are not there yet."""
    _add_new(relationship_rows(rels, nodes, kind), edges, ["src", "dst", "rel_type"])
