"""The engine's data model on the driver's tables: timelines, segments, a containment tree, entities, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.session import table

#: Each view in DuckDB's SQL.
SQL = {
    "frames": "SELECT user_id AS video_id, event_id AS frame_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS ts_ms, event_type AS kind, value AS score, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "segments": "SELECT conv_id AS video_id, turn AS idx, turn * 10000 AS start_ms, turn * 10000 + 8000 AS end_ms, role AS speaker, text FROM conversations",
    "contains_": "SELECT DISTINCT l_orderkey AS frame_id, l_partkey AS entity_id FROM lineitem",
    "entities": "SELECT p_partkey AS entity_id, p_name AS name, p_type AS type, p_brand AS brand FROM part",
    "vectors": "SELECT vec_id AS node_id, label AS video_id, embedding AS v FROM embeddings",
}


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as the frames of a video; time in ms from the first."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), us.alias("us"), F.col("event_type").alias("kind"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    # under its new name before the window, so that later windows find the rows already dealt out by it
    ms = F.floor((F.col("us") - F.min("us").over(Window.partitionBy("video_id"))) / 1000).cast("long")
    return e.select("video_id", "frame_id", ms.alias("ts_ms"), "kind", "score", "k")


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), (F.col("turn") * 10000).alias("start_ms"), (F.col("turn") * 10000 + 8000).alias("end_ms"), F.col("role").alias("speaker"), "text")


def contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("entity_id")).distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("video_id"), F.col("embedding").alias("v"))


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
