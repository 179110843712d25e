"""Tables in folders: events, outboxes and quarantine are added to; keyed rows are changed, consumed and deleted in a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators.tables import add, merge, read, replace, version

#: What every event and outbox row has; anything else of it is in its JSON columns.
EVENT = "event_id string, media_id long, stage string, status string, message string, details string, event_time timestamp"
OUTBOX = "outbox_id string, media_id long, status string, progress double, message string, processing_result string, error string, emitted_at timestamp, consumed_at timestamp"
QUARANTINE = "quarantine_id string, media_id long, stage string, reason string, error_type string, details string, created_at timestamp"


def append(rows: DataFrame, path: str, schema: str) -> None:
    """Adds rows to a table, under its schema: columns that a row lacks are null, others are left out."""
    empty = rows.sparkSession.createDataFrame([], schema)
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
    add(rows.select(*cast), path)


def quarantine(rows: DataFrame, ok: Column, path: str, reason: Column, key: str) -> DataFrame:
    """The rows that pass; the others are appended to the quarantine with a reason."""
    good = F.coalesce(ok, F.lit(False))
    bad = rows.where(~good).select(F.sha2(F.col(key).cast("string"), 256).alias("quarantine_id"), F.col(key).cast("long").alias("media_id"), F.lit("validate").alias("stage"), reason.alias("reason"), F.lit("ValueError").alias("error_type"), F.to_json(F.struct(key)).alias("details"), F.lit(None).cast("timestamp").alias("created_at"))
    append(bad, path, QUARANTINE)
    return rows.where(good)


def change(spark: SparkSession, path: str, where: Column, columns: dict[str, Column]) -> None:
    """Sets columns of the rows that match."""
    since, df = version(spark, path), read(spark, path)
    hit = F.coalesce(where, F.lit(False))
    replace(df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(dict(df.dtypes)[c]) for c, v in columns.items()}), path, since)


def mark_consumed(spark: SparkSession, path: str, ids: DataFrame, at: Column, key: str = "outbox_id") -> None:
    """Sets ``consumed_at`` of the rows with these ids that aren't consumed yet."""
    since, df = version(spark, path), read(spark, path)
    named = ids.select(F.col(key).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    held = df.join(named, F.col(key) == F.col("_id"), "left")
    replace(held.withColumn("consumed_at", F.when(F.col("_hit") & F.col("consumed_at").isNull(), at).otherwise(F.col("consumed_at"))).select(*df.columns), path, since)


def delete(spark: SparkSession, path: str, where: Column) -> int:
    """Deletes the rows that match and says how many these were."""
    since, df = version(spark, path), read(spark, path)
    keep = ~F.coalesce(where, F.lit(False))
    n = df.where(~keep).count()
    if n:
        replace(df.where(keep), path, since)
    return n


def upsert(rows: DataFrame, path: str, keys: list[str], fixed: tuple[str, ...] = ("created_at",)) -> None:
    """Merges rows into a table by key: only the columns that they have change."""
    spark = rows.sparkSession
    since = version(spark, path)
    replace(merge(read(spark, path), rows, keys, fixed), path, since)


def rebuild(rows: DataFrame, path: str, key: str) -> None:
    """Replaces all rows of the keys that ``rows`` has: the same again if it is run again."""
    spark = rows.sparkSession
    since, old = version(spark, path), read(spark, path)
    replace(old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows), path, since)


def delete_video(spark: SparkSession, nodes: str, edges: str, video: Column, node: str = "node") -> int:
    """Deletes a video's nodes and every edge that touches one; returns how many nodes there were."""
    since, n = version(spark, edges), read(spark, nodes)
    gone = n.where(video).select(F.col(node).alias("_n")).distinct()
    e = read(spark, edges)
    for end in ("src", "dst"):
        e = e.join(gone, F.col(end) == F.col("_n"), "left_anti")
    replace(e, edges, since)
    return delete(spark, nodes, video)


def manifest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``n, dataset_hash``: a hash of all rows that doesn't depend on their order, from a hash of each.

    The rows' hashes are added up by four parts of 64 bits, so that none gathers anywhere.
    """
    one = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)"))
    return rows.select(key, one.alias("_h")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *[part(i).cast("string") for i in range(4)]), 256).alias("dataset_hash"))


def export_json(rows: DataFrame, path: str, name: str | None = None, evaluators: list[str] | None = None) -> None:
    """JSON lines in a folder; with a name, each line is wrapped with it and the evaluators."""
    if name is not None:
        rows = rows.select(F.lit(name).alias("name"), F.array(*map(F.lit, evaluators or [])).cast("array<string>").alias("evaluators"), F.struct(*rows.columns).alias("data"))
    rows.write.mode("overwrite").json(path)


def with_coarse(vectors: DataFrame, v: str = "v", n: int = 16) -> DataFrame:
    """Vectors with the prefix that a first pass of a search compares."""
    return vectors.withColumn("coarse", F.slice(v, 1, n))
