"""Queries that run as streams over the tables, until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.plans.registry import query
from lumenweave.session import new_path, table
from lumenweave.streaming import stages as S

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("""WITH e AS (SELECT user_id AS media_id, 'd' || event_id % 3 AS dispatch_id, event_type AS stage, CASE WHEN event_type = 'signup' THEN 'dispatched' WHEN (props->>'$.k')::BIGINT % 4 = 0 THEN 'completed' WHEN (props->>'$.k')::BIGINT % 4 = 1 THEN 'failed' ELSE 'running' END AS status, ts AS t, event_id FROM events),
c AS (SELECT media_id, dispatch_id FROM e WHERE status = 'dispatched' QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY t DESC, event_id DESC) = 1)
SELECT media_id, dispatch_id, stage, status AS state, event_id FROM e JOIN c USING (media_id, dispatch_id) WHERE status <> 'dispatched' QUALIFY row_number() OVER (PARTITION BY media_id, stage ORDER BY status <> 'running' DESC, t DESC, event_id DESC) = 1""")
def streamed_stages(spark, d):
    """Every event as one of a stage, in two parts of which the later comes first: the changes that the stream hands on, and where they lead."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "signup", "dispatched").when(k % 4 == 0, "completed").when(k % 4 == 1, "failed").otherwise("running")
    e = table(spark, d, "events").select(F.col("user_id").alias("media_id"), F.concat(F.lit("d"), F.col("event_id") % 3).alias("dispatch_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    source, log = new_path(spark, "events"), new_path(spark, "changes")
    for odd in (1, 0):
        e.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(source)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(log)
        stream = spark.readStream.schema(e.schema).parquet(source)
        S.stage_stream(stream, 10**12, "100 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return S.latest_changes(spark.read.parquet(log)).drop("at")
