"""The stages as a stream: any order, repeats, restarts and silence lead to what the finished table says."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lumenweave.session import new_path
from lumenweave.streaming import stages as S

DAY = datetime.datetime(2024, 5, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def events(seed):
    rng = random.Random(seed)
    out, n = [], 0
    for media in range(6):
        for dispatch in range(rng.randrange(1, 4)):
            start = rng.randrange(0, 3000)
            out.append((media, f"d{dispatch}", None, "dispatched", DAY + datetime.timedelta(seconds=start), n := n + 1))
            for stage in ("audio", "frames", "scenes"):
                for _ in range(rng.randrange(0, 3)):
                    out.append((media, f"d{dispatch}", stage, "running", DAY + datetime.timedelta(seconds=start + rng.randrange(500)), n := n + 1))
                if rng.random() < 0.6:
                    out.append((media, f"d{dispatch}", stage, rng.choice(S.TERMINAL), DAY + datetime.timedelta(seconds=start + rng.randrange(500)), n := n + 1))
    return out


def drained(spark, source, checkpoint, log, late="10 days", silent=10**12):
    """All that is new in the source, through the stream; changes are added to the log."""
    stream = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(log)
    S.stage_stream(stream, silent, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rows(df):
    return sorted((r.media_id, r.dispatch_id, r.stage, r.state, r.event_id) for r in df.collect())


def test_a_stream_in_any_order_with_repeats_and_a_restart(rocks):
    all_ = events(1)
    rng = random.Random(2)
    sent = [*all_, *rng.sample(all_, len(all_) // 2)]
    rng.shuffle(sent)
    source, checkpoint, log = (new_path(rocks, x) for x in ("events", "checkpoint", "log"))
    third = len(sent) // 3
    for part in (sent[:third], sent[third : 2 * third]):
        rocks.createDataFrame(part, S.EVENT).coalesce(1).write.mode("append").parquet(source)
    drained(rocks, source, checkpoint, log)
    rocks.createDataFrame(sent[2 * third :], S.EVENT).coalesce(1).write.mode("append").parquet(source)
    drained(rocks, source, checkpoint, log)  # another query goes on from the checkpoint
    want = S.stage_table(rocks.createDataFrame(all_, S.EVENT))
    assert rows(S.latest_changes(rocks.read.parquet(log))) == rows(want)


def test_a_stage_of_which_nothing_is_heard_is_stalled(rocks):
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    first = [(1, "d", None, "dispatched", at(0), 1), (1, "d", "audio", "running", at(1), 2), (1, "d", "frames", "running", at(2), 3), (1, "d", "frames", "completed", at(5), 4), (1, "old", "scenes", "running", at(3), 5)]
    source, checkpoint, log = (new_path(rocks, x) for x in ("events", "checkpoint", "log"))
    for part in (first, [(2, "e", None, "dispatched", at(4000), 6)], [(2, "e", "audio", "running", at(4001), 7)]):
        rocks.createDataFrame(part, S.EVENT).coalesce(1).write.mode("append").parquet(source)
        drained(rocks, source, checkpoint, log, late="1 second", silent=60_000)
    got = rows(S.latest_changes(rocks.read.parquet(log)))
    assert got == [(1, "d", "audio", "stalled", 2), (1, "d", "frames", "completed", 4), (2, "e", "audio", "running", 7)]
    table = rocks.createDataFrame([*first, (2, "e", None, "dispatched", at(4000), 6), (2, "e", "audio", "running", at(4001), 7)], S.EVENT)
    assert rows(S.stage_table(table, 60_000, "2024-05-01 01:06:41")) == got


def test_a_later_dispatch_takes_over_and_terminal_states_stay(spark):
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    e = [(1, "a", None, "dispatched", at(0), 1), (1, "a", "audio", "failed", at(1), 2), (1, "a", "audio", "running", at(9), 3), (1, "b", None, "dispatched", at(2), 4), (1, "b", "audio", "running", at(3), 5), (2, "a", "audio", "completed", at(1), 6)]
    table = spark.createDataFrame(e, S.EVENT)
    assert rows(S.stage_table(table)) == [(1, "b", "audio", "running", 5)]
    assert rows(S.stage_table(table.where("dispatch_id = 'a'"))) == [(1, "a", "audio", "failed", 2)]
