"""Keyed tables: upserts, outbox and status, quality gates, and the analytics of a pipeline's operation."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge(target: DataFrame, updates: DataFrame, keys: list[str], fixed: tuple[str, ...] = ("created_at", "started_at")) -> DataFrame:
    """Matching rows take every column of the update but the ``fixed`` ones; the other updates are inserted.

    Null keys match null keys. Of updates with the same key one is used, the largest.
    """
    whole = F.struct(*[F.col(c) for c in updates.columns])
    updates = updates.groupBy(*keys).agg(F.max(whole).alias("_u")).select("_u.*")
    u = updates.select(*[F.col(c).alias(f"u_{c}") for c in updates.columns], F.lit(True).alias("u_"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in keys])
    take = lambda c: F.when(F.col("u_").isNull() | (F.col("t_").isNotNull() & F.lit(c in fixed)), F.col(c)).otherwise(F.col(f"u_{c}")) if c in updates.columns else F.col(c)
    return target.withColumn("t_", F.lit(True)).join(u, on, "full_outer").select(*[take(c).alias(c) for c in target.columns])


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The number of the table's last version; 0 if it is a plain folder of Parquet files, or isn't there."""
    jvm, at, fs = _files(spark, f"{path}/_versions")
    return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=0) if fs.exists(at) else 0


def _folders(spark: SparkSession, path: str, number: int) -> list[str]:
    return [f"{path}/{r.value}" for r in spark.read.text(f"{path}/_versions/{number}").collect()] if number else [path]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's last version. Later writes don't change what was read."""
    return spark.read.parquet(*_folders(spark, path, version(spark, path)))


def _commit(spark: SparkSession, path: str, number: int, folders: list[str], keep: int = 2) -> None:
    """Names the folders of version ``number`` in a file that must not exist yet: that one step makes them the table."""
    jvm, at, fs = _files(spark, f"{path}/_versions/{number}")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if fs.exists(at):
            raise Conflict(f"{path} has a version {number} already") from e
        raise
    try:
        out.write(bytearray("\n".join(folders).encode()))
    finally:
        out.close()
    # what only the version before the last ``keep`` named; a folder that was never named, by a writer that failed or still writes, is left alone
    names = lambda n: {f.removeprefix(f"{path}/") for f in _folders(spark, path, n)} if n > 0 else set()
    for name in names(number - keep) - set().union(*(names(n) for n in range(number - keep + 1, number + 1))):
        fs.delete(jvm.Path(f"{path}/{name}"), True)


def replace(df: DataFrame, path: str, since: int | None = None) -> None:
    """Makes ``df`` the table, from which it may itself be read.

    Written into a folder of its own first; then one small file, which only one
    writer can create, switches to it. Whatever fails before leaves the table as it
    was. ``since``: the version that ``df`` was made from, by default the last one
    when this begins; if there is a later one then, :class:`Conflict` is raised and
    the later one stays.
    """
    spark = df.sparkSession
    number = (version(spark, path) if since is None else since) + 1
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    _commit(spark, path, number, [name])


def add(df: DataFrame, path: str, since: int | None = None) -> None:
    """Adds rows: a folder more in the next version. Tried again if another writer was first, as rows that are added don't depend on others.

    ``since``: the version that they do depend on; :class:`Conflict` is raised if there is a later one.
    """
    spark = df.sparkSession
    _, at, fs = _files(spark, path)
    if not version(spark, path) and fs.exists(at) and len(fs.listStatus(at)):
        replace(spark.read.parquet(path), path)  # a plain folder becomes a version
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    for _ in range(100):
        number = version(spark, path) + 1
        if since is not None and number > since + 1:
            break
        before = [f.removeprefix(f"{path}/") for f in _folders(spark, path, number - 1)] if number > 1 else []
        try:
            return _commit(spark, path, number, [*before, name])
        except Conflict:
            continue
    raise Conflict(f"{path}: another writer was first")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_applied(intents: DataFrame, existing: DataFrame, key: str = "upsert_id", payload: str = "properties_json") -> DataFrame:
    """New intents are pending; one that is applied with the same payload stays applied."""
    old = existing.select(F.col(key), F.col(payload).alias("_old"), F.col("status").alias("_status"))
    status = F.when((F.col("_status") == "applied") & F.col("_old").eqNullSafe(F.col(payload)), "applied").otherwise("pending")
    return intents.join(old, key, "left").withColumn("status", status).drop("_old", "_status")


def split_by_gates(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``rows`` with ``failed_gates``, the names of those that don't hold; null is a failure."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()])
    return rows.withColumn("failed_gates", F.array_compact(failed))


def unconsumed(outbox: DataFrame, n: int, at: str = "emitted_at", key: str = "outbox_id") -> DataFrame:
    return outbox.where("consumed_at IS NULL").orderBy(at, key).limit(n)


def project_status(control: DataFrame, events: DataFrame, key: str = "media_id") -> DataFrame:
    """The latest event of each key put onto its control row; an event of another dispatch is rejected."""
    last = latest(events.join(control.select(key, "dispatch_id"), [key, "dispatch_id"], "left_semi"), [key], [F.desc("emitted_at"), F.desc("outbox_id")])
    e = last.select(key, F.col("status").alias("_s"), F.col("progress").alias("_p"))
    status = F.when(F.col("_s").isin("completed", "failed"), F.col("_s")).when(F.col("_s").isNotNull(), "running").otherwise(F.col("status"))
    progress = F.when(F.col("_s") == "completed", 1.0).otherwise(F.coalesce("_p", "progress"))
    done = F.when(F.col("_s").isin("completed", "failed"), F.col("_s") == "completed").otherwise(F.col("processed"))
    return control.join(e, key, "left").withColumns({"status": status, "progress": progress, "processed": done}).drop("_s", "_p")


def by_digest(key: str, seed: int) -> Column:
    """An order that has nothing to do with the key and is the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(rows: DataFrame, bucket: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, round after round one of each bucket, in an order by digest."""
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(by_digest(key, seed), key))
    return rows.withColumn("_n", rn).where(F.col("_n") <= n).orderBy("_n", bucket).limit(n).drop("_n")


def equal_quotas(rows: DataFrame, bucket: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` divided by the number of buckets, at least one, of each bucket, ``n`` in all at most; all rows if there are no more than ``n``."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_size"))
    quota = sizes.agg(F.when(F.coalesce(F.sum("_size"), F.lit(0)) <= n, F.lit(1 << 62)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count("*")))).alias("_quota"))
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(by_digest(key, seed), key))
    some = rows.withColumn("_n", rn).crossJoin(F.broadcast(quota)).where(F.col("_n") <= F.col("_quota"))  # one row
    return some.orderBy(by_digest(key, seed), key).limit(n).drop("_n", "_quota")


def regressions(runs: DataFrame, key: str, order: str, value: str, last: int = 7, drop: float = 0.03) -> DataFrame:
    """``baseline``: the median of the ``last`` runs before; ``regressed`` if the value is more than ``drop`` below."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-last, -1)
    return runs.withColumn("baseline", F.percentile(value, F.lit(0.5)).over(w)).withColumn("regressed", F.coalesce(F.col(value) < F.col("baseline") - drop, F.lit(False)))


def hash_distinct(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first row of each content, by SHA-256."""
    return latest(rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)), ["sha256"], [F.col(c) for c in order])
