"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted by
the whole text and then the id, and a row belongs to the row before it if the two
texts are equal in full; so the first row of a run holds the identifier that stays.
A text with very many copies would still be one range: such texts are found by a
count of digests, and their ranges are split by a slice of the id. Each slice's run
hands on its first row, and these few rows are sorted and compared with their
neighbours in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import lower_ascii
from lumenweave.session import cut

#: Rows of the table of hot texts up to which it is broadcast; beyond, Spark joins by shuffle.
MOST_BROADCAST = 200_000


def _bounded(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side


def _runs(ordered: DataFrame, place: list[str], order: Column, best: str) -> DataFrame:
    """``run`` (its number within a range), ``leads`` (first of its run) and ``keep`` (struct: ``best`` of the first).

    ``ordered`` is range-partitioned by ``place``, which the windows keep: they add
    sorts and no exchange.
    """
    sorted_ = Window.partitionBy(*place).orderBy("norm", order)
    leads = ~F.coalesce(F.col("norm") == F.lag("norm").over(sorted_), F.lit(False))
    so_far = sorted_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ordered.withColumn("leads", leads)
    return marked.withColumns({"run": F.sum(F.col("leads").cast("long")).over(so_far), "keep": F.last(F.when(F.col("leads"), F.struct(best)), ignorenulls=True).over(so_far)})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", slices: int = 64, head: int = 32, hot: int = 1000) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``keep`` says whether the smallest or the largest id of a group stays. A null
    id loses against any other; of rows that repeat the winning id one is kept.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.

    ``head``: characters of the text in a splitter, so that what the driver
    samples doesn't grow with the texts; a digest of the text follows them. A text
    with more than ``hot`` copies is dealt over ``slices`` ranges.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    order = (lambda c: F.col(c).asc_nulls_last()) if keep == "smallest" else (lambda c: F.col(c).desc_nulls_last())
    norm = lower_ascii(F.col(text_col))
    counted = cut(docs.select(F.xxhash64(norm).alias("mix")).groupBy("mix").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("mix"))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumns({"head": F.substring("norm", 1, head), "mix": F.xxhash64("norm")})
    rows = rows.join(_bounded(counted.withColumn("hot", F.lit(True))), "mix", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("slice", F.when(F.col("hot"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(slices))).otherwise(0))

    place = ["head", "mix", "slice"]
    runs = _runs(rows.repartitionByRange(*place), place, order("id"), "id")
    # the size of a run is counted without its texts; only the first row of a hot slice brings its text along
    runs = runs.select("id", *place, "run", "hot", "leads", "keep.id", F.sha2("norm", 256).alias("sha"), F.when(F.col("hot") & F.col("leads"), F.col("norm")).alias("norm")).toDF("id", *place, "run", "hot", "leads", "keep_id", "sha", "norm")
    runs = cut(runs.withColumn("n", F.count("*").over(Window.partitionBy(*place, "run"))))

    # side by side: at most ``slices`` rows for each hot text
    first = runs.where("hot AND leads").select("norm", *place, F.col("run").alias("of"), "n", "keep_id")
    met = _runs(first.repartitionByRange("head", "mix"), ["head", "mix"], order("keep_id"), "keep_id")
    texts = met.select("head", "mix", "slice", "of", F.col("leads").alias("top"), F.col("keep.keep_id").alias("best"), F.sum("n").over(Window.partitionBy("head", "mix", "run")).alias("total"))
    texts = cut(texts.withColumnsRenamed({"head": "head2", "mix": "mix2", "slice": "slice2"}))
    same = (F.col("head") == F.col("head2")) & (F.col("mix") == F.col("mix2")) & (F.col("slice") == F.col("slice2")) & (F.col("run") == F.col("of"))
    calm = runs.where("NOT hot").select("id", "keep_id", F.col("n").alias("group_size"), F.col("leads").alias("kept"), "sha")
    many = runs.where("hot").join(_bounded(texts), same).select("id", F.col("best").alias("keep_id"), F.col("total").alias("group_size"), (F.col("leads") & F.col("top")).alias("kept"), "sha")
    out = calm.unionByName(many)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
