"""The corpus pipeline: documents in, token shards out.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.decontaminate import decontaminate
from lumenweave.llm.language_id import UNKNOWN, fit, floors, predict
from lumenweave.llm.mixing import mix
from lumenweave.llm.near_dedup import near_dedup
from lumenweave.llm.token_shards import read_token_shards, write_token_shards
from lumenweave.session import cut, new_path, table, written

#: A text whose language is less certain than this is rejected, and one without letters.
LEAST_CERTAIN = 0.5
#: A text is also rejected whose letters cost so many nats more than the dearest text allowed in its language would at that length.
#: The cost adds up over the text: a few odd words never reach it, lines of random letters do.
MOST_UNLIKE = 100.0
#: A text goes if this share of its words stands in benchmark passages.
MOST_HIT = 0.0


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as ``row``, their id as ``i`` and the hash of their text as ``h``: (i, h) names a text under an id."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _of(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``keep`` (doc_id, text_hash); a null id matches a null id."""
    named = keep.select(F.col("doc_id").alias("ki"), F.col("text_hash").alias("kh")).distinct()
    return _keyed(docs).join(named, F.col("i").eqNullSafe(F.col("ki")) & (F.col("h") == F.col("kh")), "left_semi").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, of no certain language or unlike any learned one; ``lang`` becomes what was predicted."""
    model = fit(docs, texts_per_language=None)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    told = written(predict(rows, model, "row", "text", (), ("told", "certain", "fits")))
    least = floors(told.select(F.col("row.lang").alias("lang"), "told", "fits"))
    floor = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("told")] if least else F.lit(None)
    unlike = F.coalesce((floor - F.col("fits")) * F.octet_length("row.text") > MOST_UNLIKE, F.lit(False))
    kept = told.where((F.col("told") != UNKNOWN) & (F.col("certain") >= LEAST_CERTAIN) & ~unlike)
    return kept.select(*[F.col("told").alias("lang") if c == "lang" else F.col(f"row.{c}") for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Without an id in the group it is the one of the smallest text hash. Texts without
    a word stand alone. Of rows that repeat an id and a text one stays.
    """
    found = cut(near_dedup(docs, words=5, percent=80))
    one = F.struct("doc_id", "text_hash")
    best = found.where("group IS NOT NULL").groupBy("group").agg(F.min_by(one, F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one"))
    keep = best.select("one.*").unionByName(found.where("group IS NULL").select("doc_id", "text_hash"))
    stays = _of(docs, keep)
    repeated = cut(found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    if repeated.isEmpty():
        return stays
    again = repeated.select(F.col("doc_id").alias("ri"), F.col("text_hash").alias("rh"))
    same = F.col("i").eqNullSafe(F.col("ri")) & (F.col("h") == F.col("rh"))
    rows = _keyed(stays)
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["i", "h"])).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage of ten words go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _of(docs, found.where(F.col("n_hit") <= MOST_HIT * F.col("n_words")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mix(docs)


def _placed(docs: DataFrame) -> DataFrame:
    """Where the table ``docs`` holds its rows: ``_id, _nth, _file, _row``; rows of one id are numbered by text, as they stand in the shards.

    Only texts whose id is repeated are looked at: of all others none moves.
    """
    place = F.col("doc_id").alias("_id"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    repeated = cut(docs.groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"))
    alone = docs.select(*place)
    if not repeated.isEmpty():
        same = F.col("_id").eqNullSafe(F.col("_again"))
        again = docs.select(*place, F.coalesce("text", F.lit("")).alias("_text")).join(repeated, same, "left_semi")
        again = again.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("_text"))).select("_id", "_nth", "_file", "_row")
        return alone.join(repeated, same, "left_anti").select("_id", F.lit(1).alias("_nth"), "_file", "_row").unionByName(again)
    return alone.select("_id", F.lit(1).alias("_nth"), "_file", "_row")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, as read back from the files.

    The shards are in order of the ids, for lookups; ``mix_start`` counts the ids
    before a document in the order in which the table ``docs`` holds its rows, which
    is the mix: a reader that follows it gets the sources on target.
    """
    shards = read_token_shards(spark, write_token_shards(docs, new_path(spark, "corpus")))
    placed = _placed(docs)
    nth = shards.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))
    both = cut(nth.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_nth"))))
    # a row for each file in one window, then each file for itself
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = both.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"))
    files = files.select(F.col("_file"), F.coalesce(F.sum("_sum").over(before(Window.orderBy("_file"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("_file").orderBy("_row"))), F.lit(0))
    return both.withColumn("_in", within).join(files, "_file").select(*shards.columns, (F.col("_base") + F.col("_in")).alias("mix_start"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID output", token_output),
]
#: SQL expresses neither the language model nor the tokenizer: tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
