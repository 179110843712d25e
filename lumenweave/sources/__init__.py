"""Readers that look at what they are given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, wrapper: tuple[str, ...] = ("questions", "rows", "videos")) -> DataFrame:
    """A table from Parquet, CSV, JSON lines, or JSON that is a list or an object around one; by the path's suffix."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        df = spark.read.json(path, multiLine=True)
        for name in wrapper:
            if name in df.columns and dict(df.dtypes)[name].startswith("array<struct"):
                return df.select(F.inline(name))
        return df
    raise ValueError(f"no reader for .{kind}")


def first_of(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Each column as the first of its aliases that is there and not null."""
    lower = {c.lower(): c for c in df.columns}
    return df.select(*[F.coalesce(*[F.col(f"`{lower[a.lower()]}`") for a in aliases if a.lower() in lower] or [F.lit(None).cast("string")]).alias(n) for n, aliases in names.items()])


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, kind`` of files: parquet, html, json, text or binary, by their first bytes. Spark doesn't list empty files."""
    files = spark.read.format("binaryFile").load(path)
    head = F.lower(F.ltrim(F.decode(F.substring("content", 1, 64), "ISO-8859-1")))
    kind = F.when(F.substring("content", 1, 4) == F.lit(b"PAR1"), "parquet").when(head.rlike("^(<!doctype|<html)"), "html").when(head.rlike(r"^[\[{]"), "json").when(F.contains(head, F.lit("\x00")), "binary").otherwise("text")
    return files.select("path", "length", kind.alias("kind"))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` of one file; an error if there is none."""
    one = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").limit(1)
    if one.isEmpty():
        raise FileNotFoundError(path)
    return one


def ordered_rows(df: DataFrame, key: dict, order: list[str], needed: str | None = None) -> DataFrame:
    """The rows whose columns are as in ``key``, in order; none is an error if a step that makes them is ``needed`` first."""
    found = df.where(F.lit(True) if not key else reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(x)) for c, x in key.items()]))
    if needed and found.isEmpty():
        raise LookupError(f"no rows for {', '.join(f'{c}={x}' for c, x in key.items())}; run {needed} first")
    return found.orderBy(*order)
