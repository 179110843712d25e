"""Scores of answers: citations of time, grounding in a window, and multiple choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.scalar import seconds_of

CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
# Words that refer to a time without naming one.
SOFT = ["beginning", "middle", "end", "opening", "closing", "earlier", "later", "after", "before"]
CITATION = "struct<kind: string, seconds: double, frame: int, raw: string>"


def citations(text: Column) -> Column:
    """What an answer cites, kind by kind: ``[m:ss]``, ``(m:ss)``, a bare ``m:ss`` outside of both, ``frame N``, ``t=Ns`` and ``at N s``.

    Structs of kind (timestamp or frame), seconds, frame and the raw text; hours may stand before minutes.
    """
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    one = lambda raw, seconds, frame: F.struct(F.when(frame.isNull(), "timestamp").otherwise("frame").alias("kind"), seconds.alias("seconds"), frame.alias("frame"), raw.alias("raw")).cast(CITATION)
    clock = lambda raw: one(raw, seconds_of(F.regexp_replace(raw, r"[^\d:]", "")), F.lit(None).cast("int"))
    plain = lambda raw: one(raw, F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).cast("double"), F.lit(None).cast("int"))
    frame = lambda raw: one(raw, F.lit(None).cast("double"), F.regexp_extract(raw, r"(\d+)", 1).cast("int"))
    marked = rf"\[\s*{CLOCK}\s*\]|\(\s*{CLOCK}\s*\)"
    return F.coalesce(
        F.concat(
            F.transform(found(text, rf"\[\s*{CLOCK}\s*\]"), clock), F.transform(found(text, rf"\(\s*{CLOCK}\s*\)"), clock),
            F.transform(found(F.regexp_replace(text, marked, " "), rf"(?<![\d.]){CLOCK}(?!\d)"), clock),
            F.transform(found(text, r"(?i)\bframe\s*#?\s*\d{1,7}\b"), frame), F.transform(found(text, r"(?i)\bt\s*=\s*\d+(?:\.\d+)?\s*s\b"), plain),
            F.transform(found(text, r"(?i)\bat\s+\d+(?:\.\d+)?\s*(?:s|sec|secs|seconds?)\b"), plain),
        ),
        F.array().cast(f"array<{CITATION}>"),
    )


def in_window(citation: Column, lo: Column, hi: Column, fps: Column) -> Column:
    """Whether a citation falls between two times; a frame only counts if the frame rate is known."""
    at = F.when(citation["kind"] == "timestamp", citation["seconds"]).when(fps > 0, citation["frame"] / fps)
    return F.coalesce(at.between(lo, hi), F.lit(False))


def fraction_in_window(cited: Column, lo: Column, hi: Column, fps: Column) -> Column:
    """Of the citations, the share within the window; 0 without any."""
    inside = F.size(F.filter(cited, lambda c: in_window(c, lo, hi, fps)))
    return F.when(F.size(cited) > 0, inside / F.size(cited)).otherwise(0.0)


def soft_reference(text: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(text), F.lit(rf"\b({'|'.join(SOFT)})\b")), F.lit(False))


def choice(text: Column) -> Column:
    """The first letter A to D that stands alone; null if none does."""
    return F.nullif(F.regexp_extract(F.trim(text), r"\b([A-D])\b", 1), F.lit(""))


def grounding(n_in: Column, n: Column, soft: Column) -> Column:
    return F.when(n_in > 0, 1.0).when((n > 0) | soft, 0.5).otherwise(0.0)


def bucket_accuracy(rows: DataFrame, bucket: str, score: str) -> DataFrame:
    """``bucket, n, accuracy``: the mean score of each bucket, over the rows that have one."""
    return rows.where(F.col(score).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n"), F.avg(score).alias("accuracy"))
