"""Columns and keys that several operators of this package share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Words of the scans: runs of ASCII digits, ASCII lower-case letters and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: All other ASCII characters.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty.

    ``lower`` has a byte loop for plain ASCII and would change other letters, so
    it takes the rows that are all ASCII and ``translate`` the rest.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of ``WORD`` in the lower-cased text; null has none.

    One pass of ``translate`` lower-cases A-Z and blanks what stands between
    words; splitting at a fixed character is several times faster than a pattern.
    """
    blanked = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(blanked, " "), "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``id``, ``text`` and ``fp``, whatever else the input holds.

    ``(id, fp)`` names a text under an id. Rows that repeat both are the same
    document: row-wise results are computed once for the pair and given to each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("fp"))
