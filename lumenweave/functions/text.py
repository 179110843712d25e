"""Text columns: cutting, cleaning, normalising and comparing. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types and their aliases, relation types, stop words, hints of detail, phrases for empty pictures.
ENTITY_TYPES = ["person", "object", "location", "action", "event", "text", "brand", "concept"]
ENTITY_ALIASES = {
    "concept": ["lighting", "emotion", "weather", "time", "color", "sound", "music", "abstract", "expression", "symbol"],
    "object": ["animal", "vehicle", "thing", "product", "food", "clothing", "furniture", "technology"],
    "location": ["place", "scene", "setting", "nature"],
    "action": ["activity", "gesture", "movement"],
    "brand": ["organization", "logo", "company"],
    "person": ["group", "crowd"],
}
RELATION_ALIASES = {"RELATES_TO": ["NEAR", "ON"], "CONTAINS": ["INSIDE", "PART_OF", "HAS"], "INTERACTS_WITH": ["USES", "HOLDS", "WEARS"]}
RELATION_TYPES = ["CONTAINS", "RELATES_TO", "SIMILAR_TO", "CAUSES", "CAUSED_BY", "INTERACTS_WITH", "APPEARS_WITH", "MENTIONED_IN"]
STOP_WORDS = ["the", "and", "for", "with", "this", "that", "what", "when", "where", "which", "who", "how", "about", "video", "scene", "please"]
DETAIL_HINTS = ["exact", "specific", "detail", "timestamp", "timecode", "quote", "verbatim", "full", "complete", "all results", "evidence"]
INVALID_CONTENT = ["black screen", "completely black", "no visible", "no information", "imagen negra", "completamente negra", "no contiene elementos", "no hay información"]
TOPIC_STOP_WORDS = ["the", "this", "that", "there", "here", "where", "what", "which", "when", "image", "video", "frame"]
LUCENE_SPECIAL = r'([+\-&|!(){}\[\]^"~*?:\\/])'


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, n: int) -> Column:
    """White space collapsed; over ``n`` characters cut and ended by three dots. Null if empty."""
    c = collapse(text)
    return F.when(F.length(c) == 0, None).when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("...")))


def truncate_with_notice(text: Column, n: int) -> Column:
    over = F.length(text) - n
    return F.when(over <= 0, text).otherwise(F.concat(F.substring(text, 1, n), F.lit(" […"), over.cast("string"), F.lit(" chars omitted]")))


def first_sentence(text: Column, fallback: str, n: int = 100) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split_part(truncate(text, n), F.lit("."), F.lit(1))), F.lit("")), F.lit(fallback))


def entity_name(name: Column) -> Column:
    """The canonical name: lower case, single spaces, a fixed set of letters; 'unknown' if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(collapse(F.lower(name)), "[^a-z0-9áéíóúüñ _.-]", "")), F.lit("")), F.lit("unknown"))


def graph_name(name: Column) -> Column:
    """The other spelling in use: spaces become underscores."""
    return F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("_"))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def entity_type(raw: Column) -> Column:
    table = {t: t for t in ENTITY_TYPES} | {a: t for t, aliases in ENTITY_ALIASES.items() for a in aliases}
    return _lookup(F.lower(F.trim(raw)), table, "concept")


def relation_type(raw: Column) -> Column:
    table = {t: t for t in RELATION_TYPES} | {a: t for t, aliases in RELATION_ALIASES.items() for a in aliases}
    return _lookup(F.upper(F.trim(raw)), table, "RELATES_TO")


def escape_fulltext(query: Column, n: int = 1000) -> Column:
    return F.regexp_replace(F.nullif(F.substring(F.trim(query), 1, n), F.lit("")), LUCENE_SPECIAL, r"\\$1")


def clean_generated(text: Column, prefixes: list[str]) -> Column:
    """Without list marker, bold marks and line breaks; then without each of the prefixes, in order."""
    c = F.regexp_replace(F.trim(text), r"^(\d+[.)]|[-*•])\s+", "")
    c = collapse(F.regexp_replace(c, r"\*\*", ""))
    for p in prefixes:
        c = F.when(F.startswith(c, F.lit(p)), F.ltrim(F.substring(c, len(p) + 1, 1 << 30))).otherwise(c)
    return c


def query_terms(text: Column) -> Column:
    """Distinct whole words of three or more of a-z and 0-9, without stop words, in order; a word with any other letter is none."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.array_distinct(F.filter(runs, lambda w: F.rlike(w, F.lit("^[a-z0-9]{3,}$"))))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def overlap(text: Column, terms: Column) -> Column:
    """How many of the terms the text contains."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def keywords(query: Column, n: int = 5, least: int = 3) -> Column:
    words = F.slice(F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: F.length(w) >= least), 1, n)
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\w]", "")), lambda w: w != "")


def any_keyword(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(text), w))


def unique_ci(values: Column, n: int) -> Column:
    """Trimmed, distinct whatever the case (the first spelling stays), in order, ``n`` at most."""
    none = F.array().cast("array<string>")

    def add(held: Column, value: Column) -> Column:
        v = F.trim(value)
        more = F.struct(F.array_append(held["found"], v).alias("found"), F.array_append(held["low"], F.lower(v)).alias("low"))
        return F.when((F.size(held["found"]) < n) & (v != "") & ~F.array_contains(held["low"], F.lower(v)), more).otherwise(held)

    # one pass that holds ``n`` at most, whatever the length
    return F.aggregate(values, F.struct(none.alias("found"), none.alias("low")), add, lambda held: held["found"])


def safe_segment(text: Column, default: str = "unknown") -> Column:
    c = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def is_detail_query(text: Column) -> Column:
    """Whether a question asks for detail, by hints that may stand anywhere."""
    return F.exists(F.array(*map(F.lit, DETAIL_HINTS)), lambda h: F.contains(F.lower(text), h))


def memory_budget(query: Column, base: int = 1200, detail: int = 2200) -> Column:
    """Characters of memory that a question is worth: more for detail, some more for eight terms or more."""
    return F.when(is_detail_query(query), detail).when(F.size(query_terms(query)) >= 8, base + 400).otherwise(base)


def is_valid_content(text: Column) -> Column:
    """Whether a description says something: it isn't empty and has none of the phrases for a black picture."""
    bad = F.exists(F.array(*map(F.lit, INVALID_CONTENT)), lambda h: F.contains(F.lower(text), h))
    return F.coalesce((F.length(text) > 0) & ~bad, F.lit(False))


def capitalised_topics(text: Column, n: int = 10) -> Column:
    """Words of over three characters that begin with a capital, trimmed of punctuation, without stop words, distinct whatever the case."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.rlike(w, F.lit(r"^\p{Lu}")) & (F.length(w) > 3) & ~F.lower(w).isin(TOPIC_STOP_WORDS))
    return unique_ci(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,!?:;()\[\]]+|[.,!?:;()\[\]]+$", "")), n)


def quoted_and_named(text: Column) -> Column:
    """Topics of a message: quoted phrases and runs of capitalised words, distinct and sorted."""
    quotes = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0))
    return F.array_sort(F.array_union(quotes, names))


def artifact_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\[artifact:([^\]]+)\]", 1), F.lit(""))


def expand_query(query: Column, concepts: Column, terms: Column) -> Column:
    """The query and, unless it contains them, its first three concepts and two terms."""
    fresh = lambda xs, n: F.filter(F.slice(xs, 1, n), lambda x: ~F.contains(F.lower(query), F.lower(x)))
    return F.concat_ws(" ", query, fresh(concepts, 3), fresh(terms, 2))


def labelled(parts: list[tuple[str, Column]], sep: str = " | ") -> Column:
    """``label: value`` of every part that has a value."""
    return F.concat_ws(sep, *[F.when(F.length(v) > 0, F.concat(F.lit(f"{k}: "), v)) for k, v in parts])
