"""Benchmark decontamination over a distributed positional inverted index.

The benchmark is cut into windows of consecutive words. One pass over the corpus
counts how often each test term occurs; each window then names its rarest terms,
and a second pass stores the postings (document, position) of those terms only, as
a table in the shared folder. A window's lists are shifted by the terms' offsets
and intersected from the rarest on; what is left is compared with the text word by
word. Common words never become postings unless a window has nothing rarer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import keyed, words_of
from lumenweave.session import cut

#: Rows of a table made from the benchmark alone up to which it is broadcast; beyond, Spark joins by shuffle.
MOST_BROADCAST = 200_000
#: Stands for the end of a text in the index; no word is empty.
END = ""


def _bounded(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = 10) -> DataFrame:
    """Distinct windows: ``win`` (array), ``key`` (its words in a string), ``m`` (their number), ``items`` (sorted ids as strings).

    An item of fewer words is one window; an item without words has none. An item
    without an id counts as a source of windows and is not named in ``items``.
    """
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    cuts = w.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {words} + 1, 1)), i -> slice(w, i, {words}))")).alias("win"))
    return cuts.groupBy(F.array_join("win", " ").alias("key")).agg(F.first("win").alias("win"), F.array_sort(F.collect_set("item")).alias("items")).withColumn("m", F.size("win"))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).select(F.struct("id", "fp").alias("doc"), words_of(F.col("text")).alias("w"))


def rare_terms(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: int = 3) -> DataFrame:
    """``windows`` that may occur, with ``rare``: up to ``lists`` structs (n, at, term), the rarest first; n counts the corpus."""
    spread = windows.select("key", F.posexplode("win").alias("at", "term"))
    terms = _bounded(cut(spread.select("term").distinct()))
    found = _words(docs, id_col, text_col).select(F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = spread.join(found, "term", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("rare"))
    return windows.join(ranked.where("rare[0].n > 0").select("key", F.slice("rare", 1, lists).alias("rare")), "key")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: ``term, doc, pos`` of every place in the corpus where one of ``terms`` stands. Words count from 0.

    Each row of ``docs`` also has a posting of :data:`END` behind its last word,
    whose ``pos`` is the number of its words.
    """
    wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    places = _words(docs, id_col, text_col).select("doc", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "term"))
    return places.join(_bounded(cut(wanted)), "term", "left_semi").select("term", "doc", "pos")


def _intersect(rare: DataFrame, index: DataFrame, lists: int, slop: int = 0) -> DataFrame:
    """``key, doc, start``: where the windows' rarest terms stand at their offsets, ``slop`` words more or less."""
    seeds = rare.select("key", "rare", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["at"].alias("at"))
    hits = index.join(_bounded(seeds), "term").select("key", "rare", "doc", (F.col("pos") - F.col("at")).alias("start"))
    for k in range(1, lists):
        other = index.select(F.col("term").alias("t"), F.col("doc").alias("d"), F.col("pos").alias("p"))
        if slop:  # the place may be off by some words: the other list is offered at each
            other = other.withColumn("p", F.explode(F.sequence(F.col("p") - slop, F.col("p") + slop))).distinct()
        nth = F.expr(f"rare[{k} % size(rare)]")  # a window of fewer words asks for its first again
        more = hits.withColumns({"t": nth["term"], "p": F.col("start") + nth["at"]})
        hits = more.join(other, (F.col("doc") == F.col("d")) & (more["p"] == other["p"]) & (more["t"] == other["t"]), "left_semi").drop("t", "p")
    return hits.select("key", "doc", "start")


def _index(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, words: int, lists: int) -> tuple[DataFrame, DataFrame]:
    windows = cut(benchmark_windows(benchmark, item_col, item_text, words))
    rare = cut(rare_terms(docs, windows, id_col, text_col, lists))
    return rare, cut(postings(docs, rare.select(F.explode("rare.term").alias("term")), id_col, text_col))


def occurrences(docs: DataFrame, rare: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: int = 3) -> DataFrame:
    """Exact phrase matches: ``doc`` (id, fp), ``start``, ``m``, ``items``; one row for a window and a place."""
    hits = _intersect(rare, index, lists).where("start >= 0").join(rare.select("key", "win", "m", "items"), "key")
    places = cut(hits.groupBy("doc").agg(F.collect_set(F.struct("start", "m", "win", "items")).alias("places")))
    texts = keyed(docs, id_col, text_col).select(F.struct("id", "fp").alias("doc"), "text")
    # only texts that are still suspected travel, unless there are too many to say so to every task
    some = texts.join(_bounded(places.select("doc")), "doc", "left_semi")
    again = some.join(places, "doc").select("doc", "places", words_of(F.col("text")).alias("w"))
    return again.select("doc", "w", F.explode("places").alias("x")).where("slice(w, x.start + 1, x.m) = x.win").select("doc", "x.start", "x.m", "x.items").distinct()


def proximity(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 10, lists: int = 3, slop: int = 2) -> DataFrame:
    """Proximity matches: ``id_col, start, items`` where a window's rarest terms stand within ``slop`` words of their places.

    ``start`` is where the window would begin by its rarest term and may be
    negative. Nothing is said of the other words; exact matches are among the rows.
    """
    rare, index = _index(docs, benchmark, id_col, text_col, item_col, item_text, words, lists)
    hits = _intersect(rare, index, lists, slop).join(rare.select("key", "items"), "key")
    return hits.select(F.col("doc.id").alias(id_col), "start", "items").distinct()


def covered(spans: str) -> Column:
    """How many words the column ``spans``, an array of structs (start, m), covers."""
    step = "aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + cast(greatest(x.start + x.m - greatest(x.start, a.to), 0) as bigint), 'to', greatest(a.to, x.start + x.m)), a -> a.n)"
    return F.expr(step.replace("spans", spans))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 10, lists: int = 3) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated, text_hash`` (the text's ``xxhash64``).

    A word is hit inside any occurrence of a window of ``words`` consecutive item
    words; A-Z are lower-cased and nothing else. Null and empty texts have no words.
    With an empty benchmark nothing is hit. Rows that repeat id and text are each
    returned; other columns of ``docs`` and ``benchmark`` are ignored.
    """
    rare, index = _index(docs, benchmark, id_col, text_col, item_col, item_text, words, lists)
    found = occurrences(docs, rare, index, id_col, text_col, lists)
    hit = found.groupBy("doc").agg(F.collect_set(F.struct("start", "m")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = hit.select(F.col("doc").alias("d"), covered("spans").alias("n_hit"), "items")
    rows = index.where(F.col("term") == END).select("doc", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return rows.join(hit, F.col("doc") == F.col("d"), "left").select(
        F.col("doc.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("doc.fp").alias("text_hash")
    )
