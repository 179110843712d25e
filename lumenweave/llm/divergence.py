"""Source divergence audit with mergeable radix tries.

A task counts the terms of its documents in one radix trie over bytes for each
language; a leaf holds in how many documents the term stands and how often it stands
in each source. A trie of many leaves is written down in the order of its traversal
and a new one begun. Spark deals the leaves of all tries by ranges of (language, term
bytes); within a range the leaves of equal prefixes follow each other, so the tries
merge as they are read, whatever their number. A second
traversal of the merged leaves that are kept, in UTF-8 order, streams what each term
adds to the divergence of every pair of sources, and keeps of every source the best
candidates; of equal ones the first in that order stay.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import LOWER, UPPER
from lumenweave.session import text_batches, written

#: A-Z lower-cased, every other ASCII character but a-z a blank; bytes of other characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).islower() else ord(LOWER[UPPER.index(chr(b))]) if chr(b).isupper() else 32 for b in range(256))
SCALE = 1_000_000_000
#: Bytes of leaves that are merged together, about.
AT_ONCE = 4_000_000
LEAF = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


class Trie:
    """A trie over bytes whose lowest branches are containers: one that holds over ``BURST`` terms bursts into branches by its next byte.

    A leaf is [documents, source, count, source, count, ...]; counts of a source that stands there twice add up.
    """

    BURST = 256
    __slots__ = ("depth", "terms", "branches")

    def __init__(self, terms: dict[bytes, list] | None = None, depth: int = 0) -> None:
        self.depth, self.terms, self.branches = depth, {} if terms is None else terms, None
        self._burst()

    def _burst(self) -> None:
        if len(self.terms) <= self.BURST:
            return
        at, parts = self.depth, defaultdict(dict)
        for term, leaf in self.terms.items():
            parts[term[at] if len(term) > at else -1][term] = leaf  # -1: the term ends here, before all others
        self.terms, self.branches = {}, {byte: Trie(part, at + 1) for byte, part in parts.items()}

    def add(self, term: bytes, leaf: list) -> None:
        node = self
        while node.branches is not None:
            byte = term[node.depth] if len(term) > node.depth else -1
            if byte not in node.branches:
                node.branches[byte] = Trie(depth=node.depth + 1)
            node = node.branches[byte]
        own = node.terms.get(term)
        if own is None:
            node.terms[term] = list(leaf)
            node._burst()
        else:
            own[0] += leaf[0]
            own += leaf[1:]

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """(term, leaf) in the order of the terms' bytes, which is that of their UTF-8."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node.branches is None:
                for term in sorted(node.terms):
                    yield term, node.terms[term]
            else:
                stack += [node.branches[byte] for byte in sorted(node.branches, reverse=True)]

    def merge(self, other: Trie) -> Trie:
        for term, leaf in other.walk():
            self.add(term, leaf)
        return self


class Counts:
    """What a task has read since it last wrote: terms are counted by language and source, then put in the language's trie."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.terms: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.since = 0

    def read(self, text: bytes, lang: str, source: str) -> None:
        terms = text.translate(_FOLD).split()
        self.terms[lang, source].update(terms)
        self.docs[lang].update(set(terms))
        self.since += len(terms)

    def full(self, most: int) -> bool:
        """Whether over ``most`` counters are held; looked at after so many terms as could bring in a quarter of them."""
        if self.since <= most // 4:
            return False
        self.since = 0
        return sum(map(len, self.terms.values())) + sum(map(len, self.docs.values())) > most

    def tries(self) -> dict[str, Trie]:
        leaves = {lang: {term: [n] for term, n in terms.items()} for lang, terms in self.docs.items()}
        for (lang, source), terms in self.terms.items():
            own = leaves[lang]
            for term, n in terms.items():
                own[term] += (source, n)
        return {lang: Trie(terms) for lang, terms in leaves.items()}


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _leaf_rows(leaves: Iterator[tuple[str, bytes, list]], at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(leaves, at_once)):
        langs, terms, own = zip(*held, strict=True)
        flat = list(chain.from_iterable(leaf[1:] for leaf in own))
        offsets = pa.array(np.cumsum([0, *(len(leaf) // 2 for leaf in own)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[k::2], kind)) for k, kind in ((0, pa.string()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(terms), pa.array([leaf[0] for leaf in own]), *lists], schema=_LEAF)


def tries(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """The leaves of all tasks' tries: ``lang, term, docs, sources, counts``; a term once in each trie, at the most.

    ``most`` counters are held by a task before it writes its tries and begins anew.
    """

    def written_down(held: Counts) -> Iterator[pa.RecordBatch]:
        return _leaf_rows((lang, *leaf) for lang, trie in held.tries().items() for leaf in trie.walk())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for text, lang, source in zip(batch.column("text"), langs, sources, strict=True):
                held.read(text.as_py(), lang, source)
                if held.full(most):
                    yield from written_down(held)
                    held = Counts()
        yield from written_down(held)

    text_batches(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, LEAF)


def merged(leaves: DataFrame, least: int) -> DataFrame:
    """One row a language and term in ``least`` documents or more, in ranges of both.

    In a sorted range the leaves of one term, of however many tries, follow each
    other. Runs of equal terms are found a batch at a time; only those that are kept
    are looked into, and the last run of a batch waits for the next one.
    """

    def summed(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.add.reduceat(rows.column("docs").to_numpy(), starts)
        found = total >= least
        if not found.any():
            return
        keep = np.repeat(found, np.diff(np.append(starts, rows.num_rows)))
        kept = rows.select(["sources", "counts"]).filter(pa.array(keep)).combine_chunks()
        sources, counts = (kept.column(c).chunk(0) for c in ("sources", "counts"))
        names = sources.flatten().dictionary_encode()
        run = np.repeat(np.cumsum(found) - 1, np.diff(np.append(starts, rows.num_rows)))[keep]
        of = np.repeat(run, pc.list_value_length(sources).to_numpy()) * len(names.dictionary) + names.indices.to_numpy()
        # a source's counts of one run side by side
        order = np.argsort(of, kind="stable")
        of = of[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        sums = np.add.reduceat(counts.flatten().to_numpy()[order], first)
        of = of[first]
        ends = np.append(0, np.cumsum(np.bincount(of // len(names.dictionary), minlength=int(found.sum()))))
        heads = rows.select(["lang", "term"]).take(pa.array(starts[found])).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (names.dictionary.take(pa.array(of % len(names.dictionary))), pa.array(sums))]
        yield pa.RecordBatch.from_arrays([*(heads.column(c).chunk(0) for c in ("lang", "term")), pa.array(total[found]), *lists], schema=_LEAF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(rows)
            end = rows.num_rows if last else starts[-1]
            held[:] = rows.slice(end).to_batches()
            if end:
                yield from summed(rows.slice(0, end), starts if last else starts[:-1])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > AT_ONCE:
                yield from settled(False)
                size = 0
        if sum(b.num_rows for b in held):
            yield from settled(True)

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, LEAF)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where another (lang, term) begins."""
    n = rows.num_rows
    same = [pc.equal(rows.column(c).slice(1), rows.column(c).slice(0, n - 1)).to_numpy() for c in ("lang", "term")]
    return np.flatnonzero(np.append(True, ~(same[0] & same[1])))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals), exact: two steps of a long division, in Python's integers where 64 bits don't do."""
    step = 32_000
    if totals.max() >= (1 << 63) // step:
        counts, totals = counts.astype(object), totals.astype(object)
        return (1 + counts * SCALE // totals).astype("int64")
    high, rest = np.divmod(counts * step, totals)
    return 1 + high * (SCALE // step) + rest * (SCALE // step) // totals


class _Audit:
    """What a task knows of one language's terms: sums for pairs of sources and the best terms of each."""

    def __init__(self, lang: str, sources: list[str], sums: list[int], size: int, block: slice, top: int, prior: int) -> None:
        self.lang, self.sources, self.block, self.top, self.prior = lang, sources, block, top, prior
        self.at = {s: i for i, s in enumerate(sources)}
        self.totals = np.array(sums, "int64") + prior * size
        self.all = sum(sums) + prior * size
        mine = range(*block.indices(len(sources)))
        self.pairs = np.zeros((len(mine), len(sources)), "int64")
        self.best: dict[int, list] = {i: [] for i in mine}
        self.terms: list[tuple[bytes, dict[int, int]]] = []
        self.nth = 0

    def term(self, term: bytes, sources: list[str], counts: list[int]) -> None:
        self.terms.append((term, {self.at[s]: n for s, n in zip(sources, counts, strict=True)}))
        if len(self.terms) * len(self.sources) >= 1 << 18:
            self.settle()

    def settle(self) -> None:
        if not self.terms:
            return
        counts = np.zeros((len(self.terms), len(self.sources)), "int64")
        for row, (_, own) in enumerate(self.terms):
            counts[row, list(own)] = list(own.values())
        p = shares(counts + self.prior, self.totals)
        q = shares(counts.sum(axis=1) + self.prior, np.array(self.all))
        for k, i in enumerate(self.best):
            self.pairs[k] += np.abs(p - p[:, i : i + 1]).sum(axis=0)
            heap, value = self.best[i], p[:, i] - q
            for row in np.flatnonzero((counts[:, i] > 0) & (value > 0)):
                # the smallest is at the top: of equal values the one that came last
                item = (int(value[row]), -(self.nth + int(row)), self.terms[row][0])
                if len(heap) < self.top:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        self.nth += len(self.terms)
        self.terms = []

    def rows(self) -> Iterator[tuple]:
        self.settle()
        for k, i in enumerate(self.best):
            yield from ((self.lang, self.sources[i], "pair", s, int(self.pairs[k, j])) for j, s in enumerate(self.sources) if j != i)
            yield from ((self.lang, self.sources[i], "term", term.decode(), value) for value, _, term in self.best[i])


OUT = "lang string, source string, part string, item string, value long"
_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _audited(kept: DataFrame, groups: dict[str, list[tuple[str, int]]], sizes: dict[str, int], top: int, prior: int, block: int) -> DataFrame:
    """Sums and candidates of each range of the kept terms; ``block`` sources have their sums in one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, audit = None, None
            for batch in batches:
                for lang, nth, term, sources, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "term", "sources", "counts")), strict=True):
                    if (lang, nth) != key:
                        if audit:
                            yield from audit.rows()
                        key = (lang, nth)
                        audit = _Audit(lang, [s for s, _ in groups[lang]], [n for _, n in groups[lang]], sizes[lang], slice(nth * block, (nth + 1) * block), top, prior)
                    audit.term(term, sources, counts)
            if audit:
                yield from audit.rows()

        return _batches(rows(), _OUT)

    blocks = {lang: (len(own) + block - 1) // block for lang, own in groups.items()}
    number = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("lang")]
    spread = kept.withColumn("block", F.explode(F.sequence(F.lit(0), number - 1)))
    return spread.repartitionByRange("lang", "block", "term").sortWithinPartitions("lang", "block", "term").mapInArrow(run, OUT)


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 30, top: int = 50, prior: int = 5, block: int = 512, most: int = 1_000_000
) -> DataFrame:
    """How the sources of a language differ: ``lang, source, part, item, value, rank``.

    Terms are runs of ASCII letters and of all that is not ASCII, A-Z lower-cased. A
    language keeps those in at least ``least`` of its documents. In a source, a term
    has p = 1 + floor(10^9 * (count + prior) / (N + prior * V)), N the counts' sum
    over the V kept terms; all of the language's documents give q in the same way.
    ``pair``: each other source of the language, with the sum of abs(p - p'). ``term``:
    up to ``top`` terms that stand in the source with p > q, by p - q. Ranks count from 1
    for each source and part, larger values first, then items in UTF-8 order.

    Null text, language and source count as empty. Repeated rows count each. Every
    (language, source) that occurs is a group; without kept terms it has pairs of
    value 0 and no terms, and a language with one source has no pairs. An empty table
    gives no row; other columns of ``docs`` are ignored.

    The driver holds one row a group; the result has the square of a language's
    sources. Sums for ``block`` sources are in one task's memory.
    """
    spark: SparkSession = docs.sparkSession
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = written(merged(written(tries(docs, lang_col, source_col, text_col, most)), least))
    sizes = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    used = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    there = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source")).distinct()
    found = there.join(used, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).collect()
    groups: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.lang, r.source)):
        groups[r.lang].append((r.source, r.n))

    if not sizes:
        parts = spark.createDataFrame([], OUT)
    else:
        parts = _audited(kept, {lang: groups[lang] for lang in sizes}, sizes, top, prior, block)
    # a range has its own sums: they meet here, and so do its candidates
    parts = written(parts)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = spark.createDataFrame([(lang, a) for lang, own in groups.items() if lang not in sizes for a, _ in own], "lang string, source string")
    other = bare.withColumnRenamed("source", "item")
    none = bare.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    both = parts.where("part = 'term'").unionByName(pairs).unionByName(none)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
