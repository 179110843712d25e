"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. How well
a word fits it is the sum, over every way to cut the word into pieces, of the
product of their probabilities: the forward algorithm. The probabilities are fitted
by EM (forward and backward) on the words of labelled texts, of all or of a bounded
sample; scoring reads every whole text. The model is one number for each piece and language.
Words are counted, cut into pieces once and weighed in every round where Spark has dealt
them; the driver only gets the sums of a round, as many as the model has numbers.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.memory import held
from lumenweave.llm.vocab import rank_pieces
from lumenweave.session import cut, text_batches, written

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: A longer word is scored by itself, with a scale of its own; in training it is cut into stretches of so many bytes.
STRETCH = 32
#: Every byte counts this much, so that a word's sum stays near 1; it is taken off again.
LIFT = 32.0
#: Twice so many words' scores a process remembers before it starts anew.
WORDS_KEPT = 150_000
WORDS_AT_ONCE = 4000
#: Distinct tokens that a task counts before it hands the counts on.
TOKENS_HELD = 300_000
#: A piece between two places of a stretch.
EDGE = np.dtype([("start", "u1"), ("end", "u1"), ("piece", "<u4")])
#: Of a histogram of log-probabilities: steps in a nat, and steps of the second one in a step of the first.
COARSE, FINE = 256, 1024


def words_in(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower()) if text else []


class Prefixes(dict):
    """The numbers of pieces, and -1 for what only begins one: where neither stands, no longer piece does."""

    def __init__(self, pieces: dict[bytes, int]):
        super().__init__((piece[:n], -1) for piece in pieces for n in range(1, len(piece)))
        self.update(pieces)


def edges_of(words: list[str], pieces: dict[bytes, int], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch of some words its word and its size, then all their edges in turn and how many each has."""
    starts, ends, ids = array("B"), array("B"), array("i")
    word_of, sizes, edge_counts = [], [], []
    get = (pieces if isinstance(pieces, Prefixes) else Prefixes(pieces)).get
    for w, word in enumerate(words):
        whole = b" " + word.encode("utf-8", "replace")
        for cut_at in range(0, len(whole), STRETCH):
            b = whole[cut_at : cut_at + STRETCH]
            n, before = len(b), len(ids)
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    if (p := get(b[i:j])) is None:
                        break
                    if p >= 0:
                        starts.append(i)
                        ends.append(j)
                        ids.append(p)
            word_of.append(w)
            sizes.append(n)
            edge_counts.append(len(ids) - before)
    edges = np.empty(len(ids), EDGE)
    edges["start"], edges["end"], edges["piece"] = starts, ends, ids
    return np.array(word_of, np.int64), np.array(sizes, np.int64), edges, np.array(edge_counts, np.int64)


class Lattice:
    """All segmentations of some words: an edge for each piece that stands in one."""

    def __init__(self, words: list[str], pieces: dict[bytes, int], longest: int):
        word_of, sizes, edges, edge_counts = edges_of(words, pieces, longest)
        self._lay(word_of, len(words), sizes, edges, edge_counts)

    @staticmethod
    def of(sizes: np.ndarray, edges: np.ndarray, edge_counts: np.ndarray) -> Lattice:
        """From the edges of stretches that are a word each."""
        self = Lattice.__new__(Lattice)
        self._lay(np.arange(len(sizes)), len(sizes), sizes, edges, edge_counts)
        return self

    def _lay(self, word_of: np.ndarray, n_words: int, sizes: np.ndarray, edges: np.ndarray, edge_counts: np.ndarray) -> None:
        self.word_of, self.n_words = word_of.astype(np.int64), n_words
        self.last = np.cumsum(sizes + 1, dtype=np.int64) - 1
        self.first = self.last - sizes
        base = self.nodes = int(sizes.sum()) + len(sizes)
        of_edge = np.repeat(self.first, edge_counts).astype(np.int32)
        start, end, piece = of_edge + edges["start"], of_edge + edges["end"], edges["piece"].astype(np.int32)
        size = end - start
        depth = np.zeros(base, np.int64)  # of a node in its stretch
        depth[self.first] = 1
        depth = np.arange(base) - np.maximum.accumulate(np.where(depth > 0, np.arange(base), 0))
        order = np.lexsort((end, depth[end])) if len(end) else np.zeros(0, np.int64)
        self.start, self.end, self.piece, self.size = start[order], end[order], piece[order], size[order]
        self.steps = np.flatnonzero(np.diff(depth[self.end], prepend=-1)).tolist() + [len(order)]
        back = np.lexsort((self.start, -depth[self.start])) if len(order) else order
        self.back = back
        self.back_steps = np.flatnonzero(np.diff(-depth[self.start[back]], prepend=1)).tolist() + [len(order)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Of each node, the summed probability of all ways to it; p has a row for each piece and a column for each language."""
        a = np.zeros((self.nodes, p.shape[1]))
        a[self.first] = 1
        lifted = p[self.piece] * (LIFT ** self.size.astype(float))[:, None]
        for lo, hi in zip(self.steps, self.steps[1:], strict=False):
            flow, to = a[self.start[lo:hi]] * lifted[lo:hi], self.end[lo:hi]
            at = np.flatnonzero(np.diff(to, prepend=-1))
            a[to[at]] = np.add.reduceat(flow, at, axis=0)
        return a

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in each language."""
        each = np.log(self.forward(p)[self.last]) - ((self.last - self.first) * np.log(LIFT))[:, None]
        out = np.zeros((self.n_words, p.shape[1]))
        np.add.at(out, self.word_of, each)
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, which stand ``weight`` times in one language."""
        a = self.forward(p[:, None])[:, 0]
        b = np.zeros(self.nodes)
        b[self.last] = 1
        start, end, piece, size = (x[self.back] for x in (self.start, self.end, self.piece, self.size))
        lifted = p[piece] * LIFT ** size.astype(float)
        for lo, hi in zip(self.back_steps, self.back_steps[1:], strict=False):
            flow, to = b[end[lo:hi]] * lifted[lo:hi], start[lo:hi]
            at = np.flatnonzero(np.diff(to, prepend=-1))
            b[to[at]] = np.add.reduceat(flow, at)
        of_node = np.repeat(weight[self.word_of] / a[self.last], self.last - self.first + 1)
        return np.bincount(piece, a[start] * lifted * b[end] * of_node[start], len(p))


def long_score(whole: bytes, pieces: dict[bytes, int], longest: int, p: np.ndarray) -> np.ndarray:
    """Natural log of a word's probability in each language, over all its segmentations, at any length.

    Only the last ``longest`` values of the forward algorithm are needed; they share
    a scale, which is taken out as they shrink.
    """
    last, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for end in range(1, len(whole) + 1):
        here = np.zeros(p.shape[1])
        for back in range(1, min(len(last), longest) + 1):
            if (i := pieces.get(whole[end - back : end])) is not None:
                here += last[-back] * p[i]
        last = [*last[1 - longest :], here] if longest > 1 else [here]
        if here.min() < 1e-200:
            top = np.maximum.reduce(last)
            last, scale = [x / top for x in last], scale + np.log(top)
    return np.log(last[-1]) + scale


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: str
    p: np.ndarray  # pieces x languages
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Scores texts by their words, each word once: what it has learned stays with the process."""

    def __init__(self, model: LanguageModel):
        self.model, known = model, rank_pieces(model.pieces)
        self.ids, self.longest = {b: i for i, b in enumerate(known)}, max(map(len, known))
        self.prefixes = Prefixes(self.ids)
        self.row_of: dict[str, int] = {}
        self.table = np.zeros((WORDS_KEPT * 2, len(model.languages)), np.float64)

    @staticmethod
    def of(model: LanguageModel) -> Scorer:
        return held(("scorer", model.name), lambda: Scorer(model))

    def _scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        whole = [b" " + w.encode("utf-8", "replace") for w in words]
        short = [i for i, b in enumerate(whole) if len(b) <= STRETCH]
        if short:
            out[short] = Lattice([words[i] for i in short], self.prefixes, min(STRETCH, self.longest)).scores(self.model.p)
        for i, b in enumerate(whole):
            if len(b) > STRETCH:
                out[i] = long_score(b, self.ids, self.longest, self.model.p)
        return out

    def __call__(self, texts: list[list[str]]) -> list[tuple[str, float, float | None]]:
        """Of each list of words the language, its posterior and the mean log-probability of a byte in it."""
        new = list({w for words in texts for w in words if w not in self.row_of})
        if self.row_of and len(self.row_of) + len(new) > len(self.table):
            self.row_of, new = {}, list({w for words in texts for w in words})
        if new and self.model.languages:
            at = len(self.row_of)
            if at + len(new) > len(self.table):
                self.table = np.zeros((at + len(new), self.table.shape[1]))
            for lo in range(0, len(new), WORDS_AT_ONCE):
                part = new[lo : lo + WORDS_AT_ONCE]
                self.table[at + lo : at + lo + len(part)] = self._scores(part)
            self.row_of.update(zip(new, range(at, at + len(new)), strict=True))
        out = []
        for words in texts:
            if not words or not self.model.languages:
                out.append((UNKNOWN, 0.0, None))
                continue
            total = self.table[np.fromiter(map(self.row_of.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            size = len("".join(words).encode("utf-8", "replace")) + len(words)
            out.append((self.model.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum()), float(total[best] / size)))
        return out


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lang, text: lang, word, n.

    Tokens between white space are counted; letters are only looked for in distinct ones.
    """
    tokens: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in tokens.items():
            counts: Counter = Counter()
            for token, n in own.items():
                for word in LETTERS.findall(token):
                    counts[word] += n
            words = [w.encode("utf-8", "replace") for w in counts]
            for lo in range(0, len(words), 20_000):
                part = words[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(list(islice(counts.values(), lo, lo + len(part))), pa.int64())], ["lang", "word", "n"])
        tokens.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens[lang].update(text.lower().split())
        if sum(map(len, tokens.values())) > TOKENS_HELD:
            yield from out()
    yield from out()


def labelled(train: DataFrame, lang_col: str, text_col: str, texts_per_language: int | None) -> tuple[DataFrame, list[str]]:
    """``lang, text`` of all texts with a label, or of about ``texts_per_language`` whole ones of each, chosen by a hash of the text alone; and the labels."""
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return rows, []
    if texts_per_language is None:
        return rows, sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, texts_per_language / n))])
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003), sorted(sizes)


def _numbered(pieces: str) -> tuple[Prefixes, int]:
    """The pieces by number, and the length of the longest that fits a stretch."""
    known = {b: i for i, b in enumerate(rank_pieces(pieces))}
    return Prefixes(known), min(STRETCH, max(map(len, known)))


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", pieces: str = "byte_bpe_multi_50k.tiktoken", texts_per_language: int | None = 600, rounds: int = 4, smooth: float = 0.02) -> LanguageModel:
    """Fits a model to labelled texts.

    The bound of the sample: about ``texts_per_language`` whole texts of each
    label, chosen by a hash of the text alone; without one it learns from all.
    Rows without label or text teach nothing.
    """
    spark = train.sparkSession
    text_batches(spark)
    chosen, languages = labelled(train, lang_col, text_col, texts_per_language)
    if not languages:
        return LanguageModel([], pieces, np.zeros((0, 0)))
    number = {lang: i for i, lang in enumerate(languages)}
    size = len(rank_pieces(pieces))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From lang, word, n: of each stretch its language's number, its size, its word's count and its edges."""
        known, longest = held(("pieces", pieces), lambda: _numbered(pieces))
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(at, WORDS_AT_ONCE)
                word_of, sizes, found, edge_counts = edges_of(part.column(1).to_pylist(), known, longest)
                langs = np.array([number[x] for x in part.column(0).to_pylist()], np.int32)
                flat = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(edge_counts) * EDGE.itemsize).astype(np.int32)), pa.py_buffer(found.view(np.uint8))])
                yield pa.RecordBatch.from_arrays([pa.array(langs[word_of]), pa.array(sizes.astype(np.int32)), pa.array(part.column(2).to_numpy()[word_of]), flat], ["lang", "size", "n", "edges"])

    counts = chosen.mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # in ranges of the languages, so that a task adds up for one or two
    stretches = written(cut(counts).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").mapInArrow(edges, "lang int, size int, n long, edges binary"))
    p = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)  # a number for each piece of the vocabulary and language

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, WORDS_AT_ONCE):
                    part = batch.slice(at, WORDS_AT_ONCE)
                    langs = part.column(0).to_numpy()
                    for lang in np.unique(langs).tolist():
                        own = part.filter(pa.array(langs == lang))
                        bounds = np.frombuffer(own.column(3).buffers()[1], np.int32)[own.column(3).offset :][: own.num_rows + 1]
                        found = np.frombuffer(own.column(3).buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(EDGE)
                        lattice = Lattice.of(own.column(1).to_numpy().astype(np.int64), found, np.diff(bounds) // EDGE.itemsize)
                        got = lattice.expected(np.ascontiguousarray(shared.value[:, lang]), own.column(2).to_numpy().astype(float))
                        sums[lang] = sums[lang] + got if lang in sums else got
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                for lo in range(0, len(at), 20_000):
                    own = at[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.int32()), pa.array(own.astype(np.int32)), pa.array(total[own])], ["lang", "piece", "x"])

        got = stretches.mapInArrow(expected, "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toArrow()
        p = np.full_like(p, smooth)
        p[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("x").to_numpy()
        p /= p.sum(0)
        shared.unpersist()
    return LanguageModel(languages, pieces, p)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """One row per input row: ``id_col``, the columns of ``carry``, then the language and its posterior (0 to 1) under ``names``.

    A third name gets the mean natural log-probability of a byte of the words in
    that language, which unlike the posterior tells texts of no learned language.

    ``und`` with score 0 where the text is null or has no letter, or if the model
    has learned no language. Only the text decides; repeated rows are each returned.
    """
    spark, kept = docs.sparkSession, [id_col, *carry]
    text_batches(spark)
    rows = docs.select(*kept) if text_col in kept else docs.select(*kept, text_col)
    at_text = rows.columns.index(text_col)
    kinds = ["string", "double", "double"][: len(names)]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes[: len(kept)], *zip(names, kinds, strict=True)])
    shared = spark.sparkContext.broadcast(model)  # a number for each piece of the vocabulary and language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                told = zip(*scorer([words_in(t) for t in part.column(at_text).to_pylist()]), strict=True)
                told = [pa.array(x, t) for x, t in zip(told, (pa.string(), pa.float64(), pa.float64()), strict=True)][: len(names)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *told], [*kept, *names])

    return rows.mapInArrow(score, schema)


def floors(told: DataFrame, margin: float = 1.0) -> dict[str, float]:
    """Of each language the mean log-probability of a byte below which a text is not in it.

    ``told`` has ``lang, told, fits`` of the texts: their label and what :func:`predict`
    says of them. The floor is ``margin`` nats under the median of all texts that are told as
    labelled, the lower one of two, to a step of 4e-6 nats; texts with keys, numbers or passages
    of another language in them are some tenths under it, random letters several.
    """
    right = told.where("told = lang").select("lang", F.floor(F.col("fits") * (COARSE * FINE)).alias("step"))
    low: dict[str, int] = {}
    before: dict[str, int] = {}

    def passed(rows: DataFrame, width: int) -> None:
        """Goes on to the step that holds the middle text: a row for each language and step of the histogram."""
        seen: dict[str, list] = defaultdict(list)
        for r in rows.groupBy("lang", F.floor(F.col("step") / width).alias("at")).count().collect():
            seen[r.lang].append((r.at, r["count"]))
        for lang, own in seen.items():
            own.sort()
            if lang not in before:
                middle[lang], before[lang] = (sum(n for _, n in own) - 1) // 2, 0
            for at, n in own:
                if before[lang] + n > middle[lang]:
                    low[lang] = at
                    break
                before[lang] += n

    middle: dict[str, int] = {}
    passed(right, FINE)
    if not low:
        return {}
    held_in = F.create_map(*[F.lit(x) for pair in low.items() for x in pair])[F.col("lang")]
    passed(right.where(F.floor(F.col("step") / FINE) == held_in), 1)
    return {lang: at / (COARSE * FINE) - margin for lang, at in low.items()}


def held_out(id_col: str, mod: int = 3, rest: int = 1) -> Column:
    """Whether a document is kept from training: by the CRC-32 of its id as text; one without an id always is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """Fits on the documents that aren't held out and predicts all: ``id_col, held_out, lang_pred, score``."""
    rows = docs.select(id_col, lang_col, text_col, held_out(id_col).alias("held_out"))
    model = fit(rows.where("NOT held_out"), lang_col, text_col, **options)
    return predict(rows, model, id_col, text_col, ("held_out",))
