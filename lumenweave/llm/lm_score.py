"""Language-model scoring by a log-bilinear model.

The context is the last two tokens: their vectors, each through a matrix of its
place, add up to a prediction. The frequent words are tokens of their own, in classes
by rank; a word's probability is that of its class after the context times its own
within the class, and each of the two is the softmax of the prediction's products with
vectors, plus biases. So matrix products stay small with any vocabulary and scores are
normalised exactly. All other words share one token, within which a word has its
add-one share of the counts.

Noise-contrastive estimation trains the vectors in rounds. In each the texts are dealt
by hash into shards of about as many tokens, whatever the cluster; a task takes one pass
over a shard from the same parameters, and the results are averaged and sent out again:
all training texts are read once, none gathers in one place, and nothing depends on how
the table is cut or how many cores there are.

The counts come from the whole training corpus. The most frequent words are sent to
every task, their number fixed; the others meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.session import cut, text_batches

#: The end of a text as a token. No word can be white space.
END = b"\n"
#: Distinct words that a task counts before it hands the counts on.
WORDS_HELD = 300_000
CACHED = 1 << 18  # products of a class that are looked at together, so that they stay in a core's cache
DOCS = 1000  # texts looked at together: the more, the more contexts they share


@dataclass(frozen=True)
class Shape:
    """The size of a model.

    A word that stands ``least`` times in the training texts is a token of its own,
    up to ``words`` of them; ``head``: words whose counts every task gets; ``shard``:
    tokens, about, that one pass of a task learns from.
    """

    words: int = 1 << 15
    least: int = 16
    head: int = 1 << 17
    size: int = 16
    context: int = 2
    noise: int = 16
    noise_in_class: int = 1
    batch: int = 1024
    rate: float = 0.1
    rounds: int = 2
    shard: int = 2_000_000


def class_starts(n: int) -> np.ndarray:
    """First ranks of the classes of ``n`` tokens, and ``n``: one token, then two, then three; the last token is a class of its own."""
    starts, size = [0], 1
    while starts[-1] + size < n - 1:
        starts.append(starts[-1] + size)
        size += 1
    return np.array([*starts, n - 1, n] if n > 1 else [0, n])


@dataclass
class Params:
    """Vectors of context tokens, matrices of the places, vectors and biases of predicted tokens and of classes.

    Tokens: the words by rank, then the token of all other words; a context may
    also hold the start of a text, which comes last.
    """

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray
    qc: np.ndarray
    bc: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.r, self.c, self.q, self.b, self.qc, self.bc

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray, n: int, shape: Shape) -> Params:
        d, k = shape.size, len(class_starts(n)) - 1
        r, c, q, b, qc, bc = np.split(np.array(flat, np.float32), np.cumsum([(n + 1) * d, shape.context * d * d, n * d, n, k * d]))
        return Params(r.reshape(n + 1, d), c.reshape(shape.context, d, d), q.reshape(n, d), b, qc.reshape(k, d), bc)

    @staticmethod
    def start(prior: np.ndarray, shape: Shape) -> Params:
        """Small random vectors; the biases make it the unigram model."""
        rng, n, starts = np.random.default_rng(5), len(prior), class_starts(len(prior))
        some = lambda rows: (rng.standard_normal((rows, shape.size)) * 0.1).astype(np.float32)
        turn = np.stack([np.eye(shape.size, dtype=np.float32)] * shape.context) / shape.context
        return Params(some(n + 1), turn, some(n), np.log(prior).astype(np.float32), some(len(starts) - 1), np.log(np.add.reduceat(prior, starts[:-1])).astype(np.float32))

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.r[contexts[:, i]] @ self.c[i] for i in range(contexts.shape[1]))


def contexts_of(tokens: np.ndarray, lengths: np.ndarray, n: int, context: int) -> np.ndarray:
    """Of each token the ones before it, the nearest first; the start (token ``n``) before the first."""
    firsts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(tokens)) - firsts
    out = np.full((len(tokens), context), n, np.int64)
    for i in range(context):
        has = place > i
        out[has, i] = tokens[np.flatnonzero(has) - i - 1]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps, of classes and of words within their class.

    A batch shares its noise classes; noise words are drawn for each token, from its class.
    """

    def __init__(self, params: Params, prior: np.ndarray, shape: Shape, seed: int):
        self.shape, self.rng = shape, np.random.default_rng(seed)
        # a row has a vector, its bias and, where that makes it even, a zero: both are fetched and moved at once
        self.words, self.classes = (self._rows(v, bias) for v, bias in ((params.q, params.b), (params.qc, params.bc)))
        d = shape.size
        self.p = Params(params.r, params.c, self.words[:, :d], self.words[:, d], self.classes[:, :d], self.classes[:, d])
        self.starts = class_starts(len(prior))
        self.sum = np.concatenate([[0.0], np.cumsum(prior)])
        self.sum[-1] = 1.0
        of_class = np.diff(self.sum[self.starts])
        self.class_of = np.repeat(np.arange(len(of_class)), np.diff(self.starts))
        self.class_sum = np.cumsum(of_class)
        self.many = np.diff(self.starts) > 1
        self.below, self.width = self.sum[self.starts[:-1]], of_class
        self.log_class = np.log(shape.noise * of_class).astype(np.float32)
        self.log_word = np.log(shape.noise_in_class * prior / of_class[self.class_of]).astype(np.float32)
        self.seen = {id(x): np.full_like(x, 1e-8) for x in (self.p.r, self.p.c, self.words, self.classes)}  # far below a batch's squared gradients

    @staticmethod
    def _rows(vectors: np.ndarray, biases: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(vectors), (vectors.shape[1] + 2) // 2 * 2), np.float32)
        rows[:, : vectors.shape[1]], rows[:, vectors.shape[1]] = vectors, biases
        return rows

    def _step(self, param: np.ndarray, at, grad: np.ndarray) -> None:
        seen = self.seen[id(param)]
        squares = grad * grad
        squares += seen.take(at, 0)
        seen[at] = squares
        np.sqrt(squares, out=squares)
        grad *= np.float32(self.shape.rate)
        grad /= squares
        grad += param.take(at, 0)
        param[at] = grad

    @staticmethod
    def _by_row(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")  # few bits sort by counting
        ranked = rows.take(order)
        new = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        first = np.flatnonzero(new)
        grad = grad.take(order, 0)
        # two floats add up as one complex number: half as many sums
        pairs = grad.view(np.complex64) if grad.shape[1] % 2 == 0 else grad
        return ranked.take(first), np.add.reduceat(pairs, first, axis=0).view(np.float32)

    def _wide(self, n: int) -> np.ndarray:
        """Room for gradients of rows of ``words`` or ``classes``."""
        wide = np.empty((n, self.words.shape[1]), np.float32)
        wide[:, self.shape.size + 1 :] = 0
        return wide

    def learn(self, contexts: np.ndarray, target: np.ndarray) -> None:
        p, shape, k, d = self.p, self.shape, self.shape.noise_in_class, self.shape.size
        for lo in range(0, len(target), shape.batch):
            at = contexts[lo : lo + shape.batch].T.ravel()  # place after place
            t = target[lo : lo + shape.batch]
            c = self.class_of.take(t)
            scale = np.float32(1 / len(t))
            each = p.r.take(at, 0).reshape(shape.context, len(t), d)
            hat = sum(each[i] @ p.c[i] for i in range(shape.context))
            # classes
            noise = np.minimum(np.searchsorted(self.class_sum, self.rng.random(shape.noise)), len(p.bc) - 1)
            own_rows, noise_rows = self.classes.take(c, 0), self.classes.take(noise, 0)
            g_c = 1 - _sigmoid(np.einsum("ij,ij->i", hat, own_rows[:, :d]) + own_rows[:, d] - self.log_class.take(c))
            g_n = -_sigmoid(hat @ noise_rows[:, :d].T + noise_rows[:, d] - self.log_class.take(noise))
            g_hat = g_c[:, None] * own_rows[:, :d]
            g_hat += g_n @ noise_rows[:, :d]
            wide = self._wide(len(t) + len(noise))
            np.multiply(g_c[:, None], hat, out=wide[: len(t), :d])
            np.matmul(g_n.T, hat, out=wide[len(t) :, :d])
            wide[: len(t), d], wide[len(t) :, d] = g_c, g_n.sum(0)
            wide *= scale
            moves = [(self.classes, *self._by_row(np.concatenate([c, noise]), wide))]
            # words, where the class has more than one
            own = np.flatnonzero(self.many.take(c))
            if len(own):
                tw, cw, hw = t.take(own), c.take(own), hat.take(own, 0)
                drawn = np.searchsorted(self.sum, self.below.take(cw) + self.rng.random((k, len(own))) * self.width.take(cw), side="right") - 1  # within the class
                drawn = np.clip(drawn, self.starts.take(cw), self.starts.take(cw + 1) - 1)
                every = np.concatenate([tw, *drawn])
                rows = self.words.take(every, 0)
                vectors = rows[:, :d].reshape(k + 1, len(own), d)
                s = np.einsum("kij,ij->ki", vectors, hw) + (rows[:, d] - self.log_word.take(every)).reshape(k + 1, -1)
                g = -_sigmoid(s)
                g[0] += 1
                g_hat[own] += np.einsum("ki,kij->ij", g, vectors)
                wide = self._wide(len(every))
                np.multiply(g[:, :, None], hw, out=wide.reshape(k + 1, len(own), -1)[:, :, :d])
                wide[:, d] = g.ravel()
                wide *= scale
                moves.append((self.words, *self._by_row(every, wide)))
            g_hat *= scale
            before = np.concatenate([g_hat @ p.c[i].T for i in range(shape.context)])
            turns = [each[i].T @ g_hat for i in range(shape.context)]
            for param, rows, grad in moves:
                self._step(param, rows, grad)
            self._step(p.r, *self._by_row(at, before))
            self._step(p.c, np.arange(shape.context), np.stack(turns))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            part = batch.slice(at, DOCS)
            yield part, [split_words(t) for t in part.column(column).to_pylist()]


def count_words(train: DataFrame, text_col: str) -> DataFrame:
    """``word`` (binary) and ``n`` over whole texts, with the ends. Tasks hand on counts, not words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for _, texts in _texts(batches):
            for words in texts:
                held.update(words)
            held[END] += len(texts)
            if len(held) > WORDS_HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return train.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    shape: Shape
    head: dict[bytes, int]  # word -> count, the most frequent first
    total: int  # tokens
    distinct: int
    params: Params | None = None

    def __post_init__(self) -> None:
        self.tokens = {w: i for i, (w, n) in enumerate(list(self.head.items())[: self.shape.words]) if n >= self.shape.least}
        own = sum(self.head[w] for w in self.tokens)
        #: Of the words that share a token: their counts and one each, and one for what was never seen.
        self.rest = self.total - own + self.distinct - len(self.tokens) + 1
        counts = np.array([*(self.head[w] for w in self.tokens), max(1, self.total - own)], float)
        self.prior = counts / counts.sum()

    def ranks(self, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words of some texts, each text with its end; their ranks in the head, -1 for others; and the lengths of the texts."""
        flat = list(chain.from_iterable(chain(words, (END,)) for words in texts))
        index = self.__dict__.setdefault("_index", _Ranks((w, i) for i, w in enumerate(self.head)))
        return flat, np.fromiter(map(index.__getitem__, flat), np.int32, len(flat)), np.array([len(words) + 1 for words in texts])

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        own = len(self.tokens)
        return np.where((ranks >= 0) & (ranks < own), ranks, own).astype(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_index"}


class _Ranks(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def train(rows: DataFrame, text_col: str, model: Model) -> Params:
    """Each round, one pass of every task over its part of the round's texts; the average by tokens read, summed on the executors."""
    spark, shape, n = rows.sparkSession, model.shape, len(model.prior)
    flat = Params.start(model.prior, shape).flat()
    words = spark.sparkContext.broadcast(model)
    pieces = max(64, len(flat) >> 14)
    schema = "piece int, part int, n long, v array<float>"
    shards = max(1, round(model.total / shape.rounds / shape.shard))

    def add(group):
        import pandas as pd

        group = group.sort_values("part")
        total = group.n.sum()
        v = np.average(np.stack(group.v.to_numpy()), 0, group.n.to_numpy(float)).astype(np.float32)
        return pd.DataFrame({"piece": group.piece[:1], "part": group.part.to_numpy()[:1] // 64, "n": [total], "v": [v]})

    # a row's round, its shard and its place in it come from a hash of the id and the text: copies of a text are dealt out
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = rows.select(text.alias("text"), F.xxhash64(text, *[F.col(c) for c in rows.columns if c != text_col], F.lit(11)).alias("h"))
    hashed = hashed.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int"))

    def learner(shared, nth: int):
        def learn(table):
            m, part = words.value, table.column("shard")[0].as_py()
            trainer, read = Trainer(Params.of(shared.value, n, shape), m.prior, shape, part * 64 + nth), 0
            for _, texts in _texts(table.sort_by("h").select(["text"]).to_batches(DOCS)):
                _, ranks, lengths = m.ranks(texts)
                tokens = m.ids(ranks)
                trainer.learn(contexts_of(tokens, lengths, n, shape.context), tokens)
                read += len(tokens)
            each = np.array_split(trainer.p.flat(), pieces)
            v = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate(each)))
            columns = [pa.array(range(pieces), pa.int32()), pa.array([part] * pieces, pa.int32()), pa.array([read] * pieces, pa.int64()), v]
            return pa.Table.from_arrays(columns, ["piece", "part", "n", "v"])

        return learn

    for nth in range(shape.rounds):
        shared = spark.sparkContext.broadcast(flat)
        # a shard is a few MB of text: its rows are in one task's memory
        sums = hashed.where(F.pmod("h", F.lit(shape.rounds)) == nth).select("shard", "h", "text").groupBy("shard").applyInArrow(learner(shared, nth), schema)
        for key in (F.expr("part div 64"), F.lit(0)):  # in two steps: no task gathers a row of every other
            sums = sums.groupBy("piece", key.alias("of")).applyInPandas(add, schema)
        got = sums.select("piece", "v").toArrow().sort_by("piece")  # the size of one model
        if got.num_rows:
            flat = got.column("v").combine_chunks().flatten().to_numpy()
        shared.unpersist()
    return Params.of(flat, n, shape)


def most_frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` words, each more frequent than those left out, by count.

    Their least count comes from a histogram of the counts' logarithms, whose
    length is fixed; so nothing is sorted, and no more than these words move.
    """
    step = F.floor(F.log(F.col("n")) * 64).cast("int")
    room, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # a row for each step of 1.6 %
        if r["count"] > room:
            break
        room, least = room - r["count"], r.step
    if least is None:
        return {}
    got = counts.where(step >= least).toArrow()
    pairs = zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)
    return dict(sorted(pairs, key=lambda x: (-x[1], x[0])))


def fit(rows: DataFrame, text_col: str = "text", shape: Shape = Shape()) -> tuple[Model, DataFrame]:
    """The model and the table of all counts (``word, n``), from whole texts."""
    counts = cut(count_words(rows, text_col))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    model = Model(shape, most_frequent(counts, shape.head), sums.total, sums.distinct)
    if model.head:
        model.params = train(rows, text_col, model)
    return model, counts


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Of each row the log of the sum of the exponentials; ``s`` is used up."""
    top = s.max(initial=0.0)  # scores are some tens at most, so one shift does for all rows
    if top > 40:
        s -= top
    np.exp(s, out=s)
    return np.log(s.sum(1)) + (top if top > 40 else 0.0)


def _products(h: np.ndarray, vectors: np.ndarray, biases: np.ndarray) -> np.ndarray:
    out = h @ vectors.T
    out += biases
    return out


def log_probs(params: Params, tokens: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of the tokens after their contexts: of the class, and of the token within it."""
    starts = class_starts(len(params.b))
    classes = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[tokens]
    out = np.empty(len(tokens))
    # contexts that recur are predicted once
    code = np.zeros(len(tokens), np.int64)
    for i in range(contexts.shape[1]):
        code = code * (len(params.b) + 1) + contexts[:, i]
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    hat = params.predict(contexts[first])
    sums = np.concatenate([_log_sum(_products(hat[lo : lo + 1024], params.qc, params.bc)) for lo in range(0, len(hat), 1024)]) if len(hat) else np.zeros(0)
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(len(starts)))
    for c in np.flatnonzero(np.diff(ends)).tolist():
        x, y = starts[c], starts[c + 1]
        step = max(1024, CACHED // (y - x))
        for lo in range(ends[c], ends[c + 1], step):
            part = order[lo : min(lo + step, ends[c + 1])]
            of = which.take(part)
            h = hat.take(of, 0)
            each = h @ params.qc[c] + params.bc[c] - sums.take(of)
            if y - x > 1:
                t = tokens.take(part)
                each += np.einsum("ij,ij->i", h, params.q.take(t, 0)) + params.b.take(t) - _log_sum(_products(h, params.q[x:y], params.b[x:y]))
            out[part] = each
    return out / np.log(10)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``carry``, ``n_tokens, n_known, train_tokens, base_score, score``.

    A null text counts as empty and has the end token only. Rows that repeat id and
    text get the same row each. With nothing learned every word is unknown and the
    scores are those of the base formula with no counts.
    """
    spark, shape = docs.sparkSession, model.shape
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), F.struct(F.col(id_col), *[F.col(c) for c in carry], F.xxhash64(text).alias("_fp")).alias("doc"))
    shared = spark.sparkContext.broadcast(model)  # head and tokens: numbers fixed by the shape
    schema = pa.schema([("at", pa.int32()), ("word", pa.binary()), ("tf", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())])
    denominator, rest = float(np.log10(model.total + model.distinct + 1)), float(np.log10(model.rest))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, task, nth = shared.value, TaskContext.get().partitionId(), 0
        n, own = len(m.prior), len(m.tokens)
        logs = np.log10(np.array([*m.head.values(), 0], float) + 1)  # last, at -1: none of the head
        for part, texts in _texts(batches):
            words, ranks, lengths = m.ranks(texts)
            tokens, known, starts = m.ids(ranks), ranks >= 0, np.cumsum(lengths) - lengths
            if m.params is not None:
                each = log_probs(m.params, tokens, contexts_of(tokens, lengths, n, shape.context))
            else:
                each = np.zeros(len(tokens))
            # of the head all is known here; a word of it without a token of its own has its share among the others
            logged = logs[ranks]
            base = np.where(known, logged - denominator, 0.0)
            lm = np.add.reduceat(each + np.where(known & (ranks >= own), logged - rest, 0.0), starts)
            n_known, base = np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts)
            unknown = np.flatnonzero(~known)
            of = np.repeat(np.arange(len(texts)), lengths)[unknown].tolist()
            tail = Counter(zip(of, map(words.__getitem__, unknown.tolist()), strict=True))
            k, nth = len(texts), nth + 1
            # a key of its own for each text's own row, so that the join with the counts deals them out
            doc_rows = [pa.array(range(k), pa.int32()), pa.array([b"\n\n%d.%d.%d" % (task, nth, i) for i in range(k)], pa.binary()), pa.nulls(k, pa.int32()), pa.array(lengths, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(lm, pa.float64())]
            j = len(tail)
            tail_rows = [pa.array([x for x, _ in tail], pa.int32()), pa.array([w for _, w in tail], pa.binary()), pa.array(list(tail.values()), pa.int32()), *(pa.nulls(j, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            doc = part.column(1)
            for cols in (doc_rows, tail_rows):
                for lo in range(0, len(cols[0]), 10_000):
                    own_rows = [c.slice(lo, 10_000) for c in cols]
                    yield pa.RecordBatch.from_arrays([doc.take(own_rows[0]), *own_rows[1:]], ["doc", *schema.names[1:]])

    kind = dict(rows.dtypes)["doc"]
    seen = rows.mapInArrow(read, f"doc {kind}, word binary, tf int, n_tokens long, n_known long, base double, lm double")
    tail = counts.select(F.col("word").alias("w"), F.col("n").alias("c"))
    met = seen.join(tail, F.col("word") == F.col("w"), "left")
    many, count = F.col("tf"), F.coalesce("c", F.lit(0))
    sums = met.groupBy("doc").agg(
        F.count("n_tokens").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum("n_known"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), many)), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(many * (F.log10(count + 1) - denominator)), F.lit(0.0))).alias("base_score"),
        (F.sum("lm") + F.coalesce(F.sum(many * (F.log10(count + 1) - rest)), F.lit(0.0))).alias("score"),
    )
    # rows that repeat id and text were summed together: taken apart again
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = lambda c: (F.col(c) / F.col("copies"))
    return each.select(F.col(f"doc.{id_col}"), *[F.col(f"doc.{c}") for c in carry], share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"))


def held_out(id_col: str, mod: int = 7, rest: int = 2) -> Column:
    """Whether a document is kept from training; one without an id always is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(True))


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """Fits on the documents that aren't held out and scores all: ``id_col, held_out`` and what :func:`score` gives."""
    text_batches(docs.sparkSession)
    rows = docs.select(id_col, text_col).withColumn("held_out", held_out(id_col))
    model, counts = fit(rows.where("NOT held_out").drop("held_out"), text_col, shape)
    return score(rows, model, counts, id_col, text_col, ("held_out",))
