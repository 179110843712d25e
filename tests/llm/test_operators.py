"""Each operator against brute force or SQL, on the driver's smallest tables and on rows made to be awkward."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import decontaminate as D
from lumenweave.llm import language_id as LI
from lumenweave.llm import license_scan as LS
from lumenweave.llm import line_dedup as LD
from lumenweave.llm import lm_score as LM
from lumenweave.llm import mixing as M
from lumenweave.llm import near_dedup as N
from lumenweave.llm import queries as Q
from lumenweave.llm import suffix_dedup as SD
from lumenweave.llm import token_shards as T
from lumenweave.llm.components import components
from lumenweave.llm.exact_dedup import exact_dedup
from lumenweave.session import new_path
from tests.compare import DATA, plain, same

PASSAGE = " ".join(f"word{i} of{i % 7}" for i in range(40))
MIT = next(iter(LS.NOTICES))
TEXTS = [
    None, "", "   ", "...", "a", "A", "same text here for all", "Same TEXT here for all", "École É and é", "x\x00y\tz", PASSAGE, PASSAGE + " tail", "lead " + PASSAGE,
    f"See the MIT License, and {MIT.upper()} and so on", "GNU general public license. Apache License; CC-BY", "cc\nby", "licensed under apache licens", "line one is a long enough line\nshort\nline one is a long enough lime\nshort\n\n",
    "aaaa " * 200, "z" * 450, ("the cat sat on the mat and " * 3000), "日本語 テキスト 日本語", "\U0001f600 \U0001f600", "<|endoftext|> is text", "one two three four five six seven eight nine ten eleven twelve",
]
#: Names that the operators use inside.
CLASH = ["id", "fp", "norm", "head", "mix", "slice", "sha", "size", "node", "key", "a", "b", "w", "word", "n", "doc", "start", "pos", "term", "block", "keep_id", "kept", "score", "_source", "_held", "label"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[10], (None, "no id, but a text", "en", "s1", 3), (None, PASSAGE, "fr", "s1", 3), (-7, "negative id", "fr", "s2", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def unique(awkward):
    """Without ids that are null or repeated, for SQL that joins by id."""
    return awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sql_same(df, docs, sql, benchmark=None):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    if benchmark is not None:
        con.register("benchmark", benchmark.select("item_id", "text").toPandas())
    want, columns = con.sql(sql), sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(Q.QUERIES[name](spark, DATA), Q.ORACLE_SQL[name])


OPERATORS = {
    "exact": exact_dedup, "license": LS.license_scan, "line": LD.line_dedup, "near": N.near_dedup, "suffix": SD.suffix_dedup, "language": LI.identify, "mixing": M.schedule, "lm": lambda d: LM.lm_score(d, shape=LM.Shape(words=8, least=1, size=4, noise=4)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_row_counts(awkward, empty, name):
    assert OPERATORS[name](empty).collect() == []
    got = OPERATORS[name](awkward)
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(i) for i, _ in rows_of(awkward))


def test_exact_dedup(awkward):
    docs = rows_of(awkward)
    low = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for keep, best in (("largest", max), ("smallest", min)):
        groups = defaultdict(list)
        for i, t in docs:
            groups[hashlib.sha256(low(t).encode()).hexdigest()].append(i)
        got = exact_dedup(awkward, keep=keep, slices=3, hot=1).collect()
        for r in got:
            own = groups[r.text_sha256]
            ids = [i for i in own if i is not None]
            assert r.group_size == len(own) and r.keep_id == (best(ids) if ids else None)
        assert all(sum(r.kept for r in got if r.text_sha256 == g) == 1 for g in groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_license_scan(unique):
    sql_same(LS.license_scan(unique), unique, Q.OP2_SQL)
    got = {r.doc_id: r for r in LS.license_scan(unique).collect()}
    assert got[13].base_labels == "mit" and got[13].labels == "mit" and got[14].base_labels == "apache,cc-by,gpl" and got[15].n_base == 1 and got[16].score == 0


def test_license_notice_with_a_word_more(spark):
    words = MIT.split()
    text = " ".join([*words[:6], "really", *words[6:]])
    got = LS.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "mit" and got.n_base == 0 and got.score >= 0.8


def test_license_notices_stand_out_from_their_own_words(spark):
    """Each notice in full among repeats of its own words, after and before them, twice, and cut off in the middle."""
    rows, want = [], {}
    for nth, (notice, label) in enumerate(LS.NOTICES.items()):
        words = notice.split()
        tail, head, mixed = " ".join(words[-3:] * 12), " ".join(words[:3] * 9), " ".join(words[i] + " " + words[i + 1] for i in range(len(words) - 2, -1, -1))
        texts = [f"{notice} {tail}", f"{head} {notice}", f"{tail} {notice} {head}", f"{mixed} {notice} {mixed}", f"{notice} {notice}", " ".join(words[: len(words) // 2]) + " " + head]
        for j, text in enumerate(texts):
            rows.append((10 * nth + j, text))
            want[10 * nth + j] = label if j < 5 else None
    docs = spark.createDataFrame([(i, text, "en", "web") for i, text in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in LS.license_scan(docs).collect()}
    for i, label in want.items():
        assert (label in got[i].labels.split(",") and got[i].score == 1) if label else got[i].labels == got[i].base_labels, (i, got[i])
    spans = LS.license_spans(docs).where("NOT exact").groupBy("id", "template").count().collect()
    assert all(r["count"] == 2 for r in spans if r.id % 10 == 4)
    sql_same(LS.license_scan(docs), docs, Q.OP2_SQL)


@pytest.fixture(scope="module")
def items(spark):
    texts = [None, "", " ".join(PASSAGE.split()[10:25]), "one two three four five six seven eight nine ten eleven", "Cat sat", "of0", PASSAGE, PASSAGE, "unseen words only in here", "日本語 テキスト"]
    return spark.createDataFrame([(i if i != 7 else 6, t) for i, t in enumerate(texts)] + [(None, "the mat and the cat")], "item_id long, text string").withColumns({"doc": F.lit("x"), "key": F.lit("y")})


def test_decontaminate(spark, awkward, unique, items):
    sql_same(D.decontaminate(unique, items.where("item_id IS NOT NULL")).drop("text_hash"), unique, Q.OP10_SQL, items.where("item_id IS NOT NULL"))
    got = D.decontaminate(awkward, items)
    assert got.count() == awkward.count()
    assert got.where("doc_id = 10").count() == 2
    assert not any(r.contaminated for r in D.decontaminate(awkward, items.limit(0)).collect())
    assert D.decontaminate(awkward.limit(0), items).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma beta"), (4, "alpha q q q q q beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id for r in D.proximity(docs, bench, slop=1).collect()} == {1, 2}


def shingle_components(docs, k, percent):
    sets = []
    for _, t in docs:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[find(i)].append(d)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(spark, awkward, k):
    rng = random.Random(k)
    base = [f"w{i}" for i in range(60)]
    copies = []
    for g in range(6):
        words = [f"{g}{w}" for w in base]
        for _ in range(40 if g == 0 else 6):  # a chain of edits: its ends are far apart
            words[rng.randrange(60)] = f"e{rng.random()}"
            copies.append(" ".join(words))
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(copies)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(made)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.near_dedup(docs, words=k).collect())
    want = shingle_components(rows_of(docs), k, 80)
    assert got == sorted((str(a), b, str(c)) for a, b, c in want)


def test_line_links_of_a_hot_segment(spark):
    rng = random.Random(5)
    lines = [f"a notice that all of these lines begin with, no {rng.randrange(10**6):06d}" for _ in range(300)]
    lines += [x[:-1] + "x" for x in lines[:40]]
    texts = LD.keyed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text").select("id", "fp", "text")
    firsts = texts.mapInArrow(LD._lines, "h1 long, h2 long, id long, fp long, no int").groupBy("h1", "h2").agg(F.min(F.struct("id", "no", "fp")).alias("first"), F.count("*").alias("n"))
    got = {frozenset((r.a.h1, r.b.h1)) for r in LD.line_links(texts, firsts, 2, 20, hot=50, tile=64).collect()}
    distinct = sorted({LD.normal(x) for x in lines})
    assert got == {frozenset((LD._hash(x)[0], LD._hash(y)[0])) for x, y in combinations(distinct, 2) if LD.distance(x, y, 2) <= 2} and got
    # a task hands a hot segment on, a batch at a time, and compares none of it
    batch = lambda side: pa.RecordBatch.from_pydict({"k": [8 | side] * 40, "h1": list(range(40)), "bag": [0] * 40})
    out = list(LD._meet(2, 50)(iter([batch(0)] * 3 + [batch(1)] * 3)))
    assert sum(b.num_rows for b in out) == 240 and max(b.num_rows for b in out) <= 50 + 40 and all(b.column(1).null_count == b.num_rows for b in out)


@pytest.mark.parametrize("named", [256, 0])
def test_near_dedup_links_every_copy_of_a_star_and_a_template(spark, monkeypatch, named):
    monkeypatch.setattr(N, "NAMED", named)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for g in range(1100):  # each within 0.8 of the base and far from each other: only links to the base join them
        words = list(base)
        for i in rng.sample(range(0, 200, 5), 4):
            words[i + 2] = f"c{g} {i}".replace(" ", "x")
        texts.append(" ".join(words))
    page = [f"t{i}" for i in range(100)]
    for g in range(600):  # pages at about 0.7 with each other; every 50th has a copy at over 0.8
        own = [f"p{g}x{i}" for i in range(18)]
        texts.append(" ".join(page + own))
        if g % 50 == 0:
            texts.append(" ".join(page + own[:-8]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_dedup(docs, words=5).collect())
    assert got == sorted(shingle_components(list(enumerate(texts)), 5, 80))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_suffix_dedup(awkward):
    docs = [(i, t.encode()) for i, t in rows_of(awkward)]
    for length in (60, 200):
        seen = Counter(t[s : s + length] for _, t in docs for s in range(len(t) - length + 1))
        want = []
        for i, t in docs:
            gone = bytearray(len(t))
            for s in range(len(t) - length + 1):
                if seen[t[s : s + length]] > 1:
                    gone[s : s + length] = b"\1" * length
            kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
            want.append((str(i), len(t), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in SD.suffix_dedup(awkward, length=length).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("attribute, value", [("MOST_IN_MEMORY", 2), ("MOST_BROADCAST", 0), ("STRETCH", 700)])
def test_suffix_dedup_by_its_other_ways(spark, monkeypatch, attribute, value):
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(400))) + common + "".join(rng.choice("qrs ") for _ in range(rng.randrange(3))) * 30 for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, SD.suffix_dedup(docs, length=100).collect()))
    monkeypatch.setattr(SD, attribute, value)
    assert sorted(map(tuple, SD.suffix_dedup(docs, length=100).collect())) == want
    assert sum(r[2] for r in want) >= 12 * 150


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, line, n):
    line = bytearray(line)
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        line[i : i + rng.randrange(2)] = rng.choice([b"", b"x", b"y"])
    return bytes(line)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(6000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(25)))
        b = changed(rng, a, rng.randrange(5))
        for most in (1, 2, 3):
            assert LD.distance(a, b, most) == min(edits(a, b), most + 1)


def test_line_dedup(spark):
    rng = random.Random(2)
    lines = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randrange(5, 60))) for _ in range(30)]
    texts = ["\n".join(changed(rng, rng.choice(lines), rng.randrange(4)).decode() for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, ""), (101, "\n\n")]
    first = {}
    for i, t in docs:
        for no, line in enumerate(t.split("\n")):
            if n := LD.normal(line):
                first.setdefault(n, (i, no))
    near = {n for n in first for o in first if first[o] < first[n] and min(len(n), len(o)) >= 20 and abs(len(n) - len(o)) <= 2 and edits(n, o) <= 2}
    want = []
    for i, t in docs:
        kept = [line for no, line in enumerate(t.split("\n")) if not (n := LD.normal(line)) or first[n] == (i, no) and n not in near]
        want.append((i, len(t.split("\n")), "\n".join(kept)))
    got = LD.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert near and sorted((r.doc_id, r.n_lines, r.kept) for r in got) == sorted(want)


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = {p: i for i, p in enumerate([b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"])}
    p = rng.random((len(pieces), 2))

    def total(word, j):
        return 1.0 if not word else sum(p[i, j] * total(word[len(x) :], j) for x, i in pieces.items() if word.startswith(x))

    words = ["a", "ab", "abab", "bbaba", "aababba"]
    got = LI.Lattice(words, pieces, 3).scores(p)
    assert got == pytest.approx(np.log([[total(b" " + w.encode(), j) for j in (0, 1)] for w in words]))
    weight = np.arange(1.0, 6.0)
    expected = LI.Lattice(words, pieces, 3).expected(p[:, 0], weight)
    lengths = np.array([len(x) for x in pieces])
    assert expected @ lengths == pytest.approx(sum((len(w) + 1) * x for w, x in zip(words, weight, strict=True)))


def test_long_words_sum_all_segmentations_too():
    rng = np.random.default_rng(1)
    pieces = {p: i for i, p in enumerate([b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"])}
    p = rng.random((len(pieces), 2))
    for word in ("a", "abab", "ab" * 14):
        want = LI.Lattice([word], pieces, 3).scores(p)[0]
        assert LI.long_score(b" " + word.encode(), pieces, 3, p) == pytest.approx(want)
    longer = LI.long_score(b" " + b"ab" * 20_000, pieces, 3, p * 1e-3)
    assert np.isfinite(longer).all() and (longer < -50_000).all()


def brute_language(text, model, pieces):
    """The sum over all segmentations, by its definition, byte by byte."""
    words = [b" " + w.encode() for w in LI.words_in(text)]
    total = np.zeros(len(model.languages))
    for w in words:
        a = [np.ones(len(model.languages))]
        for end in range(1, len(w) + 1):
            a.append(sum((a[start] * model.p[pieces[w[start:end]]] for start in range(end) if w[start:end] in pieces), np.zeros(len(model.languages))))
        total += np.log(a[-1])
    return model.languages[int(total.argmax())] if words else "und", total


def test_language_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = LI.fit(docs.where(~LI.held_out("doc_id")))
    pieces = {b: i for i, b in enumerate(LI.rank_pieces(model.pieces))}
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 1500}
    got = [r for r in LI.identify(docs).collect() if r.doc_id in texts]
    assert len(got) > 50
    for r in got:
        lang, total = brute_language(texts[r.doc_id], model, pieces)
        assert r.lang_pred == lang and (lang == "und" or r.score == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-6))


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = LI.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_of_nothing(awkward):
    got = {r.doc_id: r for r in LI.identify(awkward).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3))
    assert got[4].lang_pred in ("en", "fr") and 0 <= got[4].score <= 1


def test_token_shards(spark, awkward, empty):
    docs = awkward.where("doc_id IS NOT NULL")
    manifest = T.write_token_shards(docs, new_path(spark, "test"))
    got = T.read_token_shards(spark, manifest).orderBy("start").collect()
    from tokenizers import Tokenizer

    from lumenweave.llm.vocab import public_path

    tok, start = Tokenizer.from_file(public_path("word_bpe_49k.json")), 0
    want = sorted(rows_of(docs))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert T.lookup(manifest, i).tolist() == ids
        start += len(ids)
    assert T.lookup(manifest, 10**9) is None
    nulls = T.read_token_shards(spark, T.write_token_shards(awkward, new_path(spark, "test"))).orderBy("start").collect()
    assert [r.doc_id for r in nulls[:2]] == [None, None]
    assert T.read_token_shards(spark, T.write_token_shards(empty, new_path(spark, "test"))).collect() == []


def test_other_tokenizers_encode_whole_texts(spark, awkward):
    from tokenizers import Tokenizer

    from lumenweave.llm.vocab import public_path

    assert isinstance(T.encoder("word_bpe_49k.json"), T.WordIds) and isinstance(T.encoder("byte_bpe_50k.json"), T.WholeIds)
    docs = awkward.where("doc_id IS NOT NULL")
    manifest = T.write_token_shards(docs, new_path(spark, "test"), "byte_bpe_50k.json", 50256)
    got = T.read_token_shards(spark, manifest).orderBy("start").collect()
    tok = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = [zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 50256], "<u4").tobytes()) for _, t in sorted(rows_of(docs))]
    assert [r.ids_crc32 for r in got] == want


def test_shard_has_many_blocks_and_tells_damage(tmp_path):
    import pyarrow.fs as pafs

    entries = [(T.key_of(i), bytes([i % 256, 0]) * (i % 900)) for i in range(0, 3000, 3)]
    path = tmp_path / "s"
    with path.open("wb") as f:
        T.write_shard(f, iter(entries), 2)
    fs = pafs.LocalFileSystem()
    shard = T.Shard(fs.open_input_file(str(path)))
    assert len(shard.index) > 5 and list(shard.scan()) == entries
    assert all(shard.get(i).tolist() == [i % 256] * (i % 900) for i in range(0, 3000, 3)) and all(shard.get(i) is None for i in range(1, 3000, 3))
    data = bytearray(path.read_bytes())
    data[-60] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        T.Shard(fs.open_input_file(str(path)))


def fluid(blocks, parts, t):
    """What each source has got at time t if all that have not ended share it by their parts, found phase by phase."""
    got, at, left = dict.fromkeys(blocks, Fraction(0)), Fraction(0), set(blocks)
    while left:
        all_parts = sum(parts[s] for s in left)
        step = min([t - at, *(Fraction(blocks[s] - got[s]) * all_parts / parts[s] for s in left)])
        for s in left:
            got[s] += step * parts[s] / all_parts
        at += step
        left = {s for s in left if got[s] < blocks[s]}
        if at == t:
            break
    return got


def edf(blocks, parts):
    """Slot by slot: of the blocks that the fluid schedule has begun by then, the one that it ends first goes."""
    total, out, done = sum(blocks.values()), {}, dict.fromkeys(blocks, 0)
    shares = [fluid(blocks, parts, Fraction(t)) for t in range(total + 1)]
    begun = lambda s, k, t: math.ceil(shares[t + 1][s]) > k
    ends = lambda s, k: next(t for t in range(total + 1) if shares[t][s] >= k + 1)
    for t in range(total):
        _, s = min((ends(s, done[s]), s) for s in blocks if done[s] < blocks[s] and begun(s, done[s], t))
        out[s, done[s]] = t
        done[s] += 1
        assert all(abs(done[s] - shares[t + 1][s]) < 1 for s in blocks)
    return out


def by_slot(blocks, parts):
    return {(s, k): t for s, own in M.slots(blocks, parts).items() for k, t in enumerate(own)}


def test_mixing_deviates_by_less_than_a_block():
    rng = random.Random(3)
    for n in (1, 2, 5, 9):
        weights = {i: round(rng.random() ** 2 + 0.01, 3) for i in range(n)} | {n: 0.001}
        blocks = {s: rng.choice([1, 3, 20, 60]) for s in weights}
        got = by_slot(blocks, M.parts_of(weights))
        assert got == edf(blocks, M.parts_of(weights)) and sorted(got.values()) == list(range(sum(blocks.values())))
    assert M.slots({}, {}) == {}
    # parts of any size are met exactly, however long a period that makes
    assert M.parts_of({"a": 1, "b": Fraction(1, 3), "c": 0.0005}) == {"a": 6000, "b": 2000, "c": 3}
    odd = M.parts_of({"a": 1.0, "b": 0.12345678901, "c": Fraction(1, 10**12 + 39)})
    blocks = {"a": 50, "b": 30, "c": 2}
    assert by_slot(blocks, odd) == edf(blocks, odd)


def test_mixing_deviation_on_many_sources():
    """Against the shares in floating point: 4,000 sources of 1 to 40 blocks, most of which end before the last."""
    rng = random.Random(5)
    blocks, parts = {i: 1 + int(40 * rng.random() ** 4) for i in range(4000)}, {i: rng.randint(1, 10**6) for i in range(4000)}
    got = M.slots(blocks, parts)
    total = sum(blocks.values())
    assert sorted(t for own in got.values() for t in own) == list(range(total))
    n, p = np.array([blocks[i] for i in range(4000)]), np.array([parts[i] for i in range(4000)])
    order = np.argsort(n / p)
    v = (n / p)[order]
    left = np.concatenate([p[order][::-1].cumsum()[::-1], [0]])  # parts of those that have not ended
    ends = np.concatenate([[0], n[order].cumsum()])[:-1] + v * left[:-1]
    owner = np.empty(total, int)
    for i, own in got.items():
        owner[own] = i
    done = np.zeros(4000)
    for t in range(total):
        done[owner[t]] += 1
        if t % 97 == 0:
            share = np.minimum(n, p * np.interp(t + 1, np.concatenate([[0], ends]), np.concatenate([[0], v])))
            assert np.abs(done - share).max() < 1 + 1e-6


def test_schedule(awkward):
    weights = {"": 1.0, "s0": 1.0, "s1": 2.0, "s2": 3.5, "s3": Fraction(13, 3)}
    got = M.schedule(awkward, weights=weights, block_bytes=300).collect()
    assert all(r.block == r.start // 300 for r in got)
    names = sorted({r.source or "" for r in got})
    blocks = {s: -(-sum(r.n_bytes for r in got if (r.source or "") == s) // 300) for s in names}
    want = by_slot(blocks, M.parts_of({s: weights[s] for s in names}))
    assert all(r.slot == want[r.source or "", r.block] for r in got)
    for s in names:
        own = sorted((r.start, r.n_bytes, r.block) for r in got if (r.source or "") == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False))
        longest = max(n for _, n, _ in own)
        for k in range(blocks[s]):  # the bytes of the first blocks
            assert min((k + 1) * 300, sum(n for _, n, _ in own)) <= sum(n for _, n, b in own if b <= k) < (k + 1) * 300 + longest
    mixed = M.mix(awkward, weights=weights, block_bytes=300)
    assert mixed.columns == awkward.columns and mixed.count() == awkward.count()
    with pytest.raises(ValueError):
        M.schedule(awkward, weights={"s0": 1.0})


def test_schedule_by_default_against_brute_force(spark):
    rows = [(i, "x" * (37 * i % 211), f"s{min(i % 11, 3)}") for i in range(400)]
    got = M.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_bytes=500).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.n_bytes
    parts = {s: round(1000 * n**0.5) for s, n in sizes.items()}
    want = edf({s: -(-n // 500) for s, n in sizes.items()}, parts)
    assert len(got) == 400 and all(r.slot == want[r.source, r.block] for r in got)


def test_schedule_of_more_sources_than_rows_of_a_batch(spark):
    """3,000 sources, one of them a third of all bytes, and blocks that grow so that there are few enough; with and without broadcast."""
    rows = [(i, "y" * (i % 13), f"s{i}" if i % 3 else "hot") for i in range(4500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.schedule(docs, block_bytes=10, blocks=1000).collect()
    size = got[0].start // got[0].block if got[0].block else None
    total = sum(r.n_bytes for r in got)
    wide = max(10, -(-total // 1000))
    assert all(r.block == r.start // wide for r in got) and (size is None or size >= wide) and len(got) == 4500
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.n_bytes
    want = by_slot({s: -(-n // wide) for s, n in sorted(sizes.items())}, {s: round(1000 * n**0.5) for s, n in sizes.items()})
    assert all(r.slot == want[r.source, r.block] for r in got)
    joined = M.schedule(docs, block_bytes=10, blocks=1000, most_broadcast=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_lm_score(spark, awkward):
    shape = LM.Shape(words=12, least=1, head=20, size=6, noise=5, batch=64)
    docs = [(i, [*t.encode().lower().split(), b"\n"]) for i, t in rows_of(awkward)]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in docs if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), total) for i, ws in docs)
    got = LM.lm_score(awkward, shape=shape).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = sorted((str(i), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in docs)
    assert [x for _, x in sorted((str(r.doc_id), r.base_score) for r in got)] == pytest.approx([x for _, x in base], abs=1e-5)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_is_normalised_and_learns(spark):
    rng = random.Random(6)
    texts = [" ".join(["a b", "c d", "e f g"][rng.randrange(3)] for _ in range(60)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = LM.fit(docs, "text", LM.Shape(words=7, least=1, head=8, size=6, noise=8, batch=64))
    n = len(model.prior)
    contexts = np.array([[i, j] for i in range(n + 1) for j in range(n + 1)])
    sums = sum(10 ** LM.log_probs(model.params, np.full(len(contexts), t), contexts) for t in range(n))
    assert sums == pytest.approx(np.ones(len(contexts)), abs=1e-5)
    got = LM.score(docs, model, counts).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_classes_hold_every_token_once():
    for n in (1, 2, 3, 7, 500, 32769):
        starts = LM.class_starts(n)
        assert starts[0] == 0 and starts[-1] == n and (np.diff(starts) > 0).all() and (n < 2 or starts[-2] == n - 1)


def test_lm_held_out_is_better_than_the_base_at_any_number_of_partitions(spark):
    """The registered shape: the same scores however the table is cut, and better than the base's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scores = []
    for parts in (1, 8, 64):
        got = LM.lm_score(docs.repartition(parts)).collect()
        held = [r for r in got if r.held_out]
        assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held) > 0.05
        scores.append({r.doc_id: r.score for r in got})
    for other in scores[1:]:
        assert max(abs(other[i] - s) for i, s in scores[0].items()) < 1e-3


def test_lm_of_many_shards_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = LM.lm_score(docs, shape=LM.Shape(shard=20_000, batch=128)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.s - got.b) / got.n > 0.03


def brute_score(model, counts, text):
    """The score by its definition: over the whole vocabulary, token by token."""
    p, starts, n = model.params, LM.class_starts(len(model.prior)), len(model.prior)
    total, before = 0.0, [n] * model.shape.context
    for w in [*LM.split_words(text), LM.END]:
        t = model.tokens.get(w, len(model.tokens))
        hat = sum(p.r[c].astype(float) @ p.c[i] for i, c in enumerate(before))
        k = int(np.searchsorted(starts, t, side="right")) - 1
        c = np.exp(p.qc @ hat + p.bc)
        own = np.exp(p.q[starts[k] : starts[k + 1]] @ hat + p.b[starts[k] : starts[k + 1]])
        total += math.log10(c[k] / c.sum() * own[t - starts[k]] / own.sum())
        if t == len(model.tokens):
            total += math.log10((counts.get(w, 0) + 1) / model.rest)
        before = [t, *before[:-1]]
    return total


def test_lm_score_against_brute_force(spark, awkward):
    model, counts = LM.fit(awkward, "text", LM.Shape(words=12, least=1, head=20, size=6, noise=5, batch=64))
    table = {bytes(r.word): r.n for r in counts.collect()}
    got = LM.score(awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), model, counts).collect()
    texts = dict(rows_of(awkward))
    assert all(r.score == pytest.approx(brute_score(model, table, texts[r.doc_id]), rel=1e-4, abs=1e-4) for r in got)


def test_near_dedup_low_bits_lose_no_link(monkeypatch):
    # whatever the sizes and however many shingles share their low bits, a linked pair passes; most others don't
    rng, left, passed, links = np.random.default_rng(9), 0, 0, 0
    for n in (1, 5, 40, 400, 30_000):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 1)), dtype=np.uint64)]))
            may, linked = N._may_be_linked(x.astype(np.uint16), y.astype(np.uint16), 80), N._linked(x, y, 80)
            assert may or not linked
            left, passed, links = left + (n <= 400), passed + (may and n <= 400), links + (linked and n <= 400)
    assert links <= passed < links + left // 8 and links > 10


def test_near_dedup_sets_move_once_to_each_meeting_of_tiles(spark):
    # sets that share a shingle in tiles of one; a tile that meets itself is sent once
    sets = [("a", [1, 2, 3, 4, 5]), ("b", [1, 2, 3, 4, 5, 6]), ("c", [7, 8, 9]), ("d", [7, 8, 10])]
    members = [{"root": r.encode(), "at": 0, "s": np.array(s, np.uint64).tobytes()} for r, s in sets]
    batch = pa.RecordBatch.from_pydict({"x_members": [members, members[:1], members[2:]], "y_members": [[], members[1:2], None]})
    got = [sorted(map(bytes, (x, y))) for b in N._share(80)(iter([batch])) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == [[b"a", b"b"], [b"a", b"b"]]


def test_lm_trainer_moves_a_vector_and_its_bias_at_once():
    """Against AdaGrad row by row: one move for classes, one for words, one for contexts and one for the matrices."""
    prior = np.array([0.4, 0.2, 0.15, 0.1, 0.08, 0.05, 0.02])
    for size in (3, 4):
        shape = LM.Shape(size=size, noise=3, batch=32)
        trainer = LM.Trainer(LM.Params.start(prior, shape), prior, shape, 1)
        moves, step = [], trainer._step

        def checked(param, at, grad, moves=moves, step=step, trainer=trainer, shape=shape):
            seen, before = trainer.seen[id(param)][at] + grad * grad, param[at].copy()
            want = before + shape.rate * grad / np.sqrt(seen)
            step(param, at, grad)
            assert len(set(at.tolist())) == len(at) and np.allclose(param[at], want, atol=1e-6)
            moves.append(param)

        trainer._step = checked
        trainer.learn(np.random.default_rng(2).integers(0, 8, (32, 2)), np.arange(32) % 7)
        assert [id(x) for x in moves] == [id(x) for x in (trainer.classes, trainer.words, trainer.p.r, trainer.p.c)]
        assert np.array_equal(trainer.p.q, trainer.words[:, :size]) and np.array_equal(trainer.p.b, trainer.words[:, size]) and np.abs(trainer.p.b - np.log(prior)).max() > 0
        rows, sums = trainer._by_row(np.array([5, 2, 5]), np.arange(3 * size, dtype=np.float32).reshape(3, size))
        assert rows.tolist() == [2, 5] and np.array_equal(sums, np.array([np.arange(size, 2 * size), 2 * np.arange(size) + 2 * size], np.float32))
