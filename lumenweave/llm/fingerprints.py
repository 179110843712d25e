"""Document fingerprints by Order MinHash.

A text is cut into pieces, and every run of ``k`` pieces is a k-mer, numbered by how
often it stood before, so that a repeated passage counts as often as it stands. The
hash of a numbered k-mer deals it to one of ``entries`` buckets and ranks it there.
Of each bucket the ``length`` smallest are selected and put back into the order in
which they stand in the text; the hash of that tuple is one entry. Two texts agree in
an entry if the same k-mers are minimal and stand in the same order, so moved text
costs likeness as well as changed text, as in an edit distance.

All of it is built-in expressions over arrays: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.session import written

#: Pieces: single characters of scripts that put no blanks between words, else up to 16 characters without a blank.
ALONE = r"\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
PIECE = rf"[{ALONE}]|[^\s{ALONE}]{{1,16}}"
#: Hexadecimal digits of an entry; a bucket without a k-mer has as many of EMPTY.
DIGITS = 8
EMPTY = "-"
#: Splitters are looked up in steps of this many.
STEP = 64


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 3, length: int = 2, bits: int = 6) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as ``name``: ``2 ** bits`` entries of :data:`DIGITS` characters.

    ``k``: pieces in a k-mer; a text of fewer has one k-mer of all its pieces.
    ``length``: k-mers in a tuple. Null counts as empty, and an empty text has
    :data:`EMPTY` in every entry. Columns ``_p``, ``_g``, ``_z``, ``_s`` are used on the way.
    """
    kmer = "xxhash64(x, " + ", ".join(f"get(_p, i + {j})" for j in range(1, k)) + ")" if k > 1 else "x"
    # the pieces' hashes, then those of their runs
    df = df.withColumn("_p", F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))
    df = df.withColumn("_g", F.expr(f"transform(slice(_p, 1, greatest(size(_p) - {k - 1}, least(size(_p), 1))), (x, i) -> {kmer})"))
    # numbered: equal k-mers are side by side when sorted, and a k-mer's number is its place behind the first of them
    df = df.withColumn("_z", F.expr("IF(size(array_distinct(_g)) = size(_g), NULL, sort_array(transform(_g, (x, i) -> named_struct('g', x, 'i', i))))"))
    df = df.withColumn("_s", F.expr("filter(slice(sequence(0, size(_z)), 1, size(_z)), i -> i = 0 OR _z[i].g <> _z[i - 1].g)"))
    one = "named_struct('h', xxhash64({g}, {n}), 'i', {i}, 'g', {g})"
    once = f"transform(_g, (x, i) -> {one.format(g='x', n='0', i='i')})"
    more = f"flatten(transform(_s, (s, r) -> transform(slice(_z, s + 1, coalesce(get(_s, r + 1), size(_z)) - s), (x, n) -> {one.format(g='x.g', n='n', i='x.i')})))"
    df = df.withColumn("_z", F.expr(f"sort_array(IF(_z IS NULL, {once}, {more}))"))
    # the leading bits of the hash are the bucket: in order of the hash, buckets follow each other and each has its smallest first
    bucket = f"shiftright({{}}.h, {64 - bits})"
    df = df.withColumn("_s", F.expr(f"filter(slice(sequence(0, size(_z)), 1, size(_z)), i -> i = 0 OR {bucket.format('_z[i]')} <> {bucket.format('_z[i - 1]')})"))
    least = f"filter(slice(_z, s + 1, {length}), x -> {bucket.format('x')} = {bucket.format('_z[s]')})"
    ordered = f"transform(sort_array(transform({least}, x -> named_struct('i', x.i, 'g', x.g))), x -> x.g)"
    entry = f"lower(right(lpad(hex(xxhash64({ordered})), 16, '0'), {DIGITS}))"
    before = f"IF(r = 0, {-(1 << bits - 1) - 1}, {bucket.format('_z[_s[r - 1]]')})"
    gap = f"repeat('{EMPTY}', cast({DIGITS} * ({bucket.format('_z[s]')} - {before} - 1) as int))"
    whole = f"rpad(array_join(transform(_s, (s, r) -> concat({gap}, {entry})), ''), {DIGITS << bits}, '{EMPTY}')"
    return df.withColumn(name, F.expr(whole)).drop("_p", "_g", "_z", "_s")


def likeness(a: str | Column, b: str | Column, bits: int = 6) -> Column:
    """The share of entries in which two fingerprints agree, of those that either has; 1 if neither has any."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    at = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    part = lambda f, i: F.substr(f, i * DIGITS + 1, F.lit(DIGITS))
    none = F.lit(EMPTY * DIGITS)
    same = F.size(F.filter(at, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != none)))
    some = F.size(F.filter(at, lambda i: (part(a, i) != none) | (part(b, i) != none)))
    return F.when(a == b, 1.0).otherwise(same / F.greatest(some, F.lit(1)))


def _ranges(keys: DataFrame) -> list:
    """The first key (id, fp) of each of the ranges into which Spark deals ``keys``: no more rows than partitions.

    Four ranges to a partition: a hash deals them out, and several even out.
    """
    n = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, "id", "fp").select("id", "fp", F.spark_partition_id().alias("part"))
    return sorted((r.k for r in dealt.groupBy("part").agg(F.min(F.struct("id", "fp")).alias("k")).select("k").collect()), key=lambda k: (k.id is not None, k.id, k.fp))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``range, place, own, id, fp, text, next``: each text beside the one that follows by id; after the last, the first.

    Null ids come first; rows of one id are in order of their text's hash. Texts
    travel once, each range sorted by itself; the first row of a range also goes to
    the range before, with ``own`` false, and the very first to the last range.
    ``range`` and ``place`` give the order: a window over them moves nothing again.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    keys = written(rows.select("id", "fp"))
    firsts = _ranges(keys)
    kind = keys.select(F.struct("id", "fp").alias("k")).schema["k"].dataType.simpleString()
    key = F.struct("id", "fp")
    listed = keys.sparkSession.createDataFrame([([(f.id, f.fp) for f in firsts],)], f"_f array<{kind}>")
    rows = rows.crossJoin(F.broadcast(listed))  # one row: as many splitters as ranges
    # a splitter is looked up among every STEP-th, then among those between
    rows = rows.withColumn("_k", key).withColumn("_c", F.expr(f"size(filter(transform(sequence(1, greatest(size(_f), 1), {STEP}), j -> get(_f, j - 1)), f -> f <= _k)) - 1"))
    rows = rows.withColumn("_r", F.expr(f"_c * {STEP} + size(filter(slice(_f, _c * {STEP} + 1, {STEP}), f -> f <= _k)) - 1"))
    here = F.struct(F.col("_r").alias("range"), F.lit(0).alias("_wrap"), F.lit(True).alias("own"))
    back = F.struct(F.when(F.col("_r") > 0, F.col("_r") - 1).otherwise(F.size("_f") - 1).alias("range"), (F.col("_r") == 0).cast("int").alias("_wrap"), F.lit(False).alias("own"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_k") == F.expr("get(_f, _r)"), F.array(here, back)).otherwise(F.array(here)))).select("_at.*", "id", "fp", "text")
    rows = rows.withColumn("place", F.struct("_wrap", "id", "fp", ~F.col("own"))).drop("_wrap")
    return rows.withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy("place")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, length: int = 2, bits: int = 6) -> DataFrame:
    """One row per input row: the fingerprint of its text and of its edited text, and how alike they are.

    ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has the last half of the characters (rounded down)
    replaced by as many, or all, of the first of the next document; after the last
    document the first is the next, and a single document is its own next. Null
    counts as empty: it has 0 characters, is its own edited text, and its fingerprint
    is like that of another empty text (1) and of no other (0). Null ids come first,
    rows of one id are ordered by their text's hash, and rows that repeat both are
    each returned. An empty table gives no row; other columns of ``docs`` are ignored.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n", F.length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.when(F.col("own"), F.concat(F.substr("text", F.lit(1), F.col("n").cast("int") - half), F.substr("next", F.lit(1), half)))
    rows = rows.withColumn("edited", edited).drop("next")
    rows = with_fingerprint(rows, "text", "fingerprint", k, length, bits).drop("text").withColumn("sha", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", k, length, bits).drop("edited")
    rows = rows.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))).where("own")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", bits).alias("near_edited"), likeness("fingerprint", "next", bits).alias("near_next"),
    )
