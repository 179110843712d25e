"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal bytes, and a fluid schedule shares every
moment among the sources that have not ended, by their targets. A block is released
in the slot in which the fluid schedule begins it and due at the end of that in which
it is done; the earliest deadline among the released goes first. So at every slot
each source is less than one block from its target, also where another one ends and
its share goes to the rest.

In the fluid schedule source s has got ``min(blocks, parts * v)`` at the virtual time
v, so it ends at v = blocks / parts; between two ends the real time is ``E + v P``,
of the blocks E of those that have ended and the parts P of the others. Releases and
deadlines are thus whole numbers that follow from a block's number without rounding,
for targets of any denominators. Blocks get larger with the corpus, so that there
are about a million at most; their slots are a small table that the rows are joined with.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks in all, besides one for each source: blocks of a larger corpus are larger.
BLOCKS = 1 << 20
#: More sources than this are refused: targets are given for each.
MOST_SOURCES = 1 << 20
#: Slots of a source in one row of their table, and the rows up to which it is broadcast (1 kB each).
RUN, MOST_BROADCAST = 256, 20_000


def parts_of(weights: dict) -> dict:
    """The weights as whole parts, exactly: what a decimal or fraction says, nothing is rounded."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    whole = lcm(*(x.denominator for x in exact.values()))
    counts = {s: int(x * whole) for s, x in exact.items()}
    common = gcd(*counts.values())
    return {s: n // common for s, n in counts.items()}


def slots(blocks: dict, parts: dict) -> dict:
    """Of each source the slots of its blocks, in their order."""
    ends = sorted(blocks, key=lambda s: (Fraction(blocks[s], parts[s]), s))
    # from the end of one source to that of the next: blocks of the ended, parts of the others, the next to end
    ended, others, phases = 0, sum(parts.values()), []
    for s in ends:
        phases.append((ended, others, blocks[s], parts[s]))
        ended += blocks[s]
        others -= parts[s]

    def time(k: int, s, phase: int) -> tuple[int, int, int]:
        """Real time at which the fluid schedule has done k blocks of s, rounded down and up, and its phase."""
        p, step = parts[s], 1
        past = lambda j: k * phases[j][3] > phases[j][2] * p
        while past(min(phase + step, len(phases)) - 1):
            phase, step = phase + step, 2 * step
        lo, hi = phase, min(phase + step, len(phases)) - 1
        while lo < hi:  # the first phase that ends no earlier
            middle = (lo + hi) // 2
            lo, hi = (middle + 1, hi) if past(middle) else (lo, middle)
        e, all_parts = phases[lo][:2]
        return e + k * all_parts // p, e - (-k * all_parts // p), lo

    out: dict = {s: [] for s in blocks}
    rank = {s: i for i, s in enumerate(sorted(blocks))}
    state = dict.fromkeys(blocks, (0, 0, 0))
    ready: list = []
    releases: dict[int, list] = {0: list(rank)} if blocks else {}
    for t in range(ended):
        for s in releases.pop(t, ()):
            state[s] = time(len(out[s]) + 1, s, state[s][2])
            heapq.heappush(ready, (state[s][1], rank[s], s))
        s = heapq.heappop(ready)[2]
        out[s].append(t)
        if len(out[s]) < blocks[s]:  # the next is begun when this one is done
            releases.setdefault(max(t + 1, state[s][0]), []).append(s)
    return out


def _placed(docs: DataFrame, source_col: str, id_col: str, text_col: str, weights: dict | None, block_bytes: int, blocks: int, temperature: float, buckets: int, most_broadcast: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` as ``_row``, with ``_source, _bytes, _start, _block, _slot``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(source_col).cast("string").alias("_source"), F.greatest(F.octet_length(text), F.lit(1)).cast("long").alias("_bytes"), F.xxhash64(F.col(id_col), text).alias("_mix"), F.col(id_col).alias("_id"))
    rows = rows.withColumns({"_bucket": F.pmod("_mix", F.lit(buckets)), "_source": F.coalesce("_source", F.lit("")), "_null": F.col("_source").isNull()})

    # a source may hold any share of the rows: it is numbered bucket by bucket, from summed sizes
    sizes = rows.groupBy("_source", "_bucket").agg(F.sum("_bytes").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    totals = {r._source: r.n for r in sizes.groupBy("_source").agg(F.sum("_sum").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    if weights is not None and (bad := [s for s in totals if not weights.get(s) or weights[s] <= 0]):
        raise ValueError(f"no positive weight for {sorted(bad)[:5]}")
    chosen = {s: max(1, round(1000 * n**temperature)) for s, n in totals.items()} if weights is None else parts_of({s: weights[s] for s in totals}) if totals else {}
    size = max(block_bytes, -(-sum(totals.values()) // blocks))
    found = slots({s: -(-n // size) for s, n in totals.items()}, chosen)
    runs = [(s, i // RUN, own[i : i + RUN]) for s, own in found.items() for i in range(0, len(own), RUN)]
    table = docs.sparkSession.createDataFrame(runs, "_source string, _run long, _slots array<int>")

    within = Window.partitionBy("_source", "_bucket").orderBy("_mix", "_id", "_bytes").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_bytes").over(within), F.lit(0))).join(offsets, ["_source", "_bucket"])
    placed = placed.withColumn("_start", F.col("_before") + F.col("_in")).withColumn("_block", F.floor(F.col("_start") / size).cast("long"))
    placed = placed.withColumn("_run", F.expr(f"_block div {RUN}"))
    placed = placed.join(F.broadcast(table) if len(runs) <= most_broadcast else table, ["_source", "_run"])
    slot = F.expr(f"_slots[cast(_block % {RUN} as int)]").cast("long")
    return placed.select("_row", F.when(~F.col("_null"), F.col("_source")).alias("_source"), "_bytes", "_start", "_block", slot.alias("_slot"))


def schedule(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None, block_bytes: int = 64 << 10, blocks: int = BLOCKS, temperature: float = 0.5, buckets: int = 4096, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per input row: ``id_col, source, n_bytes, start, block, slot``; sorted by ``slot, start`` it is the mix.

    ``weights`` gives each source its target, met exactly: decimals and fractions
    count as written. Without it the targets go by the bytes of the sources to the
    power ``temperature``. A block has ``block_bytes``, or more where the corpus would
    have over ``blocks`` of them. ``start`` is where the document
    begins in its source, in an order by hash; a document belongs to the block where
    it begins, so after any slot the bytes of a source are its blocks' and less than
    its longest document more, and a block within a long document is empty. Nothing
    is left out or repeated.
    A null text weighs one byte like an empty one. A null source is a source of its
    own, named "" in ``weights``. Rows that repeat each other are each scheduled.
    """
    placed = _placed(docs.select(F.col(id_col), F.col(source_col), F.col(text_col)), source_col, id_col, text_col, weights, block_bytes, blocks, temperature, buckets, most_broadcast, [id_col])
    return placed.select(F.col(f"_row.{id_col}").alias(id_col), F.col("_source").alias("source"), F.col("_bytes").alias("n_bytes"), F.col("_start").alias("start"), F.col("_block").alias("block"), F.col("_slot").alias("slot"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None, block_bytes: int = 64 << 10, blocks: int = BLOCKS, temperature: float = 0.5, buckets: int = 4096, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All columns and rows of ``docs`` in the order of the mix; partitions follow each other in it."""
    placed = _placed(docs, source_col, id_col, text_col, weights, block_bytes, blocks, temperature, buckets, most_broadcast, docs.columns)
    return placed.repartitionByRange("_slot", "_start").sortWithinPartitions("_slot", "_start").select("_row.*")
