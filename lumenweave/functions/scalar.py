"""Time, number, ladder and vector columns. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days without access and the storage tier from there on, with its price in USD per GB and month.
TIERS = [(180, "Archive", 0.00099), (90, "Cold", 0.0036), (30, "Cool", 0.0115), (0, "Hot", 0.0208)]
# Weights of vector, full-text, graph and temporal scores, by what is asked for.
PROFILES = {
    "default": (0.35, 0.25, 0.25, 0.15), "time-based": (0.25, 0.15, 0.20, 0.40), "object": (0.30, 0.20, 0.35, 0.15), "person": (0.30, 0.20, 0.35, 0.15),
    "text": (0.25, 0.40, 0.20, 0.15), "action": (0.40, 0.20, 0.20, 0.20), "scene": (0.40, 0.20, 0.20, 0.20), "event": (0.35, 0.20, 0.20, 0.25),
}


def clock(seconds: Column) -> Column:
    """``m:ss``, from an hour on ``h:mm:ss``."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def seconds_of(text: Column) -> Column:
    """Seconds of ``m:ss``, ``h:mm:ss`` or a number; null for anything else."""
    p = F.split(F.trim(text), ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 1, part(1)).when(F.size(p) == 2, part(1) * 60 + part(2)).when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def rate(n: Column, total: Column) -> Column:
    """Null without a total; no count is none."""
    return F.when(total > 0, F.round(F.coalesce(n, F.lit(0)) / total, 3))


def frame_rate(text: Column) -> Column:
    """``a/b`` or a number; null if it is neither or b is 0."""
    p = F.split(text, "/")
    a, b = F.get(p, 0).try_cast("double"), F.get(p, 1).try_cast("double")
    return F.when(F.size(p) == 2, F.try_divide(a, b)).when(F.size(p) == 1, a)


def gaussian(t: Column, lo: Column | float, hi: Column | float, missing: float = 0.5) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    d, w = t - (lo + hi) / 2, (hi - lo) / 2
    return F.when(t.isNull(), missing).when(w <= 0, F.when(d == 0, 1.0).otherwise(0.0)).otherwise(F.exp(-0.5 * F.pow(d / w, F.lit(2))))


def degree_score(n: Column) -> Column:
    return F.least(F.lit(1.0), (n + 1) / 50)


def tier(days: Column) -> Column:
    out = F
    for least, name, _ in TIERS[:-1]:
        out = out.when(days >= least, name)
    return out.otherwise(TIERS[-1][1])


def tier_price(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for _, t, p in TIERS for x in (t, p)])[name]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a.cast("array<double>"))


def spread(a: Column, d: int) -> Column:
    """``d`` evenly spaced dimensions, brought to unit length; a vector of no more than ``d`` as it is."""
    return F.when(F.size(a) <= d, a.cast("array<double>")).otherwise(unit(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.get(a, F.floor(i * F.size(a) / d).cast("int")))))


def scene_confidence(segments: Column, frames: Column, gap: Column) -> Column:
    """Confidence in a scene candidate, by what speaks for it."""
    return F.round(F.least(F.lit(0.95), 0.45 + F.when(segments, 0.2).otherwise(0.0) + F.when(frames, 0.15).otherwise(0.0) + F.when(gap, 0.1).otherwise(0.0)), 3)


def strength_weight(strength: Column) -> Column:
    """A strength of 1 to 10 as a weight of 0.1 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), strength / 10))


def transition(score: Column) -> Column:
    return F.when(score > 0.7, "cut").when(score > 0.4, "dissolve").otherwise("fade")


def decode_seek(duration: Column, sample: Column | float) -> Column:
    """Where a sample of a video is decoded: its middle, or earlier if the sample would not fit."""
    return F.greatest(F.lit(0.0), F.least(duration / 2, F.greatest(duration - sample, F.lit(0.0))))


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total > 0 and abs(total - 1) > 1e-9 else dict(weights)
