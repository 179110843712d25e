"""Who may see what: tenants, lists of videos, times and kinds, as filters put before any search or path."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope(rows: DataFrame, user: str | int | None = None, videos: Collection | None = None, video: str | int | None = None, user_col: str = "user_id", video_col: str = "video_id") -> DataFrame:
    """Rows of a user, and of a list of videos or else of one.

    A list beats a single video. An empty list allows nothing; no list, and no user,
    allow everything.
    """
    if user is not None:
        rows = rows.where(F.col(user_col) == user)
    if videos is not None:
        return rows.where(F.col(video_col).isin(*videos)) if videos else rows.limit(0)
    return rows.where(F.col(video_col) == video) if video is not None else rows


def scoped_edges(edges: DataFrame, nodes: DataFrame, user: str | int, node: str = "node", user_col: str = "user_id") -> DataFrame:
    """Edges whose both ends belong to the user, so that every path over them does."""
    own = nodes.where(F.col(user_col) == user).select(F.col(node).alias("_n")).distinct()
    for end in ("src", "dst"):
        edges = edges.join(own, F.col(end) == F.col("_n"), "left_semi")
    return edges


def time_bounds(rows: DataFrame, at: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows from ``lo`` to ``hi``; a side that isn't given is open."""
    if lo is not None:
        rows = rows.where(F.col(at) >= lo)
    return rows.where(F.col(at) <= hi) if hi is not None else rows


def time_range(lo: float | None, hi: float | None) -> tuple[float, float] | None:
    """A range only if both sides are given."""
    return (lo, hi) if lo is not None and hi is not None else None


def kinds(rows: DataFrame, allowed: Collection[str] | None, column: str = "type") -> DataFrame:
    """Rows of the kinds; none given, or "any" among them, is all."""
    return rows if not allowed or "any" in allowed else rows.where(F.col(column).isin(*allowed))
