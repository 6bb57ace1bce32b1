"""Retention: the oldest sealed segments go while they are too old, or more than the budget is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def mark(segments: DataFrame, now: Column | int | None = None, max_age_days: int | None = None, max_bytes: int | None = None, active_bytes: Column | int = 0) -> DataFrame:
    """``segments`` with ``trimmed``. Only a run of the oldest of each stream goes: the first one that may stay keeps all after it.

    Where ``rolled_at`` is null, the file's time (``modified_at``), if there is such a column, stands for it. A segment goes if it was rolled at or before the cutoff, or if with it more than ``max_bytes`` (stored bytes, the active head
    included) would be kept.
    """
    if max_age_days is None and max_bytes is None or max_age_days is not None and max_age_days <= 0 or max_bytes is not None and max_bytes <= 0:
        raise ValueError("a policy needs an age or a budget above zero")
    w = Window.partitionBy("stream_id").orderBy("start_offset")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    goes = F.lit(False)
    if max_age_days is not None:
        rolled = F.coalesce("rolled_at", "modified_at") if "modified_at" in segments.columns else F.col("rolled_at")
        goes = goes | (rolled <= as_column(now) - max_age_days * DAY)
    if max_bytes is not None:
        before = F.coalesce(F.sum("stored_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("stored_bytes").over(Window.partitionBy("stream_id"))
        goes = goes | (as_column(active_bytes) + total - before > max_bytes)
    marked = segments.withColumn("_stays", (~F.coalesce(goes, F.lit(False))).cast("int"))
    return marked.withColumn("trimmed", F.max("_stays").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_stays")


def retained_start(marked: DataFrame, active_start: DataFrame) -> DataFrame:
    """``stream_id, retained_start``: the first segment that stays, else where the active head begins."""
    kept = marked.where("not trimmed").groupBy("stream_id").agg(F.min("start_offset").alias("kept_start"))
    return active_start.join(kept, "stream_id", "left").select("stream_id", F.coalesce("kept_start", "active_start").alias("retained_start"))
