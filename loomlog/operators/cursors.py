"""Consumers' progress, quorums and memberships as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import scalars


def lag(cursors: DataFrame, status: DataFrame) -> DataFrame:
    """``cursor_id, stream_id, position, next_offset, pending, caught_up``; what lies before the cursor never counts below zero."""
    joined = cursors.join(status.select("stream_id", "next_offset"), "stream_id")
    pending = F.greatest(F.col("next_offset") - F.col("position"), F.lit(0))
    return joined.select("cursor_id", "stream_id", "position", "next_offset", pending.alias("pending"), (pending == 0).alias("caught_up"))


def pending_window(history: DataFrame, from_offset: int) -> DataFrame:
    """``from_offset, next_offset, pending, caught_up`` of a consumer of one stream."""
    head = F.coalesce(F.max("offset") + 1, F.lit(0))
    return history.agg(F.lit(from_offset).cast("long").alias("from_offset"), head.alias("next_offset"), F.count_if(F.col("offset") >= from_offset).alias("pending"), (head <= from_offset).alias("caught_up"))


def quorum(acks: DataFrame, offset: int, members: str = "members") -> DataFrame:
    """``stream_id, acked, needed, reached`` from each peer's highest acknowledged offset; the writer counts as one."""
    counts = acks.groupBy("stream_id").agg(F.max(members).alias("members"), (F.count_if(F.col("acked_offset") >= offset) + 1).alias("acked"))
    return counts.select("stream_id", "acked", scalars.quorum_size(F.col("members")).alias("needed")).withColumn("reached", F.col("acked") >= F.col("needed"))


def live_members(heartbeats: DataFrame, now: int) -> DataFrame:
    """Nodes whose last heartbeat has not expired."""
    return heartbeats.groupBy("node_id").agg(F.max("expires_at").alias("expires_at")).where(F.col("expires_at") > now).select("node_id")


def frontier_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Streams of ``a`` with ``caught_up``: whether ``b`` has the same frontier (manifest, generation, root, next offset)."""
    same = ["manifest_id", "generation", "root", "next_offset"]
    other = b.select("stream_id", F.struct(*same).alias("theirs"))
    return a.join(other, "stream_id", "left").select("stream_id", F.struct(*same).eqNullSafe(F.col("theirs")).alias("caught_up"))


def missing_segments(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What a replica has to fetch; a segment of the same number with another digest is a divergence and raises."""
    both = remote.alias("r").join(local.alias("l"), ["stream_id", "segment_id"])
    if both.where("r.digest <> l.digest").limit(1).count():
        raise ValueError("the replica has diverged")
    return remote.join(local.select("stream_id", "segment_id"), ["stream_id", "segment_id"], "left_anti")
