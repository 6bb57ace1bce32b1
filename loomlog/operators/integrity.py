"""Digests of segments and manifests, and their verification.

A segment's digest is built in two levels (records by 1,024, then the groups), so no task gathers a whole segment.
Only content is hashed, never where a file lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators import replay

GROUP = 1024


def with_segment(records: DataFrame, size: int) -> DataFrame:
    """Records with ``segment``: their number by offset, ``size`` records each."""
    return records.withColumn("segment", F.floor(F.col("offset") / size).cast("bigint"))


def segment_summary(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by).agg(F.min("offset").alias("start_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("record_count"), F.sum(F.octet_length("payload")).alias("raw_bytes"))


def segment_digest(records: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``digest``; the digest depends on offsets, payloads and their order."""
    one = F.sha2(F.concat(F.col("offset").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("payload").cast("binary")), 256)
    groups = records.select(*by, "offset", one.alias("d")).groupBy(*by, F.floor(F.col("offset") / GROUP).alias("_group")).agg(F.sort_array(F.collect_list(F.struct("offset", "d"))).alias("x"))
    hashed = groups.select(*by, "_group", F.sha2(F.array_join(F.transform("x", lambda r: r["d"]), ""), 256).alias("g"))
    whole = hashed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_group", "g"))).alias("x"))
    return whole.select(*by, F.sha2(F.array_join(F.transform("x", lambda r: r["g"]), ""), 256).alias("digest"))


def manifest_root(segments: DataFrame) -> DataFrame:
    """``stream_id, root`` over the segments in order: ids, offsets, counts and digests."""
    line = F.concat_ws("|", "segment_id", "start_offset", "last_offset", "record_count", "digest")
    rows = segments.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("start_offset", line.alias("line")))).alias("x"))
    return rows.select("stream_id", F.sha2(F.concat_ws("\n", F.col("stream_id"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")), 256).alias("root"))


def verify(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose records, count, bounds or digest are not as written; ``records`` carry ``stream_id`` and ``segment_id``."""
    by = ["stream_id", "segment_id"]
    now = segment_summary(records, by).join(segment_digest(records, by), by).select(*by, *(F.col(c).alias(f"now_{c}") for c in ("start_offset", "last_offset", "record_count", "digest")))
    both = segments.join(now, by, "full_outer")
    same = [F.col(c).eqNullSafe(F.col(f"now_{c}")) for c in ("start_offset", "last_offset", "record_count", "digest")]
    bad = ~(same[0] & same[1] & same[2] & same[3])
    return both.where(bad).select(*by, "digest", "now_digest")


def contiguity(records: DataFrame) -> DataFrame:
    """Of each stream: first and last offset, count, and whether no offset is missing or doubled."""
    counts = records.groupBy("stream_id").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("n"), F.count_distinct("offset").alias("distinct"))
    return counts.select("stream_id", "first_offset", "last_offset", "n", ((F.col("n") == F.col("distinct")) & (F.col("last_offset") - F.col("first_offset") + 1 == F.col("n"))).alias("contiguous"))


gaps = replay.gaps
