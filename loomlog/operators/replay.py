"""Replay over branches and merges.

``records``: own records of all streams. ``edges``: ``stream_id, parent_id, fork_offset`` of every stream that inherits (a branch from its
parent, a merge from its base). Which part of which ancestor a stream sees is worked out on this metadata first: by the driver while there
are at most ``SMALL`` edges, else by joins that double the distance each round. The records of the owners found are then read
once; a small list of owners is a filter on the scan and a broadcast of the bounds, so that no record is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.plans import staging

#: Edges, and pairs of a stream and an ancestor, that the driver works out by itself.
SMALL, SMALL_PAIRS = 10_000, 200_000
#: Owners that a filter on the scan names.
NAMED = 1_000
_REACH = "stream_id string, owner_id string, max_offset bigint, depth bigint"


class Trimmed(ValueError):
    """A record at a fork is gone, and with it a part of the history."""


def _link() -> Column:
    """What a stream inherits: its parent if it is a branch, its base if it is a merge."""
    return F.when(F.col("kind") == "branch", F.get("parents", F.lit(0))).when(F.col("kind") == "merge", F.col("merge_base"))


def edges(streams: DataFrame) -> DataFrame:
    """What each stream inherits: the parent of a branch, the base of a merge; nothing else."""
    return streams.select("stream_id", _link().alias("link")).where("link is not null").select("stream_id", F.col("link.stream_id").alias("parent_id"), F.col("link.offset").alias("fork_offset"))


def _parents(links: DataFrame) -> dict[str, list[tuple[str, int | None]]] | None:
    """What each stream links to, if that is little."""
    rows = links.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        return None
    found: dict[str, list[tuple[str, int | None]]] = {}
    for r in rows:
        found.setdefault(r[0], []).append((r[1], r[2]))
    return found


def _walk(start: str, parents: dict[str, list[tuple[str, int | None]]]) -> dict[str, tuple[int | None, int]]:
    """Ancestors with the smallest bound and the least distance."""
    found: dict[str, tuple[int | None, int]] = {}
    level, depth = {start: None}, 0
    while level:
        depth += 1
        above: dict[str, int | None] = {}
        for at, bound in level.items():
            for parent, fork in parents.get(at, ()):
                least = min((x for x in (bound, fork) if x is not None), default=None)
                if parent not in found and parent != start:
                    known = above.get(parent, least)
                    above[parent] = least if known is None else known if least is None else min(known, least)
        found.update({k: (v, depth) for k, v in above.items()})
        level = above
    return found


def _doubled(links: DataFrame) -> DataFrame:
    """``stream_id, owner_id, max_offset, depth`` of all pairs that ``links(stream_id, parent_id, fork_offset)`` connect, however far apart.

    Round by round: pairs up to k apart, joined with those exactly k apart, give all up to 2k.
    """
    with staging.Scratch(links.sparkSession) as scratch:
        first = links.toDF("stream_id", "owner_id", "max_offset").where("stream_id <> owner_id").distinct()
        exact = scratch.stage(first, "reach-exact")
        within, k = scratch.stage(exact.withColumn("depth", F.lit(1).cast("long")), "reach"), 1
        while True:
            far = exact.select(F.col("stream_id").alias("start"), F.col("owner_id").alias("stream_id"), F.col("max_offset").alias("bound"))
            more = within.join(far, "stream_id").where("start <> owner_id").select(F.col("start").alias("stream_id"), "owner_id", F.least("bound", "max_offset").alias("max_offset"), (F.col("depth") + k).alias("depth"))
            step = within.unionByName(more).groupBy("stream_id", "owner_id").agg(F.min("max_offset").alias("max_offset"), F.min("depth").alias("depth"))
            exact = exact.join(far, "stream_id").where("start <> owner_id").groupBy(F.col("start").alias("stream_id"), "owner_id").agg(F.min(F.least("bound", "max_offset")).alias("max_offset"))
            within, exact, k = scratch.stage(step, "reach", keep=True), scratch.stage(exact, "reach-exact"), 2 * k
            if exact.isEmpty():
                return within


def _reach_rows(streams: DataFrame, only: Column | None) -> list[tuple] | None:
    """The rows of ``reach`` for the streams wanted, if the metadata is little; it is read once."""
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    known = streams.select("stream_id", _link().alias("link"), wanted.alias("wanted")).select("stream_id", "link.stream_id", "link.offset", "wanted").limit(SMALL + 1).collect()
    if len(known) > SMALL:
        return None
    parents = {r[0]: [(r[1], r[2])] for r in known if r[1] is not None}
    rows: list[tuple] = []
    for start in {r[0]: None for r in known if r[3]}:
        rows += [(start, start, None, 0), *((start, owner, bound, depth) for owner, (bound, depth) in _walk(start, parents).items())]
        if len(rows) > SMALL_PAIRS:
            return None
    return rows


def reach(streams: DataFrame, only: Column | None = None) -> DataFrame:
    """``stream_id, owner_id, max_offset, depth``: the owners whose records a stream sees, each up to an offset (null: all).

    An ancestor is seen up to the smallest fork offset on the way to it. ``only``: the streams wanted.
    """
    rows = _reach_rows(streams, only)
    if rows is not None:
        return streams.sparkSession.createDataFrame(rows, _REACH)
    own = (streams if only is None else streams.where(only)).select("stream_id").distinct()
    first = own.select("stream_id", F.col("stream_id").alias("owner_id"), F.lit(None).cast("bigint").alias("max_offset"), F.lit(0).cast("long").alias("depth"))
    return first.unionByName(_doubled(edges(streams)).join(own, "stream_id", "left_semi"))


def closure(streams: DataFrame) -> DataFrame:
    """``stream_id, ancestor_id, depth`` over all parents, those of merges too; the least depth of each pair."""
    links = streams.select("stream_id", F.explode("parents").alias("p")).select("stream_id", F.col("p.stream_id").alias("parent_id"), F.lit(None).cast("bigint").alias("fork_offset"))
    parents, pairs = _parents(links), []
    if parents is not None:
        for start in parents:
            pairs += [(start, owner, depth) for owner, (_, depth) in _walk(start, parents).items()]
            if len(pairs) > SMALL_PAIRS:
                break
        else:
            return streams.sparkSession.createDataFrame(pairs, "stream_id string, ancestor_id string, depth bigint")
    return _doubled(links).select("stream_id", F.col("owner_id").alias("ancestor_id"), "depth")


def replay_all(records: DataFrame, streams: DataFrame, only: Column | None = None) -> DataFrame:
    """Rows of every stream's whole history: ``stream_id`` (the one replayed), ``owner_id, offset, payload, inherited``."""
    own = records.select(F.col("stream_id").alias("owner_id"), "offset", "payload")
    known = _reach_rows(streams, only)
    if known is None:
        seen = reach(streams, only)
    else:
        owners = sorted({r[1] for r in known})
        own = own.where(F.col("owner_id").isin(owners)) if len(owners) <= NAMED else own
        seen = F.broadcast(streams.sparkSession.createDataFrame(known, _REACH))  # at most SMALL_PAIRS rows
    rows = own.join(seen, "owner_id").where(F.col("max_offset").isNull() | (F.col("offset") <= F.col("max_offset")))
    return rows.select("stream_id", "owner_id", "offset", "payload", (F.col("depth") > 0).alias("inherited"))


def missing_anchors(records: DataFrame, streams: DataFrame, only: Column | None = None) -> DataFrame:
    """Streams that can't be read, since the record at a fork was trimmed: a bound alone would return fewer rows without a word."""
    seen = reach(streams, only).where("max_offset is not null")
    there = records.select(F.col("stream_id").alias("owner_id"), F.col("offset").alias("max_offset"))
    # The bound lies in the one owner whose own records reach it; in others it is below their first.
    own = seen.join(first_offsets(streams), "owner_id").where("max_offset >= first_offset")
    return own.join(there, ["owner_id", "max_offset"], "left_anti").select("stream_id", "owner_id", F.col("max_offset").alias("offset"))


def first_offsets(streams: DataFrame) -> DataFrame:
    """Where each stream's own records begin."""
    e = edges(streams).select(F.col("stream_id").alias("owner_id"), "fork_offset")
    return streams.select(F.col("stream_id").alias("owner_id")).join(e, "owner_id", "left").select("owner_id", F.coalesce(F.col("fork_offset") + 1, F.lit(0)).cast("bigint").alias("first_offset"))


def replay(records: DataFrame, streams: DataFrame, stream_id: str, check: bool = False) -> DataFrame:
    """One stream's history; ``check``: raise ``Trimmed`` if the record at a fork on the way is gone."""
    one = F.col("stream_id") == stream_id
    if check and (gone := missing_anchors(records, streams, one).first()):
        raise Trimmed(f"{gone['owner_id']}@{gone['offset']}, from which {stream_id} inherits, was trimmed")
    return replay_all(records, streams, one)


def tail_from(history: DataFrame, from_offset: int) -> DataFrame:
    return history.where(F.col("offset") >= from_offset)


def page(history: DataFrame, from_offset: int, size: int) -> DataFrame:
    """The first ``size`` rows at or after an offset, each with ``has_more`` and ``next_offset`` of the page."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    some = tail_from(history, from_offset).orderBy("offset").limit(size + 1)
    whole = Window.partitionBy(F.lit(1))  # size + 1 rows at most
    ranked = some.withColumn("rank", F.row_number().over(whole.orderBy("offset"))).withColumn("has_more", F.count("*").over(whole) > size).where(F.col("rank") <= size)
    return ranked.withColumn("next_offset", F.max("offset").over(whole) + 1).drop("rank")


def page_status(history: DataFrame, from_offset: int, size: int) -> DataFrame:
    """One row for a page, empty ones too: ``from_offset, n, has_more, next_offset`` (of an empty page: where it began)."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    some = tail_from(history, from_offset).select("offset").orderBy("offset").limit(size + 1)
    found = some.agg(F.sort_array(F.collect_list("offset")).alias("o"))  # size + 1 numbers at most
    n = F.least(F.size("o"), F.lit(size))
    return found.select(F.lit(from_offset).cast("long").alias("from_offset"), n.cast("long").alias("n"), (F.size("o") > size).alias("has_more"), F.coalesce(F.get("o", n - 1) + 1, F.lit(from_offset).cast("long")).alias("next_offset"))


def branch_view(records: DataFrame, streams: DataFrame, stream_id: str) -> DataFrame:
    """A branch's history, each row ``prefix`` (shared with its parent) or ``suffix``."""
    kind = streams.where(F.col("stream_id") == stream_id).select("kind").first()
    if kind is None or kind[0] != "branch":
        raise ValueError(f"{stream_id} is not a branch")
    return replay(records, streams, stream_id).withColumn("part", F.when(F.col("inherited"), F.lit("prefix")).otherwise(F.lit("suffix")))


def dependents(streams: DataFrame, stream_id: str) -> DataFrame:
    """Streams that name this one as a parent or base."""
    return streams.where(F.exists("parents", lambda p: p["stream_id"] == stream_id) | (F.col("merge_base.stream_id") == stream_id)).select("stream_id")


def bad_anchors(streams: DataFrame, status: DataFrame) -> DataFrame:
    """Anchors of branches, parents and bases that name no stream, their own stream, or an offset not written yet."""
    anchors = streams.select("stream_id", F.explode(F.array_compact(F.concat(F.coalesce("parents", F.array().cast("array<struct<stream_id:string,offset:bigint>>")), F.array("merge_base")))).alias("a"))
    heads = status.select(F.col("stream_id").alias("parent_id"), "next_offset")
    joined = anchors.select("stream_id", F.col("a.stream_id").alias("parent_id"), F.col("a.offset").alias("offset")).join(heads, "parent_id", "left")
    return joined.where(F.col("next_offset").isNull() | (F.col("parent_id") == F.col("stream_id")) | (F.col("offset") >= F.col("next_offset")))


def status(records: DataFrame, streams: DataFrame) -> DataFrame:
    """One row for each stream: ``kind, parents, first_offset, next_offset, record_count, retained_count, retained_start, payload_bytes``."""
    counts = records.groupBy(F.col("stream_id").alias("owner_id")).agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"), F.sum(F.length("payload")).alias("payload_bytes"))
    rows = streams.select(F.col("stream_id").alias("owner_id"), "kind", F.array_join(F.transform(F.coalesce("parents", F.array().cast("array<struct<stream_id:string,offset:bigint>>")), lambda p: F.concat(p["stream_id"], F.lit("@"), p["offset"].cast("string"))), ",").alias("parents"))
    rows = rows.join(first_offsets(streams), "owner_id").join(counts, "owner_id", "left")
    following = F.coalesce(F.col("high") + 1, F.col("first_offset"))
    return rows.select(
        F.col("owner_id").alias("stream_id"), "kind", "parents", "first_offset", following.alias("next_offset"), following.alias("record_count"),
        F.coalesce("n", F.lit(0)).alias("retained_count"), F.coalesce("low", "first_offset").alias("retained_start"), F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"),
    )


def assign_offsets(rows: DataFrame, order: list[str], base: Column | int, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``offset`` from ``base`` on, within each stream of ``by``, in the order given.

    Rows are dealt by ranges of stream and order and written, then counts of the parts before are added, so that a stream of any length is
    numbered by many tasks.
    """
    by = by or []
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = staging.stage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    key = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]
    sizes = dealt.groupBy(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(f"_of_{i}" for i in range(len(by)))).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part", *by).orderBy("_at"))
    joined = dealt.withColumn("_rank", rank).join(starts, [F.col("_part") == F.col("_in"), *key])
    return joined.withColumn("offset", (F.col("_before") + F.col("_rank") - 1 + base).cast("bigint")).select(*rows.columns, "offset")


def gaps(records: DataFrame) -> DataFrame:
    """Records whose offset does not follow the one before in their stream, doubled ones too: ``stream_id, offset, before``.

    Offsets are joined with their neighbours; only where runs of offsets begin and end are sorted by stream.
    """
    at = records.select("stream_id", "offset").groupBy("stream_id", "offset").agg(F.count("*").alias("n"))
    there = at.select("stream_id", "offset")
    begins = there.join(there.withColumn("offset", F.col("offset") + 1), ["stream_id", "offset"], "left_anti").withColumn("end", F.lit(False))
    ends = there.join(there.withColumn("offset", F.col("offset") - 1), ["stream_id", "offset"], "left_anti").withColumn("end", F.lit(True))
    before = F.lag("offset").over(Window.partitionBy("stream_id").orderBy("offset", "end"))
    missing = begins.unionByName(ends).withColumn("before", before).where("not end and before is not null").select("stream_id", "offset", "before")
    doubled = at.where("n > 1").select("stream_id", "offset", F.col("offset").alias("before"), F.explode(F.sequence(F.lit(2), F.col("n"))).alias("copy")).drop("copy")
    return missing.unionByName(doubled)
