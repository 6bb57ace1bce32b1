"""Content-addressed snapshots: sorted entries cut into chunks by the hashes of their keys.

The same entries always give the same nodes, whatever their history. Each level is one distributed pass: range-partitioned by key,
boundaries counted per partition and then summed over partitions, so that no window runs over the whole table in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import scalars
from loomlog.operators import replay
from loomlog.plans import staging
from loomlog.sources.files import Files

NODES = "level int, node long, digest string, low binary, high binary, n_entries long, children array<string>"


def chunk(entries: DataFrame, mask: int = scalars.CHUNK_MASK, least: int = 1, salt: bytes = b"") -> DataFrame:
    """``entries`` (unique ``key``) with ``node``: the number of the chunk, in key order. A boundary key ends its chunk.

    ``least``: entries of a chunk, 2 for inner levels, so that levels shrink. ``salt``: hashed after the key. Inner levels need one, since
    the last key of a leaf is a boundary already.
    """
    sorted_rows = entries.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    rows = staging.stage(sorted_rows.withColumn("ends", scalars.chunk_boundary(F.concat("key", F.lit(salt)), mask)), "chunks")
    here = Window.partitionBy("part").orderBy("key")
    rows = rows.withColumn("rank", F.row_number().over(here))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("ends").alias("cuts"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = sizes.select("part", F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("cuts_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    cut = F.coalesce(F.sum(F.col("ends").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("cut", cut).join(sums, "part").withColumn("node", F.col("cut") + F.col("cuts_before"))
    if least == 1:
        return out.drop("part", "ends", "rank", "cut", "cuts_before", "n_before")
    # Levels must shrink: a chunk with too few entries goes to the one before it.
    sized = out.groupBy("node").agg(F.count("*").alias("size"))
    single = sized.withColumn("run", F.col("node") - F.sum((F.col("size") < least).cast("long")).over(Window.orderBy("node")))
    return out.join(single.select("node", "run"), "node").withColumn("node", F.col("run")).drop("run", "part", "ends", "rank", "cut", "cuts_before", "n_before")


def entry_digest(key: str = "key", value: str = "value"):
    return F.sha2(F.concat(F.lpad(F.length(key).cast("string"), 10, "0").cast("binary"), F.col(key), F.col(value)), 256)


def leaves(entries: DataFrame, mask: int = scalars.CHUNK_MASK) -> DataFrame:
    """One row for each leaf: ``node, digest, low, high, n_entries``. A leaf's size follows the mask, not the table."""
    return _leaves(chunk(entries, mask).withColumn("entry", entry_digest()))


def _leaves(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "entry"))).alias("e"))
    return found.select("node", F.sha2(F.concat(F.lit("leaf"), F.array_join(F.transform("e", lambda x: x["entry"]), "")), 256).alias("digest"), F.col("e")[0]["key"].alias("low"), F.element_at("e", -1)["key"].alias("high"), F.size("e").cast("long").alias("n_entries"))


def build(entries: DataFrame, mask: int = scalars.CHUNK_MASK) -> DataFrame:
    """All nodes: ``level, node, digest, low, high, n_entries, children``; the root is the one node of the highest level.

    No entries give one empty leaf. Duplicate keys are an error.
    """
    if entries.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate keys")
    return over_leaves(leaves(entries, mask), mask)


def over_leaves(found: DataFrame, mask: int = scalars.CHUNK_MASK) -> DataFrame:
    """All nodes of the tree with these leaves (see ``leaves``)."""
    spark = found.sparkSession
    level = staging.stage(found.select(F.lit(0).alias("level"), "node", "digest", "low", "high", "n_entries", F.lit(None).cast("array<string>").alias("children")), "leaves")
    if not level.limit(1).count():
        return spark.sql("SELECT 0 AS level, 0L AS node, sha2('leaf', 256) AS digest, CAST(NULL AS BINARY) AS low, CAST(NULL AS BINARY) AS high, 0L AS n_entries, CAST(NULL AS ARRAY<STRING>) AS children")
    nodes, k, size = level, 0, level.count()
    while size > 1:
        k += 1
        rows = chunk(level.select(F.col("high").alias("key"), "digest", "low", "n_entries"), mask, 2, bytes([k]))
        grouped = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "digest", "low", "n_entries"))).alias("e"))
        level = staging.stage(
            grouped.select(
                F.lit(k).alias("level"), "node", F.sha2(F.concat(F.lit("inner"), F.array_join(F.transform("e", lambda x: F.concat(F.hex(x["key"]), F.lit(":"), x["digest"])), ",")), 256).alias("digest"),
                F.col("e")[0]["low"].alias("low"), F.element_at("e", -1)["key"].alias("high"), F.aggregate("e", F.lit(0).cast("long"), lambda acc, x: acc + x["n_entries"]).alias("n_entries"),
                F.transform("e", lambda x: x["digest"]).alias("children"),
            ),
            "inner",
        )
        nodes, size = nodes.unionByName(level), level.count()
    return nodes


class LeafStore:
    """Entries of leaves in a folder, each leaf by its digest: equal leaves are there once, and what is read is checked against its name.

    The leaves of one ``put`` share a few files, sorted by digest, so files follow the size of what is written, not the number of leaves, and
    the files' statistics tell where a leaf is. Folders ``digest=...``, one for each leaf, as earlier stores have them, are read as well.
    """

    SCHEMA = "key binary, value binary, digest string"

    def __init__(self, spark: SparkSession, path: str, mask: int = scalars.CHUNK_MASK) -> None:
        self.spark, self.path, self.mask = spark, path, mask

    def _rows(self, only: list[str] | None = None) -> DataFrame:
        """``key, value, digest`` of these leaves, or of all; unchecked."""
        names, parts = Files(self.spark).names(self.path), []
        if "leaves" in names:
            parts.append(self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/leaves"))
        wanted = None if only is None else {f"digest={d}" for d in only}
        if folders := [f"{self.path}/{n}" for n in names if n.startswith("digest=") and (wanted is None or n in wanted)]:
            parts.append(self.spark.read.option("basePath", self.path).schema(self.SCHEMA).parquet(*folders))
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.SCHEMA)
        return rows if only is None else rows.where(F.col("digest").isin(only))

    def digests(self) -> DataFrame:
        return self._rows().select("digest").distinct()

    def put(self, entries: DataFrame) -> DataFrame:
        """Write the leaves of ``entries`` (unique ``key``, ``value``) that are not there yet; the leaves, as ``leaves`` gives them."""
        rows = staging.stage(chunk(entries.select("key", "value"), self.mask).withColumn("entry", entry_digest()), "entries")
        found = staging.stage(_leaves(rows), "leaves")
        new = found.select("node", "digest").join(self.digests(), "digest", "left_anti")
        rows.select("node", "key", "value").join(new, "node").select("key", "value", "digest").sortWithinPartitions("digest", "key").write.mode("append").option("compression", "zstd").parquet(f"{self.path}/leaves")
        return found

    def get(self, digests: list[str]) -> DataFrame:
        """``key, value, digest`` of these leaves; one that is not there, or whose content has another digest, raises."""
        rows = self._rows(digests)
        now = _leaves(rows.withColumn("node", F.col("digest")).withColumn("entry", entry_digest())).select(F.col("node").alias("name"), "digest")
        right = {r["name"] for r in now.where("name = digest").select("name").collect()}
        if bad := sorted(set(digests) - right):
            raise ValueError(f"leaves are missing or damaged: {bad[:3]}")
        return rows

    def update(self, found: DataFrame, changes: DataFrame) -> tuple[DataFrame, list[str]]:
        """The leaves after ``changes(key, value, deleted)`` (unique keys), and the digests of those that were read; others are not touched.

        A change belongs to the first leaf that ends at or after its key, or to the last. The leaf after it is read as well, since a leaf whose
        end is deleted runs on into that one.
        """
        after = _leaf_after(found.select(F.col("high").alias("key"), "digest").unionByName(changes.select("key", F.lit(None).cast("string").alias("digest"))))
        last = found.agg(F.max_by("digest", "high").alias("digest")).first()["digest"]
        hit = after.where("digest is null").select(F.coalesce("after", F.lit(last).cast("string")).alias("digest")).where("digest is not null")
        next_ones = after.where("digest is not null").select("digest", F.col("after").alias("then"))
        touched = [r["digest"] for r in hit.distinct().join(next_ones, "digest", "left").select(F.explode(F.array_compact(F.array("digest", "then"))).alias("digest")).distinct().collect()]  # two for each change at most
        kept = found.where(~F.col("digest").isin(touched)) if touched else found
        old = self.get(touched).select("key", "value")
        merged = old.join(changes.select("key"), "key", "left_anti").unionByName(changes.where("not deleted").select("key", "value"))
        both = kept.drop("node").unionByName(self.put(merged).drop("node"))
        return replay.assign_offsets(both, ["high"], 0).withColumnRenamed("offset", "node"), touched


def _leaf_after(ends: DataFrame) -> DataFrame:
    """``ends`` (``key``, and ``digest`` where a leaf ends at it) with ``after``: the leaf that ends next, for other keys at the key or next.

    Ranges of keys are dealt to many tasks and looked through from their last key to the first; a range's last rows take the leaf from the ranges after it.
    """
    order = [F.col("key"), F.col("digest").isNotNull()]
    dealt = staging.stage(ends.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ends")
    back = Window.partitionBy("part").orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("part").agg(F.min_by("digest", F.when(F.col("digest").isNotNull(), F.col("key"))).alias("first"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    beyond = firsts.select("part", F.last("first", True).over(later).alias("beyond"))
    return dealt.withColumn("within", F.last("digest", True).over(back)).join(beyond, "part").select("key", "digest", F.coalesce("within", "beyond").alias("after"))


def root_digest(nodes: DataFrame) -> str:
    return nodes.orderBy(F.desc("level")).select("digest").first()[0]


def shared_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("digest").intersect(b.select("digest"))


def manifest(nodes: DataFrame, stream_id: str, head_offset: int) -> DataFrame:
    """A snapshot's manifest: its id, root and source position."""
    top = nodes.groupBy().agg(F.max_by("digest", "level").alias("root"), F.count("*").alias("n_nodes"), F.max_by("n_entries", "level").alias("n_entries"))
    return top.select(scalars.numbered("snapshot", F.lit(head_offset)).alias("snapshot_id"), F.lit(stream_id).alias("stream_id"), F.lit(head_offset).cast("long").alias("offset"), F.concat(F.lit("tree:"), "root").alias("root"), "n_nodes", "n_entries")
