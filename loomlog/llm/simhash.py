"""SimHash near-duplicate detection with meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits are linked. Plain ball hashing needs all variants
within two bits (2,081 for each fingerprint). Here the 64 bits are first cut into ``blocks`` blocks. If two
fingerprints differ in one to three bits, some block holds one of them; without that block at most two
differing bits are left, and the two balls of radius one meet in the middle. So every fingerprint emits, for each
block left out, itself and its one-bit variants (131 with three blocks); a bucket holds the fingerprints that share a
variant, and its members are verified on all 64 bits. No link is missed and no chance collision is believed.

Buckets work on distinct fingerprints, so exact copies meet in a group-by with map-side combine. Within a bucket only a
spanning forest of the links is emitted, found without looking at all pairs (see ``link_bucket``).

For a wider radius (``wide_links``) all blocks but one are left out: of ``3 * blocks - 1`` differing bits or fewer, some block holds at
most two, and there the balls of radius one meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm import common
from loomlog.plans import staging

RADIUS = 3
BLOCKS = 3
SHINGLE = 3
SEED = 42
#: Blocks of which ``wide_links`` keeps one; it then finds all within three times as many bits, less one.
WIDE_BLOCKS = 4
_CHUNK = 1 << 16
#: Members of a bucket that are all compared with each other.
_SQUARE = 1 << 12
_FILE_EDGES = 1 << 15
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text (UTF-8), unsigned. No words: zero."""
    import xxhash

    words = (text or b"").translate(_LOW).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, hashes.size, _CHUNK):
        part = hashes[i : i + _CHUNK]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def cuts(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """First bit and end of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def variants(fps: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of every fingerprint, and the fingerprint of each key.

    A key holds the kept bits, moved together, and from bit 60 on the number of the block left out, so different buckets
    never share a key.
    """
    keys, of = [], []
    for j, (a, b) in enumerate(cuts(blocks)):
        kept = (fps & np.uint64((1 << a) - 1)) | (fps >> np.uint64(b) << np.uint64(a) if b < 64 else np.uint64(0))
        flips = np.array([0, *(1 << i for i in range(64 - b + a))], np.uint64)
        keys.append(((kept | np.uint64(j << 60))[:, None] ^ flips[None, :]).ravel())
        of.append(np.repeat(fps, flips.size))
    return np.concatenate(keys), np.concatenate(of)


def wide_variants(fps: np.ndarray, blocks: int = WIDE_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """As ``variants``, with all blocks but one left out; from bit 60 on a key holds the number of the block kept."""
    keys, of = [], []
    for j, (a, b) in enumerate(cuts(blocks)):
        kept = fps >> np.uint64(a) & np.uint64((1 << b - a) - 1)
        flips = np.array([0, *(1 << i for i in range(b - a))], np.uint64)
        keys.append(((kept | np.uint64(j << 60))[:, None] ^ flips[None, :]).ravel())
        of.append(np.repeat(fps, flips.size))
    return np.concatenate(keys), np.concatenate(of)


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _flips(bits: list[int], n: int) -> list[int]:
    return [sum(c) for c in combinations(bits, n)]


def link_bucket(key: int, members: list[int], blocks: int = BLOCKS, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the members of a bucket just as all their links would; time is linear in its size.

    With r the bits of the left-out block, and "plain" members those whose kept bits are the key itself: members are at
    most 2 apart in the kept bits (1 if one is plain, 0 if both are). So members whose r differ in at most one bit are
    linked; with two bits, those of which one is plain; with three, those which both are. Two members with the same
    flipped bit also meet, as plain members, in the bucket of their own kept bits. r are looked up, not compared in pairs.
    """
    a, b = cuts(blocks)[key >> 60]
    kept, low, block = key & (1 << 60) - 1, (1 << a) - 1, (1 << b - a) - 1
    forest, links = _Forest(), []

    def link(a: int, b: int) -> None:
        if (a ^ b).bit_count() <= radius and forest.union(a, b):
            links.append((a, b) if a < b else (b, a))

    first: dict[int, int] = {}
    plain: dict[int, int] = {}
    for x in members:
        r = x >> a & block
        if r in first:
            link(first[r], x)
        else:
            first[r] = x
        if x & low | x >> b << a == kept:
            plain[r] = x
    bits = [1 << i for i in range(b - a)]
    for r, x in first.items():
        for f in bits:
            if (y := first.get(r ^ f)) is not None and x < y:
                link(x, y)
    two, three = (_flips(bits, 2), _flips(bits, 3)) if plain else ([], [])
    for r, x in plain.items():
        if len(first) <= len(two):
            for y in first.values():
                link(x, y)
        else:
            for f in two:
                if (y := first.get(r ^ f)) is not None:
                    link(x, y)
        if len(plain) <= len(three):
            for y in plain.values():
                link(x, y)
        else:
            for f in three:
                if (y := plain.get(r ^ f)) is not None:
                    link(x, y)
    return links


def link_near(key: int, members: list[int], blocks: int, radius: int) -> list[tuple[int, int]]:
    """Links that connect the (different) members of a bucket just as all their links would.

    They form a forest: up to ``_SQUARE`` members one of the least distances, which a check on the texts most likely confirms. Beyond, a breadth
    first one, for which a member is compared with those not yet reached: near copies, however many, are reached at once.
    """
    left = np.array(members, np.uint64)
    if left.size > _SQUARE:
        return _breadth_first(left, radius)
    step = max(1, (1 << 18) // left.size)
    left = left[np.concatenate([(np.bitwise_count(left[i : i + step, None] ^ left) <= radius).sum(1) > 1 for i in range(0, left.size, step)])]
    links: list[tuple[int, int]] = []
    if not left.size:
        return links
    x, left = left[0], left[1:].copy()
    least, of = np.full(left.size, 255, np.uint8), left.copy()  # distance to the nearest one taken, and that one
    while left.size:
        distance = np.bitwise_count(left ^ x)
        nearer = distance < least
        least[nearer], of[nearer] = distance[nearer], x
        i = int(least.argmin())
        x = left[i]
        if least[i] <= radius:
            links.append((int(min(x, of[i])), int(max(x, of[i]))))
        left[i], least[i], of[i] = left[-1], least[-1], of[-1]
        left, least, of = left[:-1], least[:-1], of[:-1]
    return links


def _breadth_first(left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    links: list[tuple[int, int]] = []
    while left.size > 1:
        reached, left = [left[:1]], left[1:]
        for some in reached:
            for x in some:
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    found, left = left[near], left[~near]
                    links += zip(np.minimum(found, x).tolist(), np.maximum(found, x).tolist(), strict=True)
                    reached.append(found)
    return links


def _fingerprints(text: str, out: str, shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in common.utf8(batch.column(text))], np.uint64)
            yield batch.drop_columns([text]).append_column(out, pa.array(fps.view(np.int64)))

    return run


def _emit(blocks: int, variants=variants):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, fps.size, 4096):
                keys, of = variants(fps[i : i + 4096], blocks)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of.view(np.int64))], ["bucket", "fp"])

    return run


def _links(blocks: int, radius: int, link_bucket=link_bucket):
    names = ["a", "b"]

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b)], names)

    def runs(keys: np.ndarray, fps: np.ndarray, seen: set) -> Iterator[pa.RecordBatch]:
        """keys: sorted, of whole buckets."""
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, keys.size])
        twos = starts[sizes == 2]
        a, b = fps[twos], fps[twos + 1]
        near = np.bitwise_count(a ^ b) <= radius
        found = list(zip(np.minimum(a, b)[near].tolist(), np.maximum(a, b)[near].tolist(), strict=True))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found += link_bucket(int(keys[s]), fps[s : s + n].tolist(), blocks, radius)
        fresh = list(dict.fromkeys(p for p in found if p not in seen))
        if len(seen) > 200_000:  # only saves repeats; distinct() comes after
            seen.clear()
        seen.update(fresh)
        if fresh:
            x = np.array(fresh, np.uint64)
            yield out(x[:, 0], x[:, 1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, seen = np.empty(0, np.uint64), np.empty(0, np.uint64), set()
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one bucket that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if held and k[-1] == held[0][0][0]:
                held.append((k, f))
                continue
            keys, fps = np.concatenate([x[0] for x in held] + [k]), np.concatenate([x[1] for x in held] + [f])
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield from runs(keys[:cut], fps[:cut], seen)
            held = [(keys[cut:].copy(), fps[cut:].copy())]
        if held:
            yield from runs(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), seen)

    return run


def fingerprints(docs: DataFrame, keep: list[Column], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint as a signed long) of every row."""
    common.ship(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(_fingerprints("_text", "fp", shingle), ", ".join([*kept, "fp long"]))


def links(fps: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)``, a before b as unsigned numbers, that connect what lies within ``radius``; ``fps``: distinct longs."""
    if not 0 <= radius <= 3:
        raise ValueError("one-bit balls meet for a radius of at most 3")
    spark = fps.sparkSession
    common.ship(spark)
    emitted = fps.mapInArrow(_emit(blocks), "bucket long, fp long")
    dealt = emitted.repartition(common.ordered(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_links(blocks, radius), "a long, b long").distinct()


def wide_links(fps: DataFrame, blocks: int = WIDE_BLOCKS) -> DataFrame:
    """As ``links``, for a radius of ``3 * blocks - 1`` bits.

    A bucket has all that agree in ``64 // blocks`` bits but two, strangers too, which are compared as 64-bit numbers: quadratic in their number.
    """
    if not 1 <= blocks <= 16:
        raise ValueError("1 to 16 blocks")
    spark = fps.sparkSession
    common.ship(spark)
    emitted = fps.mapInArrow(_emit(blocks, wide_variants), "bucket long, fp long")
    dealt = emitted.repartition(common.ordered(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_links(blocks, 3 * blocks - 1, link_near), "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60, parts: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: root is the smallest node that can be reached.

    Alternating large-star and small-star steps, each written to the shared folder, in a file for each ``_FILE_EDGES`` edges at least
    (``parts``: the most files of the first). The
    smallest neighbour comes from an aggregation with map-side combine, then joins back, so a hub is never one task's group.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = staging.write_table(now, "cc", parts)
    before = None
    for _ in range(most_rounds):
        e = spark.read.schema("u long, v long").parquet(path)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        parts = -(-state[0] // _FILE_EDGES)
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = staging.write_table(large, "cc", parts)
        e = spark.read.schema("u long, v long").parquet(mid)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        after = staging.write_table(small, "cc", parts)
        for old in (path, mid):
            staging.remove(spark, old)
        path = after
    else:
        raise RuntimeError("components did not settle")
    e = spark.read.schema("u long, v long").parquet(path)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, first_id, root`` for every fingerprint of ``prints(doc_id, fp)``: its smallest id, and its class as a fingerprint."""
    with staging.Scratch(prints.sparkSession) as scratch:
        firsts = scratch.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
        roots = components(links(firsts.select("fp"), radius=radius))
        of = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        return scratch.stage(of, "simhash-roots", keep=True)


def _prints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    return staging.stage(fingerprints(docs, [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")], text, shingle), "simhash")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, text_hash, fp, root, component_id`` (root: the class as a fingerprint).

    ``component_id`` is the smallest id of the rows whose fingerprints are linked, directly or through others. Null and
    empty texts have the fingerprint zero and are linked like any other; a null id counts as larger than all ids, and
    a component of null ids alone has the component id null. Repeated rows each give a row; an empty table gives none. Texts may
    be of any length: hashes are counted in chunks. Other columns are not read.
    """
    prints = _prints(docs, doc_id, text, shingle)
    of = classes(prints, radius)
    component = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of.join(component, "root").select("fp", "root", "component_id")
    # Only a projection follows the join on fp, so a fingerprint that many rows share can be split over tasks.
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component: the smallest id, and of rows with that id one.

    Among rows with the same smallest id the one with the smallest text hash stays; of rows equal in both, any one. Null ids come last.
    """
    prints = _prints(docs, doc_id, text, shingle)
    return keep_first(docs, prints, classes(prints, radius), doc_id, text)


def keep_first(docs: DataFrame, prints: DataFrame, roots: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each root of ``roots(fp, root)``; ``prints``: ``doc_id, text_hash, fp`` of each row of ``docs``.

    The first row of each fingerprint is found before anything is joined, so copies are combined where they are read.
    """
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("best"))
    keep = first.join(roots.select("fp", "root"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    # Plain equalities of columns that are never null: the join's shuffle of the texts then serves the window too.
    names = [common.free_name(docs, n) for n in ("_key_null", "_key_id", "_key_hash", "_copy")]
    null, ident, content, copy = names
    keep = keep.select(F.col("best.n").alias(null), F.coalesce("best.doc_id", F.lit(0)).alias(ident), F.col("best.text_hash").alias(content))
    keyed = docs.withColumns({null: F.col(doc_id).isNull(), ident: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), content: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    one = Window.partitionBy(null, ident, content).orderBy(ident)
    return keyed.join(keep, [null, ident, content]).withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
