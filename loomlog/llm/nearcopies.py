"""Near copies by SimHash and ball hashing, held against the true similarity of their sets of word shingles.

Candidates come from balls around the SimHash fingerprints of the sets (``simhash.wide_links``): whatever lies within 11 bits is
connected. Each candidate is verified on its texts, so no chance collision is believed. The links among the fingerprints of a
bucket form a forest, so a large group of copies stays linear, and what they connect needs no further comparison.

An exact check follows, since sets that are 80 % similar differ in about 10 bits, give or take 3, and a link of the forest may fail
where another would have held. MinHash bands tell which texts to look at: two texts of similarity s share none of ``bands`` keys over
``rows`` hashes with probability ``(1 - s**rows)**bands``: 4e-9 at 0.8. In buckets that still hold more than one component, the texts of
others are compared with the most central one (which shares the most buckets); those of buckets still not settled
are joined by prefixes of their sets, which loses no pair. Shingles are ordered by the number of texts that have them, rare ones
first. Two sets of sizes k and l that are ``percent`` similar share at least a = percent * (k + l) / (100 + percent) shingles, so the
first k - a + 1 of the one and the first l - a + 1 of the other have a shingle in common. Copies that differ too much have
enough shingles of their own to fill these prefixes, so they don't meet, however many they are. Sets are
dealt by classes of size, so that l is known well enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm import common, simhash
from loomlog.plans import staging

SHINGLE = 5
PERCENT = 80
#: Bands, and rows of each.
BANDS, ROWS = 64, 6
#: Each class of sizes is that many percent wider than the one before.
_WIDER = 3
#: Documents for which a file of an intermediate table is planned.
_FILE_DOCS = 1 << 12
#: Hashes of sets that a worker holds while it verifies.
_HELD = 1 << 23


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Distinct 64-bit hashes of the runs of ``shingle`` words (fewer words: one run of all), sorted; and a hash of all words in order."""
    import xxhash

    words = (text or b"").translate(simhash._LOW).split()
    whole = xxhash.xxh64_intdigest(b" ".join(words), 1)
    if len(words) < shingle:
        return np.array([whole], np.uint64), whole
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = w.size - shingle + 1
    runs = w[:n]
    for i in range(1, shingle):
        runs = _mixed(runs) + w[i : i + n]
    return np.unique(_mixed(runs)), whole


@cache
def _seeds(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = np.random.default_rng((42, bands, rows)).integers(0, 1 << 63, (3, bands * rows), np.uint64)
    odd = of << np.uint64(1) | np.uint64(1)
    return of[0], odd[1], odd[2].reshape(bands, rows)


def band_keys(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` keys of a set, each from ``rows`` smallest hashes."""
    xor, times, mix = _seeds(bands, rows)
    least = np.full(xor.size, np.iinfo(np.uint64).max, np.uint64)
    step = max(8, (1 << 15) // xor.size)  # what fits a core's cache
    for i in range(0, grams.size, step):
        np.minimum(least, ((grams[i : i + step, None] ^ xor) * times).min(0), out=least)
    return _mixed((_mixed(least.reshape(bands, rows)) * mix).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Is the Jaccard similarity of two sets (sorted, distinct) at least that?"""
    if 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (a.size + b.size - both)


def _lists(keys: list[np.ndarray], bands: int) -> pa.Array:
    flat = np.concatenate(keys).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands), pa.int32()), pa.array(flat))


def _prints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = [shingles(t, shingle) for t in common.utf8(batch.column(2))]
            nodes = np.array([x[1] for x in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(x[0]) for x in sets], np.uint64).view(np.int64)
            keys = _lists([band_keys(x[0], BANDS, ROWS) for x in sets], BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([x[0].size for x in sets], pa.int64()), pa.array(fps), keys], ["doc_id", "text_hash", "node", "n", "simhash", "keys"])

    return run


def _grams(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            grams = [pa.array(shingles(t, shingle)[0].view(np.int64)) for t in common.utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])

    return run


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 + _WIDER / 100))).cast("int")


def prefixes(grams: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``gram, low, high, own, node, n, at, shared`` from ``grams(node, n, gram)``: two nodes that are ``percent`` similar meet in ``gram, low, high``.

    ``low`` and ``high``: the classes of size of the two, ``own``: that of the node. Shingles that only one node has take their places in a prefix
    but are not returned; ``at`` is the place among the ``shared`` others.
    """
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    nodes = grams.join(often, "gram").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    widest = int(np.ceil(np.log(100 / percent) / np.log(1 + _WIDER / 100))) + 1
    nodes = nodes.withColumn("own", _size_class(F.col("n"))).withColumn("other", F.explode(F.sequence(F.col("own") - widest, F.col("own") + widest)))
    n, edge = F.col("n"), lambda c: F.pow(F.lit(1 + _WIDER / 100), c)
    least = F.greatest(F.ceil(n * percent / 100), F.ceil(edge(F.col("other")) - 1e-6))  # sizes of the class that can be similar
    most = F.least(F.floor(n * 100 / percent), F.ceil(edge(F.col("other") + 1)))
    take = (n - _overlap(n, least, percent) + 1 - (n - F.size("grams"))).cast("int")
    nodes = nodes.where(least <= most).withColumn("take", take).where("take > 0")
    rows = nodes.select("node", "n", F.size("grams").alias("shared"), "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.posexplode(F.slice("grams", F.lit(1), F.col("take"))).alias("at", "s"))
    return rows.select(F.col("s.gram").alias("gram"), "low", "high", "own", "node", "n", "at", "shared")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least that sets of these sizes share if they are ``percent`` similar."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def prefix_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b`` (a before b) for nodes of different ``root`` that can be ``percent`` similar; ``rows``: ``prefixes`` with a ``root``."""
    key = ["gram", "low", "high"]
    several = rows.groupBy(key).agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select(key)
    rows = rows.join(several, key)
    other = rows.where("own = high").select(*key, *(F.col(c).alias(f"{c}_") for c in ("node", "n", "root", "at", "shared")))
    pairs = rows.where("own = low").join(other, key).where((F.col("root") != F.col("root_")) & ((F.col("low") < F.col("high")) | (F.col("node") < F.col("node_"))))
    # Common shingles before this one, this one, and those after it.
    bound = F.least("at", "at_") + 1 + F.least(F.col("shared") - F.col("at"), F.col("shared_") - F.col("at_")) - 1
    pairs = pairs.where(bound >= _overlap(F.col("n"), F.col("n_"), percent))
    return pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def _verify(percent: int, shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(node: int, text: bytes) -> np.ndarray:
            nonlocal held
            if (found := sets.get(node)) is None:
                found = shingles(text, shingle)[0]
                if held > _HELD:  # only saves work
                    sets.clear()
                    held = 0
                sets[node] = found
                held += found.size
            return found

        for batch in common.slices(batches):
            pairs = zip(*(batch.column(i).to_pylist() for i in (0, 1)), common.utf8(batch.column(2)), common.utf8(batch.column(3)), strict=True)
            out = [(x, y) for x, y, s, t in pairs if similar(of(x, s), of(y, t), percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def ball_pairs(nodes: DataFrame, balls: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b`` (a before b) of ``nodes(node, n, simhash)`` whose fingerprints are equal or linked by ``balls(a, b)`` and whose sizes allow it.

    Nodes with one fingerprint are paired with the first of them, which also stands for it in the links.
    """
    heads = nodes.groupBy("simhash").agg(F.min(F.struct("node", "n")).alias("head"))
    same = nodes.join(heads, "simhash").select("head", F.struct("node", "n").alias("other"))
    linked = balls.join(heads.select(F.col("simhash").alias("a"), "head"), "a").join(heads.select(F.col("simhash").alias("b"), F.col("head").alias("other")), "b")
    pairs = same.union(linked.select("head", "other")).where("head.node <> other.node")
    fits = 100 * F.least("head.n", "other.n") >= percent * F.greatest("head.n", "other.n")
    return pairs.where(fits).select(F.least("head.node", "other.node").alias("a"), F.greatest("head.node", "other.node").alias("b"))


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, fp`` of every row, and ``fp, root`` of every ``fp`` that is linked to another."""
    spark = docs.sparkSession
    common.ship(spark)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("_text"))
    prints = staging.stage(source.mapInArrow(_prints(shingle), "doc_id long, text_hash long, node long, n long, simhash long, keys array<long>"), "copies")
    parts = max(1, -(-prints.count() // _FILE_DOCS))
    at = [F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")]
    with staging.Scratch(spark) as scratch:
        nodes = scratch.stage(prints.groupBy("node").agg(F.min("n").alias("n"), F.min("simhash").alias("simhash")), "copies-nodes", parts)
        balls = scratch.stage(simhash.wide_links(nodes.select("simhash").distinct().withColumnRenamed("simhash", "fp")), "copies-balls", parts)
        near = scratch.stage(ball_pairs(nodes, balls, percent), "copies-pairs", parts)
        members = near.select(F.explode(F.array("a", "b")).alias("node"))
        if exact:
            keyed = prints.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("bucket"))
            several = keyed.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).where("m > 1")
            buckets = scratch.stage(several.join(nodes.select("node", "n"), "node"), "copies-buckets", parts)
            members = members.union(buckets.select("node"))

        # One row for each text, found by its id: all copies of a text would be found by its hash.
        chosen = prints.groupBy("node").agg(F.min(F.struct(*at)).alias("at")).join(members.select("node").distinct(), "node", "left_semi")
        chosen = chosen.select("node", "at.*")
        there = source.select(*at, "_text").join(chosen, ["null", "id", "text_hash"])
        copy = F.row_number().over(Window.partitionBy("null", "id", "text_hash").orderBy("id"))
        texts = scratch.stage(there.withColumn("copy", copy).where("copy = 1").select("node", F.col("_text").alias("text")), "copies-texts", parts)

        def verified(pairs: DataFrame) -> DataFrame:
            x = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            x = x.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            return scratch.stage(x.select("a", "b", "ta", "tb").mapInArrow(_verify(percent, shingle), "a long, b long"), "copies-links", 4 * parts)

        links = verified(near)
        if not exact:
            roots = scratch.stage(simhash.components(links, parts=parts), "copies-roots", parts, keep=True)
            return prints.select("doc_id", "text_hash", F.col("node").alias("fp")), roots.withColumnRenamed("node", "fp")

        def unsettled_in(buckets: DataFrame, links: DataFrame) -> DataFrame:
            roots = simhash.components(links, parts=parts).select("node", "root")
            rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            rooted = scratch.stage(rooted, "copies-rooted", parts)
            several = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
            return rooted.join(several, "bucket")

        mixed = scratch.stage(unsettled_in(buckets, links), "copies-unsettled", parts)
        degree = buckets.groupBy("node").agg(F.sum("m").alias("degree"))
        central = mixed.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node", "n", "root")).alias("c"))
        fits = 100 * F.least("c.n", "n") >= percent * F.greatest("c.n", "n")
        stars = mixed.join(central, "bucket").where((F.col("c.root") != F.col("root")) & fits)
        stars = stars.select(F.least("c.node", "node").alias("a"), F.greatest("c.node", "node").alias("b")).distinct()
        stars = scratch.stage(stars.join(near, ["a", "b"], "left_anti"), "copies-pairs", parts)
        links = links.union(verified(stars))

        unsettled = unsettled_in(mixed.drop("root"), links).groupBy("node").agg(F.min("root").alias("root"))
        grams = unsettled.join(texts, "node").select("node", "text").mapInArrow(_grams(shingle), "node long, grams array<long>")
        grams = scratch.stage(grams, "copies-grams", 4 * parts).select("node", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram"))
        left = prefixes(grams, percent).join(unsettled.select("node", "root"), "node")
        left = scratch.stage(left, "copies-prefixes", parts)
        rest = scratch.stage(prefix_pairs(left, percent).join(near.union(stars), ["a", "b"], "left_anti"), "copies-pairs", parts)
        roots = scratch.stage(simhash.components(links.union(verified(rest)), parts=parts), "copies-roots", parts, keep=True)
    return prints.select("doc_id", "text_hash", F.col("node").alias("fp")), roots.withColumnRenamed("node", "fp")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, exact: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, text_hash, fp, root`` (fp: a hash of the words, root: its class).

    Two texts are linked if the sets of their runs of ``shingle`` words (A-Z lower-cased) are ``percent`` similar or more; classes are
    what links connect. Null and empty texts are alike. Ids may be null or repeated; repeated rows each give a row, an empty
    table gives none. Texts may be of any length; other columns are not read. Without ``exact`` the links are those that the balls alone find.
    """
    prints, roots = _classes(docs, doc_id, text, shingle, percent, exact)
    return prints.join(roots, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each class of ``near_copies``, chosen as ``simhash.keep_first`` does."""
    prints, roots = _classes(docs, doc_id, text, shingle, percent)
    return simhash.keep_first(docs, prints, roots, doc_id, text)
