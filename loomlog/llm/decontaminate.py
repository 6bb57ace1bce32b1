"""Benchmark decontamination by winnowing.

Test texts are cut into windows of ``window`` words (a shorter text is one window). Of each text the hashes of its k-grams
are winnowed: the smallest of every ``window - k + 1`` consecutive ones stays. Any span of ``window`` words that a document shares
with a test text has the same k-grams, so both keep the same one: its hash is the fingerprint on which the two sides are
joined. Each hit is then extended to the windows that hold that k-gram, compared word by word. Shorter test texts have
no such guarantee; their whole word sequences are looked up by hash at each of the few lengths that occur.

A test side of at most ``BLOCK_CHARS`` bytes (its size is checked) goes to every worker as an index, and documents are not shuffled. A larger one
is never gathered: both sides are joined on their fingerprints, and each pair of a document and a test text that
share one is compared on its texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import common
from loomlog.plans import staging

WINDOW = 10
K = 5
#: Bytes of test texts of which an index goes to every worker; more are joined.
BLOCK_CHARS = 4 << 20
#: Words whose codes a worker remembers.
_HELD_WORDS = 200_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULT = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def words(text: bytes | None) -> list[bytes]:
    """Runs of a-z (A-Z lower-cased), digits and characters above ASCII."""
    return (text or b"").translate(_WORD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of word codes."""
    n = codes.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += codes[i : i + n] * np.uint64(pow(_MULT, i + 1, 1 << 64))
    return _mix(total)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash (the last of equals) of every w consecutive ones."""
    n = hashes.size
    if not n:
        return np.empty(0, np.int64)
    if n < w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    best = hashes[: n - w + 1].copy()
    at = np.arange(n - w + 1)
    for i in range(1, w):
        other = hashes[i : n - w + 1 + i]
        less = other <= best
        np.copyto(best, other, where=less)
        np.copyto(at, np.arange(i, n - w + 1 + i), where=less)
    return at[np.r_[True, at[1:] != at[:-1]]]  # never goes back


def word_codes(vocabulary: dict[bytes, int]) -> np.ndarray:
    """A fixed random code for each word of the test side; code 0 is for all other words."""
    codes = np.zeros(len(vocabulary) + 1, np.uint64)
    for word, i in vocabulary.items():
        codes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1
    return codes


class Index:
    """The windows of some test texts, by winnowed fingerprint."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        self.vocabulary: dict[bytes, int] = {}
        one: dict = {}  # equal words, and equal sets of items, are one object
        seqs = [(item, [one.setdefault(x, x) for x in words(text)]) for item, text in items]
        for _, seq in seqs:
            for word in seq:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.codes = word_codes(self.vocabulary)
        found: dict[tuple, set] = defaultdict(set)
        prints: list[np.ndarray] = [np.empty(0, np.uint64)]
        short: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, seq in seqs:
            if not seq:
                continue
            for i in range(max(1, len(seq) - window + 1)):
                found[tuple(seq[i : i + window])].add(item)
            codes = self.codes[np.fromiter(map(self.vocabulary.__getitem__, seq), np.int64, len(seq))]
            if len(seq) >= window:
                hashes = gram_hashes(codes, k)
                prints.append(hashes[winnow(hashes, window - k + 1)])
            else:
                short[len(seq)].append(gram_hashes(codes, len(seq)))
        self.items = {seq: one.setdefault(ids, ids) for seq, ids in ((seq, frozenset(ids)) for seq, ids in found.items())}
        self.prints = np.unique(np.concatenate(prints))
        self.short_prints = {m: np.unique(np.concatenate(x)) for m, x in short.items()}

    def hits(self, seqs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, set]]:
        """For each text the words inside any occurrence of a window, and the items of those windows."""
        flat: list[bytes] = []
        for seq in seqs:
            flat += seq
            flat.append(b"")  # no window has it, so none goes over the end of a text
        codes = self.codes[np.fromiter(map(self.vocabulary.get, flat, repeat(0)), np.int64, len(flat))]
        hit, found = np.zeros(len(flat), bool), defaultdict(set)
        ends = np.cumsum([len(seq) + 1 for seq in seqs])
        starts = [(self.window, self._starts(codes)), *((m, np.flatnonzero(_among(gram_hashes(codes, m), known))) for m, known in self.short_prints.items())]
        for m, at in starts:
            for i in at.tolist():
                items = self.items.get(tuple(flat[i : i + m]))
                if items is not None:
                    hit[i : i + m] = True
                    found[int(np.searchsorted(ends, i, "right"))] |= items
        for j, seq in enumerate(seqs):
            yield hit[ends[j] - 1 - len(seq) : ends[j] - 1], found.get(j, set())

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        """Where a window may begin: those around each fingerprint that the test side has too."""
        n = codes.size
        if n < self.window or not self.prints.size:
            return np.empty(0, np.int64)
        hashes = gram_hashes(codes, self.k)
        unknown = np.r_[0, np.cumsum(codes == 0)]
        hashes[unknown[self.k :] > unknown[: -self.k]] = _ALL  # no test text has this k-gram
        kept = winnow(hashes, self.window - self.k + 1)
        kept = kept[_among(hashes[kept], self.prints)]
        if not kept.size:
            return kept
        near = np.unique((kept[:, None] - np.arange(self.window - self.k + 1)[None, :]).ravel())
        return near[(near >= 0) & (near <= n - self.window)]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not known.size:
        return np.zeros(x.size, bool)
    at = np.searchsorted(known, x)
    at[at == known.size] = 0
    return known[at] == x


def _columns(seqs: list[list[bytes]], found: list[tuple[np.ndarray, set]]) -> list[pa.Array]:
    """Number of words, of hit words, and items."""
    return [
        pa.array([len(s) for s in seqs], pa.int64()),
        pa.array([int(h.sum()) for h, _ in found], pa.int64()),
        pa.array([sorted(i for i in f if i is not None) for _, f in found], pa.list_(pa.string())),
    ]


def _scan(block, text: str, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(block.value)
        for batch in common.slices(batches):
            seqs = [words(t) for t in common.utf8(batch.column(text))]
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, *_columns(seqs, list(index.hits(seqs)))], [*rest.schema.names, *names])

    return run


def _codes(seq: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Each word's code, the same in every process."""
    for word in seq:
        if word not in known:
            if len(known) > _HELD_WORDS:  # only saves work
                known.clear()
            known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1
    return np.array([known[w] for w in seq], np.uint64)


def _prints(window: int, k: int, lengths: list[int] | None):
    """Fingerprints ``(row, size, print)`` of ``(row, text)``. ``lengths``: of the shorter test texts; None: these are the test texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in common.slices(batches):
            rows, sizes, prints = [], [], []

            def add(row: int, size: int, hashes: np.ndarray) -> None:
                hashes = np.unique(hashes)  # noqa: B023
                rows.append(np.full(hashes.size, row, np.int64))  # noqa: B023
                sizes.append(np.full(hashes.size, size, np.int32))  # noqa: B023
                prints.append(hashes.view(np.int64))  # noqa: B023

            for row, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
                seq = words(text)
                codes = _codes(seq, known)
                if len(seq) >= window:
                    hashes = gram_hashes(codes, k)
                    add(row, window, hashes[winnow(hashes, window - k + 1)])
                for m in (lengths if lengths is not None else [len(seq)] if 0 < len(seq) < window else []):
                    add(row, m, gram_hashes(codes, m))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (rows, sizes, prints)], ["row", "size", "print"])

    return run


def _compare(window: int, k: int):
    """Hit words and the item of each pair ``(row, item, item text, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in common.slices(batches):
            out = []
            for row, item, body, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.utf8(batch.column(2)), common.utf8(batch.column(3)), strict=True):
                if index is None or last != body:
                    last, index = body, Index([("", body)], window, k)
                ((hit, found),) = index.hits([words(text)])
                if found:
                    out.append((row, item, np.flatnonzero(hit)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["row", "item", "at"])

    return run


def _joined(docs: DataFrame, bench: DataFrame, body: str, names: list[str], window: int, k: int) -> DataFrame:
    """The same by a join on fingerprints. ``bench``: ``item, text``. Rows of ``docs`` are numbered in a written table."""
    spark = docs.sparkSession
    row, n = common.free_name(docs, "_row"), common.free_name(docs, "_words")
    docs = staging.stage(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(n, F.size(F.filter(F.split(common.ascii_lower(F.coalesce(F.col(body), F.lit(""))), _NO_WORD, -1), lambda w: w != "")).cast("long")), "leak-docs")
    with staging.Scratch(spark) as scratch:
        bench = scratch.stage(bench.distinct().withColumn("id", F.monotonically_increasing_id()), "leak-items")
        schema = "row long, size int, print long"
        theirs = scratch.stage(bench.select("id", "text").mapInArrow(_prints(window, k, None), schema), "leak-prints")
        lengths = [r["size"] for r in theirs.where(F.col("size") < window).select("size").distinct().collect()]  # fewer than ``window``
        ours = docs.select(row, body).mapInArrow(_prints(window, k, sorted(lengths)), schema)
        pairs = ours.join(theirs.withColumnRenamed("row", "id"), ["size", "print"]).select("row", "id").distinct()
        texts = docs.select(F.col(row).alias("row"), F.col(body).alias("text"))
        pairs = pairs.join(bench.select("id", "item", F.col("text").alias("body")), "id").join(texts, "row")
        found = scratch.stage(pairs.sortWithinPartitions("id").select("row", "item", "body", "text").mapInArrow(_compare(window, k), "row long, item string, at array<long>"), "leak-hits")
        hit = found.select("row", F.explode("at").alias("at")).distinct().groupBy("row").agg(F.count("*").alias("hit"))
        items = found.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
        hit = scratch.stage(hit.join(items, "row"), "leak-found", keep=True)
    hit = hit.select(F.col("row").alias(row), F.struct("hit", "items").alias(common.free_name(docs, "_found")))
    found = common.free_name(docs, "_found")
    kept = [F.col(c) for c in docs.columns if c not in (row, n, body)]
    wanted = [F.col(n).alias(names[0]), F.coalesce(F.col(found)["hit"], F.lit(0)).cast("long").alias(names[1]), F.coalesce(F.col(found)["items"], F.array().cast("array<string>")).alias(names[2])]
    return docs.join(hit, row, "left").select(*kept, *wanted)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns and rows of ``docs`` with ``n_words``, ``n_hit`` and ``items`` (sorted ids, as strings, of windows that occur).

    Null and empty texts have no words; texts may be of any length. Repeated rows each give a row, an empty table none. Repeated test
    texts share their windows; a test text with a null id marks words but is not listed. Without test texts nothing is hit. If ``docs``
    has columns of those three names, the new ones get a trailing underscore.
    """
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and the window")
    spark = docs.sparkSession
    common.ship(spark)
    names = [common.free_name(docs, n) for n in ("n_words", "n_hit", "items")]
    body = common.free_name(docs, "_body")
    fields = [*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.ArrayType(T.StringType()))]
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    docs = docs.withColumn(body, F.col(text).cast("string"))
    if (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_chars:
        return _joined(docs, bench, body, names, window, k)
    items = [(r["item"], (r["text"] or "").encode()) for r in bench.where("text <> ''").collect()]  # at most BLOCK_CHARS bytes
    block = spark.sparkContext.broadcast(pickle.dumps(Index(items, window, k)))  # about 25 bytes for each of them
    return docs.mapInArrow(_scan(block, body, names), T.StructType(fields))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with a test text."""
    found = scan(docs, benchmark, text)
    return found.where(F.col(found.columns[-2]) == 0).select(*docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws, row_number() OVER () AS rid FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(s) AS m, array_to_string(s, ' ') AS g FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: list_slice(ws, i, least(i + 9, len(ws))))) AS s FROM b WHERE len(ws) > 0)
), m AS (SELECT DISTINCT m FROM win), grams AS (
  SELECT rid, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g FROM (
    SELECT rid, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, m WHERE len(ws) >= m)
), occ AS (SELECT rid, grams.m, i, item_id FROM grams JOIN win ON grams.m = win.m AND grams.g = win.g
), hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM occ) GROUP BY rid
), it AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
