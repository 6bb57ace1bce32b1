"""Packing into sequences of fixed capacity: first-fit decreasing over a tournament tree of free space.

Each document's ids, with an end id, are cut where they are longer than a sequence: as many full pieces as there are, and a
rest. Pieces are dealt to randomised groups by a hash; each group is packed by itself, so nothing grows with the corpus but
the number of groups. Within a group pieces go by falling length into the first sequence with room, found in a
tree whose nodes hold the largest free space below them: O(log n) for each piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import common, tokens
from loomlog.plans import staging

CAPACITY = 2048
END = 1
#: Pieces for which a group is planned.
GROUP_PIECES = 8192
#: Parts among which equal pieces (rows repeated whole) are dealt, so that they don't share a group.
SALT = 256
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece. Pieces of equal length keep their order."""
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * size)
    used: list[int] = [0] * n
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need = lengths[i]
        if not 0 <= need <= capacity:
            raise ValueError(f"a piece of {need} does not fit into {capacity}")
        at = 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        b = at - size
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        tree[at] -= need
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def _pieces(source, capacity: int, end: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.WordEncoder.of(source.value)
        row = 0
        for batch in common.slices(batches, tokens.SLICE_BYTES):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(common.utf8(batch.column(1))), strict=True):
                ids += last
                n = len(ids) // 4
                row += 1
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    out.append((doc, s, len(part) // 4, zlib.crc32(part), n, row % SALT))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return run


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "start", "doc_tokens", "salt")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_pylist(), capacity)
        first = rows.column("part")[0].as_py() << 32
        kept = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text has the end id alone; a very long one is cut into as many pieces as it needs. Ids may be null or repeated: every
    row is a document of its own. No documents give no rows. Other columns of ``docs`` are not read. Sequences of
    different groups never share an id. Pieces (five numbers each) are written before they are dealt, so that a task that is
    repeated deals them as before.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = spark.sparkContext.broadcast(vocabulary or tokens.vocabulary())  # a vocabulary file: a few MB, fixed
    pieces = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(_pieces(source, capacity, end), f"{_PIECE}, salt long")
    pieces = staging.stage(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "salt"), F.lit(groups)).alias("part")
    return pieces.select("*", part).groupBy("part").applyInArrow(_pack(capacity), f"{_PIECE}, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(common.table(spark, sf_dir, "documents"))
