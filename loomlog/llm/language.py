"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed into a fixed number of buckets. Document frequencies are counted over all rows that may
be learned from. The classifier is fitted with follow-the-regularised-leader updates (per-coordinate rates, elastic-net
penalty: most weights are exactly zero) on a sample of at most ``MOST_ROWS`` different texts of each language, chosen by a hash; a
fifth of the sample is left out to fit the temperature that calibrates the scores. Whole texts are read throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import common

BUCKETS = 1 << 15
NGRAMS = 3
#: The bound on the sample: different texts of each language that the classifier is fitted on.
MOST_ROWS = 400
#: Languages that a model can have; it is BUCKETS x languages numbers, on the driver and on every worker. More are an error.
MOST_LANGUAGES = 200
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # also other numerals, such as fractions
_PART = 1 << 20


def counts(text: str | None) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased text, with a space before and after."""
    total = np.zeros(BUCKETS, np.int64)
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, codes.size, _PART):
        part = codes[at : at + _PART + NGRAMS - 1]
        n = min(_PART, codes.size - at)
        h = np.zeros(part.size, np.uint32)
        for k in range(NGRAMS):
            if part.size <= k:
                break
            h = h[: part.size - k] * np.uint32(0x01000193) + part[k:] + np.uint32(k + 1)
            total += np.bincount(((h[:n] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    return total


def weighted(found: np.ndarray, values: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the buckets found, of length one."""
    x = np.log1p(values) * idf[found]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


class Model:
    """Weights (buckets and a constant x languages) with elastic-net follow-the-regularised-leader updates."""

    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.z = np.zeros((idf.size + 1, len(languages)))
        self.n = np.zeros_like(self.z)
        self.w: np.ndarray | None = None

    def _weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, found: np.ndarray, x: np.ndarray, label: int) -> None:
        rows, x = np.r_[found, self.idf.size], np.r_[x, 1.0]
        w = self._weights(rows)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g

    def freeze(self) -> None:
        self.w = self._weights(np.arange(self.z.shape[0])).astype(np.float32)
        del self.z, self.n

    def logits(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.w[found] + self.w[-1]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """The temperature with the smallest loss, by golden-section search on its logarithm."""
        if not len(labels):
            return

        def loss(t: float) -> float:
            p = np.array([_softmax(row / np.exp(t)) for row in logits])
            return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

        a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
        for _ in range(40):
            c, d = b - r * (b - a), a + r * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.temperature = float(np.exp((a + b) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        all_counts = counts(text)
        found = np.flatnonzero(all_counts)
        p = _softmax(self.logits(found, weighted(found, all_counts[found], self.idf)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in common.slices(batches):
        for text in batch.column(0).to_pylist():
            total[:-1] += counts(text) > 0
            rows += 1
    total[-1] = rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def _sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once in a task; the sample's bound holds for what is remembered."""
    seen: set = set()
    for batch in common.slices(batches):
        fresh = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fresh.append(key not in seen)
            seen.add(key)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        found, values = [], []
        for text in batch.column(2).to_pylist():
            c = counts(text)
            at = np.flatnonzero(c)
            found.append(at.astype(np.int32))
            values.append(c[at].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["label", "h", "found", "counts"])


def fit(rows: DataFrame, text: str, label: str, most_rows: int = MOST_ROWS, epochs: int = EPOCHS) -> Model:
    """A model from the rows with a label. The sample: of each language the texts with the smallest hashes, ``most_rows`` at most, copies once.

    Rows without a label or a text are not learned from; without any the model says ``und``. More than ``MOST_LANGUAGES`` labels raise.
    """
    spark = rows.sparkSession
    common.ship(spark)
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    h: Column = F.xxhash64(F.lit(11), "text")
    texts = rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("texts"))
    sizes = {r["label"]: max(1, r["texts"]) for r in texts.orderBy(F.desc("n"), "label").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    frequency = np.zeros(BUCKETS + 1)
    for r in rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS + 1
        frequency[r["bucket"]] = r["n"]
    model = Model(languages, np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1)
    if not languages:
        model.freeze()
        return model
    share: Column = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("label") == name, F.lit(min(1.0, 0.9 * most_rows / n))).otherwise(share)
    chosen = rows.select("label", h.alias("h"), "text").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    sample: dict[str, list] = {name: [] for name in languages}
    sparse = chosen.mapInArrow(_sparse, "label string, h long, found array<int>, counts array<int>").dropDuplicates(["label", "h"]).orderBy("h", "label")
    for r in sparse.limit(most_rows * len(languages)).toArrow().to_batches(256):
        for name, found, values in zip(r.column("label").to_pylist(), r.column("found"), r.column("counts"), strict=True):
            if len(sample[name]) < most_rows:
                found, values = found.values.to_numpy(), values.values.to_numpy()
                sample[name].append((found, weighted(found, values, model.idf)))
    order = [(k, i) for k in range(len(languages)) for i in range(len(sample[languages[k]]))]
    order.sort(key=lambda x: (x[1], x[0]))  # languages in turn
    kept, left = [x for x in order if x[1] % 5 != 4], [x for x in order if x[1] % 5 == 4]
    for _ in range(epochs):
        for k, i in kept:
            model.learn(*sample[languages[k]][i], k)
    model.freeze()
    model.calibrate(np.array([model.logits(*sample[languages[k]][i]) for k, i in left]), np.array([k for k, _ in left], int))
    return model


def _predict(model, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in common.slices(batches):
            out = [m.predict(t) for t in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names)

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row; ``und`` with score 0 for a text that is null or has no letter.

    If ``keep`` has columns of these names, the new ones get a trailing underscore. Repeated rows each give a row, an empty table none; equal
    scores go to the first language by name. Texts of any length are counted in parts.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers, both bounded
    kept = docs.select(*keep)
    names = [common.free_name(kept, n) for n in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col(text).cast("string").alias(common.free_name(kept, "_text")))
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(_predict(shared, [f.name for f in schema.fields]), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the fold that nothing is learned from; a row without an id is not in it, and isn't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three of four folds. A table with no labelled rows gives ``und`` for all."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()), "text", "lang")
    return identify(docs, model, keep=(F.col("doc_id"), held_out().alias("held_out")))
