"""Secret scans: known shapes, and strings that a text vocabulary can hardly shorten.

Three kinds have a pattern (assignments, access keys, long hexadecimal strings). The method adds a fourth, ``random``: a run of
key characters is encoded with a byte-pair vocabulary learned on text; where a token covers few characters, nothing in
the run looks like language. What a known shape covers, UUIDs and digests are cut out of a run first, and what is left is judged by itself: as
a whole if no part between separators is a word, else part by part. Letters alone must cover fewer characters still, since
long words of many languages are cut finely too. Digits alone are numbers. Spans are in code points, end exclusive. Every text is
scanned whole, row by row, without a shuffle; the time is linear in its length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PART = re.compile(r"[A-Za-z0-9+]+")
#: Identifiers and digests that may look random.
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?<![A-Za-z0-9])(?:md5|sha1|sha224|sha256|sha384|sha512)[-=:_]?(?:[0-9a-fA-F]{32,}|[A-Za-z0-9+/]{22,}={0,2})", re.IGNORECASE | re.ASCII)
HEX_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
#: Fewest characters of a random string, and the most that a token of it covers on average; of letters alone.
SHORTEST = 20
MOST_PER_TOKEN, MOST_LETTERS_PER_TOKEN = 2.0, 1.75
MASK = "[SECRET]"
_ENCODINGS: dict[int, object] = {}


def ranks(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver (under a MB, whatever the input)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


#: How byte-pair vocabularies of this kind cut a text. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(source: bytes):
    """The worker's own encoding for this vocabulary."""
    key = hash(source)
    if key not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source.splitlines() if line)}
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the known shapes: of each kind the leftmost that don't overlap."""
    found = []
    lower = text.lower()
    if "pass" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _left(start: int, stop: int, cut: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a stretch without the spans ``cut`` (in order)."""
    for a, b in cut:
        if a > start:
            yield start, min(a, stop)
        start = max(start, b)
    if start < stop:
        yield start, stop


def _is_random(run: str, enc, most: float) -> bool:
    if run.isdigit() or HEX_DIGEST.fullmatch(run) or not any(map(str.isalnum, run)):
        return False
    if not any(map(str.isdigit, run)):
        most *= MOST_LETTERS_PER_TOKEN / MOST_PER_TOKEN
    return len(run) <= most * len(enc.encode_ordinary(run))


def _is_word(part: str, enc, most: float) -> bool:
    return len(part) > 3 and part.isalpha() and len(part) > most * len(enc.encode_ordinary(part))


def random_spans(text: str, enc, base: list[tuple[int, int, str]], most: float = MOST_PER_TOKEN) -> Iterator[tuple[int, int, str]]:
    """Stretches of at least ``SHORTEST`` characters that look random, apart from ``base`` (in order), UUIDs and named digests."""
    at = 0
    for m in RUN.finditer(text):
        start, stop = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        cut = []
        for i in range(at, len(base)):
            if base[i][0] >= stop:
                break
            cut.append(base[i][:2])
        named = [(x.start(), x.end()) for p in (UUID, DIGEST) for x in p.finditer(text, max(0, start - 8), stop)]
        for a, b in _left(start, stop, sorted(cut + named)):
            if b - a < SHORTEST:
                continue
            whole = _is_random(text[a:b], enc, most)
            found = [] if whole and not any(_is_word(p[0], enc, most) for p in _PART.finditer(text, a, b)) else [p.span() for p in _PART.finditer(text, a, b) if p.end() - p.start() >= SHORTEST and _is_random(p[0], enc, most)]
            if whole and not found:
                found = [(a, b)]
            for x, y in found:
                yield x, y, "random"


def spans(text: str, enc, most: float = MOST_PER_TOKEN) -> list[tuple[int, int, str]]:
    """All spans by start, then kind. Random ones overlap no others."""
    base, merged = base_spans(text), []
    for a, b, k in sorted(base):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), k)
        else:
            merged.append((a, b, k))
    return sorted(base + list(random_spans(text, enc, merged, most)), key=lambda s: (s[0], KINDS.index(s[2])))


def _scan(source, text: str, most: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(source.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in common.slices(batches):
            found = [[{"kind": k, "start": a, "stop": b} for a, b, k in spans(t or "", enc, most)] for t in batch.column(text).to_pylist()]
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, kind)], [*rest.schema.names, "spans"])

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: bytes | None = None, most: float = MOST_PER_TOKEN) -> DataFrame:
    """``doc_id, spans`` (array of ``kind, start, stop``) for every row, repeated ones too; an empty table gives none.

    A null or empty text has none; a text of any length is scanned in linear time. Ids may be null or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = spark.sparkContext.broadcast(vocabulary or ranks())  # a vocabulary file: under a MB, fixed
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    return rows.mapInArrow(_scan(source, "_text", most), T.StructType([rows.schema["doc_id"], T.StructField("spans", T.ArrayType(span))]))


def redacted(text: str | None, enc, most: float = MOST_PER_TOKEN, mask: str = MASK) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    found = spans(text or "", enc, most)
    if not found:
        return text
    out, at, stop = [], 0, -1
    for a, b, _ in found:
        if a >= stop:
            out += [text[at:a], mask] if stop < 0 else [text[stop:a], mask]
            at = stop = b
        stop = max(stop, b)
    return "".join([*out, text[stop:]])


def _redact(source, text: str, length: str | None, most: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(source.value)
        for batch in common.slices(batches):
            old = batch.column(text).to_pylist()
            new = [redacted(t, enc, most) for t in old]
            batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(new, batch.schema.field(text).type))
            if length:
                at = batch.schema.get_field_index(length)
                sizes = [n if a is b else len(b) for a, b, n in zip(old, new, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, length, pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return run


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", vocabulary: bytes | None = None, most: float = MOST_PER_TOKEN) -> DataFrame:
    """All rows and columns of ``docs``, secrets replaced by a mask; ``length``, if there is such a column, follows changed texts.

    Null and empty texts stay as they are, repeated rows too; an empty table gives none. Columns of any name stay.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = spark.sparkContext.broadcast(vocabulary or ranks())  # a vocabulary file: under a MB, fixed
    return docs.mapInArrow(_redact(source, text, length if length in docs.columns else None, most), docs.schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = scan(common.table(spark, sf_dir, "documents"))
    kind = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.size(kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(kind(*KINDS[:3])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
