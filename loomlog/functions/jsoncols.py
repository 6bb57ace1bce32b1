"""JSON payloads as columns: kinds are inferred over the whole stream, widened, and the values read by the final kind.

Two passes, each one Arrow-batched map: the first gives the distinct (field, kind) pairs of its rows, folded by a group-by; the second
reads the columns. The driver sees one row for each field.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.plans.shipping import ship

RESERVED = ("_stream_id", "_offset", "_position", "_payload", "_payload_json")
KINDS = {"boolean": (T.BooleanType(), pa.bool_()), "bigint": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64()), "string": (T.StringType(), pa.string())}
_MOST, _LEAST = 2**63 - 1, -(2**63)


def _number(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return x


def _refuse(text: str):
    raise ValueError(text)


def parse(payload: bytes | None):
    """The JSON value of a payload, or ``ValueError``. Of equal names the last counts."""
    return json.loads(bytes(payload).decode("utf-8"), parse_float=_number, parse_constant=_refuse)


def compact(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def kind_of(value) -> str | None:
    """Null has no kind; arrays and objects are text; integers beyond 64 bits are floating."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if _LEAST <= value <= _MOST else "double"
    return "double" if isinstance(value, float) else "string"


def widen(kinds: set[str | None]) -> str:
    found = kinds - {None}
    if len(found) == 1:
        return found.pop()
    return "double" if found == {"bigint", "double"} else "string"


def coerce(value, kind: str):
    """A value as the column's kind; one that does not fit is null."""
    if value is None:
        return None
    own = kind_of(value)
    if kind == "string":
        return value if isinstance(value, str) else compact(value)
    if kind == "double":
        return float(value) if own in ("bigint", "double") else None
    return value if own == kind else None


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[tuple[str, str | None]] = set()
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            try:
                value = parse(payload or b"")
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict):
                found |= {(k, kind_of(v)) for k, v in value.items()}
    rows = sorted(found, key=str)
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], ["field", "kind"])


def infer(records: DataFrame, payload: str = "payload") -> dict[str, str]:
    """Kinds by field, in the order of the fields' names."""
    ship(records.sparkSession)
    pairs = records.select(F.col(payload).cast("binary")).mapInArrow(_pairs, "field string, kind string")
    rows = pairs.groupBy("field").agg(F.collect_set("kind").alias("kinds")).collect()
    return {r["field"]: widen(set(r["kinds"])) for r in sorted(rows, key=lambda r: r["field"])}


def column_names(fields: list[str]) -> dict[str, str]:
    """A field with a reserved name gets ``payload_`` in front until the name is free."""
    taken, out = {*RESERVED, *fields}, {}
    for field in fields:
        name = field
        if name in RESERVED:
            while name in taken:
                name = f"payload_{name}"
            taken.add(name)
        out[field] = name
    return out


def _columns(kinds: dict[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            columns: dict[str, list] = {f: [] for f in kinds}
            for payload in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    value = parse(payload or b"")
                    texts.append(compact(value))
                except (ValueError, RecursionError):
                    value = None
                    texts.append(None)
                row = value if isinstance(value, dict) else {}
                for f, kind in kinds.items():
                    columns[f].append(coerce(row.get(f), kind))
            arrays = [pa.array(columns[f], KINDS[k][1]) for f, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), *arrays], [str(i) for i in range(batch.num_columns + 1 + len(arrays))])

    return run


def json_table(history: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """A replayed stream (``stream_id, owner_id, offset, payload``) with one column for each JSON field.

    ``_stream_id`` is the stream asked for; ``_position`` names the owner of an inherited record. Payloads that are no JSON, or no
    objects, keep their row with nulls.
    """
    if kinds is None:
        kinds = infer(history)
    ship(history.sparkSession)
    names = column_names(list(kinds))
    base = history.select(F.col("stream_id").alias("_stream_id"), F.col("offset").alias("_offset"), F.concat("owner_id", F.lit("@"), F.col("offset").cast("string")).alias("_position"), F.col("payload").cast("binary").alias("_payload"))
    fields = [*base.schema.fields, T.StructField("_payload_json", T.StringType()), *(T.StructField(names[f], KINDS[k][0]) for f, k in kinds.items())]
    return base.mapInArrow(_columns(kinds), T.StructType(fields))
