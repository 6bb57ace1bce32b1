"""State derived from a log: folds by key, projections, differences, and tables written by INSERT records."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.plans.shipping import ship


def last_by_key(records: DataFrame, keys: list[str], value: str, order: str = "offset") -> DataFrame:
    """The value at the greatest offset for each key; a null there is the value. Combines on the map side."""
    return records.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def upsert(entries: DataFrame, key: str = "key", value: str = "value", order: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """Key and last value of each key; keys whose last entry deletes them are gone."""
    last = F.max_by(F.struct(F.col(value).alias("v"), (deleted if deleted is not None else F.lit(False)).alias("d")), order if order is not None else F.col("offset"))
    return entries.groupBy(key).agg(last.alias("x")).where(~F.col("x.d")).select(key, F.col("x.v").alias(value))


def merge_entries(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A key/value state with later entries (``key, value, seq, deleted``) folded in."""
    old = state.select("key", "value", F.lit(-1).cast("bigint").alias("seq"), F.lit(False).alias("deleted"))
    return upsert(old.unionByName(changes.select("key", "value", "seq", "deleted")), order=F.col("seq"), deleted=F.col("deleted"))


def lookup(table: DataFrame, key: Column) -> DataFrame:
    return table.where(F.col("key") == key)


def diff(before: DataFrame, after: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``key, change, before, after`` of keys added, removed or changed; a null value equals a null value."""
    a = before.select(F.col(key).alias("key"), F.col(value).alias("before"), F.lit(True).alias("in_before"))
    b = after.select(F.col(key).alias("key"), F.col(value).alias("after"), F.lit(True).alias("in_after"))
    both = a.join(b, "key", "full_outer")
    change = F.when(F.col("in_before").isNull(), F.lit("added")).when(F.col("in_after").isNull(), F.lit("removed")).when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    return both.withColumn("change", change).where("change is not null").select("key", "change", "before", "after")


def apply_diff(state: DataFrame, changes: DataFrame) -> DataFrame:
    kept = state.join(changes.select("key"), "key", "left_anti").select("key", "value")
    return kept.unionByName(changes.where("change <> 'removed'").select("key", F.col("after").alias("value")))


def duplicate_keys(entries: DataFrame, key: str = "key") -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def reference_projection(events: DataFrame, key: str = "reference_id", order: str = "offset", deleted: str = "deleted") -> DataFrame:
    """The last event of each key by offset, without the deleted ones."""
    columns = [c for c in events.columns if c not in (key, deleted)]
    last = F.max_by(F.struct(*columns, F.coalesce(F.col(deleted), F.lit(False)).alias("_gone")), order)
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("x")).where("not x._gone").select(key, *(f"x.{c}" for c in columns))


def fold_count(records: DataFrame) -> DataFrame:
    """Records processed and the last offset of each stream."""
    return records.groupBy("stream_id").agg(F.count("*").alias("processed"), F.max("offset").alias("last_offset"))


_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<mark>.)""",
    re.DOTALL,
)


class InsertError(ValueError):
    """A record that is no plain ``INSERT INTO .. VALUES``."""


def parse_insert(sql: str) -> tuple[str, list[tuple[str, str]]]:
    """Table (the last part of its name) and the pairs of one ``INSERT INTO t [(key, value)] VALUES ..`` statement."""
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql) if m.lastgroup]
    at = 0

    def peek(*words: str) -> bool:
        return at < len(tokens) and tokens[at][0] == "word" and tokens[at][1].upper() in words

    def take(kind: str, text: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or tokens[at][0] != kind or text is not None and tokens[at][1].upper() != text:
            raise InsertError(f"expected {text or kind}: {sql[:80]!r}")
        at += 1
        return tokens[at - 1][1]

    def name() -> str:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == "quoted":
            text = take("quoted")
            return text[1:-1].replace(text[0] * 2, text[0])
        return take("word")

    def listed(item) -> list:
        nonlocal at
        take("mark", "(")
        out = [item()]
        while at < len(tokens) and tokens[at] == ("mark", ","):
            at += 1
            out.append(item())
        take("mark", ")")
        return out

    def literal() -> str:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == "string":
            return take("string")[1:-1].replace("''", "'")
        if at < len(tokens) and tokens[at][0] == "number":
            return take("number")
        if peek("TRUE", "FALSE"):
            return take("word").lower()
        if peek("NULL"):
            raise InsertError("NULL is no key or value")
        if at + 1 < len(tokens) and tokens[at][0] == "word" and tokens[at + 1][0] == "string":  # a typed string
            at += 1
            return take("string")[1:-1].replace("''", "'")
        raise InsertError(f"not a literal: {sql[:80]!r}")

    take("word", "INSERT")
    take("word", "INTO")
    table = name()
    while at < len(tokens) and tokens[at] == ("mark", "."):
        at += 1
        table = name()
    order = (0, 1)
    if at < len(tokens) and tokens[at] == ("mark", "("):
        columns = [c.lower() for c in listed(name)]
        if sorted(columns) != ["key", "value"]:
            raise InsertError("the columns are key and value")
        order = (columns.index("key"), columns.index("value"))
    take("word", "VALUES")
    rows = []
    while True:
        row = listed(literal)
        if len(row) != 2:
            raise InsertError("a row has a key and a value")
        rows.append((row[order[0]], row[order[1]]))
        if at < len(tokens) and tokens[at] == ("mark", ","):
            at += 1
            continue
        break
    if at < len(tokens) and tokens[at] == ("mark", ";"):
        at += 1
    if at < len(tokens):
        raise InsertError("one statement, without further clauses")
    return table, rows


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for offset, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table, rows = parse_insert(bytes(payload).decode())
            out += [(table, offset, i, k.encode(), v.encode()) for i, (k, v) in enumerate(rows)]
        if out:
            t, o, i, k, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(o, pa.int64()), pa.array(i, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["table_name", "offset", "row", "key", "value"])


def insert_entries(records: DataFrame) -> DataFrame:
    """Rows of INSERT records: ``table_name, offset, row, key, value``. A record that is no such statement fails the query."""
    ship(records.sparkSession)
    return records.select("offset", F.col("payload").cast("binary")).mapInArrow(_parse, "table_name string, offset long, row int, key binary, value binary")


def insert_state(records: DataFrame) -> DataFrame:
    """``table_name, key, value`` after all INSERT records; the last row of a key wins."""
    return insert_entries(records).groupBy("table_name", "key").agg(F.max_by("value", F.struct("offset", "row")).alias("value"))
