"""Derived views kept up with a log, and tails of it.

A materializer remembers the last offset it has applied, together with its state, so catching up twice applies nothing twice, and a
checkpoint is bound to what was reduced, not to wherever the head is. Keyed reducers are folds of DataFrames; reducers that
need every record in order run as one ordered pass.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import scalars
from loomlog.operators import state as folds
from loomlog.plans import staging
from loomlog.plans.shipping import ship
from loomlog.sources.files import Files
from loomlog.sources.log import InvalidRequest, Log, NotFound


class Reducer(Protocol):
    """``reduce(state, offset, payload) -> state``; the state can be written as JSON."""

    def initial(self) -> Any: ...

    def reduce(self, state: Any, offset: int, payload: bytes) -> Any: ...


class CountReducer:
    def initial(self) -> int:
        return 0

    def reduce(self, state: int, offset: int, payload: bytes) -> int:
        return state + 1


#: Bytes of records that one task of an ordered pass sorts, about; a record counts as its payload and 32 bytes.
RANGE_BYTES = 64 << 20


def fold_in_order(rows: DataFrame, reducer: Reducer, state: Any) -> Any:
    """One ordered pass, as such a reducer demands, a range of offsets after the other.

    Many tasks deal the records by ranges and write them; each range is then sorted and reduced by one task, which goes on from the state
    that the range before it has left. So no task holds more than a range, however long the log is.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("offset", "payload")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)) + F.lit(32))).first()[0] or 0
    if size <= RANGE_BYTES:
        return _fold_range(rows, reducer, state)
    with staging.Scratch(spark) as scratch:
        # An explicit number: adaptive plans leave it as it is. Sorted, so that files are in order even where a range is written as several.
        staged = scratch.stage(rows.repartitionByRange(-(-size // RANGE_BYTES), "offset").sortWithinPartitions("offset"), "ranges")
        firsts = staged.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("offset").alias("first")).collect()  # a row for each range
        for r in sorted(firsts, key=lambda r: r["first"]):
            state = _fold_range(spark.read.schema(rows.schema).parquet(f"{scratch.paths[-1]}/{r['file']}"), reducer, state)
    return state


def _fold_range(rows: DataFrame, reducer: Reducer, state: Any) -> Any:
    """The records in order through one task; a batch of them is in Python's memory at a time."""
    first = json.dumps(state)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = json.loads(first)
        for batch in batches:
            for offset, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = reducer.reduce(now, offset, bytes(payload))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(now)])], ["state"])

    done = rows.repartitionByRange(1, "offset").sortWithinPartitions("offset").mapInArrow(run, "state string").collect()
    return json.loads(done[-1]["state"]) if done else state


#: Fields of a checkpoint, beside those of its anchor, that may name something stored elsewhere.
_REFS = ("lineage_checkpoint_ref", "opaque_state_ref", "snapshot_ref")


def check_contract(checkpoint: dict) -> dict:
    """A checkpoint whose fields agree: identifiers are stated, the source is the anchor's, the reference names it."""
    try:
        scalars.check_cursor_id(checkpoint["materialization_id"])
        anchor = checkpoint["lineage_anchor"]
        for name in ("view_kind", "source_durability", "materializer_version"):
            if not (checkpoint[name] or "").strip():
                raise InvalidRequest(f"{name} must not be blank")
        for name in _REFS:
            if checkpoint[name] is not None and not checkpoint[name].strip():
                raise InvalidRequest(f"{name} must not be blank")
        if (checkpoint["stream_id"], checkpoint["anchor_offset"], checkpoint["manifest_root"]) != (anchor["stream_id"], anchor["head_offset"], anchor["manifest_root"]):
            raise InvalidRequest("the checkpoint's source is not its anchor")
        if checkpoint["lineage_ref"] != f"{checkpoint['stream_id']}@{checkpoint['anchor_offset']}":
            raise InvalidRequest("the checkpoint is of something else")
        if not {"generation", "state", "produced_at"} <= checkpoint.keys():
            raise InvalidRequest("the checkpoint is not whole")
    except (KeyError, TypeError, AttributeError) as e:
        raise InvalidRequest(f"the checkpoint lacks {e}") from e
    return checkpoint


class _Base:
    def __init__(self, log: Log, materialization_id: str, stream_id: str) -> None:
        self.log, self.id, self.stream_id = log, scalars.check_cursor_id(materialization_id), stream_id
        self.applied = -1

    def _apply(self, rows: DataFrame, upto: int) -> None:
        raise NotImplementedError

    def pending(self) -> int:
        return max(0, self.log.state(self.stream_id)["next_offset"] - (self.applied + 1))

    def catch_up(self) -> int:
        """Apply what is new up to the head as it is now; how many offsets that were."""
        head = self.log.state(self.stream_id)["next_offset"]
        n = max(0, head - (self.applied + 1))
        if n:
            rows = self.log.replay(self.stream_id, self.applied + 1).where(F.col("offset") < head)
            self._apply(rows, head - 1)
            self.applied = head - 1
        return n

    def _state_document(self) -> Any:
        raise NotImplementedError

    def _load(self, document: Any) -> None:
        raise NotImplementedError

    def _path(self) -> str:
        return f"{self.log.root}/materializations/{self.id.encode().hex()}/{self.stream_id.encode().hex()}"

    def checkpoint(self, view_kind: str = "materialization", materializer_version: str = "unspecified", durability: str = "local", **refs: str | None) -> dict:
        """Anchored at the last offset applied. ``refs``: a lineage checkpoint, state or snapshot stored elsewhere."""
        if self.applied < 0:
            raise InvalidRequest("nothing is applied yet")
        if odd := refs.keys() - set(_REFS):
            raise InvalidRequest(f"not a reference: {sorted(odd)}")
        state = self.log.state(self.stream_id)
        anchor = {"stream_id": self.stream_id, "head_offset": self.applied, "manifest_root": state["root"], "kind": "materialization"}
        found = {"materialization_id": self.id, "view_kind": view_kind, "stream_id": self.stream_id, "anchor_offset": self.applied, "generation": state["generation"], "manifest_root": state["root"], "source_durability": durability}
        found |= {"lineage_ref": f"{self.stream_id}@{self.applied}", "lineage_anchor": anchor, "state": self._state_document(), "produced_at": int(time.time()), "materializer_version": materializer_version}
        found |= dict.fromkeys(_REFS) | refs
        self.log.files.replace(self._path(), check_contract(found))
        return found

    def step(self) -> dict:
        self.catch_up()
        return self.checkpoint()

    def resume(self, checkpoint: dict | None = None) -> None:
        """Go on from a checkpoint, after checks in this order: contract, stored copy, generation, head, root, anchor record."""
        given = checkpoint
        if checkpoint is None or checkpoint.get("materialization_id") is not None:
            stored = self.log.files.read(self._path()) if self.log.files.exists(self._path()) else None
            checkpoint = checkpoint or stored
            if checkpoint is None:
                raise NotFound(f"no checkpoint of {self.id}")
            if (check_contract(checkpoint)["materialization_id"], checkpoint["stream_id"]) != (self.id, self.stream_id):
                raise InvalidRequest("the checkpoint is of something else")
            if given is not None and stored is None:
                raise NotFound("the checkpoint is not stored")
            if given is not None and given != stored:
                raise InvalidRequest("the checkpoint is not the stored one")
        state = self.log.state(self.stream_id)
        if checkpoint["generation"] > state["generation"] or checkpoint["anchor_offset"] >= state["next_offset"]:
            raise InvalidRequest("the checkpoint is ahead of the log")
        if not self.log.had_root(self.stream_id, checkpoint["manifest_root"]):
            raise InvalidRequest("the checkpoint is not of this history")
        if damaged := self.log.verify(self.stream_id):
            raise InvalidRequest(f"the log is damaged: {damaged}")
        at = checkpoint["anchor_offset"]
        if not self.log.replay(self.stream_id, at).where(F.col("offset") == at).limit(1).count():
            raise InvalidRequest("the anchor was trimmed")
        self._load(checkpoint["state"])
        self.applied = at

    def delete_checkpoint(self) -> bool:
        return self.log.files.remove(self._path())


class Materializer(_Base):
    """Any reducer, record by record in order."""

    def __init__(self, log: Log, materialization_id: str, stream_id: str, reducer: Reducer) -> None:
        super().__init__(log, materialization_id, stream_id)
        self.reducer, self.state = reducer, reducer.initial()

    def _apply(self, rows: DataFrame, upto: int) -> None:
        self.state = fold_in_order(rows, self.reducer, self.state)

    def _state_document(self) -> Any:
        return self.state

    def _load(self, document: Any) -> None:
        self.state = document


class KeyedMaterializer(_Base):
    """A key/value view as a table. ``changes``: new records to ``key, value, seq, deleted``; the greatest ``seq`` of a key wins."""

    def __init__(self, log: Log, materialization_id: str, stream_id: str, changes: Callable[[DataFrame], DataFrame]) -> None:
        super().__init__(log, materialization_id, stream_id)
        self.changes, self.path = changes, None

    def view(self) -> DataFrame:
        if self.path is None:
            return self.log.spark.createDataFrame([], "key string, value string")
        return self.log.spark.read.parquet(self.path)

    def _apply(self, rows: DataFrame, upto: int) -> None:
        new = self.changes(rows)
        path = f"{self.log.root}/views/{self.id.encode().hex()}/{upto:020d}-{uuid.uuid4().hex[:8]}"
        merged = folds.upsert(new, order=F.col("seq"), deleted=F.col("deleted")) if self.path is None else folds.merge_entries(self.view(), new)
        merged.write.option("compression", "zstd").parquet(path)
        old, self.path = self.path, path
        stored = self.log.files.read(self._path())["state"] if self.log.files.exists(self._path()) else None
        if old not in (None, stored):  # no checkpoint needs it
            self.log.files.remove(old)

    def _state_document(self) -> Any:
        return self.path

    def _load(self, document: Any) -> None:
        self.path = document


def reference_changes(rows: DataFrame) -> DataFrame:
    """Changes of the reference projection: JSON events with ``reference_id, display_name, status, deleted``."""
    e = rows.select("offset", F.from_json(F.col("payload").cast("string"), "reference_id string, display_name string, status string, deleted boolean").alias("e")).where("e.reference_id is not null")
    return e.select(F.col("e.reference_id").alias("key"), F.to_json(F.struct("e.display_name", "e.status")).alias("value"), F.struct("offset").alias("o"), F.coalesce("e.deleted", F.lit(False)).alias("deleted")).selectExpr("key", "value", "o.offset AS seq", "deleted")


def insert_changes(rows: DataFrame) -> DataFrame:
    """Changes of INSERT records; keys are ``table``, a zero character, then the key. Rows of one record go in their order."""
    e = folds.insert_entries(rows)
    last = e.groupBy("table_name", "key", "offset").agg(F.max_by("value", "row").alias("value"))
    return last.select(F.concat(F.col("table_name").cast("binary"), F.lit(b"\0"), F.col("key")).alias("key"), "value", F.col("offset").alias("seq"), F.lit(False).alias("deleted"))


def insert_table(view: DataFrame, name: str) -> DataFrame:
    """One table of an INSERT view as ``key, value``."""
    head = name.encode() + b"\0"
    return view.where(F.substring("key", 1, len(head)) == F.lit(head)).select(F.expr(f"substring(key, {len(head) + 1})").alias("key"), "value")


def read_projection(log: Log, stream_id: str, checkpoint: dict | None = None) -> dict:
    """A whole replay folded into the reference projection: the view, what was consumed, head, revision, whether a checkpoint matches it."""
    head = log.state(stream_id)["next_offset"]
    view = folds.upsert(reference_changes(log.replay(stream_id)), order=F.col("seq"), deleted=F.col("deleted"))
    return {"view": view, "consumed": log.replay(stream_id).count(), "head_offset": head - 1, "revision": f"projection:{stream_id}@{head - 1}", "checkpoint_matches": bool(checkpoint) and checkpoint["anchor_offset"] == head - 1}


class Tail:
    """A tail with credit: each poll delivers at most so many records and moves on."""

    MOST_CREDIT = 256

    def __init__(self, log: Log, stream_id: str, from_offset: int, credit: int = 100) -> None:
        if from_offset > log.state(stream_id)["next_offset"]:
            raise InvalidRequest("the tail begins past the head")
        self.log, self.stream_id, self.next_offset, self.open = log, stream_id, from_offset, True
        self.credit = self._valid(credit)

    def _valid(self, credit: int) -> int:
        if not 0 < credit <= self.MOST_CREDIT:
            raise InvalidRequest(f"credit is 1 to {self.MOST_CREDIT}")
        return credit

    def poll(self, credit: int | None = None) -> tuple[str, list]:
        """State (``active`` or ``awaiting_records``) and records."""
        if not self.open:
            raise NotFound("the tail is closed")
        n = self.credit if credit is None else self._valid(credit)
        rows = self.log.consume(self.stream_id, self.next_offset, n).collect()
        if rows:
            self.next_offset = rows[-1]["offset"] + 1
        return ("active" if rows else "awaiting_records"), rows

    def cancel(self) -> None:
        if not self.open:
            raise NotFound("the tail is closed")
        self.open = False


def live(log: Log, stream_id: str, from_offset: int | None = None, batch: int = 100, poll_seconds: float = 0.25, idle: Callable[[], bool] = lambda: True) -> Iterator[Any]:
    """Records as they come, from an offset or from the head as it is now; while there are none, ``idle`` says whether to go on waiting."""
    tail = Tail(log, stream_id, log.state(stream_id)["next_offset"] if from_offset is None else from_offset, batch)
    while True:
        rows = tail.poll()[1]
        yield from rows
        if not rows:
            if not idle():
                tail.cancel()
                return
            time.sleep(poll_seconds)


def follow(spark: SparkSession, path: str, changes: Callable[[DataFrame], DataFrame], view_path: str, checkpoint: str, schema: str = "stream_id string, offset bigint, payload binary", files_per_trigger: int = 64):
    """Structured Streaming over a folder of record files: every micro-batch is folded into a versioned key/value view.

    The view's versions are named by batch, so a batch that runs again writes the same version over and nothing is applied twice.
    """

    def fold(batch: DataFrame, number: int) -> None:
        new = changes(batch)
        before = f"{view_path}/{number - 1:020d}"
        old = batch.sparkSession.read.parquet(before).select("key", "value", "seq", "deleted") if number else None
        entries = new if old is None else old.unionByName(new)
        # Tombstones stay, with their number, so that files that arrive out of order fold to the same view.
        last = entries.groupBy("key").agg(F.max_by(F.struct("value", "seq", "deleted"), "seq").alias("x")).select("key", "x.value", "x.seq", "x.deleted")
        last.write.mode("overwrite").option("compression", "zstd").parquet(f"{view_path}/{number:020d}")
        if number > 1:  # a batch that runs again needs the version before it, no older one
            Files(batch.sparkSession).remove(f"{view_path}/{number - 2:020d}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed_view(spark: SparkSession, view_path: str) -> DataFrame:
    """The newest version of a followed view."""
    versions = [n for n in Files(spark).names(view_path) if n.isdigit()]
    return spark.read.parquet(f"{view_path}/{versions[-1]}").where("not deleted").select("key", "value")


