"""The log itself: streams, branches and merges over Parquet segments.

A stream's state is a small document in numbered versions; a commit creates the next one, which fails if another writer was faster.
Data files are written before the commit that names them, so readers see whole batches only. Small appends collect in the active
head, which is sealed into a segment once it has enough records; a DataFrame is appended as a segment of its own.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import jsoncols, scalars
from loomlog.operators import integrity, replay, retention
from loomlog.sources import schema
from loomlog.sources.files import Files


class NotFound(LookupError):
    pass


class InvalidRequest(ValueError):
    pass


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass(frozen=True)
class Appended:
    first: int
    last: int
    count: int
    generation: int
    rolled: tuple[str, ...]


def _hex(text: str) -> str:
    return text.encode().hex()


class Log:
    def __init__(self, spark: SparkSession, root: str, segment_records: int = 1024, read_only: bool = False) -> None:
        self.spark, self.root, self.segment_records, self.read_only = spark, root.rstrip("/"), segment_records, read_only
        self.files = Files(spark)

    # state ------------------------------------------------------------------------------------------------------------

    def _folder(self, stream_id: str) -> str:
        return f"{self.root}/streams/{_hex(stream_id)}"

    def state(self, stream_id: str) -> dict:
        versions = self.files.names(f"{self._folder(stream_id)}/state")
        if not versions:
            raise NotFound(f"no stream {stream_id}")
        return self.files.read(f"{self._folder(stream_id)}/state/{versions[-1]}")

    def _commit(self, state: dict, old: int | None) -> dict:
        if self.read_only:
            raise InvalidRequest("this log is a read-only replica")
        return self._store(state, old)

    def _store(self, state: dict, old: int | None) -> dict:
        state["version"] = 0 if old is None else old + 1
        state["root"] = self.root_of(state)
        self._remember(f"{self._folder(state['stream_id'])}/roots", [state["root"]])
        try:
            self.files.create(f"{self._folder(state['stream_id'])}/state/{state['version']:020d}", state)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(state["stream_id"]) from e
            raise
        return state

    @staticmethod
    def root_of(state: dict) -> str:
        """Digest of what the manifest says; file locations are left out, so a restored copy has the same root."""
        said = {k: state[k] for k in ("stream_id", "kind", "parents", "merge_base", "policy", "metadata")}
        said["segments"] = [{k: s[k] for k in ("segment_id", "start_offset", "last_offset", "record_count", "digest")} for s in state["segments"]]
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()

    def _remember(self, folder: str, roots: list[str]) -> None:
        """An empty document for each root that a stream has had, so that any of them is found at once, however many there are."""
        for root in roots:
            if not self.files.exists(f"{folder}/{root}"):
                self.files.replace(f"{folder}/{root}", None)

    def had_root(self, stream_id: str, root: str) -> bool:
        return self.files.exists(f"{self._folder(stream_id)}/roots/{root}")

    def exists(self, stream_id: str) -> bool:
        return bool(self.files.names(f"{self._folder(stream_id)}/state"))

    def stream_ids(self) -> list[str]:
        return sorted(i for i in (bytes.fromhex(n).decode() for n in self.files.names(f"{self.root}/streams")) if self.exists(i))

    # streams ----------------------------------------------------------------------------------------------------------

    def _create(self, stream_id: str, kind: str, parents: list, base, policy, metadata: dict | None) -> dict:
        scalars.check_stream_id(stream_id)
        if self.exists(stream_id):
            raise InvalidRequest(f"stream {stream_id} already exists")
        for p in [*parents, *([base] if base else [])]:
            if p[0] == stream_id:
                raise InvalidRequest("a stream cannot be its own parent")
            if not 0 <= p[1] < self.state(p[0])["next_offset"]:
                raise InvalidRequest(f"{p[0]}@{p[1]} is not written yet")
        anchor = base if kind == "merge" else parents[0] if parents else None
        state = {
            "stream_id": stream_id, "kind": kind, "parents": [list(p) for p in parents], "merge_base": list(base) if base else None, "policy": policy,
            "metadata": {"actor": None, "reason": None, "labels": {}} | (metadata or {}), "generation": 0, "first_offset": anchor[1] + 1 if anchor else 0,
            "segments": [], "head": [], "retention": None, "published": 0,
        }
        state["next_offset"] = state["first_offset"]
        return self._commit(state, None)

    def create_root(self, stream_id: str, metadata: dict | None = None) -> dict:
        return self._create(stream_id, "root", [], None, None, metadata)

    def create_branch(self, stream_id: str, parent: tuple[str, int], metadata: dict | None = None) -> dict:
        """Metadata only, whatever the length of the history."""
        return self._create(stream_id, "branch", [parent], None, None, metadata)

    def create_merge(self, stream_id: str, parents: list[tuple[str, int]], base: tuple[str, int] | None = None, policy: str = "recursive", metadata: dict | None = None) -> dict:
        """Inherits the base's history only; the policy is recorded, not carried out."""
        if len(parents) < 2 or len({p[0] for p in parents}) < len(parents):
            raise InvalidRequest("a merge has two parents or more, of different streams")
        return self._create(stream_id, "merge", parents, base, scalars.parse_merge_policy(policy), metadata)

    def dependents(self, stream_id: str) -> list[str]:
        states = [self.state(i) for i in self.stream_ids()]
        return [s["stream_id"] for s in states if any(p[0] == stream_id for p in [*s["parents"], *([s["merge_base"]] if s["merge_base"] else [])])]

    def delete_stream(self, stream_id: str) -> None:
        state = self.state(stream_id)
        if children := self.dependents(stream_id):
            raise InvalidRequest(f"{stream_id} is needed by {children}")
        if state["published"]:
            raise InvalidRequest(f"{stream_id} is published")
        self.files.remove(self._folder(stream_id))

    def streams(self) -> DataFrame:
        """The streams' descriptors, as ``operators.replay`` reads them."""
        rows = []
        for i in self.stream_ids():
            s = self.state(i)
            m = s["metadata"]
            rows.append((i, s["kind"], [tuple(p) for p in s["parents"]], tuple(s["merge_base"]) if s["merge_base"] else None, s["policy"], (m["actor"], m["reason"], m["labels"])))
        return self.spark.createDataFrame(rows, schema.STREAMS)

    def status(self, stream_id: str | None = None) -> list[dict]:
        out = []
        for i in self.stream_ids() if stream_id is None else [stream_id]:
            s = self.state(i)
            active = sum(h["record_count"] for h in s["head"])
            out.append({"stream_id": i, "kind": s["kind"], "parents": [f"{a}@{b}" for a, b in s["parents"]], "next_offset": s["next_offset"], "record_count": s["next_offset"], "retained_record_count": active + sum(x["record_count"] for x in s["segments"]), "active_record_count": active, "active_head_start": s["next_offset"] - active, "retained_start_offset": self._retained_start(s), "segment_count": len(s["segments"]), "generation": s["generation"], "manifest_root": s["root"]})
        return out

    @staticmethod
    def _retained_start(state: dict) -> int:
        blocks = [*state["segments"], *state["head"]]
        return blocks[0]["start_offset"] if blocks else state["next_offset"]

    # writes -----------------------------------------------------------------------------------------------------------

    def append(self, stream_id: str, payload: bytes) -> Appended:
        return self.append_batch(stream_id, [payload])

    def append_batch(self, stream_id: str, payloads: list[bytes], most_records: int | None = None, most_bytes: int | None = None) -> Appended:
        """All or none of the payloads, at the next offsets. The limits are those of a serving front end, if there is one."""
        if not payloads:
            raise InvalidRequest("a batch has at least one record")
        if most_records and len(payloads) > most_records or most_bytes and sum(map(len, payloads)) > most_bytes:
            raise InvalidRequest("the batch is too large")
        state = self.state(stream_id)
        base = state["next_offset"]
        rows = self.spark.createDataFrame([(base + i, bytearray(p)) for i, p in enumerate(payloads)], "offset bigint, payload binary").coalesce(1)
        path = f"{self._folder(stream_id)}/data/head-{base:020d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(path)
        state["head"].append({"start_offset": base, "last_offset": base + len(payloads) - 1, "record_count": len(payloads), "path": path})
        state["next_offset"] = base + len(payloads)
        rolled = [self._seal(state)] if sum(h["record_count"] for h in state["head"]) >= self.segment_records else []
        state = self._commit(state, state["version"])
        if rolled and state["retention"]:
            self.enforce_retention(stream_id)
        return Appended(base, base + len(payloads) - 1, len(payloads), state["generation"], tuple(rolled))

    def append_frame(self, stream_id: str, rows: DataFrame, order: list[str], payload: str = "payload") -> Appended:
        """Append any number of rows in the given order, as a sealed segment."""
        state = self.state(stream_id)
        rolled = [self._seal(state)] if state["head"] else []
        base = state["next_offset"]
        numbered = replay.assign_offsets(rows.select(*order, F.col(payload).cast("binary").alias("payload")) if payload not in order else rows, order, base)
        segment = self._write_segment(state, numbered.select("offset", "payload"))
        if segment is None:
            raise InvalidRequest("a batch has at least one record")
        state["next_offset"] = segment["last_offset"] + 1
        state = self._commit(state, state["version"])
        if state["retention"]:
            self.enforce_retention(stream_id)
        return Appended(base, segment["last_offset"], segment["record_count"], state["generation"], (*rolled, segment["segment_id"]))

    def append_acknowledged(self, stream_id: str, payloads: list[bytes], remotes: list[str], needed: int | None = None) -> tuple[Appended, int]:
        """Append, then publish to the remotes until ``needed`` copies (by default a majority, this one among them) hold it; how many do."""
        needed = (len(remotes) + 1) // 2 + 1 if needed is None else needed
        done, copies = self.append_batch(stream_id, payloads), 1
        for remote in remotes:
            if copies >= needed:
                break
            if self.publish(stream_id, remote)["next_offset"] > done.last:
                copies += 1
        if copies < needed:
            raise InvalidRequest(f"{copies} of {needed} copies hold {stream_id}@{done.last}")
        return done, copies

    def produce_text(self, stream_id: str, path: str) -> Appended:
        """Append the lines of text files, in the order of files and lines, creating the stream as a root if need be."""
        if not self.exists(stream_id):
            self.create_root(stream_id)
        lines = self.spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("payload"))
        return self.append_frame(stream_id, lines, ["file", "block", "line"])

    def produce(self, stream_id: str, payloads: list[bytes]) -> Appended:
        """Append, creating the stream as a root if need be."""
        if not self.exists(stream_id):
            self.create_root(stream_id)
        return self.append_batch(stream_id, payloads)

    def _write_segment(self, state: dict, rows: DataFrame) -> dict | None:
        state["generation"] += 1
        name = f"segment-{state['generation']:020d}"
        path = f"{self._folder(state['stream_id'])}/data/{name}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema("offset bigint, payload binary").parquet(path).withColumn("s", F.lit(0))
        found = integrity.segment_summary(written, ["s"]).join(integrity.segment_digest(written, ["s"]), "s").first()
        if found is None:
            return None
        segment = {"segment_id": name, "start_offset": found["start_offset"], "last_offset": found["last_offset"], "record_count": found["record_count"], "stored_bytes": self.files.size(path), "digest": found["digest"], "rolled_at": int(time.time() * 1000), "path": path}
        state["segments"].append(segment)
        return segment

    def _seal(self, state: dict) -> str:
        rows = self.spark.read.schema("offset bigint, payload binary").parquet(*(h["path"] for h in state["head"])).repartitionByRange(1, "offset").sortWithinPartitions("offset")
        segment = self._write_segment(state, rows)
        state["head"] = []
        return segment["segment_id"]

    def roll(self, stream_id: str) -> str | None:
        """Seal the active head; an empty one is left alone."""
        state = self.state(stream_id)
        if not state["head"]:
            return None
        name = self._seal(state)
        state = self._commit(state, state["version"])
        if state["retention"]:
            self.enforce_retention(stream_id)
        return name

    def set_retention(self, stream_id: str, max_age_days: int | None = None, max_bytes: int | None = None) -> None:
        if not any((max_age_days, max_bytes)) or any(x is not None and x <= 0 for x in (max_age_days, max_bytes)):
            raise InvalidRequest("a policy needs an age or a budget above zero")
        state = self.state(stream_id)
        state["retention"] = {"max_age_days": max_age_days, "max_bytes": max_bytes}
        self._commit(state, state["version"])

    def enforce_retention(self, stream_id: str, now: int | None = None) -> list[str]:
        """Drop the oldest segments that the policy does not keep; the active head is never trimmed."""
        state = self.state(stream_id)
        if not state["retention"] or not state["segments"]:
            return []
        active = sum(self.files.size(h["path"]) for h in state["head"])
        rows = self.segments([stream_id])
        marked = retention.mark(rows, int(time.time() * 1000) if now is None else now, active_bytes=active, **state["retention"])
        gone = {r["segment_id"] for r in marked.where("trimmed").select("segment_id").collect()}
        if gone:
            paths = [s["path"] for s in state["segments"] if s["segment_id"] in gone]
            state["segments"] = [s for s in state["segments"] if s["segment_id"] not in gone]
            state["generation"] += 1
            self._commit(state, state["version"])
            for p in paths:
                self.files.remove(p)
        return sorted(gone)

    # reads ------------------------------------------------------------------------------------------------------------

    def segments(self, stream_ids: list[str] | None = None) -> DataFrame:
        rows = [(i, *(s[c] for c in schema.SEGMENTS.fieldNames()[1:])) for i in (self.stream_ids() if stream_ids is None else stream_ids) for s in self.state(i)["segments"]]
        return self.spark.createDataFrame(rows, schema.SEGMENTS)

    def owners(self, stream_id: str) -> list[tuple[str, int | None]]:
        """The streams whose records this one sees, itself first, each up to an offset."""
        out, at, bound = [], stream_id, None
        while True:
            state = self.state(at)
            out.append((at, bound))
            link = state["merge_base"] if state["kind"] == "merge" else state["parents"][0] if state["parents"] else None
            if link is None:
                return out
            at, bound = link[0], link[1] if bound is None else min(bound, link[1])

    def replay(self, stream_id: str, from_offset: int = 0) -> DataFrame:
        """``stream_id, owner_id, offset, payload, inherited`` in no particular order; only files that can have such offsets are read."""
        parts = []
        for depth, (owner, bound) in enumerate(self.owners(stream_id)):
            state = self.state(owner)
            if bound is not None and state["first_offset"] <= bound < self._retained_start(state):
                raise InvalidRequest(f"{owner}@{bound}, from which {stream_id} inherits, was trimmed")
            paths = [b["path"] for b in [*state["segments"], *state["head"]] if b["last_offset"] >= from_offset and (bound is None or b["start_offset"] <= bound)]
            if paths:
                rows = self.spark.read.schema("offset bigint, payload binary").parquet(*paths)
                rows = rows.where(F.col("offset") >= from_offset) if from_offset else rows
                rows = rows if bound is None else rows.where(F.col("offset") <= bound)
                parts.append(rows.select(F.lit(stream_id).alias("stream_id"), F.lit(owner).alias("owner_id"), "offset", "payload", F.lit(depth > 0).alias("inherited")))
        if not parts:
            return self.spark.createDataFrame([], "stream_id string, owner_id string, offset bigint, payload binary, inherited boolean")
        return reduce(DataFrame.unionByName, parts)

    def records(self) -> DataFrame:
        """Own records of all streams."""
        parts = [self.spark.read.schema("offset bigint, payload binary").parquet(*paths).select(F.lit(i).alias("stream_id"), "offset", "payload") for i in self.stream_ids() if (paths := [b["path"] for s in [self.state(i)] for b in [*s["segments"], *s["head"]]])]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema.RECORDS)

    def register(self, surface, stream_ids: list[str] | None = None) -> None:
        """Every stream, or those given, as a table of its JSON fields; read when a query names it."""
        for i in self.stream_ids() if stream_ids is None else stream_ids:
            surface.register(i, lambda i=i: jsoncols.json_table(self.replay(i)))

    def consume(self, stream_id: str, from_offset: int = 0, limit: int | None = None) -> DataFrame:
        rows = self.replay(stream_id, from_offset).orderBy("offset")
        return rows if limit is None else rows.limit(limit)

    # integrity and publication ----------------------------------------------------------------------------------------

    def verify(self, stream_id: str) -> list[str]:
        """What does not hold: the manifest's root, or segments by their id."""
        state = self.state(stream_id)
        bad = [] if state["root"] == self.root_of(state) else ["root"]
        if state["segments"]:
            rows = self.spark.read.schema("offset bigint, payload binary").parquet(*(s["path"] for s in state["segments"]))
            segment = F.regexp_extract("_metadata.file_path", r"/(segment-[0-9]{20})-[0-9a-f]+/[^/]*$", 1)
            rows = rows.select(F.lit(stream_id).alias("stream_id"), segment.alias("segment_id"), "offset", "payload")
            bad += [r["segment_id"] for r in integrity.verify(rows, self.segments([stream_id])).collect()]
        return bad

    def checkpoint(self, stream_id: str, kind: str = "manual") -> dict:
        state = self.state(stream_id)
        if state["next_offset"] == 0:
            raise InvalidRequest("an empty stream has nothing to anchor")
        return {"stream_id": stream_id, "head_offset": state["next_offset"] - 1, "manifest_root": state["root"], "kind": kind}

    def verify_checkpoint(self, checkpoint: dict, exact: bool = True) -> bool:
        """Exact: the root is the current one. Otherwise it may be any that the stream once had."""
        state = self.state(checkpoint["stream_id"])
        known = checkpoint["manifest_root"] == state["root"] if exact else self.had_root(checkpoint["stream_id"], checkpoint["manifest_root"])
        return known and checkpoint["head_offset"] < state["next_offset"] and not self.verify(checkpoint["stream_id"])

    def publish(self, stream_id: str, remote: str) -> dict:
        """Seal the head and copy what is missing: segments, then the manifest, then the frontier that points at it."""
        self.roll(stream_id)
        state = self.state(stream_id)
        top = f"{remote.rstrip('/')}/streams/{_hex(stream_id)}"
        self._remember(f"{top}/roots", self.files.names(f"{self._folder(stream_id)}/roots"))
        manifest = {k: v for k, v in state.items() if k not in ("head", "version")} | {"segments": []}
        for s in state["segments"]:
            path = f"{top}/segments/{s['segment_id']}-{s['digest'][:16]}"
            if not self.files.exists(f"{path}/_SUCCESS"):
                self.spark.read.schema("offset bigint, payload binary").parquet(s["path"]).write.mode("overwrite").option("compression", "zstd").parquet(path)
            manifest["segments"].append(s | {"path": path})
        name = f"manifest-{state['generation']:020d}"
        self.files.replace(f"{top}/manifests/{name}", manifest)
        frontier = {"stream_id": stream_id, "manifest_id": name, "generation": state["generation"], "root": state["root"], "next_offset": state["next_offset"]}
        self.files.replace(f"{top}/frontier", frontier)
        state["published"] = state["generation"] + 1
        self._commit(state, state["version"])
        return frontier

    def frontier(self, stream_id: str, remote: str) -> dict | None:
        path = f"{remote.rstrip('/')}/streams/{_hex(stream_id)}/frontier"
        return self.files.read(path) if self.files.exists(path) else None

    def restore(self, stream_id: str, remote: str) -> dict:
        """A copy of a published stream; refuses if it is here already."""
        if self.exists(stream_id):
            raise InvalidRequest(f"stream {stream_id} already exists")
        return self._pull(stream_id, remote, None)

    def sync_replica(self, stream_id: str, remote: str) -> dict:
        """Bring a copy up to the published frontier, fetching only what it lacks; a copy that has diverged raises."""
        return self._pull(stream_id, remote, self.state(stream_id) if self.exists(stream_id) else None)

    def _pull(self, stream_id: str, remote: str, state: dict | None) -> dict:
        frontier = self.frontier(stream_id, remote)
        if frontier is None:
            raise NotFound(f"{stream_id} is not published")
        manifest = self.files.read(f"{remote.rstrip('/')}/streams/{_hex(stream_id)}/manifests/{frontier['manifest_id']}")
        if self.root_of(manifest) != frontier["root"]:
            raise InvalidRequest("the manifest is damaged")
        here = {s["segment_id"]: s for s in state["segments"]} if state else {}
        if state and (state["head"] or state["next_offset"] > frontier["next_offset"]):
            raise InvalidRequest("the replica has diverged")
        segments = []
        for s in manifest["segments"]:
            if (own := here.get(s["segment_id"])) is not None:
                if own["digest"] != s["digest"]:
                    raise InvalidRequest("the replica has diverged")
                segments.append(own)
                continue
            path = f"{self._folder(stream_id)}/data/{s['segment_id']}-{uuid.uuid4().hex[:8]}"
            rows = self.spark.read.schema("offset bigint, payload binary").parquet(s["path"])
            rows.write.option("compression", "zstd").parquet(path)
            written = self.spark.read.schema("offset bigint, payload binary").parquet(path).withColumn("s", F.lit(0))
            if integrity.segment_digest(written, ["s"]).first()["digest"] != s["digest"]:
                raise InvalidRequest(f"{s['segment_id']} is damaged")
            segments.append(s | {"path": path, "stored_bytes": self.files.size(path)})
        self._remember(f"{self._folder(stream_id)}/roots", self.files.names(f"{remote.rstrip('/')}/streams/{_hex(stream_id)}/roots"))
        new = manifest | {"segments": segments, "head": [], "next_offset": frontier["next_offset"]}
        return self._store(new, state["version"] if state else None)

    # cursors ----------------------------------------------------------------------------------------------------------

    def _cursor_path(self, cursor_id: str) -> str:
        return f"{self.root}/cursors/{_hex(scalars.check_cursor_id(cursor_id))}"

    def create_cursor(self, cursor_id: str, stream_id: str, position: int = 0, actor: str | None = None, reason: str | None = None, labels: dict | None = None) -> dict:
        if not 0 <= position <= self.state(stream_id)["next_offset"]:
            raise InvalidRequest("the cursor is past the head")
        now = int(time.time())
        cursor = {"cursor_id": cursor_id, "stream_id": stream_id, "position": position, "actor": actor, "reason": reason, "labels": labels or {}, "created_at": now, "updated_at": now}
        if self.files.exists(self._cursor_path(cursor_id)):
            raise InvalidRequest(f"cursor {cursor_id} already exists")
        self.files.create(self._cursor_path(cursor_id), cursor)
        return cursor

    def cursor(self, cursor_id: str) -> dict:
        if not self.files.exists(self._cursor_path(cursor_id)):
            raise NotFound(f"no cursor {cursor_id}")
        return self.files.read(self._cursor_path(cursor_id))

    def advance_cursor(self, cursor_id: str, position: int) -> dict:
        """Forward only, not past the head; the same position again changes nothing."""
        cursor = self.cursor(cursor_id)
        if position < cursor["position"]:
            raise InvalidRequest("a cursor does not go back")
        if position > self.state(cursor["stream_id"])["next_offset"]:
            raise InvalidRequest("the cursor is past the head")
        if position > cursor["position"]:
            cursor |= {"position": position, "updated_at": int(time.time())}
            self.files.replace(self._cursor_path(cursor_id), cursor)
        return cursor

    ack_cursor = advance_cursor

    def delete_cursor(self, cursor_id: str) -> bool:
        return self.files.remove(self._cursor_path(cursor_id))

    def cursors(self, stream_id: str | None = None) -> DataFrame:
        rows = [self.files.read(f"{self.root}/cursors/{n}") for n in self.files.names(f"{self.root}/cursors")]
        rows = sorted((r for r in rows if stream_id in (None, r["stream_id"])), key=lambda r: r["cursor_id"])
        return self.spark.createDataFrame([tuple(r[c] for c in schema.CURSORS.fieldNames()) for r in rows], schema.CURSORS)
