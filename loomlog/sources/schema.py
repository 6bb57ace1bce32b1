"""Schemas of the log's tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BinaryType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LABELS = T.MapType(S, S)
POSITION = _struct(stream_id=S, offset=L)
METADATA = _struct(actor=S, reason=S, labels=LABELS)
RECORDS = _struct(stream_id=S, offset=L, payload=B)
#: kind: root, branch or merge; one parent of a branch, two or more of a merge, whose base (if any) is what it inherits.
STREAMS = _struct(stream_id=S, kind=S, parents=T.ArrayType(POSITION), merge_base=POSITION, policy=S, metadata=METADATA)
EDGES = _struct(stream_id=S, parent_id=S, fork_offset=L)
SEGMENTS = _struct(stream_id=S, segment_id=S, start_offset=L, last_offset=L, record_count=L, stored_bytes=L, digest=S, rolled_at=L, path=S)
CURSORS = _struct(cursor_id=S, stream_id=S, position=L, actor=S, reason=S, labels=LABELS, created_at=L, updated_at=L)
CHECKPOINTS = _struct(materialization_id=S, stream_id=S, anchor_offset=L, manifest_root=S, state_path=S, produced_at=L)
KEY_VALUE = _struct(key=B, value=B)
EVENTS_JSON = _struct(reference_id=S, display_name=S, status=S, deleted=T.BooleanType())
