"""Vocabularies of payloads: traces of agents, threaded channels, artifacts. Builders write JSON, views read it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.scalars import parse_merge_policy

_COMMON = "type string, actor_id string, created_at bigint, reason string, labels map<string,string>"
SCHEMAS = {
    "agent.tool_call": f"{_COMMON}, task_id string, trace_kind string, tool_call_id string, tool_name string, phase string, payload_ref string",
    "agent.evaluator_decision": f"{_COMMON}, task_id string, trace_kind string, decision string, score double, subject_ref string",
    "agent.checkpoint": f"{_COMMON}, task_id string, trace_kind string, checkpoint_kind string, summary_ref string",
    "message.posted": f"{_COMMON}, channel_id string, communication_kind string, author_id string, message_id string, body_ref string",
    "thread.reply": f"{_COMMON}, channel_id string, communication_kind string, author_id string, message_id string, body_ref string, thread_stream_id string",
    "artifact": f"{_COMMON}, artifact_id string, artifact_kind string, role string, digest string, byte_length bigint, content_type string, location string, supersedes_ref string, parents array<string>",
}
#: Roles that an artifact's label can have.
ROLES = ("summary", "backlink", "merge-outcome", "human-override", "classifier-evidence")


def _payload(kind: str, **fields) -> bytes:
    names = {c.split()[0] for c in SCHEMAS[kind].split(", ")}
    if odd := fields.keys() - names:
        raise ValueError(f"{kind} has no {sorted(odd)}")
    for name, value in fields.items():
        if isinstance(value, str) and not value.strip():
            raise ValueError(f"{name} must not be blank")
    return json.dumps({"type": kind} | {k: v for k, v in fields.items() if v is not None}, separators=(",", ":"), sort_keys=True).encode()


def tool_call(task_id: str, tool_call_id: str, tool_name: str, phase: str, **more) -> bytes:
    if phase not in ("request", "result"):
        raise ValueError("a tool call is a request or a result")
    return _payload("agent.tool_call", task_id=task_id, tool_call_id=tool_call_id, tool_name=tool_name, phase=phase, **more)


def evaluator_decision(task_id: str, decision: str, **more) -> bytes:
    return _payload("agent.evaluator_decision", task_id=task_id, decision=decision, **more)


def completion_checkpoint(task_id: str, **more) -> bytes:
    return _payload("agent.checkpoint", task_id=task_id, **more)


def channel_message(channel_id: str, message_id: str, author_id: str, **more) -> bytes:
    return _payload("message.posted", channel_id=channel_id, message_id=message_id, author_id=author_id, **more)


def thread_reply(channel_id: str, message_id: str, author_id: str, thread_stream_id: str, **more) -> bytes:
    return _payload("thread.reply", channel_id=channel_id, message_id=message_id, author_id=author_id, thread_stream_id=thread_stream_id, **more)


def artifact(artifact_id: str, role: str, digest: str, byte_length: int, **more) -> bytes:
    if role not in ROLES:
        raise ValueError(f"not a role: {role}")
    if role == "merge-outcome" and len(more.get("parents") or ()) < 2:
        raise ValueError("an outcome of a merge has two parents or more")
    return _payload("artifact", artifact_id=artifact_id, role=role, digest=digest, byte_length=byte_length, **more)


def root_labels(kind: str, **labels: str) -> dict[str, str]:
    """Labels of a root stream: of a task or a channel."""
    return {"kind": kind, **{k: v for k, v in labels.items() if v}}


def branch_labels(kind: str, anchor: str | None = None, **labels: str) -> dict[str, str]:
    """Labels of a branch: a retry or critique of a task, or a thread (by hand or by a classifier) at ``message:<id>``."""
    return {"branch_kind": kind, **({"anchor_ref": anchor} if anchor else {}), **{k: str(v) for k, v in labels.items() if v is not None}}


def _stated(**fields: str) -> dict[str, str]:
    for name, value in fields.items():
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must not be blank")
    return fields


def trace_merge(task_id: str, actor_id: str, reason: str, parents: list[tuple[str, int]], policy: str, merge_reason: str) -> dict:
    """What ``Log.create_merge`` takes to merge branches of a task: ``parents, policy, metadata``. The labels repeat policy, reason and parents."""
    stated = _stated(task_id=task_id, actor_id=actor_id, reason=reason, merge_reason=merge_reason)
    policy = parse_merge_policy(policy)
    label = "fast-forward" if policy == "fast_forward" else policy.removeprefix("custom:")
    labels = stated | {"trace_kind": "merge", "merge_policy": label, "merge_parents": ",".join(f"{s}@{o}" for s, o in parents)}
    return {"parents": parents, "policy": policy, "metadata": {"actor": actor_id, "reason": reason, "labels": labels}}


def classifier_evidence(decision_id: str, classifier_id: str, classifier_version: str, anchor_message_id: str, anchor_offset: int, decision: str, decided_at: int, score: float | None = None, threshold: float | None = None, evidence_ref: str | None = None) -> dict[str, str]:
    """Labels of a thread that a classifier has opened, or of its evidence artifact. Score and threshold are recorded, not compared, and only together."""
    if (score is None) != (threshold is None):
        raise ValueError("a score goes with its threshold")
    if anchor_offset < 0:
        raise ValueError("an offset is not negative")
    labels = _stated(decision_id=decision_id, classifier_id=classifier_id, classifier_version=classifier_version, anchor_message_id=anchor_message_id, decision=decision)
    more = {"fork_offset": anchor_offset, "decided_at": decided_at, "score": score, "threshold": threshold, "evidence_ref": evidence_ref}
    return labels | {k: str(v) for k, v in more.items() if v is not None}


def classifier_artifact(artifact_id: str, digest: str, byte_length: int, evidence: dict[str, str], **more) -> bytes:
    """The evidence of a classifier's decision as an artifact."""
    return artifact(artifact_id, "classifier-evidence", digest, byte_length, labels=evidence, **more)


def typed(history: DataFrame, kind: str) -> DataFrame:
    """The records of one type, with its fields as columns; payloads that don't parse are left out."""
    text = F.col("payload").cast("string")
    rows = history.withColumn("e", F.from_json(text, SCHEMAS[kind])).where(F.col("e.type") == kind)
    return rows.select(*(c for c in history.columns if c != "payload"), "e.*")


def label(labels: Column, name: str) -> Column:
    return F.try_element_at(labels, F.lit(name))


def tool_call_pairs(calls: DataFrame) -> DataFrame:
    """Requests with their results (or null): ``task_id, tool_call_id, tool_name, request_offset, result_offset``."""
    request = calls.where("phase = 'request'").select("task_id", "tool_call_id", "tool_name", F.col("offset").alias("request_offset"))
    result = calls.where("phase = 'result'").groupBy("task_id", "tool_call_id").agg(F.min("offset").alias("result_offset"))
    return request.join(result, ["task_id", "tool_call_id"], "left")


def threads(messages: DataFrame, branches: DataFrame) -> DataFrame:
    """Messages with the branches anchored to them (label ``anchor_ref`` is ``message:<id>``)."""
    anchored = branches.select(F.col("stream_id").alias("thread_id"), label(F.col("labels"), "anchor_ref").alias("anchor")).where("anchor like 'message:%'")
    return messages.join(anchored.select("thread_id", F.expr("substring(anchor, 9)").alias("message_id")), "message_id")


def standing_overrides(overrides: DataFrame) -> DataFrame:
    """Of the overrides of each decision the latest by offset."""
    w = Window.partitionBy("supersedes_ref").orderBy(F.desc("offset"))
    return overrides.where("supersedes_ref is not null").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def envelopes(rows: DataFrame, ident: str, content: str, kind: str) -> DataFrame:
    """Envelopes that refer to large contents: ``artifact_id, artifact_kind, digest, byte_length``."""
    return rows.select(F.concat(F.lit(f"{kind}:"), F.col(ident).cast("string")).alias("artifact_id"), F.lit(kind).alias("artifact_kind"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce(content, F.lit(""))).cast("long").alias("byte_length"))


def finality(checkpoints: DataFrame, selections: DataFrame) -> DataFrame:
    """Checkpoints with whether a selection artifact has chosen them: ``stream_id, offset, root, selected``."""
    chosen = selections.select(F.col("stream_id"), F.col("offset"), F.lit(True).alias("selected")).distinct()
    return checkpoints.join(chosen, ["stream_id", "offset"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
