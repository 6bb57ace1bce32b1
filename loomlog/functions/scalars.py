"""Scalar functions of the log: positions, identifiers, digests, rules for names."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key ends a chunk where the low bits of its score are zero; one key in 2^20 by default.
CHUNK_MASK = 0x000F_FFFF
_CURSOR = re.compile(r"[A-Za-z0-9._/:-]+")


def position(stream_id: Column, offset: Column) -> Column:
    """``stream@offset``."""
    return F.concat(stream_id, F.lit("@"), offset.cast("string"))


def position_stream(text: Column) -> Column:
    """The stream of a position: all before the last ``@``; empty if it is none."""
    return F.regexp_extract(text, r"(?s)^(.*)@(\d+)$", 1)


def position_offset(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*)@(\d+)$", 2).try_cast("bigint")


def pair_key(text: Column) -> Column:
    """``key=value`` is split at the first ``=``."""
    return F.split(text, "=", 2)[0]


def pair_value(text: Column) -> Column:
    return F.get(F.split(text, "=", 2), F.lit(1))


def numbered(prefix: str, n: Column) -> Column:
    """``prefix-`` and the number with 20 digits."""
    return F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), 20, "0"))


def initial_offset(fork: Column, base: Column) -> Column:
    """Where a stream's own records begin: after its fork, after its merge base, or at 0."""
    return F.coalesce(fork + 1, base + 1, F.lit(0)).cast("bigint")


def lower_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


@F.pandas_udf(T.StringType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """FNV-1a with 64 bits, 16 hex digits; Spark has no such function."""

    def one(x: bytes | None) -> str | None:  # of equal values one is hashed
        if x is None:
            return None
        h = 0xCBF29CE484222325
        for b in bytes(x):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return data.map(cache(one))


def chunk_score(key: Column) -> Column:
    """The first four bytes of a key's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def chunk_boundary(key: Column, mask: int = CHUNK_MASK) -> Column:
    return chunk_score(key).bitwiseAND(F.lit(mask).cast("bigint")) == 0


def lease_millis(x: Column) -> Column:
    """Times below 10^12 are seconds."""
    return F.when(x < 10**12, x * 1000).otherwise(x).cast("bigint")


def retention_cutoff(now_millis: int, days: int) -> int:
    return max(0, now_millis - days * 86_400_000)


def not_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def quorum_size(members: Column) -> Column:
    """A majority; 0 of none."""
    return F.when(members == 0, F.lit(0)).otherwise(F.floor(members / 2) + 1).cast("bigint")


def merge_policy_label(policy: Column) -> Column:
    """Labels of policies: ``fast_forward`` is written ``fast-forward``; ``custom:<name>`` is its name."""
    return F.when(policy == "fast_forward", F.lit("fast-forward")).when(policy.startswith("custom:"), F.substring(policy, F.lit(8), F.length(policy))).otherwise(policy)


def position_list(positions: Column) -> Column:
    return F.array_join(F.transform(positions, lambda p: position(p["stream_id"], p["offset"])), ",")


def check_cursor_id(cursor_id: str) -> str:
    if not _CURSOR.fullmatch(cursor_id or ""):
        raise ValueError(f"not a cursor id: {cursor_id!r}")
    return cursor_id


def check_stream_id(stream_id: str) -> str:
    if not (stream_id or "").strip():
        raise ValueError("a stream id must not be blank")
    return stream_id


def parse_merge_policy(text: str) -> str:
    if text in ("fast_forward", "recursive") or text.startswith("custom:") and text[7:].strip():
        return text
    raise ValueError(f"not a merge policy: {text!r}")
