"""Deep and wide lineages, on the driver and by joins; anchors, pages and plans."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import replay

POSITION = "struct<stream_id:string,offset:bigint>"
STREAMS = f"stream_id string, kind string, parents array<{POSITION}>, merge_base {POSITION}"


@pytest.fixture(params=["driver", "joins"])
def how(request, monkeypatch):
    if request.param == "joins":
        monkeypatch.setattr(replay, "SMALL", 0)
        monkeypatch.setattr(replay, "SMALL_PAIRS", 0)
    return request.param


def test_a_thousand_branches(spark, how):
    n = 1000 if how == "driver" else 70
    streams = spark.createDataFrame([("s0", "root", [], None)] + [(f"s{i}", "branch", [(f"s{i - 1}", i)], None) for i in range(1, n)], STREAMS)
    records = spark.createDataFrame([("s0", k, str(k)) for k in range(5)] + [(f"s{i}", i + 1, f"own{i}") for i in range(1, n)], "stream_id string, offset long, payload string")
    rows = replay.replay(records, streams, f"s{n - 1}", check=True).orderBy("offset").collect()
    assert [r["payload"] for r in rows] == ["0", "1"] + [f"own{i}" for i in range(1, n)] and [r["inherited"] for r in rows][-2:] == [True, False]


def test_diamonds(spark, how):
    n = 30 if how == "driver" else 8
    rows = [("m0", "root", [], None)]
    for i in range(1, n + 1):
        rows += [(f"{x}{i}", "branch", [(f"m{i - 1}", 0)], None) for x in "ab"] + [(f"m{i}", "merge", [(f"a{i}", 0), (f"b{i}", 0)], (f"m{i - 1}", 0))]
    got = {(r["stream_id"], r["ancestor_id"]): r["depth"] for r in replay.closure(spark.createDataFrame(rows, STREAMS)).collect()}
    assert got[f"m{n}", "m0"] == 2 * n and got[f"m{n}", f"a{n}"] == 1 and got["b1", "m0"] == 1 and ("m0", "m1") not in got
    assert len(got) == sum(3 * (i - 1) + 1 for i in range(1, n + 1)) * 2 + sum(3 * i for i in range(1, n + 1))


def test_closure_like_a_model(spark, how):
    rng = random.Random(8)
    parents = {f"s{i}": rng.sample([f"s{j}" for j in range(i)], min(i, rng.randint(0, 3))) for i in range(18)}
    rows = [(k, "merge" if len(v) > 1 else "branch" if v else "root", [(p, 0) for p in v], None) for k, v in parents.items()]
    want = {}
    for start in parents:
        level, depth = {start}, 0
        while level:
            depth += 1
            level = {p for x in level for p in parents[x]}
            for p in level:
                want.setdefault((start, p), depth)
    assert {(r[0], r[1]): r[2] for r in replay.closure(spark.createDataFrame(rows, STREAMS)).collect()} == want


def test_trimmed_anchors_raise(spark):
    streams = spark.createDataFrame([("a", "root", [], None), ("b", "branch", [("a", 2)], None)], STREAMS)
    records = spark.createDataFrame([("a", k, "x") for k in range(5)] + [("b", 3, "y")], "stream_id string, offset long, payload string")
    assert replay.replay(records, streams, "b", check=True).count() == 4
    with pytest.raises(replay.Trimmed):
        replay.replay(records.where("offset <> 2"), streams, "b", check=True)


def test_pages_that_are_empty(spark):
    history = spark.range(5).select(F.col("id").alias("offset"))
    assert [tuple(replay.page_status(history, a, 2).first()) for a in (0, 3, 5, 9)] == [(0, 2, True, 2), (3, 2, False, 5), (5, 0, False, 5), (9, 0, False, 9)]
    with pytest.raises(ValueError):
        replay.page_status(history, 0, 0)


def test_no_record_is_shuffled(spark):
    streams = spark.createDataFrame([("a", "root", [], None), ("b", "branch", [("a", 2)], None)], STREAMS)
    records = spark.range(100).select(F.lit("a").alias("stream_id"), F.col("id").alias("offset"), F.lit("x").alias("payload"))
    plan = replay.replay(records, streams, "b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_offsets_and_gaps_like_a_model(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 10**6), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, k long, i long").repartition(7)
    got = {r["i"]: r["offset"] for r in replay.assign_offsets(df, ["k", "i"], 10, ["s"]).collect()}
    for s in ("a", "b", None):
        assert [got[i] for _, i in sorted((k, i) for t, k, i in rows if t == s)] == list(range(10, 10 + sum(t == s for t, _, _ in rows)))
    offsets = [(s, o) for s in "ab" for o in sorted(rng.choices(range(60), k=50))]
    want = sorted((s, o, b) for (t, b), (s, o) in zip(offsets, offsets[1:]) if s == t and b + 1 != o)
    assert sorted(map(tuple, replay.gaps(spark.createDataFrame(offsets, "stream_id string, offset long")).collect())) == want
    assert replay.assign_offsets(df.limit(0), ["k"], 0).count() == 0
