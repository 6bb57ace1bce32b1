import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import integrity, replay, retention, snapshot, state
from loomlog.sources.log import Conflict, InvalidRequest, Log, NotFound
from loomlog.streaming import materialize as m


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, f"file://{tmp_path}/log", segment_records=2)


def payloads(rows):
    return [bytes(r["payload"]).decode() for r in rows.orderBy("offset").collect()]


def test_append_replay_and_segments(log):
    log.create_root("task.root")
    for text in (b"first", b"second", b"third"):
        got = log.append("task.root", text)
    assert (got.first, got.last, got.count) == (2, 2, 1)
    assert payloads(log.replay("task.root")) == ["first", "second", "third"]
    assert payloads(log.replay("task.root", 1)) == ["second", "third"]
    s = log.status("task.root")[0]
    assert (s["next_offset"], s["segment_count"], s["active_record_count"], s["active_head_start"]) == (3, 1, 1, 2)
    seg = log.segments().first()
    assert (seg["start_offset"], seg["last_offset"], seg["record_count"]) == (0, 1, 2)
    assert log.verify("task.root") == []
    with pytest.raises(InvalidRequest):
        log.create_root("task.root")
    with pytest.raises(InvalidRequest):
        log.append_batch("task.root", [])
    with pytest.raises(InvalidRequest):
        log.append_batch("task.root", [b"x"] * 3, most_records=2)
    with pytest.raises(NotFound):
        log.append("nowhere", b"x")
    with pytest.raises(ValueError):
        log.create_root("  ")


def test_two_writers(log):
    log.create_root("a")
    state = log.state("a")
    log.append("a", b"x")
    with pytest.raises(Conflict):
        log._commit(state, state["version"])


def test_branches_and_merges(log):
    log.create_root("a/b")
    log.create_root("a_b")
    log.append_batch("a/b", [b"seed", b"context"])
    log.create_branch("retry", ("a/b", 0))
    log.create_branch("critique", ("a/b", 1), {"labels": {"k": "v"}})
    log.append("retry", b"candidate-a")
    log.append("critique", b"candidate-b")
    log.append("a/b", b"later")
    assert payloads(log.replay("retry")) == ["seed", "candidate-a"]
    assert payloads(log.replay("critique")) == ["seed", "context", "candidate-b"]
    log.create_merge("merge", [("retry", 1), ("critique", 2)], ("a/b", 0))
    assert log.status("merge")[0]["next_offset"] == 1
    log.append("merge", b"merged-answer")
    assert payloads(log.replay("merge")) == ["seed", "merged-answer"]
    assert payloads(replay.replay(log.records(), log.streams(), "critique")) == ["seed", "context", "candidate-b"]
    assert replay.bad_anchors(log.streams(), replay.status(log.records(), log.streams())).count() == 0
    for bad in (lambda: log.create_branch("x", ("a/b", 9)), lambda: log.create_branch("x", ("x", 0)), lambda: log.create_merge("x", [("retry", 1)]), lambda: log.create_merge("x", [("retry", 1), ("retry", 0)]), lambda: log.delete_stream("a/b")):
        with pytest.raises((InvalidRequest, NotFound)):
            bad()
    log.delete_stream("merge")
    assert log.stream_ids() == ["a/b", "a_b", "critique", "retry"]


def test_append_frame(log, spark):
    log.create_root("big")
    log.append("big", b"zero")
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k"), (F.lit(999) - F.col("id")).cast("string").cast("binary").alias("payload")).repartition(7)
    got = log.append_frame("big", rows, ["k"])
    assert (got.first, got.last, got.count) == (1, 1000, 1000)
    assert payloads(log.replay("big")) == ["zero", *map(str, range(1000))]
    assert replay.gaps(log.replay("big")).count() == 0 and log.verify("big") == []


def test_retention_keeps_a_suffix(log):
    log.create_root("r")
    log.append_batch("r", [b"first", b"second"])
    log.append("r", b"third")
    log.create_branch("child", ("r", 0))
    log.set_retention("r", max_bytes=1)
    assert len(log.enforce_retention("r")) == 1
    assert log.status("r")[0]["retained_start_offset"] == 2 and payloads(log.replay("r")) == ["third"]
    with pytest.raises(InvalidRequest):
        log.replay("child")
    with pytest.raises(InvalidRequest):
        log.set_retention("r")


def test_retention_like_a_model(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for k in range(40):
        n, active, most = rng.randint(1, 8), 10, rng.randint(1, 300)
        sizes = [rng.randint(1, 60) for _ in range(n)]
        at = [rng.randint(0, 3) * retention.DAY for _ in range(n)]
        rows += [(f"s{k}", i, sizes[i], at[i], most) for i in range(n)]
        kept = active + sum(sizes)
        for i in range(n):
            if at[i] <= 3 * retention.DAY - 2 * retention.DAY or kept > 100:
                expected.add((f"s{k}", i))
                kept -= sizes[i]
            else:
                break
    df = spark.createDataFrame(rows, "stream_id string, start_offset bigint, stored_bytes bigint, rolled_at bigint, most bigint")
    got = retention.mark(df, now=3 * retention.DAY, max_age_days=2, max_bytes=100, active_bytes=10).where("trimmed")
    assert {(r["stream_id"], r["start_offset"]) for r in got.collect()} == expected


def test_publish_restore_and_replica(log, spark, tmp_path):
    remote = f"file://{tmp_path}/remote"
    log.create_root("p")
    log.append_batch("p", [b"a", b"b", b"c"])
    first = log.publish("p", remote)
    copy = Log(spark, f"file://{tmp_path}/copy", read_only=True)
    assert copy.restore("p", remote)["root"] == log.state("p")["root"] == first["root"]
    with pytest.raises(InvalidRequest):
        copy.restore("p", remote)
    with pytest.raises(InvalidRequest):
        copy.append("p", b"x")
    log.append("p", b"d")
    log.publish("p", remote)
    copy.sync_replica("p", remote)
    assert payloads(copy.replay("p")) == ["a", "b", "c", "d"] and copy.verify("p") == []
    with pytest.raises(InvalidRequest):
        log.delete_stream("p")
    with pytest.raises(NotFound):
        copy.restore("q", remote)


def test_tampering_is_found(log, spark):
    log.create_root("t")
    log.append_batch("t", [b"a", b"b"])
    check = log.checkpoint("t")
    assert log.verify_checkpoint(check)
    path = log.state("t")["segments"][0]["path"]
    spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"B"))], "offset bigint, payload binary").coalesce(1).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    assert log.verify("t") == ["segment-00000000000000000001"]
    log.append_batch("t", [b"c", b"d"])
    assert not log.verify_checkpoint(check)


def test_older_checkpoints(log):
    log.create_root("t")
    log.append_batch("t", [b"a", b"b"])
    check = log.checkpoint("t")
    log.append_batch("t", [b"c", b"d"])
    assert not log.verify_checkpoint(check) and log.verify_checkpoint(check, exact=False)
    log.create_root("empty")
    with pytest.raises(InvalidRequest):
        log.checkpoint("empty")


def test_cursors(log):
    log.create_root("c")
    log.append_batch("c", [b"a", b"b"])
    log.create_cursor("x/1", "c", 1)
    assert log.advance_cursor("x/1", 2)["position"] == 2 and log.ack_cursor("x/1", 2)["position"] == 2
    for bad in (lambda: log.advance_cursor("x/1", 1), lambda: log.advance_cursor("x/1", 3), lambda: log.create_cursor("x/1", "c"), lambda: log.create_cursor("y", "c", 9)):
        with pytest.raises(InvalidRequest):
            bad()
    assert [r["cursor_id"] for r in log.cursors("c").collect()] == ["x/1"] and log.delete_cursor("x/1") and not log.delete_cursor("x/1")
    with pytest.raises(NotFound):
        log.cursor("x/1")


def test_tail(log):
    log.create_root("t")
    log.append_batch("t", [b"a", b"b", b"c"])
    tail = m.Tail(log, "t", 1, credit=1)
    assert [bytes(r["payload"]) for r in tail.poll()[1]] == [b"b"] and tail.poll(5)[0] == "active" and tail.poll()[0] == "awaiting_records"
    log.append("t", b"d")
    assert [r["offset"] for r in tail.poll()[1]] == [3]
    tail.cancel()
    for bad in (tail.poll, tail.cancel, lambda: m.Tail(log, "t", 9), lambda: m.Tail(log, "t", 0, 257)):
        with pytest.raises((InvalidRequest, NotFound)):
            bad()


def test_materializer_applies_once_and_resumes(log):
    log.create_root("s")
    log.append_batch("s", [b"one", b"two"])
    a = m.Materializer(log, "count", "s", m.CountReducer())
    assert a.catch_up() == 2 and a.catch_up() == 0 and a.state == 2
    log.append("s", b"three")
    check = a.checkpoint()
    assert check["anchor_offset"] == 1 and a.pending() == 1
    b = m.Materializer(log, "count", "s", m.CountReducer())
    b.resume(check)
    assert b.catch_up() == 1 and b.state == 3
    with pytest.raises(InvalidRequest):
        m.Materializer(log, "count", "s", m.CountReducer()).resume(check | {"anchor_offset": 0, "lineage_ref": "s@0"})
    with pytest.raises(InvalidRequest):
        m.Materializer(log, "count", "s", m.CountReducer()).resume(check | {"stream_id": "other"})
    a.delete_checkpoint()
    with pytest.raises(NotFound):
        m.Materializer(log, "count", "s", m.CountReducer()).resume(check)


def test_reference_projection_view(log):
    log.create_root("refs")
    log.append_batch("refs", [b'{"reference_id":"a","display_name":"A","status":"new","deleted":false}', b'{"reference_id":"b","display_name":"B","status":"new"}'])
    k = m.KeyedMaterializer(log, "refs", "refs", m.reference_changes)
    k.step()
    log.append_batch("refs", [b'{"reference_id":"a","deleted":true}', b'{"reference_id":"b","display_name":"B2","status":"old"}', b"junk"])
    k.catch_up()
    assert [(r["key"], r["value"]) for r in k.view().collect()] == [("b", '{"display_name":"B2","status":"old"}')]
    whole = m.read_projection(log, "refs", k.checkpoint())
    assert [tuple(r) for r in whole["view"].collect()] == [tuple(r) for r in k.view().collect()]
    assert (whole["consumed"], whole["revision"], whole["checkpoint_matches"]) == (5, "projection:refs@4", True)


def test_insert_view(log):
    log.create_root("sql")
    log.append_batch("sql", [b"INSERT INTO tasks (key, value) VALUES ('alpha','1')", b"INSERT INTO x.y.tasks VALUES ('beta','2'),('beta','3'),('alpha','4')", b"INSERT INTO other VALUES (1, 2)"])
    k = m.KeyedMaterializer(log, "sql", "sql", m.insert_changes)
    k.step()
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in m.insert_table(k.view(), "tasks").collect()) == [(b"alpha", b"4"), (b"beta", b"3")]


def test_follow_a_folder(spark, tmp_path):
    src, view, check = (f"file://{tmp_path}/{x}" for x in ("src", "view", "check"))
    write = lambda rows: spark.createDataFrame([("s", o, bytearray(p)) for o, p in rows], "stream_id string, offset bigint, payload binary").coalesce(1).write.mode("append").parquet(src)
    event = lambda i, s, d="false": f'{{"reference_id":"{i}","status":"{s}","deleted":{d}}}'.encode()
    write([(0, event("a", "x")), (1, event("b", "x"))])
    m.follow(spark, src, m.reference_changes, view, check).awaitTermination(120)
    write([(2, event("a", "y")), (3, event("b", "x", "true"))])
    m.follow(spark, src, m.reference_changes, view, check).awaitTermination(120)
    assert [r["key"] for r in m.followed_view(spark, view).collect()] == ["a"]


def entries(spark, pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "key binary, value binary")


def test_snapshots_do_not_depend_on_history(spark):
    pairs = [(f"key-{i:03d}".encode(), bytes([i])) for i in range(100)]
    a = snapshot.build(entries(spark, pairs), 3)
    b = snapshot.build(entries(spark, pairs[::-1]).repartition(5), 3)
    assert sorted(map(tuple, a.drop("children").collect())) == sorted(map(tuple, b.drop("children").collect()))
    top = a.orderBy(F.desc("level")).first()
    assert top["n_entries"] == 100 and top["level"] >= 2 and bytes(top["high"]) == b"key-099"
    c = snapshot.build(entries(spark, [*pairs, (b"key-050a", b"x")]), 3)
    assert snapshot.root_digest(c) != snapshot.root_digest(a) and snapshot.shared_nodes(a, c).count() > a.count() // 2
    assert snapshot.manifest(a, "s", 7).first()["snapshot_id"] == "snapshot-00000000000000000007"
    with pytest.raises(ValueError):
        snapshot.build(entries(spark, [(b"k", b"1"), (b"k", b"2")]), 3)
    assert snapshot.build(entries(spark, []), 3).count() == 1


def test_folds_are_a_dict(spark):
    rng = random.Random(3)
    events = [(f"k{rng.randint(0, 9)}", str(i), i, rng.random() < 0.2) for i in range(200)]
    model = {}
    for k, v, _, gone in events:
        model.pop(k, None) if gone else model.update({k: v})
    df = spark.createDataFrame(events, "key string, value string, seq bigint, deleted boolean")
    got = state.upsert(df, order=F.col("seq"), deleted=F.col("deleted"))
    assert {r["key"]: r["value"] for r in got.collect()} == model
    half = state.upsert(df.where("seq < 100"), order=F.col("seq"), deleted=F.col("deleted"))
    assert {r["key"]: r["value"] for r in state.merge_entries(half, df.where("seq >= 100")).collect()} == model
    changes = state.diff(half, got)
    assert {r["key"]: r["value"] for r in state.apply_diff(half, changes).collect()} == model


def test_lineage_like_a_model(spark):
    """Random trees of branches against a model in plain Python."""
    rng = random.Random(11)
    position = "struct<stream_id:string,offset:bigint>"
    own, streams, history = {}, [], {}
    for i in range(12):
        name = f"s{i}"
        if i and rng.random() < 0.8:
            parent = rng.choice(list(history))
            fork = rng.choice(history[parent])[1]
            streams.append((name, "branch", [(parent, fork)], None))
            base, inherited = fork + 1, [x for x in history[parent] if x[1] <= fork]
        else:
            streams.append((name, "root", [], None))
            base, inherited = 0, []
        own[name] = [(name, base + j) for j in range(rng.randint(1, 5))]
        history[name] = inherited + own[name]
    records = spark.createDataFrame([(n, o, f"{n}.{o}") for rows in own.values() for n, o in rows], "stream_id string, offset bigint, payload string")
    got = replay.replay_all(records, spark.createDataFrame(streams, f"stream_id string, kind string, parents array<{position}>, merge_base {position}")).collect()
    assert {(r["stream_id"], r["owner_id"], r["offset"]) for r in got} == {(n, *x) for n, rows in history.items() for x in rows} and len(got) == sum(map(len, history.values()))


def test_digests_notice_order(spark):
    rows = lambda a, b: spark.createDataFrame([("s", 0, a), ("s", 1, b)], "s string, offset bigint, payload string")
    digest = lambda df: integrity.segment_digest(df, ["s"]).first()["digest"]
    assert digest(rows("a", "b")) != digest(rows("b", "a")) and digest(rows("a", "b")) == digest(rows("a", "b").repartition(2))


def test_retention_runs_when_a_segment_is_sealed(log, spark):
    log.create_root("r")
    log.set_retention("r", max_bytes=1)
    log.append_frame("r", spark.range(3).select("id", F.lit("x").alias("payload")), ["id"])
    assert log.segments(["r"]).count() == 0 and log.status("r")[0]["retained_start_offset"] == 3
    log.append("r", b"y")
    log.roll("r")
    assert log.segments(["r"]).count() == 0 and log.status("r")[0]["next_offset"] == 4
    rows = spark.createDataFrame([("a", 0, 1, None, 5), ("a", 1, 1, 200 * retention.DAY, 0)], "stream_id string, start_offset long, stored_bytes long, rolled_at long, modified_at long")
    assert [r["trimmed"] for r in retention.mark(rows, 100 * retention.DAY, 1).orderBy("start_offset").collect()] == [True, False]


def test_every_root_is_remembered(log, spark, tmp_path):
    log.create_root("t")
    checks = []
    for _ in range(3):
        log.append_batch("t", [b"a", b"b"])
        checks.append(log.checkpoint("t"))
    assert all(log.verify_checkpoint(c, exact=False) for c in checks) and not log.verify_checkpoint(checks[0] | {"manifest_root": "0" * 64}, exact=False)
    log.publish("t", f"file://{tmp_path}/remote")
    other = Log(spark, f"file://{tmp_path}/other", read_only=True)
    other.restore("t", f"file://{tmp_path}/remote")
    assert all(other.verify_checkpoint(c, exact=False) for c in checks)


def test_acknowledged_appends(log, tmp_path):
    log.create_root("t")
    remote = f"file://{tmp_path}/remote"
    done, copies = log.append_acknowledged("t", [b"a"], [remote])
    assert (done.last, copies) == (0, 2) and log.frontier("t", remote)["next_offset"] == 1
    with pytest.raises(InvalidRequest):
        log.append_acknowledged("t", [b"b"], [remote], needed=3)


def test_documents_are_replaced_whole(log):
    path = f"{log.root}/doc/one"
    for value in ({"a": 1}, {"a": 2}):
        log.files.replace(path, value)
        assert log.files.read(path) == value and log.files.names(f"{log.root}/doc") == ["one"]


def test_contracts(log):
    log.create_root("s")
    log.append("s", b"one")
    a = m.Materializer(log, "count", "s", m.CountReducer())
    a.catch_up()
    check = a.checkpoint(view_kind="counts", materializer_version="1", snapshot_ref="snap@1")
    assert len(check) == 15 and m.check_contract(check) is check
    for bad in ({"view_kind": " "}, {"snapshot_ref": ""}, {"anchor_offset": 5}, {"manifest_root": "x"}, {"lineage_anchor": None}, {"materialization_id": "?"}, {"lineage_ref": "s@9"}):
        with pytest.raises(ValueError):
            m.check_contract(check | bad)
    with pytest.raises(InvalidRequest):
        a.checkpoint(other_ref="x")


def test_live_records(log):
    log.create_root("t")
    log.append("t", b"old")
    left = [b"new", b"newer"]

    def idle():
        if not left:
            return False
        log.append("t", left.pop(0))
        return True

    assert [bytes(r["payload"]) for r in m.live(log, "t", poll_seconds=0, idle=idle)] == [b"new", b"newer"]
    assert [r["offset"] for r in m.live(log, "t", 1, idle=lambda: False)] == [1, 2]


def test_stored_leaves_after_changes(spark, tmp_path):
    """Point changes give the leaves of a tree built anew, reading few; damaged leaves are found."""
    rng = random.Random(11)
    schema = "key binary, value binary"
    table = {f"k{i:04d}".encode(): b"v" for i in range(400)}
    frame = lambda t: spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in t.items()], schema)
    store = snapshot.LeafStore(spark, f"file://{tmp_path}/leaves", 15)
    found = store.put(frame(table))
    ends = [bytes(r["high"]) for r in found.orderBy("node").collect()]
    steps = [{ends[2]: None}, {b"k0100x": b"new", ends[5]: None, ends[6]: None}, {b"zz": b"after all", b"a": b"before all"}, {rng.choice(list(table)): b"changed"}]
    for changes in steps:
        table = {k: v for k, v in (table | changes).items() if v is not None}
        rows = [(bytearray(k), None if v is None else bytearray(v), v is None) for k, v in changes.items()]
        found, read = store.update(found, spark.createDataFrame(rows, f"{schema}, deleted boolean"))
        want = snapshot.leaves(frame(table), 15)
        assert [tuple(r) for r in found.select("digest", "n_entries").orderBy("node").collect()] == [tuple(r) for r in want.orderBy("node").select("digest", "n_entries").collect()]
        assert len(read) <= 2 * len(changes) and len(read) < want.count() / 2
    assert snapshot.root_digest(snapshot.over_leaves(found, 15)) == snapshot.root_digest(snapshot.build(frame(table), 15))
    some = [r["digest"] for r in found.limit(2).collect()]
    assert {r["digest"] for r in store.get(some).collect()} == set(some) and store.get([]).count() == 0
    with pytest.raises(ValueError):
        store.get(["0" * 64])
    spark.createDataFrame([(bytearray(b"x"), bytearray(b"y"))], schema).write.mode("append").parquet(f"file://{tmp_path}/leaves/digest={some[0]}")
    with pytest.raises(ValueError):
        store.get(some)


def test_stored_leaves_share_files(spark, tmp_path):
    """Thousands of leaves take a few files, and equal leaves are written once; leaves in folders of their own, as earlier stores have them, are read."""
    rows = spark.range(3000).selectExpr("CAST(lpad(id, 6, '0') AS BINARY) AS key", "CAST('v' AS BINARY) AS value")
    store = snapshot.LeafStore(spark, f"file://{tmp_path}/leaves", 3)
    found = store.put(rows)
    n = found.count()
    assert n > 500 and len(list((tmp_path / "leaves").rglob("*.parquet"))) <= 16
    store.put(rows)
    assert store.get([r["digest"] for r in found.limit(5).collect()]).count() == found.limit(5).agg(F.sum("n_entries")).first()[0]
    assert store.digests().count() == n and store._rows().count() == 3000
    old = snapshot.LeafStore(spark, f"file://{tmp_path}/old", 3)
    some = [r["digest"] for r in found.orderBy("node").limit(40).collect()]
    store.get(some).write.partitionBy("digest").parquet(f"file://{tmp_path}/old")
    assert {r["digest"] for r in old.digests().collect()} == set(some) and old.get(some[:3]).select("digest").distinct().count() == 3
    ends = found.orderBy("node").limit(40)
    now, _ = old.update(ends, spark.createDataFrame([(bytearray(b"000001x"), bytearray(b"new"), False)], "key binary, value binary, deleted boolean"))
    want = snapshot.leaves(store.get(some).select("key", "value").unionByName(spark.createDataFrame([(bytearray(b"000001x"), bytearray(b"new"))], "key binary, value binary")), 3)
    assert [r["digest"] for r in now.orderBy("node").collect()] == [r["digest"] for r in want.orderBy("node").collect()]


def test_leaf_after_over_many_parts(spark):
    """The leaf at or after a key, where ranges of keys lie in many parts and some have no leaf."""
    rng = random.Random(3)
    leaves = {rng.randrange(1000): f"d{i}" for i in range(25)}
    keys = [k for k in range(1003) if rng.random() < 0.3 or k in leaves]
    frame = spark.createDataFrame([(k.to_bytes(2, "big"), d) for k, d in [*leaves.items(), *((k, None) for k in keys)]], "key binary, digest string")
    set_aside = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = snapshot._leaf_after(frame)
        got = sorted((int.from_bytes(r["key"], "big"), r["digest"] or "", r["after"]) for r in found.collect())
    finally:
        for k, v in set_aside.items():
            spark.conf.set(k, v)
    first = lambda low: next((leaves[k] for k in sorted(leaves) if k >= low), None)
    assert got == sorted([*((k, d, first(k + 1)) for k, d in leaves.items()), *((k, "", first(k)) for k in keys)], key=lambda r: r[:2])


def test_ordered_fold_in_ranges(spark, log, monkeypatch):
    """A reducer that depends on the order sees every record once, in order, though no task has more than a range of them."""

    class Chain:
        def initial(self):
            return {"hash": "", "n": 0, "last": -1, "tasks": []}

        def reduce(self, state, offset, payload):
            import hashlib

            from pyspark import TaskContext

            assert offset > state["last"]
            task = TaskContext.get().taskAttemptId()
            tasks = state["tasks"] if state["tasks"] and state["tasks"][-1][0] == task else [*state["tasks"], [task, 0]]
            tasks[-1][1] += 1
            return {"hash": hashlib.sha256(state["hash"].encode() + b"%d:" % offset + payload).hexdigest(), "n": state["n"] + 1, "last": offset, "tasks": tasks}

    log.create_root("long")
    log.append_frame("long", spark.range(3000).selectExpr("id", "repeat(CAST(id AS STRING), 1 + id % 5) AS payload").repartition(6), ["id"])
    want = m.Materializer(log, "whole", "long", Chain())
    want.catch_up()
    assert want.state["n"] == 3000 and len(want.state["tasks"]) == 1
    monkeypatch.setattr(m, "RANGE_BYTES", 20_000)
    parts = m.Materializer(log, "parts", "long", Chain())
    parts.catch_up()
    assert (parts.state["hash"], parts.state["n"], parts.state["last"]) == (want.state["hash"], 3000, 2999)
    assert len(parts.state["tasks"]) >= 5 and max(n for _, n in parts.state["tasks"]) <= 1200
    log.append_batch("long", [b"one", b"two"])
    assert parts.catch_up() == 2 and want.catch_up() == 2 and parts.state["hash"] == want.state["hash"]
