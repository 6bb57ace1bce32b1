import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.functions import jsoncols, scalars
from loomlog.functions.last import rewrite_last
from loomlog.operators import state, workloads
from loomlog.plans.sqlsurface import Surface


def test_last_is_rewritten():
    assert rewrite_last("SELECT LAST(balance) FROM t") == "SELECT max_by(balance, _offset) FROM t"
    assert rewrite_last("SELECT last (balance ORDER BY event_offset) FROM t") == "SELECT max_by(balance, event_offset) FROM t"
    assert rewrite_last("SELECT LAST(x ORDER BY a DESC)") == "SELECT min_by(x, a)"
    assert rewrite_last("SELECT LAST(x ORDER BY a, b)") == "SELECT max_by(x, struct(a, b))"
    assert rewrite_last("SELECT 'LAST(x)', \"LAST(x)\", `LAST(x)`, blast(x) -- LAST(x)") == "SELECT 'LAST(x)', \"LAST(x)\", `LAST(x)`, blast(x) -- LAST(x)"
    assert rewrite_last("LAST(f(')', g(x)))") == "max_by(f(')', g(x)), _offset)"
    with pytest.raises(ValueError):
        rewrite_last("LAST(x")
    with pytest.raises(ValueError):
        rewrite_last("LAST(x ORDER BY a, b DESC)")


def test_insert_statements():
    assert state.parse_insert("INSERT INTO tasks (key, value) VALUES ('alpha','1')") == ("tasks", [("alpha", "1")])
    assert state.parse_insert("insert into a.b.\"My\"\"T\" VALUES ('it''s', 2.50), (TRUE, DATE '2020-01-01');") == ('My"T', [("it's", "2.50"), ("true", "2020-01-01")])
    assert state.parse_insert("INSERT INTO t (VALUE, Key) VALUES (1, 'k')") == ("t", [("k", "1")])
    for bad in ["SELECT 1", "INSERT INTO t VALUES ('a')", "INSERT INTO t VALUES ('a', NULL)", "INSERT INTO t VALUES ('a', -1)", "INSERT INTO t (a, b) VALUES (1, 2)", "INSERT INTO t SELECT 1, 2", "INSERT OVERWRITE t VALUES (1, 2)", "INSERT INTO t VALUES (1, 2); SELECT 1", "INSERT INTO t VALUES (1, 2) RETURNING key"]:
        with pytest.raises(state.InsertError):
            state.parse_insert(bad)


def test_positions(spark):
    row = spark.sql("SELECT 'a@b@12' AS p, 'k=v=w' AS q, 'none' AS r").select(scalars.position_stream(F.col("p")), scalars.position_offset(F.col("p")), scalars.pair_key(F.col("q")), scalars.pair_value(F.col("q")), scalars.pair_value(F.col("r")), scalars.position_offset(F.col("r"))).first()
    assert tuple(row) == ("a@b", 12, "k", "v=w", None, None)


def test_digests(spark):
    row = spark.sql("SELECT CAST('' AS BINARY) AS a, CAST('foobar' AS BINARY) AS b").select(scalars.fnv1a64("a"), scalars.fnv1a64("b"), scalars.chunk_score(F.col("b"))).first()
    assert tuple(row) == ("cbf29ce484222325", "85944171f73967e8", 0xC3AB8FF1)


def test_names():
    assert scalars.check_cursor_id("a/b:c.d_e-1")
    for bad in ("", "a b", "ü"):
        with pytest.raises(ValueError):
            scalars.check_cursor_id(bad)
    assert scalars.parse_merge_policy("custom:mine") == "custom:mine"
    with pytest.raises(ValueError):
        scalars.parse_merge_policy("custom:")


value = st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.text(max_size=3), x, max_size=2), max_leaves=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "_offset"]), value, max_size=3), max_size=5))
def test_kinds_hold_for_all_values(rows):
    """What has a column's own kind is kept; a column that is text keeps everything but nulls."""
    for field in {f for r in rows for f in r}:
        values = [r[field] for r in rows if field in r]
        kind = jsoncols.widen({jsoncols.kind_of(v) for v in values})
        for v in values:
            got = jsoncols.coerce(v, kind)
            assert (got is None) == (v is None)
            if kind == "string" and not isinstance(v, str) and v is not None:
                assert json.loads(got) == v


def test_json_columns(spark):
    texts = ['{"id":"1","n":1,"x":null,"_offset":7}', '{"id":2,"n":2.0,"b":true,"o":{"z":1,"a":[1]}}', "second", "5", '{"n":18446744073709551615,"n":3}', "NaN", '{"b":"no"}', ""]
    rows = spark.createDataFrame([("s", "s", i, bytearray(t.encode())) for i, t in enumerate(texts)], "stream_id string, owner_id string, offset bigint, payload binary")
    assert jsoncols.infer(rows) == {"_offset": "bigint", "b": "string", "id": "string", "n": "double", "o": "string", "x": "string"}
    t = jsoncols.json_table(rows)
    assert t.columns == ["_stream_id", "_offset", "_position", "_payload", "_payload_json", "payload__offset", "b", "id", "n", "o", "x"]
    got = {r["_offset"]: r for r in t.collect()}
    assert (got[0]["id"], got[0]["n"], got[0]["payload__offset"], got[0]["x"]) == ("1", 1.0, 7, None)
    assert (got[1]["id"], got[1]["b"], got[1]["o"]) == ("2", "true", '{"a":[1],"z":1}')
    assert got[2]["_payload_json"] is None and got[5]["_payload_json"] is None and got[3]["_payload_json"] == "5"
    assert got[4]["n"] == 3.0 and len(got) == len(texts)


def test_surface(spark):
    s = Surface(spark, "log")
    made = []

    def kv():
        made.append(1)
        return spark.sql("SELECT CAST('alpha' AS BINARY) AS key, CAST('1' AS BINARY) AS value, 0L AS _offset")

    s.register("tasks", kv)
    s.register("demo.root", spark.range(3).withColumnRenamed("id", "_offset"))
    with pytest.raises(ValueError):
        s.register("tasks", kv)
    assert not made
    for name in ("tasks", "public.tasks", "log.public.tasks"):
        assert s.query(f"SELECT COUNT(*) AS n FROM {name}").first()["n"] == 1
    assert s.query('SELECT tasks.key, r._offset FROM tasks, "demo.root" r WHERE r._offset = 2').count() == 1
    assert s.query('SELECT LAST(_offset) AS x FROM "demo.root"').first()["x"] == 2
    assert s.query("WITH c AS (SELECT key FROM tasks) SELECT * FROM c JOIN tasks t ON t.key = c.key").count() == 1
    assert s.query_key_values("SELECT key, value, 1 FROM tasks").columns == ["key", "value"]
    with pytest.raises(ValueError):
        s.query_key_values("SELECT _offset FROM tasks")
    assert s.names() == ["demo.root", "tasks"] and s.deregister("tasks") and not s.deregister("tasks")


def test_last_respects_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", None, 1)], "k string, v int, offset bigint")
    assert state.last_by_key(rows, ["k"], "v").first()["v"] is None


def test_workloads(spark):
    payloads = [workloads.tool_call("t", "c1", "grep", "request"), workloads.tool_call("t", "c1", "grep", "result"), workloads.tool_call("t", "c2", "ls", "request"), workloads.evaluator_decision("t", "accept", score=0.5), b"junk"]
    rows = spark.createDataFrame([("s", i, bytearray(p)) for i, p in enumerate(payloads)], "stream_id string, offset bigint, payload binary")
    pairs = workloads.tool_call_pairs(workloads.typed(rows, "agent.tool_call")).orderBy("request_offset").collect()
    assert [(r["tool_call_id"], r["request_offset"], r["result_offset"]) for r in pairs] == [("c1", 0, 1), ("c2", 2, None)]
    assert workloads.typed(rows, "agent.evaluator_decision").first()["score"] == 0.5
    for bad in (lambda: workloads.tool_call("t", "c", "n", "other"), lambda: workloads.tool_call(" ", "c", "n", "request"), lambda: workloads.artifact("a", "merge-outcome", "d", 1, parents=["x"]), lambda: workloads.artifact("a", "odd", "d", 1), lambda: workloads.channel_message("c", "m", "a", odd=1)):
        with pytest.raises(ValueError):
            bad()


def test_merges_and_evidence(spark):
    spec = workloads.trace_merge("t", "agent", "better", [("a", 1), ("b", 2)], "fast_forward", "both agree")
    assert spec["metadata"]["labels"]["merge_parents"] == "a@1,b@2" and spec["metadata"]["labels"]["merge_policy"] == "fast-forward"
    labels = workloads.classifier_evidence("d", "c", "v1", "m", 3, "thread", 9, 0.4, 0.5)
    assert labels["fork_offset"] == "3" and labels["score"] == "0.4" and "evidence_ref" not in labels
    row = spark.createDataFrame([("s", 0, bytearray(workloads.classifier_artifact("a", "d", 1, labels)))], "stream_id string, offset bigint, payload binary")
    assert workloads.typed(row, "artifact").first()["labels"] == labels
    for bad in (lambda: workloads.trace_merge(" ", "a", "r", [], "recursive", "x"), lambda: workloads.trace_merge("t", "a", "r", [], "odd", "x"), lambda: workloads.classifier_evidence("d", "c", "v", "m", 1, "x", 1, score=1.0), lambda: workloads.classifier_evidence("d", "", "v", "m", 1, "x", 1), lambda: workloads.classifier_evidence("d", "c", "v", "m", -1, "x", 1)):
        with pytest.raises(ValueError):
            bad()


def test_pairs_as_a_table(spark):
    found = Surface(spark)
    found.register_pairs("seed", ["a=1", "b=x=y", "c="])
    assert [(bytes(r["key"]), bytes(r["value"])) for r in found.query_key_values("SELECT key, value FROM seed ORDER BY key").collect()] == [(b"a", b"1"), (b"b", b"x=y"), (b"c", b"")]
    with pytest.raises(ValueError):
        found.register_pairs("bad", ["nothing"])


def test_config(tmp_path):
    from loomlog.config import LogConfig

    path = tmp_path / "c.json"
    path.write_text('{"root": "here", "segment_records": 10}')
    assert LogConfig.load(str(path), {"LOOMLOG_SEGMENT_RECORDS": "20", "LOOMLOG_READ_ONLY": "true"}) == LogConfig(root="here", segment_records=20, read_only=True)
    assert LogConfig.load(environ={}) == LogConfig()
    path.write_text('{"odd": 1}')
    for load in (lambda: LogConfig.load(str(path), {}), lambda: LogConfig.load(environ={"LOOMLOG_SEGMENT_RECORDS": "0"}), lambda: LogConfig.load(environ={"LOOMLOG_READ_ONLY": "maybe"})):
        with pytest.raises(ValueError):
            load()
