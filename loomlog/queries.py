"""Queries over the driver's tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import jsoncols, scalars
from loomlog.operators import cursors, integrity, replay, retention, snapshot, state, workloads
from loomlog.plans import staging
from loomlog.plans.sqlsurface import Surface
from loomlog.sources import testdata
from loomlog.sources.testdata import RECORDS_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _history(spark: SparkSession, sf_dir: str, stream_id: str) -> DataFrame:
    return replay.replay(testdata.records(spark, sf_dir), testdata.streams(spark), stream_id)


_LINEAGE = f"WITH RECURSIVE {RECORDS_SQL}"
_COLUMNS = 'stream_id, owner_id, "offset", payload, inherited'

# replay -----------------------------------------------------------------------------------------------------------------


def _replay_query(name: str, stream_id: str) -> None:
    query(f"{_LINEAGE} SELECT {_COLUMNS} FROM history WHERE stream_id = '{stream_id}'", name)(lambda spark, sf_dir: _history(spark, sf_dir, stream_id))


_replay_query("replay_root", "events")
_replay_query("branch_replay", "retry")
_replay_query("nested_branch_replay", "late")
_replay_query("merge_replay", "merged")


@query(f"{_LINEAGE} SELECT {_COLUMNS} FROM history")
def replay_all(spark, sf_dir):
    return replay.replay_all(testdata.records(spark, sf_dir), testdata.streams(spark))


@query(f"{_LINEAGE} SELECT {_COLUMNS} FROM history WHERE stream_id = 'critique' AND \"offset\" >= 545")
def tail_from(spark, sf_dir):
    return replay.tail_from(_history(spark, sf_dir, "critique"), 545)


@query(f"""{_LINEAGE} SELECT {_COLUMNS}, true AS has_more, CAST(640 AS BIGINT) AS next_offset FROM history WHERE stream_id = 'retry' AND "offset" BETWEEN 490 AND 639""")
def replay_page(spark, sf_dir):
    """A page that goes over the fork; the branch has more records than that at every size of the tables."""
    return replay.page(_history(spark, sf_dir, "retry"), 490, 150)


@query("""WITH p AS (SELECT * FROM (VALUES (0, 3), (990, 20), (100000000, 5)) t(from_offset, size)), e AS (SELECT from_offset, size, event_id, row_number() OVER (PARTITION BY from_offset ORDER BY event_id) AS r FROM p LEFT JOIN events ON event_id >= from_offset)
SELECT CAST(from_offset AS BIGINT) AS from_offset, count(event_id) FILTER (r <= size) AS n, count(event_id) > size AS has_more, coalesce(max(event_id) FILTER (r <= size) + 1, from_offset) AS next_offset FROM e GROUP BY from_offset, size""")
def page_status(spark, sf_dir):
    """Pages of the root stream, the last one empty."""
    history = _history(spark, sf_dir, "events")
    return replay.page_status(history, 0, 3).unionByName(replay.page_status(history, 990, 20)).unionByName(replay.page_status(history, 100_000_000, 5))


@query(f"{_LINEAGE} SELECT {_COLUMNS}, CASE WHEN inherited THEN 'prefix' ELSE 'suffix' END AS part FROM history WHERE stream_id = 'critique'")
def branch_view(spark, sf_dir):
    return replay.branch_view(testdata.records(spark, sf_dir), testdata.streams(spark), "critique")


@query("""WITH RECURSIVE p AS (SELECT * FROM (VALUES ('retry','events'),('critique','retry'),('late','critique'),('merged','retry'),('merged','critique')) t(stream_id, parent_id)),
up AS (SELECT stream_id, parent_id AS ancestor_id, 1 AS depth FROM p UNION ALL SELECT up.stream_id, p.parent_id, depth + 1 FROM up JOIN p ON p.stream_id = up.ancestor_id)
SELECT stream_id, ancestor_id, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY ALL""")
def lineage_closure(spark, sf_dir):
    return replay.closure(testdata.streams(spark))


@query("SELECT DISTINCT stream_id FROM (VALUES ('retry','events'),('critique','retry'),('late','critique'),('merged','retry'),('merged','critique'),('merged','events')) t(stream_id, parent_id) WHERE parent_id = 'retry'")
def dependent_streams(spark, sf_dir):
    return replay.dependents(testdata.streams(spark), "retry")


@query(f"""{_LINEAGE} SELECT s.stream_id, s.kind, s.parents, CAST(s.base AS BIGINT) AS first_offset, max("offset") + 1 AS next_offset, max("offset") + 1 AS record_count, count(*) AS retained_count, min("offset") AS retained_start, CAST(sum(length(payload)) AS BIGINT) AS payload_bytes
FROM own JOIN (VALUES ('events','root','',0),('retry','branch','events@499',500),('critique','branch','retry@549',550),('late','branch','critique@520',521),('merged','merge','retry@540,critique@560',300)) s(stream_id, kind, parents, base) USING (stream_id) GROUP BY ALL""")
def stream_status(spark, sf_dir):
    return replay.status(testdata.records(spark, sf_dir), testdata.streams(spark))


@query(f"""{_LINEAGE}, firsts AS (SELECT stream_id, min("offset") AS low FROM own GROUP BY stream_id)
SELECT up.stream_id, up.owner_id, up.bound AS "offset" FROM up JOIN firsts f ON f.stream_id = up.owner_id
WHERE up.bound >= f.low AND NOT EXISTS (SELECT 1 FROM own o WHERE o.stream_id = up.owner_id AND o."offset" = up.bound AND NOT (o.stream_id = 'retry' AND o."offset" = 520))""")
def missing_anchors(spark, sf_dir):
    """What can't be read any more once retry has lost the record at 520."""
    kept = testdata.records(spark, sf_dir).where("not (stream_id = 'retry' and offset = 520)")
    seen = replay.missing_anchors(kept, testdata.streams(spark))
    return seen


@query("SELECT 'bad' AS stream_id, 'nowhere' AS parent_id, CAST(3 AS BIGINT) AS \"offset\", CAST(NULL AS BIGINT) AS next_offset UNION ALL SELECT 'far', 'events', 99999999, max(event_id) + 1 FROM events")
def bad_anchors(spark, sf_dir):
    position = "struct<stream_id:string,offset:bigint>"
    more = spark.createDataFrame([("bad", "branch", [("nowhere", 3)], None), ("far", "branch", [("events", 99999999)], None)], f"stream_id string, kind string, parents array<{position}>, merge_base {position}")
    status = replay.status(testdata.records(spark, sf_dir), testdata.streams(spark))
    return replay.bad_anchors(more, status).select("stream_id", "parent_id", "offset", "next_offset")


@query(f"{_LINEAGE} SELECT stream_id, min(\"offset\") AS first_offset, max(\"offset\") AS last_offset, count(*) AS n, count(DISTINCT \"offset\") = max(\"offset\") - min(\"offset\") + 1 AND count(*) = count(DISTINCT \"offset\") AS contiguous FROM own GROUP BY stream_id")
def offset_contiguity(spark, sf_dir):
    return integrity.contiguity(testdata.records(spark, sf_dir))


@query("""SELECT event_type AS stream_id, "offset", before FROM (SELECT event_type, event_id AS "offset", lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND before + 1 <> "offset" """)
def offset_gaps(spark, sf_dir):
    return replay.gaps(testdata.events(spark, sf_dir).select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("offset")))


@query("SELECT event_type AS stream_id, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS \"offset\" FROM events")
def assign_offsets(spark, sf_dir):
    rows = testdata.events(spark, sf_dir).select(F.col("event_type").alias("stream_id"), "event_id")
    return replay.assign_offsets(rows, ["event_id"], 0, ["stream_id"])


# JSON columns and SQL ---------------------------------------------------------------------------------------------------


def _event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsoncols.json_table(_history(spark, sf_dir, "events"))


@query(f"""SELECT 'events' AS _stream_id, event_id AS _offset, 'events@' || CAST(event_id AS VARCHAR) AS _position, {testdata.PAYLOAD_SQL} AS _text, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, user_id, CAST(printf('%.2f', value) AS DOUBLE) AS value FROM events""")
def json_columns(spark, sf_dir):
    return _event_table(spark, sf_dir).withColumn("_text", F.col("_payload").cast("string")).drop("_payload", "_payload_json")


@query(f"""WITH p AS (SELECT {testdata.PAYLOAD_SQL} AS j FROM events), f AS (SELECT j, unnest(json_keys(j)) AS field FROM p), k AS (SELECT DISTINCT field, json_type(j, '$.' || field) AS t FROM f)
SELECT field, CASE WHEN bool_or(t = 'VARCHAR') THEN 'string' WHEN bool_or(t = 'DOUBLE') THEN 'double' ELSE 'bigint' END AS kind FROM k WHERE t <> 'NULL' GROUP BY field""")
def json_schema_inference(spark, sf_dir):
    return spark.createDataFrame(list(jsoncols.infer(_history(spark, sf_dir, "events")).items()), "field string, kind string")


def _surface(spark: SparkSession, sf_dir: str) -> Surface:
    found = Surface(spark)
    found.register("events", lambda: _event_table(spark, sf_dir))
    found.register("demo.retry", lambda: jsoncols.json_table(_history(spark, sf_dir, "retry")))
    return found


@query("SELECT count(*) AS n FROM events")
def count_stream(spark, sf_dir):
    return _surface(spark, sf_dir).query("SELECT COUNT(*) AS n FROM log.public.events")


@query("SELECT user_id, last(value ORDER BY event_id) AS value FROM events GROUP BY user_id")
def last_by_key(spark, sf_dir):
    return state.last_by_key(testdata.events(spark, sf_dir).select("user_id", "value", F.col("event_id").alias("offset")), ["user_id"], "value")


@query("SELECT user_id, last(CAST(printf('%.2f', value) AS DOUBLE) ORDER BY event_id) AS value, count(*) AS n FROM events GROUP BY user_id")
def sql_last(spark, sf_dir):
    return _surface(spark, sf_dir).query("SELECT user_id, LAST(value) AS value, COUNT(*) AS n FROM events GROUP BY user_id")


@query("SELECT event_type, last(user_id ORDER BY CAST(printf('%.2f', value) AS DOUBLE), event_id) AS user_id, first(event_id ORDER BY event_id) AS first_offset FROM events GROUP BY event_type")
def last_explicit_order(spark, sf_dir):
    return _surface(spark, sf_dir).query("SELECT event_type, LAST(user_id ORDER BY value, _offset) AS user_id, LAST(_offset ORDER BY _offset DESC) AS first_offset FROM events GROUP BY event_type")


@query(f"{_LINEAGE} SELECT owner_id, count(*) AS n FROM history WHERE stream_id = 'retry' GROUP BY owner_id")
def sql_quoted_name(spark, sf_dir):
    return _surface(spark, sf_dir).query("SELECT substring_index(_position, '@', 1) AS owner_id, COUNT(*) AS n FROM \"demo.retry\" GROUP BY 1")


# functions --------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, event_type || '@' || CAST(event_id AS VARCHAR) AS position, event_type AS stream_id, event_id AS "offset", 'segment-' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS segment_id,
  lower(hex(event_type)) AS hexed, sha256(event_type) AS digest, CASE WHEN event_id < 5000 THEN event_id * 1000 ELSE event_id END AS at, CAST(CASE WHEN user_id = 0 THEN 0 ELSE user_id // 2 + 1 END AS BIGINT) AS majority FROM events""")
def scalar_functions(spark, sf_dir):
    e = testdata.events(spark, sf_dir)
    at = scalars.position(F.col("event_type"), F.col("event_id"))
    millis = F.when(F.col("event_id") < 5000, scalars.lease_millis(F.col("event_id"))).otherwise(F.col("event_id"))
    return e.select("event_id", at.alias("position"), scalars.position_stream(at).alias("stream_id"), scalars.position_offset(at).alias("offset"), scalars.numbered("segment", F.col("event_id")).alias("segment_id"), scalars.lower_hex(F.col("event_type")).alias("hexed"), scalars.sha256(F.col("event_type")).alias("digest"), millis.alias("at"), scalars.quorum_size(F.col("user_id")).alias("majority"))


@query("""SELECT event_id, trim(event_type) <> '' AND user_id % 7 <> 0 AS named, CASE user_id % 3 WHEN 0 THEN 'recursive' WHEN 1 THEN 'fast-forward' ELSE event_type END AS policy, event_type || '@' || CAST(event_id AS VARCHAR) || ',x@' || CAST(user_id AS VARCHAR) AS positions,
  CASE WHEN user_id % 2 = 0 THEN event_id + 1 WHEN user_id % 3 = 0 THEN user_id + 1 ELSE 0 END AS first FROM events""")
def naming_functions(spark, sf_dir):
    e, third = testdata.events(spark, sf_dir), F.col("user_id") % 3
    policy = F.when(third == 0, F.lit("recursive")).when(third == 1, F.lit("fast_forward")).otherwise(F.concat(F.lit("custom:"), F.col("event_type")))
    at = F.array(F.struct(F.col("event_type").alias("stream_id"), F.col("event_id").alias("offset")), F.struct(F.lit("x").alias("stream_id"), F.col("user_id").alias("offset")))
    named = scalars.not_blank(F.when(F.col("user_id") % 7 == 0, F.lit("  ")).otherwise(F.col("event_type")))
    first = scalars.initial_offset(F.when(F.col("user_id") % 2 == 0, F.col("event_id")), F.when(third == 0, F.col("user_id")))
    return e.select("event_id", named.alias("named"), scalars.merge_policy_label(policy).alias("policy"), scalars.position_list(at).alias("positions"), first.alias("first"))


@query("""WITH t AS (SELECT DISTINCT event_type, list_transform(range(1, length(event_type) + 1), lambda i: CAST(ascii(substr(event_type, CAST(i AS INTEGER), 1)) AS HUGEINT)) AS bytes FROM events),
h AS (SELECT event_type, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), bytes), lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS x FROM t)
SELECT event_id, lpad(lower(hex(CAST(x AS UBIGINT))), 16, '0') AS checksum FROM events JOIN h USING (event_type)""")
def fnv_checksums(spark, sf_dir):
    return testdata.events(spark, sf_dir).select("event_id", scalars.fnv1a64(F.col("event_type").cast("binary")).alias("checksum"))


# state ------------------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(user_id AS VARCHAR) AS reference_id, arg_max(event_type, event_id) AS status, max(event_id) AS "offset" FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def reference_projection(spark, sf_dir):
    e = testdata.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("reference_id"), F.col("event_type").alias("status"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("offset"))
    return state.reference_projection(e).select("reference_id", "status", "offset")


@query(f"{_LINEAGE} SELECT stream_id, count(*) AS processed, max(\"offset\") AS last_offset FROM own GROUP BY stream_id")
def projection_fold_count(spark, sf_dir):
    return state.fold_count(testdata.records(spark, sf_dir))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(max(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY o_custkey")
def kv_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("offset"))
    return state.upsert(o)


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer WHERE c_custkey = 7")
def kv_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return state.lookup(c, F.lit("7"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers before and after some are dropped, added and renamed."""
    c = table(spark, sf_dir, "customer")
    before = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    after = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("value"))
    return before, after


@query("""WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS v FROM customer WHERE c_custkey % 10 <> 0), a AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS v FROM customer WHERE c_custkey % 7 <> 0)
SELECT * FROM (SELECT coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN b.v IS DISTINCT FROM a.v THEN 'changed' END AS change, b.v AS before, a.v AS after FROM b FULL OUTER JOIN a ON a.key = b.key) WHERE change IS NOT NULL""")
def kv_diff(spark, sf_dir):
    return state.diff(*_versions(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer WHERE c_custkey % 7 <> 0")
def kv_apply_diff(spark, sf_dir):
    before, after = _versions(spark, sf_dir)
    return state.apply_diff(before, state.diff(before, after))


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return state.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumnRenamed("l_orderkey", "key")


@query("SELECT 'tasks' AS table_name, CAST(o_custkey AS VARCHAR) AS key, CAST(max(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY o_custkey")
def insert_materialize(spark, sf_dir):
    """Orders written as INSERT statements, folded into a table."""
    o = table(spark, sf_dir, "orders")
    statement = F.concat(F.lit("INSERT INTO log.public.tasks (value, key) VALUES ('"), F.col("o_orderkey").cast("string"), F.lit("', "), F.col("o_custkey").cast("string"), F.lit(")"))
    found = state.insert_state(o.select(F.col("o_orderkey").alias("offset"), statement.alias("payload")))
    return found.select("table_name", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, last(value ORDER BY event_id) AS value FROM events GROUP BY user_id")
def resume_equivalence(spark, sf_dir):
    """A state at an anchor with the rest folded in: the same as a whole replay."""
    e = testdata.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "value", F.col("event_id").alias("seq"), F.lit(False).alias("deleted"))
    anchor = state.upsert(e.where("seq <= 400"), order=F.col("seq"))
    return state.merge_entries(anchor, e.where("seq > 400"))


# segments, retention, snapshots -----------------------------------------------------------------------------------------


@query("SELECT event_id // 1024 AS segment, min(event_id) AS start_offset, max(event_id) AS last_offset, count(*) AS record_count, CAST(sum(length(props)) AS BIGINT) AS raw_bytes FROM events GROUP BY 1")
def segment_summary(spark, sf_dir):
    e = testdata.events(spark, sf_dir).select(F.col("event_id").alias("offset"), F.col("props").alias("payload"))
    return integrity.segment_summary(integrity.with_segment(e, 1024), ["segment"])


@query("""WITH g AS (SELECT event_id // 4096 AS segment, event_id // 1024 AS grp, sha256(string_agg(sha256(CAST(event_id AS VARCHAR) || ':' || props), '' ORDER BY event_id)) AS d FROM events GROUP BY 1, 2)
SELECT segment, sha256(string_agg(d, '' ORDER BY grp)) AS digest FROM g GROUP BY segment""")
def segment_digest(spark, sf_dir):
    e = testdata.events(spark, sf_dir).select(F.col("event_id").alias("offset"), F.col("props").alias("payload"))
    return integrity.segment_digest(integrity.with_segment(e, 4096), ["segment"])


_SEGMENTS_SQL = "s AS (SELECT event_type AS stream_id, event_id // 512 AS segment, min(event_id) AS start_offset, CAST(sum(length(props)) AS BIGINT) AS stored_bytes, min(event_id) * 60000 AS rolled_at FROM events GROUP BY 1, 2)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = testdata.events(spark, sf_dir).withColumn("segment", F.floor(F.col("event_id") / 512).cast("bigint"))
    return e.groupBy(F.col("event_type").alias("stream_id"), "segment").agg(F.min("event_id").alias("start_offset"), F.sum(F.length("props")).alias("stored_bytes"), (F.min("event_id") * 60000).alias("rolled_at"))


@query(f"""WITH {_SEGMENTS_SQL}, x AS (SELECT *, 100 + sum(stored_bytes) OVER (PARTITION BY stream_id) - coalesce(sum(stored_bytes) OVER (PARTITION BY stream_id ORDER BY start_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 5000 AS goes FROM s)
SELECT stream_id, segment, start_offset, stored_bytes, bool_and(goes) OVER (PARTITION BY stream_id ORDER BY start_offset ROWS UNBOUNDED PRECEDING) AS trimmed FROM x""")
def retention_by_bytes(spark, sf_dir):
    return retention.mark(_segments(spark, sf_dir), max_bytes=5000, active_bytes=100).drop("rolled_at")


@query(f"""WITH {_SEGMENTS_SQL}, x AS (SELECT *, rolled_at <= 120000000 - 86400000 AS goes FROM s)
SELECT stream_id, segment, start_offset, rolled_at, bool_and(goes) OVER (PARTITION BY stream_id ORDER BY start_offset ROWS UNBOUNDED PRECEDING) AS trimmed FROM x""")
def retention_by_age(spark, sf_dir):
    return retention.mark(_segments(spark, sf_dir), now=120_000_000, max_age_days=1).drop("stored_bytes")


@query(f"""WITH {_SEGMENTS_SQL}, lines AS (SELECT stream_id, string_agg(printf('segment-%020d', segment) || '|' || CAST(start_offset AS VARCHAR) || '|' || CAST(rolled_at AS VARCHAR) || '|' || CAST(stored_bytes AS VARCHAR) || '|d', chr(10) ORDER BY start_offset) AS x FROM s GROUP BY stream_id) SELECT stream_id, sha256(stream_id || chr(10) || x) AS root FROM lines""")
def manifest_root(spark, sf_dir):
    s = _segments(spark, sf_dir).select("stream_id", scalars.numbered("segment", F.col("segment")).alias("segment_id"), "start_offset", F.col("rolled_at").alias("last_offset"), F.col("stored_bytes").alias("record_count"), F.lit("d").alias("digest"))
    return integrity.manifest_root(s)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("key-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).cast("binary").alias("key"), F.col("c_name").cast("binary").alias("value"))


@query("""WITH e AS (SELECT 'key-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer), s AS (SELECT key, CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) AS score FROM e)
SELECT key, score, score & 15 = 0 AS boundary, CAST(coalesce(sum(CASE WHEN score & 15 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node FROM s""")
def chunk_boundaries(spark, sf_dir):
    found = snapshot.chunk(_entries(spark, sf_dir), 15)
    return found.select(F.col("key").cast("string").alias("key"), scalars.chunk_score(F.col("key")).alias("score"), scalars.chunk_boundary(F.col("key"), 15).alias("boundary"), F.col("node").cast("long").alias("node"))


@query("""WITH e AS (SELECT 'key-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, c_name AS value FROM customer), s AS (SELECT *, CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) & 15 = 0 AS ends, sha256(lpad(CAST(length(key) AS VARCHAR), 10, '0') || key || value) AS entry FROM e),
n AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node FROM s)
SELECT CAST(node AS BIGINT) AS node, sha256('leaf' || string_agg(entry, '' ORDER BY key)) AS digest, min(key) AS low, max(key) AS high, count(*) AS n_entries FROM n GROUP BY node""")
def snapshot_leaves(spark, sf_dir):
    found = snapshot.leaves(_entries(spark, sf_dir), 15)
    return found.select(F.col("node").cast("long").alias("node"), "digest", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "n_entries")


@query("""WITH e AS (SELECT 'key-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, c_name AS value FROM customer WHERE c_custkey <> 9 UNION ALL SELECT 'key-00000007a', 'new' UNION ALL SELECT 'z', 'last'), s AS (SELECT *, CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) & 15 = 0 AS ends, sha256(lpad(CAST(length(key) AS VARCHAR), 10, '0') || key || value) AS entry FROM e),
n AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS node FROM s)
SELECT CAST(node AS BIGINT) AS node, sha256('leaf' || string_agg(entry, '' ORDER BY key)) AS digest, count(*) AS n_entries FROM n GROUP BY node""")
def snapshot_update(spark, sf_dir):
    """A stored tree after two keys more and one less: only the leaves concerned are read and written."""
    store = snapshot.LeafStore(spark, staging.new_path(spark, "leaf-store"), 15)
    found = store.put(_entries(spark, sf_dir))
    changes = spark.createDataFrame([(bytearray(b"key-00000007a"), bytearray(b"new"), False), (bytearray(b"z"), bytearray(b"last"), False), (bytearray(b"key-00000009"), None, True)], "key binary, value binary, deleted boolean")
    return store.update(found, changes)[0].select("node", "digest", "n_entries")


@query("SELECT 'snapshot-' || lpad(CAST(max(event_id) AS VARCHAR), 20, '0') AS snapshot_id, 'events' AS stream_id, max(event_id) AS \"offset\", (SELECT count(*) FROM customer) AS n_entries FROM events")
def snapshot_manifest(spark, sf_dir):
    head = testdata.events(spark, sf_dir).agg(F.max("event_id")).first()[0]
    return snapshot.manifest(snapshot.build(_entries(spark, sf_dir), 15), "events", head).select("snapshot_id", "stream_id", "offset", "n_entries")


@query()
def snapshot_nodes(spark, sf_dir):
    return snapshot.build(_entries(spark, sf_dir), 15).select("level", "node", "digest", "n_entries")


@query()
def node_sharing(spark, sf_dir):
    """Nodes that a table and a copy with one more key share."""
    entries = _entries(spark, sf_dir)
    more = spark.createDataFrame([(bytearray(b"key-00000007a"), bytearray(b"branch-only"))], "key binary, value binary")
    return snapshot.shared_nodes(snapshot.build(entries, 15), snapshot.build(entries.unionByName(more), 15))


# cursors and control ----------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT event_type AS stream_id, max(event_id) + 1 AS next_offset FROM events GROUP BY 1), c AS (SELECT 'user-' || CAST(user_id AS VARCHAR) || '/' || event_type AS cursor_id, event_type AS stream_id, max(event_id) AS position FROM events GROUP BY user_id, event_type)
SELECT cursor_id, c.stream_id, position, next_offset, greatest(next_offset - position, 0) AS pending, next_offset <= position AS caught_up FROM c JOIN h USING (stream_id)""")
def cursor_lag(spark, sf_dir):
    e = testdata.events(spark, sf_dir)
    heads = e.groupBy(F.col("event_type").alias("stream_id")).agg((F.max("event_id") + 1).alias("next_offset"))
    progress = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("position"))
    own = progress.select(F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("cursor_id"), F.col("event_type").alias("stream_id"), "position")
    return cursors.lag(own, heads)


@query("SELECT CAST(700 AS BIGINT) AS from_offset, max(event_id) + 1 AS next_offset, count(*) FILTER (event_id >= 700) AS pending, max(event_id) + 1 <= 700 AS caught_up FROM events")
def pending_window(spark, sf_dir):
    return cursors.pending_window(_history(spark, sf_dir, "events"), 700)


@query("""WITH a AS (SELECT event_type AS stream_id, user_id % 5 AS node, max(event_id) AS acked FROM events GROUP BY 1, 2), c AS (SELECT stream_id, count(*) FILTER (acked >= 970) + 1 AS acked FROM a GROUP BY 1)
SELECT stream_id, acked, CAST(4 AS BIGINT) AS needed, acked >= 4 AS reached FROM c""")
def quorum_count(spark, sf_dir):
    acks = testdata.events(spark, sf_dir).groupBy(F.col("event_type").alias("stream_id"), (F.col("user_id") % 5).alias("node")).agg(F.max("event_id").alias("acked_offset"))
    return cursors.quorum(acks.withColumn("members", F.lit(6)), 970)


@query("SELECT user_id AS node_id FROM events GROUP BY 1 HAVING max(event_id) > 900")
def live_members(spark, sf_dir):
    return cursors.live_members(testdata.events(spark, sf_dir).select(F.col("user_id").alias("node_id"), F.col("event_id").alias("expires_at")), 900)


@query("SELECT event_type AS stream_id, max(event_id) % 2 = 0 AS caught_up FROM events GROUP BY 1")
def frontier_compare(spark, sf_dir):
    heads = testdata.events(spark, sf_dir).groupBy(F.col("event_type").alias("stream_id")).agg((F.max("event_id")).alias("next_offset"))
    a = heads.select("stream_id", F.lit("m").alias("manifest_id"), F.lit(1).alias("generation"), F.lit("r").alias("root"), "next_offset")
    b = a.withColumn("next_offset", F.col("next_offset") - F.col("next_offset") % 2)
    return cursors.frontier_matches(a, b)


@query("SELECT DISTINCT event_type AS stream_id, event_id // 512 AS segment_id, 'd' AS digest FROM events WHERE event_id // 512 > 0")
def replica_missing_segments(spark, sf_dir):
    s = testdata.events(spark, sf_dir).select(F.col("event_type").alias("stream_id"), F.floor(F.col("event_id") / 512).cast("bigint").alias("segment_id"), F.lit("d").alias("digest")).distinct()
    return cursors.missing_segments(s, s.where("segment_id = 0"))


# workloads --------------------------------------------------------------------------------------------------------------


@query("""SELECT 'document:' || CAST(doc_id AS VARCHAR) AS artifact_id, 'document' AS artifact_kind, sha256(coalesce(text, '')) AS digest, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS byte_length FROM documents""")
def artifact_envelopes(spark, sf_dir):
    return workloads.envelopes(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "document")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of channels."""
    c = table(spark, sf_dir, "conversations")
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    event = F.struct(F.lit("message.posted").alias("type"), F.concat(F.lit("channel-"), F.col("conv_id").cast("string")).alias("channel_id"), ident.alias("message_id"), F.col("role").alias("author_id"))
    return c.select(F.concat(F.lit("channel-"), F.col("conv_id").cast("string")).alias("stream_id"), F.col("turn").alias("offset"), F.to_json(event).alias("payload"))


@query("SELECT 'channel-' || CAST(conv_id AS VARCHAR) AS stream_id, turn AS \"offset\", CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS message_id, role AS author_id FROM conversations")
def typed_messages(spark, sf_dir):
    return workloads.typed(_messages(spark, sf_dir), "message.posted").select("stream_id", "offset", "message_id", "author_id")


@query("SELECT CAST(conv_id AS VARCHAR) || '.1' AS message_id, role AS author_id, 'thread-' || CAST(conv_id AS VARCHAR) AS thread_id FROM conversations WHERE turn = 1")
def thread_view(spark, sf_dir):
    """Threads anchored to the second message of each channel."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    branches = c.select(F.concat(F.lit("thread-"), F.col("conv_id").cast("string")).alias("stream_id"), F.create_map(F.lit("anchor_ref"), F.concat(F.lit("message:"), F.col("conv_id").cast("string"), F.lit(".1"))).alias("labels"))
    messages = workloads.typed(_messages(spark, sf_dir), "message.posted")
    return workloads.threads(messages, branches).select("message_id", "author_id", "thread_id")


@query("""SELECT 'decision-' || CAST(user_id AS VARCHAR) AS supersedes_ref, max(event_id) AS "offset", arg_max(event_type, event_id) AS verdict FROM events GROUP BY user_id""")
def override_chain(spark, sf_dir):
    e = testdata.events(spark, sf_dir)
    return workloads.standing_overrides(e.select(F.concat(F.lit("decision-"), F.col("user_id").cast("string")).alias("supersedes_ref"), F.col("event_id").alias("offset"), F.col("event_type").alias("verdict")))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'result' ELSE 'request' END AS phase, CAST(turn // 2 AS VARCHAR) AS call FROM conversations)
SELECT CAST(r.conv_id AS VARCHAR) AS task_id, r.call AS tool_call_id, 'chat' AS tool_name, r.turn AS request_offset, s.result_offset FROM c r LEFT JOIN (SELECT conv_id, call, min(turn) AS result_offset FROM c WHERE phase = 'result' GROUP BY 1, 2) s ON s.conv_id = r.conv_id AND s.call = r.call WHERE r.phase = 'request'""")
def tool_call_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    calls = c.select(F.col("conv_id").cast("string").alias("task_id"), F.floor(F.col("turn") / 2).cast("string").alias("tool_call_id"), F.lit("chat").alias("tool_name"), F.when(F.col("role") == "assistant", F.lit("result")).otherwise(F.lit("request")).alias("phase"), F.col("turn").alias("offset"))
    return workloads.tool_call_pairs(calls)


@query("SELECT event_type AS stream_id, event_id AS \"offset\", 'r' AS root, event_type = 'purchase' OR user_id > 50 AS selected FROM events")
def finality(spark, sf_dir):
    e = testdata.events(spark, sf_dir).select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("offset"), F.lit("r").alias("root"), "user_id")
    return workloads.finality(e.drop("user_id"), e.where("stream_id = 'purchase' OR user_id > 50"))


# delegated SQL: Catalyst's own operators over the same tables -------------------------------------------------------------


def _delegated(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        surface = Surface(spark)
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            surface.register(t, lambda t=t: table(spark, sf_dir, t))
        return surface.query(sql)

    query(oracle or sql, name)(run)


_delegated("join_inner", "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
_delegated("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_delegated("join_right", "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
_delegated("join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey > 5 GROUP BY c_nationkey) x FULL OUTER JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey < 20 GROUP BY s_nationkey) y ON c_nationkey = s_nationkey")
_delegated("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_delegated("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_delegated("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_delegated("join_theta", "SELECT a.n_name AS small, b.r_name AS region FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
_delegated("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
_delegated("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_delegated("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_delegated("rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
_delegated("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_delegated("window_rank", "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS q FROM orders")
_delegated("window_frame", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY event_id) AS following, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m, count(*) OVER (PARTITION BY event_type) AS n FROM events")
_delegated("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_delegated("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
_delegated("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_delegated("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_delegated("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 15")
_delegated("subquery_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN big ON o_custkey = c_custkey WHERE n > (SELECT avg(n) FROM big)")
_delegated("case_predicates", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' ELSE 'much' END AS class, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name LIKE '%1' GROUP BY 1")
_delegated("string_functions", "SELECT n_name, upper(substring(n_name, 1, 3)) AS head, length(n_name) AS len, replace(n_name, 'A', '-') AS dashed, reverse(n_name) AS back, lpad(CAST(n_nationkey AS STRING), 4, '0') AS code FROM nation", "SELECT n_name, upper(substring(n_name, 1, 3)) AS head, CAST(length(n_name) AS INTEGER) AS len, replace(n_name, 'A', '-') AS dashed, reverse(n_name) AS back, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code FROM nation")
_delegated("date_functions", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, max(date_trunc('month', o_orderdate)) AS start FROM orders GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, max(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS start FROM orders GROUP BY 1, 2")
_delegated("math_functions", "SELECT l_linenumber, count(*) AS n, max(round(l_discount * 100, 0)) AS d, min(floor(l_quantity / 7)) AS f, max(abs(l_tax - l_discount)) AS a FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, count(*) AS n, max(round(l_discount * 100, 0)) AS d, CAST(min(floor(l_quantity / 7)) AS BIGINT) AS f, max(abs(l_tax - l_discount)) AS a FROM lineitem GROUP BY l_linenumber")


@query()
def approx_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("SELECT event_type, len(list(DISTINCT user_id)) AS users, max(event_id) AS last_id FROM events GROUP BY event_type")
def collection_functions(spark, sf_dir):
    e = testdata.events(spark, sf_dir).groupBy("event_type").agg(F.collect_set("user_id").alias("u"), F.max("event_id").alias("last_id"))
    return e.select("event_type", F.size("u").cast("long").alias("users"), F.element_at(F.map_from_arrays(F.array("event_type"), F.array("last_id")), F.col("event_type")).alias("last_id"))


from loomlog import logqueries  # noqa: E402, F401  its queries are registered as it loads
