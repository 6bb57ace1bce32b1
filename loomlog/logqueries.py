"""Queries that write the driver's tables to a log and read them back: segments, publication, retention, cursors, views, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators import cursors
from loomlog.plans import staging
from loomlog.plans.sqlsurface import Surface
from loomlog.queries import _LINEAGE, query
from loomlog.sources import testdata
from loomlog.sources.log import InvalidRequest, Log
from loomlog.streaming import materialize

_BRANCH = "retry"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.events(spark, sf_dir).select("event_id", "event_type", testdata.payload().alias("payload"))


def _log(spark: SparkSession, sf_dir: str, branch: bool = False) -> Log:
    """The events as a stream, and a branch with the events of one type."""
    log, rows = Log(spark, staging.new_path(spark, "log")), _payloads(spark, sf_dir)
    log.create_root("events")
    log.append_frame("events", rows, ["event_id"])
    if branch:
        parent, fork, kind = testdata.FORKS[_BRANCH]
        log.create_branch(_BRANCH, (parent, fork), {"actor": "tester", "labels": {"kind": kind}})
        log.append_frame(_BRANCH, rows.where(F.col("event_type") == kind), ["event_id"])
    return log


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload", F.col("payload").cast("string"))


@query(f"{_LINEAGE} SELECT stream_id, owner_id, \"offset\", payload, inherited FROM history WHERE stream_id = '{_BRANCH}'")
def log_replay(spark, sf_dir):
    """A branch's history, read from segments."""
    return _plain(_log(spark, sf_dir, branch=True).replay(_BRANCH))


@query(f"{_LINEAGE} SELECT stream_id, CASE stream_id WHEN 'events' THEN 'root' ELSE 'branch' END AS kind, CASE stream_id WHEN 'events' THEN '' ELSE 'events@499' END AS parents, max(\"offset\") + 1 AS next_offset, count(*) AS retained, CAST(1 AS BIGINT) AS segments, CAST(0 AS BIGINT) AS active, min(\"offset\") AS retained_start FROM own WHERE stream_id IN ('events', '{_BRANCH}') GROUP BY stream_id")
def log_status(spark, sf_dir):
    rows = [(s["stream_id"], s["kind"], ",".join(s["parents"]), s["next_offset"], s["retained_record_count"], s["segment_count"], s["active_record_count"], s["retained_start_offset"]) for s in _log(spark, sf_dir, branch=True).status()]
    return spark.createDataFrame(rows, "stream_id string, kind string, parents string, next_offset long, retained long, segments long, active long, retained_start long")


@query(f"""WITH g AS (SELECT event_id // 1024 AS grp, sha256(string_agg(sha256(CAST(event_id AS VARCHAR) || ':' || {testdata.PAYLOAD_SQL}), '' ORDER BY event_id)) AS d, min(event_id) AS a, max(event_id) AS b, count(*) AS n FROM events GROUP BY 1)
SELECT 'events' AS stream_id, 'segment-00000000000000000001' AS segment_id, min(a) AS start_offset, max(b) AS last_offset, CAST(sum(n) AS BIGINT) AS record_count, sha256(string_agg(d, '' ORDER BY grp)) AS digest FROM g""")
def log_segments(spark, sf_dir):
    return _log(spark, sf_dir).segments().select("stream_id", "segment_id", "start_offset", "last_offset", "record_count", "digest")


@query("SELECT 'events' AS owner_id, CAST(499 AS BIGINT) AS bound, CAST(1 AS BIGINT) AS depth UNION ALL SELECT 'retry', NULL, 0 WHERE EXISTS (SELECT 1 FROM events)")
def log_lineage(spark, sf_dir):
    found = _log(spark, sf_dir, branch=True).owners(_BRANCH)
    return spark.createDataFrame([(owner, bound, depth) for depth, (owner, bound) in enumerate(found)], "owner_id string, bound long, depth long")


@query(f"SELECT 'events' AS stream_id, event_id AS \"offset\", {testdata.PAYLOAD_SQL} AS payload FROM events")
def log_publish_restore(spark, sf_dir):
    """A stream published, restored elsewhere and read there."""
    log, remote = _log(spark, sf_dir), staging.new_path(spark, "remote")
    log.publish("events", remote)
    other = Log(spark, staging.new_path(spark, "log"), read_only=True)
    other.restore("events", remote)
    return _plain(other.replay("events")).select("stream_id", "offset", "payload")


@query("SELECT 'events' AS stream_id, max(event_id) + 3 AS next_offset, CAST(2 AS BIGINT) AS segments, true AS caught_up, max(event_id) + 1 AS before FROM events")
def log_replica(spark, sf_dir):
    """A replica that follows a published stream, fetching only what it lacks."""
    log, remote = _log(spark, sf_dir), staging.new_path(spark, "remote")
    log.publish("events", remote)
    other = Log(spark, staging.new_path(spark, "log"), read_only=True)
    before = other.sync_replica("events", remote)["next_offset"]
    frontier = log.append_acknowledged("events", [b"one", b"two"], [remote], 2) and log.frontier("events", remote)
    other.sync_replica("events", remote)
    s = other.status("events")[0]
    same = cursors.frontier_matches(*(spark.createDataFrame([("events", frontier["manifest_id"], frontier["generation"], root, n)], "stream_id string, manifest_id string, generation long, root string, next_offset long") for root, n in ((frontier["root"], frontier["next_offset"]), (s["manifest_root"], s["next_offset"]))))
    return same.select("stream_id", F.lit(s["next_offset"]).cast("long").alias("next_offset"), F.lit(s["segment_count"]).cast("long").alias("segments"), "caught_up", F.lit(before).cast("long").alias("before"))


@query(f"SELECT event_id AS \"offset\", {testdata.PAYLOAD_SQL} AS payload FROM events WHERE event_id >= 400")
def log_retention(spark, sf_dir):
    """Three segments under a budget that the last one fits: the older ones go."""
    log, rows = Log(spark, staging.new_path(spark, "log")), _payloads(spark, sf_dir)
    log.create_root("events")
    for part in (rows.where("event_id < 300"), rows.where("event_id >= 300 AND event_id < 400"), rows.where("event_id >= 400")):
        log.append_frame("events", part, ["event_id"])
    log.set_retention("events", max_bytes=log.state("events")["segments"][-1]["stored_bytes"])
    log.enforce_retention("events")
    return _plain(log.replay("events")).select("offset", "payload")


@query("SELECT 'events' AS stream_id, max(event_id) AS head_offset, true AS exact, false AS exact_later, true AS any_later, '' AS damaged FROM events")
def log_checkpoint(spark, sf_dir):
    """A checkpoint verified at once, and after the log has gone on."""
    log = _log(spark, sf_dir)
    found = log.checkpoint("events")
    exact = log.verify_checkpoint(found)
    log.append("events", b"more")
    log.roll("events")
    row = (found["stream_id"], found["head_offset"], exact, log.verify_checkpoint(found), log.verify_checkpoint(found, exact=False), ",".join(log.verify("events")))
    return spark.createDataFrame([row], "stream_id string, head_offset long, exact boolean, exact_later boolean, any_later boolean, damaged string")


@query("WITH h AS (SELECT max(event_id) + 1 AS n FROM events) SELECT 'reader-' || event_type AS cursor_id, 'events' AS stream_id, max(event_id) AS position, n AS next_offset, n - max(event_id) AS pending, false AS caught_up FROM events, h GROUP BY event_type, n")
def log_cursors(spark, sf_dir):
    """Cursors created, moved on (never back) and compared with the head."""
    log = _log(spark, sf_dir)
    for r in testdata.events(spark, sf_dir).groupBy("event_type").agg(F.max("event_id").alias("at")).collect():  # a handful of types
        cursor = f"reader-{r['event_type']}"
        log.create_cursor(cursor, "events", 0, labels={"type": r["event_type"]})
        log.advance_cursor(cursor, r["at"])
        try:
            log.ack_cursor(cursor, 0)
        except InvalidRequest:
            continue
        raise AssertionError("a cursor went back")
    status = spark.createDataFrame([(s["stream_id"], s["next_offset"]) for s in log.status()], "stream_id string, next_offset long")
    return cursors.lag(log.cursors("events"), status)


@query(f"SELECT event_id AS \"offset\", {testdata.PAYLOAD_SQL} AS payload, (event_id - 250) // 100 AS poll FROM events WHERE event_id BETWEEN 250 AND 549")
def log_tail(spark, sf_dir):
    """What three polls of a tail with a credit of 100 deliver."""
    tail, rows = materialize.Tail(_log(spark, sf_dir), "events", 250, 100), []
    for poll in range(3):
        rows += [(r["offset"], bytes(r["payload"]).decode(), poll) for r in tail.poll()[1]]  # 100 at most
    tail.cancel()
    return spark.createDataFrame(rows, "offset long, payload string, poll long")


@query("SELECT count(*) + 2 AS n, max(event_id) + 2 AS applied, count(*) AS n_before, CAST(0 AS BIGINT) AS pending FROM events")
def materialized_count(spark, sf_dir):
    """A count resumed from its checkpoint: what came since is applied once."""
    log = _log(spark, sf_dir)
    first = materialize.Materializer(log, "count", "events", materialize.CountReducer())
    first.step()
    log.append_batch("events", [b"one", b"two"])
    second = materialize.Materializer(log, "count", "events", materialize.CountReducer())
    second.resume()
    before = second.state
    second.catch_up()
    return spark.createDataFrame([(second.state, second.applied, before, second.pending())], "n long, applied long, n_before long, pending long")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.struct(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("reference_id"), F.col("event_type").alias("status"), (F.col("event_type") == "error").alias("deleted"))
    return testdata.events(spark, sf_dir).select("event_id", F.to_json(e).alias("payload"))


_STANDING = "FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"


@query(f"SELECT 'user-' || CAST(user_id AS VARCHAR) AS key, '{{\"status\":\"' || arg_max(event_type, event_id) || '\"}}' AS value {_STANDING}")
def materialized_references(spark, sf_dir):
    """The reference projection as a view, kept up in two steps."""
    log, rows = Log(spark, staging.new_path(spark, "log")), _references(spark, sf_dir)
    log.create_root("refs")
    view = materialize.KeyedMaterializer(log, "refs", "refs", materialize.reference_changes)
    for part in (rows.where("event_id < 600"), rows.where("event_id >= 600")):
        log.append_frame("refs", part, ["event_id"])
        view.step()
    return view.view().select("key", "value")


@query(f"SELECT count(*) AS references_left, (SELECT count(*) FROM events) AS consumed, (SELECT max(event_id) FROM events) AS head_offset, 'projection:refs@' || CAST((SELECT max(event_id) FROM events) AS VARCHAR) AS revision FROM (SELECT user_id {_STANDING})")
def projection_read(spark, sf_dir):
    log = Log(spark, staging.new_path(spark, "log"))
    log.create_root("refs")
    log.append_frame("refs", _references(spark, sf_dir), ["event_id"])
    found = materialize.read_projection(log, "refs")
    return found["view"].agg(F.count("*").alias("references_left"), F.lit(found["consumed"]).cast("long").alias("consumed"), F.lit(found["head_offset"]).cast("long").alias("head_offset"), F.lit(found["revision"]).alias("revision"))


@query("SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def materialized_inserts(spark, sf_dir):
    """INSERT records folded into a table's view."""
    log, n = Log(spark, staging.new_path(spark, "log")), testdata.table(spark, sf_dir, "nation")
    log.create_root("sql")
    statement = F.concat(F.lit("INSERT INTO nations VALUES ('"), F.col("n_name"), F.lit("', '"), F.col("n_regionkey").cast("string"), F.lit("')"))
    log.append_frame("sql", n.select("n_nationkey", statement.alias("payload")), ["n_nationkey"])
    view = materialize.KeyedMaterializer(log, "sql", "sql", materialize.insert_changes)
    view.catch_up()
    return materialize.insert_table(view.view(), "nations").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT event_type, count(*) AS n, max(user_id) AS top FROM events GROUP BY event_type")
def log_sql(spark, sf_dir):
    """All streams of a log as tables, named by a query."""
    surface = Surface(spark)
    _log(spark, sf_dir, branch=True).register(surface)
    return surface.query("SELECT event_type, COUNT(*) AS n, MAX(user_id) AS top FROM log.public.events GROUP BY event_type")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS \"offset\", n_name AS payload FROM nation")
def log_text_source(spark, sf_dir):
    """Lines of a text file appended in their order."""
    path = staging.new_path(spark, "lines")
    testdata.table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select("n_name").write.text(path)
    log = Log(spark, staging.new_path(spark, "log"))
    log.produce_text("lines", path)
    return _plain(log.replay("lines")).select("offset", "payload")


@query("SELECT event_type || '@' || CAST(event_id AS VARCHAR) AS key, props AS value FROM events")
def remote_record_rows(spark, sf_dir):
    """Records as key and value, the key being the position."""
    e = testdata.events(spark, sf_dir)
    return e.select(F.concat_ws("@", "event_type", "event_id").alias("key"), F.col("props").alias("value"))
