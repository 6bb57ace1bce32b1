"""The star schema's tables seen as streams: the log of events with branches and a merge, conversations as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Branches, merge and where they fork. Own records of a stream are the events of a type, numbered from its first offset.
FORKS = {"retry": ("events", 499, "error"), "critique": ("retry", 549, "purchase"), "late": ("critique", 520, "view")}
MERGE = ("merged", [("retry", 540), ("critique", 560)], ("events", 299), "click")

PAYLOAD_SQL = """'{"user_id":' || CAST(user_id AS VARCHAR) || ',"event_type":"' || event_type || '","value":' || printf('%.2f', value) || ',"k":' || regexp_extract(props, '([0-9]+)', 1) || '}'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def payload():
    """An event as JSON text."""
    return F.concat(
        F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","value":'),
        F.format_string("%.2f", "value"), F.lit(',"k":'), F.regexp_extract("props", "([0-9]+)", 1), F.lit("}"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own records of ``events`` and of the streams that fork from it."""
    e = events(spark, sf_dir)
    root = e.select(F.lit("events").alias("stream_id"), F.col("event_id").alias("offset"), payload().alias("payload"))
    kinds = [(name, fork + 1, kind) for name, (_, fork, kind) in FORKS.items()] + [(MERGE[0], MERGE[2][1] + 1, MERGE[3])]
    of = spark.createDataFrame(kinds, "stream_id string, base bigint, event_type string")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    own = e.select("event_type", payload().alias("payload"), (rank - 1).alias("rank")).join(F.broadcast(of), "event_type")  # a handful of streams
    return root.unionByName(own.select("stream_id", (F.col("base") + F.col("rank")).cast("bigint").alias("offset"), "payload"))


def streams(spark: SparkSession) -> DataFrame:
    position = "struct<stream_id:string,offset:bigint>"
    rows = [("events", "root", [], None)] + [(n, "branch", [(p, f)], None) for n, (p, f, _) in FORKS.items()] + [(MERGE[0], "merge", MERGE[1], MERGE[2])]
    return spark.createDataFrame(rows, f"stream_id string, kind string, parents array<{position}>, merge_base {position}")


#: The same in SQL: own records, and what each stream inherits.
RECORDS_SQL = f"""
own AS (
  SELECT 'events' AS stream_id, event_id AS "offset", {PAYLOAD_SQL} AS payload FROM events
  UNION ALL
  SELECT s.stream_id, s.base + row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1, {PAYLOAD_SQL}
  FROM events JOIN (VALUES {", ".join(f"('{n}', {f + 1}, '{k}')" for n, (_, f, k) in FORKS.items())}, ('{MERGE[0]}', {MERGE[2][1] + 1}, '{MERGE[3]}')) s(stream_id, base, kind) ON event_type = s.kind),
inherit AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{p}', {f})" for n, (p, f, _) in FORKS.items())}, ('{MERGE[0]}', '{MERGE[2][0]}', {MERGE[2][1]})) t(stream_id, parent_id, fork)),
up AS (
  SELECT stream_id, stream_id AS owner_id, CAST(NULL AS BIGINT) AS bound, 0 AS depth FROM (SELECT DISTINCT stream_id FROM own)
  UNION ALL
  SELECT up.stream_id, i.parent_id, CASE WHEN bound IS NULL OR i.fork < bound THEN i.fork ELSE bound END, depth + 1 FROM up JOIN inherit i ON i.stream_id = up.owner_id),
history AS (SELECT up.stream_id, owner_id, "offset", payload, depth > 0 AS inherited FROM up JOIN own ON own.stream_id = up.owner_id WHERE bound IS NULL OR "offset" <= bound)
"""
