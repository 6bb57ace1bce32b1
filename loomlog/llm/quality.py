"""Quality rules: word and repetition counts of a text, and lines that many documents of a host share.

Only DataFrame functions: texts never leave the JVM. Counts of a text are array expressions over its own words. For the lines, each
normalised line is hashed together with its host; the documents that have it are counted; lines in more than
``max_docs`` of them are removed from its text, and a document that loses more than ``max_lost`` percent of its words, or keeps
fewer than ``min_words``, is rejected.

What counts as one document: a text, by a 64-bit hash of all of it. Exact copies on a host thus count once. Near copies are
documents of their own, so lines that more than ``max_docs`` of them share are boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import common
from loomlog.plans import staging

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 20
MAX_LOST_PERCENT = 70
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\f\r"
_SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACES, -1))


def _normalised(line: Column) -> Column:
    """A-Z lower-cased, digits alike, single spaces."""
    same = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.btrim(F.regexp_replace(same, _SPACES, " "), F.lit(_SPACE))


def with_counts(docs: DataFrame, text: str) -> DataFrame:
    """Adds the counts of each text, and ``_lines`` (those with a word). Column names here begin with an underscore."""
    t = F.col(text)
    df = docs.withColumn("_words", _words(t)).withColumn("_n", F.size("_words"))
    w = F.col("_words")
    grams = F.when(F.col("_n") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("_grams", grams)
    # Only texts with a repeated window: where all of its occurrences begin.
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = F.when(repeats, F.sort_array(F.transform(F.col("_grams"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_placed", placed)
    p = F.col("_placed")
    begins = F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])), lambda x: x["i"])
    df = df.withColumn("_begins", F.sort_array(begins))
    b = F.col("_begins")
    covered = F.aggregate(F.transform(b, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(b, i + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    df = df.withColumn("_lines", lines)
    counts = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    return df.withColumns({f"_{k}" if k == "n_words" else k: v for k, v in counts.items()}).withColumnRenamed("_n_words", "n_words")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _content(docs: DataFrame, text: str, host: str) -> tuple[Column, Column, Column]:
    """Text, host, and a hash of both."""
    t, at = F.coalesce(docs[text].cast("string"), F.lit("")), docs[host].cast("string")
    return t, at, F.xxhash64(docs[host].isNull(), at, t)


def _line_key(normalised: Column) -> Column:
    return F.xxhash64(F.col("_host").isNull(), F.col("_host"), normalised)


def _line_hashes() -> Column:
    """Key and number of words of each line."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return F.transform(F.transform("_lines", _normalised), lambda x: F.struct(_line_key(x).alias("line"), (spaces(x) + 1).alias("n")))


def _base_failed(min_words: int, max_repeat: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def _lost(rows: DataFrame, max_docs: int) -> DataFrame:
    """``row, n_lost, gone``: words in lines that too many documents of the host have, and these lines. ``rows``: a written table with ``row, content, lines``.

    Documents are counted in two steps, copies first, both with map-side combine. Only a generator and a filter stand between the join on a line
    and the sums by row, so lines that very many rows have can be split over tasks.
    """
    seen = rows.select("content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    frequent = seen.groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("line")
    found = rows.select("row", F.explode("lines").alias("x")).select("row", "x.line", "x.n").join(frequent, "line")
    return found.groupBy("row").agg(F.sum("n").alias("n_lost"), F.collect_set("line").alias("gone"))


def _judged(docs: DataFrame, kept: list[Column], doc_id: str, text: str, host: str, max_docs: int, max_lost: int, min_words: int, max_repeat: int) -> DataFrame:
    """``kept`` as ``_kept0`` and so on, ``doc_id, content, _host``, the counts, ``n_lost, base_failed, kept`` and ``gone`` (null: nothing is) for each row.

    What is kept is written once beside its counts; the lines' hashes alone are counted, and what is gone joins back by the row's number.
    """
    t, at, content = _content(docs, text, host)
    names = [f"_kept{i}" for i in range(len(kept))]
    rows = with_counts(docs.select(*(c.alias(n) for c, n in zip(kept, names, strict=True)), docs[doc_id].alias("doc_id"), t.alias("_text"), at.alias("_host"), content.alias("content")), "_text")
    rows = staging.stage(rows.select(F.monotonically_increasing_id().alias("row"), *names, "doc_id", "_host", "content", *_COUNTS, _line_hashes().alias("lines")), "quality")
    out = rows.drop("lines").join(_lost(rows, max_docs), "row", "left").withColumn("n_lost", F.coalesce("n_lost", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", _base_failed(min_words, max_repeat))
    depleted = (100 * F.col("n_lost") > max_lost * F.col("n_words")) | (F.col("n_words") - F.col("n_lost") < min_words)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row")


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST_PERCENT, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, content`` (a hash of text and host), the counts, ``n_lost, base_failed, kept``.

    A null text has no words and fails; a null host is a host of its own; ids may be null or repeated, every row is judged. An
    empty table gives no rows. Very long texts are one row's arrays, as long as the text. Other columns are not read. The counts are
    those of the whole text; ``n_lost``: words in lines that are too frequent. ``keep_good`` returns the texts without them.
    """
    found = _judged(docs, [], doc_id, text, host, max_docs, max_lost, min_words, max_repeat)
    return found.select("doc_id", "content", *_COUNTS, "n_lost", "base_failed", "kept")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST_PERCENT, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns; too frequent lines are gone from the text, ``n_chars`` follows.

    Odd rows: as in ``assess``. Columns of any name stay as they are.
    """
    found = _judged(docs, [docs[c] for c in docs.columns], doc_id, text, host, max_docs, max_lost, min_words, max_repeat).where("kept")
    names = {c: F.col(f"_kept{i}") for i, c in enumerate(docs.columns)}
    lines = F.filter(F.split(names[text].cast("string"), "\n", -1), lambda x: ~F.array_contains("gone", _line_key(_normalised(x))))
    found = found.withColumn("_clean", F.when(F.col("gone").isNotNull(), F.array_join(lines, "\n")))
    changed = {text: F.col("_clean"), "n_chars": F.length("_clean")}
    return found.select(*((F.coalesce(changed[c].cast(docs.schema[c].dataType), col) if c in changed else col).alias(c) for c, col in names.items()))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents."""
    return assess(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost")


#: Documents are counted by their text here, by its hash above.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM g) WHERE c > 1
), rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
), raw AS (
  SELECT rid, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d)
), lines AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw WHERE n > 0
), often AS (SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT t) > 20
), lost AS (SELECT rid, sum(n) AS n FROM lines l JOIN often o ON l.norm = o.norm AND l.host IS NOT DISTINCT FROM o.host GROUP BY rid
), dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid
), f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_lost > 70 * n_words OR n_words - n_lost < 50) AS kept, n_lost FROM b
"""
