"""URL filters: rules, and for the rest a classifier over segmented host names.

Host labels run words together. A unigram model of the pages' own words (counted over all of them) splits each label by Viterbi;
words of the host and tokens of the path are the features of a multinomial naive Bayes classifier, hashed into a fixed number of
buckets. It learns from the urls that a rule decides, all of them, and judges the others. The longest rule that fits always wins.

No vocabulary is gathered in one place: the substrings of the different labels are joined with the counts of the words, each label is
split with the words found in it, and the words of a host join back to its urls.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm import common
from loomlog.plans import staging

VERDICTS = ("allow", "block")
#: Buckets of the classifier.
BUCKETS = 1 << 16
#: Longest label of a host name, as the domain name system has it; longer ones are no names and stay whole.
LONGEST = 63
#: Longest stretch that may stand for a word nobody wrote.
_UNKNOWN = 4
#: Words that a worker counts before it hands them on.
_HELD_WORDS = 200_000
_TAG = re.compile(rb"<(?:(script|style)\b)?", re.IGNORECASE)
_CLOSE = {b"script": re.compile(rb"</script\s*>", re.IGNORECASE), b"style": re.compile(rb"</style\s*>", re.IGNORECASE)}
#: Letters: a-z and all above ASCII.
_WORD = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LABEL = re.compile("[a-z\x80-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_marks(html: bytes) -> bytes:
    """A page's text: tags are a space, scripts and styles go whole. Each byte is looked at a fixed number of times."""
    out, at, closed = [], 0, {b"script": True, b"style": True}
    while True:
        m = _TAG.search(html, at)
        if not m:
            out.append(html[at:])
            break
        out.append(html[at : m.start()])
        kind = m[1].lower() if m[1] else None
        end = _CLOSE[kind].search(html, m.end()) if kind and closed[kind] else None
        if end:
            at = end.end()
            continue
        if kind:
            closed[kind] = False  # nor will any later one be
        stop = html.find(b">", m.end())
        if stop < 0:  # no tag
            out.append(html[m.start() + 1 :])
            break
        at = stop + 1
    return b" ".join(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


class Rules:
    """Rules ``host/path`` with a verdict; a rule fits its host and all subdomains, if the path starts with its path."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, mark, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((mark + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


class Segmenter:
    """Unigram Viterbi: the most likely split of a name into known words; unknown stretches cost more with each character.

    ``counts``: of words in the name at least; ``total``: of all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.other = math.log(total) + 1
        self.longest = max(map(len, counts), default=1)

    def split(self, name: str) -> list[str]:
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - max(self.longest, _UNKNOWN)), j):
                word = name[i:j]
                cost = best[i] + self.cost.get(word, self.other + 2.0 * len(word) if j - i <= _UNKNOWN else math.inf)
                if cost < best[j]:
                    best[j], back[j] = cost, i
        out, j = [], n
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        out.reverse()
        return out


def labels(host: str) -> list[str]:
    """Runs of letters of a host name."""
    return _LABEL.findall(host)


def features(words: list[str], path: str) -> list[int]:
    """Buckets of the words of the host's labels and the tokens of the path (numbers alike)."""
    found = [f"h:{w}" for w in words] + [f"p:{'0' if t.isdigit() else t}" for t in re.findall(r"\w+", path.lower())]
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in found]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in common.slices(batches):
        for html in common.utf8(batch.column(0)):
            counts.update(without_marks(html or b"").translate(_WORD).split())
            if len(counts) > _HELD_WORDS:
                yield out()
                counts.clear()
    if counts:
        yield out()


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word, n`` over the texts of all pages: runs of letters, A-Z lower-cased. A null page has none."""
    common.ship(pages.sparkSession)
    counts = pages.select(F.col(html).cast("string")).mapInArrow(_count_words, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _substrings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label in batch.column(0).to_pylist():
            subs = sorted({label[i:j] for i in range(len(label)) for j in range(i + 1, len(label) + 1)}) if len(label) <= LONGEST else [label]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(subs)), pa.array(subs)], ["label", "word"])


def _split_labels(total: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(Segmenter(dict(zip(words, counts, strict=True)), total).split(label) if len(label) <= LONGEST else [label])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return run


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words`` for each ``label`` of ``names`` (all different), split by the words of ``counts(word, n)``."""
    common.ship(names.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    subs = names.mapInArrow(_substrings, "label string, word string")
    of = subs.join(counts, "word", "left").groupBy("label").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("found"))
    of = of.select("label", F.transform("found", lambda x: x["word"]).alias("w"), F.transform("found", lambda x: x["n"]).alias("n"))
    return of.mapInArrow(_split_labels(total), "label string, words array<string>")


def _parsed(rules: Rules):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                out.append((host, path, *rules.match(host, path), labels(host)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.string()))], ["page_id", "host", "path", "rule", "verdict", "labels"])

    return run


def _train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(VERDICTS), BUCKETS + 1), np.int64)
    for batch in batches:
        for path, verdict, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of = counts[VERDICTS.index(verdict)]
            of[BUCKETS] += 1
            np.add.at(of, features(words, path), 1)
    kinds, buckets = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(buckets, pa.int64()), pa.array(counts[kinds, buckets], pa.int64())], ["kind", "bucket", "n"])


class Bayes:
    """Multinomial naive Bayes with add-one smoothing; ``counts``: verdicts x (buckets, then rows). Without rows: allow."""

    def __init__(self, counts: np.ndarray) -> None:
        rows = counts[:, -1]
        words = counts[:, :-1]
        with np.errstate(divide="ignore"):
            self.prior = np.log(rows / max(1, rows.sum()))
        self.words = np.log((words + 1) / (words.sum(1, keepdims=True) + words.shape[1]))
        self.empty = not rows.sum()

    def verdict(self, buckets: list[int]) -> str:
        if self.empty:
            return VERDICTS[0]
        return VERDICTS[int(np.argmax(self.prior + self.words[:, buckets].sum(1)))]


def _judge(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = model.value
        for batch in common.slices(batches):
            paths, verdicts, words = (batch.column(i).to_pylist() for i in (2, 4, 5))
            found = [v or bayes.verdict(features(w, p)) for p, v, w in zip(paths, verdicts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    A null url, or one without ``://``, has an empty host and path and gets the method's verdict. Ids may be null or repeated; of
    equally likely splits or verdicts the first counts. An empty table gives no rows; where no rule fits any url, the method allows
    all. Labels over ``LONGEST`` letters stay whole; pages and paths may be of any length. Other columns are not read.
    """
    spark = pages.sparkSession
    common.ship(spark)
    matcher = Rules(rules)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    parsed = T.StructType([rows.schema["page_id"], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")), T.StructField("labels", T.ArrayType(T.StringType()))])
    with staging.Scratch(spark) as scratch:
        rows = scratch.stage(rows.mapInArrow(_parsed(matcher), parsed), "urls")
        counts = scratch.stage(word_counts(pages, html), "urls-words")
        hosts = rows.groupBy("host").agg(F.first("labels").alias("labels"))
        split = segmented(hosts.select(F.explode("labels").alias("label")).distinct(), counts)
        named = hosts.select("host", F.posexplode("labels").alias("at", "label")).join(split, "label")
        named = named.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
        named = scratch.stage(named, "urls-hosts")
        # A host that many urls share is a key of this join only, and nothing that follows needs its rows together.
        rows = scratch.stage(rows.join(named, "host", "left").select("page_id", "host", "path", "rule", "verdict", F.coalesce("words", F.array().cast("array<string>")).alias("words")), "urls-named", keep=True)
    counts = np.zeros((len(VERDICTS), BUCKETS + 1), np.int64)
    learned = rows.where("verdict is not null").select("path", "verdict", "words").mapInArrow(_train, "kind long, bucket long, n long")
    for r in learned.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 x BUCKETS
        counts[r["kind"], r["bucket"]] = r["n"]
    model = spark.sparkContext.broadcast(Bayes(counts))  # 2 x BUCKETS numbers
    return rows.mapInArrow(_judge(model), T.StructType(parsed.fields[:5]))


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """Verdicts for all pages."""
    return filter_urls(common.table(spark, sf_dir, "pages"), RULES)
