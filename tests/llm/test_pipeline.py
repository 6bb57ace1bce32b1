"""The pipeline's stages against what each should keep."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as p
from loomlog.llm import quality, secrets


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 3000)}" + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    clean = [prose(rng, 150) for _ in range(12)]
    item = " ".join(f"b{i}" for i in range(14))
    texts = clean + [clean[0]] * 30 + [clean[1].upper()] + [prose(rng, 10), "a a a " * 60, None] + [prose(rng, 70) + " " + item + " " + prose(rng, 50)] + [prose(rng, 60) + " token = \"" + "0a1b2c3d" * 5 + "\" " + prose(rng, 60)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, columns, sf = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), None, f"file://{tmp_path}"
    kept = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == (columns or docs.columns)
        columns = out.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in docs.collect()}
    leak, secret = len(texts) - 2, len(texts) - 1
    assert kept["quality rules"] == {*range(43), leak, secret}
    assert kept["near-dedup"] == {*range(12), leak, secret}
    assert kept["decontamination"] == kept["secret scan"] == {*range(12), secret}
    masked = docs.where(F.col("doc_id") == secret).first()
    assert secrets.MASK in masked["text"] and "0a1b2c3d" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    whole = p.run(spark, sf)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == {*range(12), secret}
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, " w" * 60000, None, None, None)], docs.schema).withColumn("kept", F.lit(1))
    for name, stage in p.STAGES:
        assert stage(spark, odd, f"file://{tmp_path}").count() >= (0 if name == "quality rules" else 2)
    assert quality.assess(odd).count() == 3


def test_pipeline_against_brute_force(spark):
    """Every stage done by hand on a whole table: the documents left, their texts, and the pieces made of them."""
    from collections import defaultdict

    from test_operators import brute_counts, brute_hits, brute_quality, check_packed, classes, lower

    data = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[1-9]", "0", lower(x))))
    seen = defaultdict(set)
    for _, t, host in docs:
        for line in (t or "").split("\n"):
            if norm(line):
                seen[host, norm(line)].add(t)
    good = {i for i, _, kept in brute_quality(docs) if kept}
    texts = {i: "\n".join(x for x in t.split("\n") if not norm(x) or len(seen[host, norm(x)]) <= 20) for i, t, host in docs if i in good}
    assert all(brute_counts(t)[0] >= 50 for t in texts.values())

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: grams(t) for i, t in texts.items()}

    def near(a, b):
        x, y = sets[a], sets[b]
        return 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y))

    of = classes(sorted(texts), near)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    enc = secrets.encoding(secrets.ranks())
    left = {i: secrets.redacted(t, enc) for i, t in texts.items() if of[i] == i and not brute_hits(items, t)[1]}
    assert 0 < len(left) < len(set(of.values())) < len(texts)
    rows = p.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} == set(left)
    check_packed(rows, sorted(left.items()), 2048)
