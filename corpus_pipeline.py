"""A corpus from raw documents to packed sequences. Counted as part of the subpackage ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import common, decontaminate, nearcopies, packing, quality, secrets
from loomlog.plans import staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    SimHash with ball hashing over five-word shingles, links verified at a similarity of 0.8; an exact check adds those out of the balls' reach.
    """
    return nearcopies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("packing", packed)]

#: Tokenizing and fingerprints have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
