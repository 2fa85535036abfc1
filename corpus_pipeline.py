"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import decontaminate, mixing, simhash, suffix, toxicity
from claimspark.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash near-duplicates", simhash.stage),
    ("suffix-array duplicates", suffix.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing to target weights", mixing.stage),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
