"""Candidate pairs within blocks, and how their facts differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.compare import dimensions, low, number_comparison, period_comparison


def blocks(normalized: DataFrame) -> DataFrame:
    """normalized facts with their block: subject_key and predicate_key."""
    return normalized.withColumn("subject_key", F.coalesce(low(F.col("canonical_subject"), F.col("subject")), F.lit(""))).withColumn("predicate_key", F.coalesce(low(F.col("canonical_predicate"), F.col("predicate")), F.lit("")))


def candidate_pairs(normalized: DataFrame, filter_irrelevant: bool = True, new: DataFrame | None = None) -> DataFrame:
    """Pairs of facts of one block, with columns a_* and b_*, a_id below b_id.

    An equi-join on the block's keys, so a skewed block is split by the adaptive planner; a block's pairs are the result
    itself. With ``new`` only pairs with a fact of ``new`` are made: new with all others.
    """
    side = lambda df, p: blocks(df).select("subject_key", "predicate_key", *[F.col(c).alias(p + c) for c in normalized.columns])
    if new is None:
        pairs = side(normalized, "a_").join(side(normalized, "b_"), ["subject_key", "predicate_key"]).where("a_id < b_id")
    else:
        old = normalized.join(new.select("id"), "id", "left_anti")
        crossed = side(new, "a_").join(side(old, "b_"), ["subject_key", "predicate_key"])
        swap = [F.when(F.col("a_id") < F.col("b_id"), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in normalized.columns]
        crossed = crossed.select("subject_key", "predicate_key", *swap)
        within = side(new, "a_").join(side(new, "b_"), ["subject_key", "predicate_key"]).where("a_id < b_id")
        pairs = within.unionByName(crossed)
    if filter_irrelevant:
        numeric = lambda p: F.col(f"{p}_normalized_value").isNotNull()
        repeat = F.expr("a_document_id <=> b_document_id AND a_page_number <=> b_page_number AND trim(a_evidence_text) <=> trim(b_evidence_text) AND a_value_raw <=> b_value_raw AND a_value_num <=> b_value_num")
        units = F.expr("coalesce(a_normalized_unit, '') <> '' AND coalesce(b_normalized_unit, '') <> '' AND a_normalized_unit <> b_normalized_unit")
        pairs = pairs.where(~repeat & (numeric("a") == numeric("b")) & ~(numeric("a") & units))
    return pairs


def compared(pairs: DataFrame) -> DataFrame:
    """pairs with num, per and dims: comparisons of numbers and periods, and the seven dimensions."""
    value = lambda p: F.coalesce(F.col(f"{p}_normalized_value"), F.col(f"{p}_value_num"))
    unit = lambda p: F.coalesce(F.col(f"{p}_normalized_unit"), F.col(f"{p}_unit"))
    out = pairs.withColumn("num", number_comparison(value("a"), unit("a"), value("b"), unit("b")))
    out = out.withColumn("per", period_comparison(F.col("a_normalized_period"), F.col("a_period_type"), F.col("b_normalized_period"), F.col("b_period_type")))
    return out.withColumn("dims", dimensions("a_", "b_", F.col("num"), F.col("per")))


def statistics(normalized: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: facts, naive pairs, blocks, candidate pairs and the share of pairs that blocking saves."""
    facts = blocks(normalized).groupBy("subject_key", "predicate_key").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_facts"), F.count(F.lit(1)).alias("candidate_groups"))
    both = facts.crossJoin(pairs.agg(F.count(F.lit(1)).alias("candidate_pairs")))  # one row each
    naive = (F.col("total_facts") * (F.col("total_facts") - 1) / 2).cast("long")
    reduction = F.when(naive > 0, F.floor((1 - F.col("candidate_pairs") / naive) * 10000 + 0.5) / 10000).otherwise(F.lit(0.0))
    return both.select("total_facts", naive.alias("naive_pairs"), "candidate_groups", "candidate_pairs", reduction.cast("double").alias("reduction_ratio"))
