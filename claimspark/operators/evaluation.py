"""Scores of claims and relationships against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions.text import collapsed, rounded
from claimspark.operators.facts import value_text

CLASSES = ("CORROBORATES", "CONTRADICTS", "RECONCILABLE", "UNCERTAIN")


def claim_key(subject: Column, predicate: Column, value: Column, unit: Column, *more: Column) -> Column:
    """Four fields know a claim of a pair; extracted claims have their effective date, as_of, as a fifth."""
    norm = lambda c: F.lower(collapsed(c))
    return F.concat_ws("\u0001", norm(subject), norm(predicate), norm(value), norm(unit), *map(norm, more))


def keyed(facts: DataFrame, name: str = "key", dated: bool = False) -> DataFrame:
    more = (F.col("as_of"),) if dated else ()
    return facts.withColumn(name, claim_key(F.col("subject"), F.col("predicate"), value_text(F.col("value_num"), F.col("value_raw")), F.col("unit"), *more))


CAPTURED = ("period", "scope")


def matched(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows (key, outcome, source, then p_ and g_ of CAPTURED): tp, duplicate, unknown or fn, a row for each claim.

    Both sides have key, seq, source and CAPTURED. The k-th prediction of a key, by seq, takes the k-th gold item of it; one
    more is a duplicate, and one whose key no gold item has is unknown. ``source`` is the gold item's.
    """
    nth = F.row_number().over(W.partitionBy("key").orderBy("seq"))
    p = predicted.select("key", nth.alias("k"), F.lit(True).alias("p"), *[F.col(c).alias(f"p_{c}") for c in CAPTURED])
    g = gold.select("key", nth.alias("k"), F.lit(True).alias("g"), "source", *[F.col(c).alias(f"g_{c}") for c in CAPTURED])
    both = p.join(g, ["key", "k"], "full")
    known = F.max("g").over(W.partitionBy("key"))
    outcome = F.when(F.col("p") & F.col("g"), "tp").when(F.col("g"), "fn").when(known, "duplicate").otherwise("unknown")
    return both.select("key", outcome.alias("outcome"), "source", *[f"{side}_{c}" for c in CAPTURED for side in "pg"])


def extraction_scores(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes, precision, recall and f1, zero on empty denominators, and the share of matched claims whose
    period and scope are as the gold item has them, of those for which it has one; null if none has."""
    n = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    of = lambda o: n(F.col("outcome") == o)
    norm = lambda c: F.lower(collapsed(F.col(c)))

    def capture(field: str) -> Column:
        asked = (F.col("outcome") == "tp") & (F.coalesce(F.col(f"g_{field}"), F.lit("")) != "")
        return rounded(n(asked & (norm(f"p_{field}") == norm(f"g_{field}"))) / F.nullif(n(asked), F.lit(0)), 4).alias(f"{field}_capture")

    rows = outcomes.agg(of("tp").alias("tp"), of("duplicate").alias("fp_duplicate"), of("unknown").alias("fp_unknown"), of("fn").alias("fn"), *map(capture, CAPTURED))
    share = lambda a, b: F.coalesce(F.expr(a) / F.nullif(F.expr(b), F.lit(0)), F.lit(0.0))
    shares = {"precision": share("tp", "tp + fp_duplicate + fp_unknown"), "recall": share("tp", "tp + fn"), "f1": share("2 * tp", "2 * tp + fp_duplicate + fp_unknown + fn")}
    return rows.withColumns({k: rounded(v, 4) for k, v in shares.items()})


def gold_by_source(outcomes: DataFrame) -> DataFrame:
    """Gold items of each source, and how many of them are matched."""
    own = outcomes.where(F.col("outcome").isin("tp", "fn"))
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("outcome") == "tp").cast("int")).alias("matched"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("\u0002", F.least(a, b), F.greatest(a, b))


def unique_pairs(comparisons: DataFrame, facts: DataFrame) -> DataFrame:
    """pair and relationship: of comparisons of equal unordered claim keys, that with the highest confidence, then the smallest id."""
    k = keyed(facts)
    a, b = k.select(F.col("id").alias("fact_a_id"), F.col("key").alias("ka")), k.select(F.col("id").alias("fact_b_id"), F.col("key").alias("kb"))
    rows = comparisons.join(a, "fact_a_id").join(b, "fact_b_id").withColumn("pair", pair_key(F.col("ka"), F.col("kb")))
    first = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("id"), F.col("relationship").alias("relationship"))).alias("first")
    return rows.groupBy("pair").agg(first).select("pair", F.col("first.relationship").alias("relationship"))


def judged_pairs(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """gold pairs (pair, expectation label or absent, expected) with produced, a relationship or null, outcome and ok."""
    p = predicted.select("pair", F.col("relationship").alias("produced"))
    absent, missing = F.col("expectation") == "absent", F.col("produced").isNull()
    outcome = F.when(absent & missing, "ok(absent)").when(absent, "VIOLATION").when(missing, "missed").when(F.col("produced") == F.col("expected"), "ok").otherwise(F.concat(F.lit("wrong("), "produced", F.lit(")")))
    return gold.join(p, "pair", "left").withColumn("outcome", outcome).withColumn("ok", F.col("outcome").isin("ok", "ok(absent)"))


def relationship_scores(judged: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: counts of gold pairs by outcome, accuracy, zero without gold pairs, and absent_compliance, null without absent ones."""
    n = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    out, absent = F.col("outcome"), F.col("expectation") == "absent"
    counts = judged.agg(
        F.count(F.lit(1)).alias("gold_items"),
        n(F.col("ok")).alias("correct"),
        n(out.startswith("wrong(")).alias("incorrect_label"),
        n(out == "missed").alias("missed_required"),
        n(out == "VIOLATION").alias("absent_violations"),
        F.coalesce(rounded(n(F.col("ok")) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias("accuracy"),
        rounded(n(absent & F.col("ok")) / F.nullif(n(absent), F.lit(0)), 4).alias("absent_compliance"),
    )
    return counts.crossJoin(predicted.agg(F.count(F.lit(1)).alias("predicted_unique_pairs")))  # one row each


def per_class_scores(judged: DataFrame, predicted: DataFrame) -> DataFrame:
    """class, how many pairs were predicted and required, and precision and recall of each; null on empty denominators.

    Precision is over all predicted pairs of a class, those without gold pair included.
    """
    n = lambda test: F.sum(test.cast("int"))
    hit = (F.col("expectation") == "label") & (F.col("outcome") == "ok")
    required = judged.where("expectation = 'label'").groupBy(F.col("expected").alias("class")).agg(n(hit).alias("hits"), F.count(F.lit(1)).alias("gold_required"))
    produced = predicted.groupBy(F.col("relationship").alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    classes = judged.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    rows = classes.join(required, "class", "left").join(produced, "class", "left").na.fill(0)
    share = lambda of: rounded(F.col("hits") / F.nullif(F.col(of), F.lit(0)), 4)
    return rows.select("class", "predicted", "gold_required", share("predicted").alias("precision"), share("gold_required").alias("recall"))
