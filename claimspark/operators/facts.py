"""Facts: normalization, fingerprints, deduplication, grounding on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.compare import low
from claimspark.functions.normalize import with_entity, with_period, with_predicate, with_value
from claimspark.functions.text import collapsed, rounded

FACTS = (
    "id string, seq bigint, document_id string, document_name string, page_number int, subject string, predicate string, value_raw string, "
    "value_num double, unit string, period string, as_of string, scope string, qualifiers array<string>, confidence double, evidence_text string"
)


def normalize(facts: DataFrame) -> DataFrame:
    """facts with canonical_subject, canonical_predicate, normalized_value, normalized_unit, normalized_period and period_type."""
    step = with_value(with_period(with_predicate(with_entity(facts, out="__e"), "predicate", F.col("__e.remainder"), "__c"), out="__p"), out="__n")
    return step.select(
        *facts.columns,
        F.col("__e.entity").alias("canonical_subject"),
        F.col("__c").alias("canonical_predicate"),
        F.col("__n.value").alias("normalized_value"),
        F.col("__n.unit").alias("normalized_unit"),
        F.col("__p.period").alias("normalized_period"),
        F.col("__p.type").alias("period_type"),
    )


def value_text(value: Column, raw: Column) -> Column:
    """A number of at most six places without needless zeros, in plain decimals; else the text."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", rounded(value, 6)), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), raw).otherwise(plain)


def fingerprint() -> Column:
    """Of a normalized fact: SHA-256 over document, subject, predicate, value, unit, period, as_of and scope; not over page and qualifiers."""
    parts = [
        low(F.col("document_name"), F.col("document_id")),
        low(F.col("canonical_subject"), F.col("subject")),
        low(F.col("canonical_predicate"), F.col("predicate")),
        low(value_text(F.coalesce("normalized_value", "value_num"), F.col("value_raw"))),
        low(F.col("normalized_unit"), F.col("unit")),
        low(F.col("normalized_period"), F.col("period")),
        low(F.col("as_of")),
        low(F.col("scope")),
    ]
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def dedupe(normalized: DataFrame) -> DataFrame:
    """The first fact, by seq, of each fingerprint; pages of later ones are noted in its qualifiers, in order, once each.

    One aggregation by fingerprint: the first is a minimum that is combined on the map side. What is gathered of a
    group is its pages, as many as the copies of one claim in one document.
    """
    keyed = normalized.withColumn("fingerprint", fingerprint())
    first = F.min(F.struct("seq", "id")).alias("first")
    pages = F.collect_set(F.struct("seq", "page_number")).alias("pages")
    groups = keyed.groupBy("fingerprint").agg(first, pages, F.count(F.lit(1)).alias("copies"))
    later = F.filter(F.array_sort("pages"), lambda p: p["seq"] > F.col("first.seq"))
    notes = F.array_distinct(F.transform(later, lambda p: F.format_string("duplicate-evidence: p.%d", p["page_number"])))
    kept = groups.select(F.col("first.id").alias("id"), F.when(F.col("copies") > 1, notes).otherwise(F.array().cast("array<string>")).alias("notes"))
    fresh = F.array_except("notes", F.coalesce("qualifiers", F.array().cast("array<string>")))
    return keyed.join(kept, "id").withColumn("qualifiers", F.concat(F.coalesce("qualifiers", F.array().cast("array<string>")), fresh)).drop("notes")


def ground(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts with verified: whether the evidence is on the page that it names, whitespace apart. A missing page: false."""
    p = pages.select(F.col("document_id").alias("__d"), F.col("page_number").alias("__n"), F.col("raw_text").alias("__text"))
    joined = facts.join(p, (F.col("document_id") == F.col("__d")) & (F.col("page_number") == F.col("__n")), "left")
    evidence = collapsed(F.col("evidence_text"))
    held = F.coalesce((evidence != "") & collapsed(F.col("__text")).contains(evidence), F.lit(False))
    return joined.select(*facts.columns, held.alias("verified"))
