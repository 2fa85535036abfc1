"""Canonical entities and predicates, normalized periods, units and values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.constants import ANAPHORA, METRIC_TERMS, PREDICATE_TERMS
from claimspark.functions.text import filled, found, has_any, rounded, stripped

LEGAL_SUFFIX = r"(?i)\b(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Limited|Ltd\.?|Corporation|Corp\.?|Incorporated|Inc\.?|LLC|LLP|PLC)\b"
TITLE = r"(?i)^(?:Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Shri|Prof\.?)\s+"
SOVEREIGN = r"(?i)^(India(?:'s)?|Indian(?:\s+economy)?)\s+(.+)$"


def metric_pattern(term: str) -> str:
    return rf"(?i)^(.*?)\s+(?:on\s+)?(?:the\s+)?({re.escape(term).replace(chr(92) + ' ', ' ')}.*)$"


def longest_first() -> list[str]:
    return sorted(METRIC_TERMS, key=len, reverse=True)


def _pair(entity: Column, remainder: Column | None = None) -> Column:
    return F.struct(entity.alias("entity"), (F.lit(None).cast("string") if remainder is None else remainder).alias("remainder"))


def with_entity(df: DataFrame, subject: str = "subject", context: str = "document_name", out: str = "entity") -> DataFrame:
    """df with struct(entity, remainder): the entity that a subject names, and the metric phrase left over.

    In steps, each a column of its own, so that no step's expression is repeated in the next one's.
    """
    raw = F.col("__raw")
    chosen = F.lit(None).cast("string")
    for term in reversed(longest_first()):
        chosen = F.when(raw.rlike(metric_pattern(term)), metric_pattern(term)).otherwise(chosen)
    part = lambda n: stripped(F.call_function("regexp_extract", raw, F.col("__pattern"), F.lit(n)))
    step = df.withColumn("__raw", stripped(F.col(subject))).withColumn("__low", F.lower("__raw")).withColumn("__pattern", chosen)
    step = step.withColumn("__head", F.when(F.col("__pattern").isNull(), raw).otherwise(stripped(F.regexp_replace(part(1), r"(?i)\b(?:net|standalone|consolidated)\b$", ""))))
    step = step.withColumn("__untitled", stripped(F.regexp_replace("__head", TITLE, "")))
    step = step.withColumn("__cleaned", stripped(F.regexp_replace(stripped(F.regexp_replace("__untitled", LEGAL_SUFFIX, "")), r"[\s,.\-]+$", "")))
    step = step.withColumn("__clean", F.regexp_replace(F.col(context), "[-_]", " "))
    clean, low = F.col("__clean"), F.col("__low")
    named = (
        F.when(F.coalesce(F.col(context), F.lit("")) == "", raw)
        .when(clean.rlike(r"(?i)\bdelhivery\b"), "Delhivery")
        .when(clean.rlike(r"(?i)\brbi\b|reserve bank"), "Reserve Bank of India")
        .otherwise(F.coalesce(found(clean, r"(?:^|\s)(\p{Lu}\S{2,})", 1), raw))
    )
    after = lambda n: filled(stripped(F.substring(raw, n + 1, 1_000_000)))
    value = (
        F.when(F.coalesce(F.col(subject), F.lit("")) == "", _pair(F.lit("")))
        .when(low.isin(*ANAPHORA), _pair(named))
        .when(low.startswith("reserve bank of india"), _pair(F.lit("Reserve Bank of India"), after(21)))
        .when(low == "rbi", _pair(F.lit("Reserve Bank of India")))
        .when(low.startswith("international monetary fund"), _pair(F.lit("IMF"), after(27)))
        .when(low == "imf", _pair(F.lit("IMF")))
        .when(low.rlike(r"^(government of india|govt\.? of india)"), _pair(F.lit("Government of India")))
        .when(raw.rlike(SOVEREIGN), _pair(F.lit("India"), stripped(F.regexp_extract(raw, SOVEREIGN, 2))))
        .when(low.isin("india", "india's", "indian economy"), _pair(F.lit("India")))
        .otherwise(_pair(F.coalesce(filled(F.col("__cleaned")), F.col("__head")), part(2)))
    )
    return step.withColumn("__value", value).select(*df.columns, F.col("__value").alias(out))


def with_predicate(df: DataFrame, predicate: str, remainder: Column, out: str = "canonical_predicate") -> DataFrame:
    low, rest = F.lower(F.coalesce(F.col(predicate), F.lit(""))), filled(remainder)
    joined = F.when(rest.isNull(), low).otherwise(F.trim(F.concat(F.lower(rest), F.lit(" "), low)))
    step, text = df.withColumn("__text", F.regexp_replace(joined, "[-_/]", " ")), F.col("__text")
    chosen = F.coalesce(filled(F.regexp_replace(F.regexp_replace(stripped(text), r"(?U)\s+", "_"), "[^a-z0-9_]", "")), F.lit("unknown_predicate"))
    for name, terms in reversed(PREDICATE_TERMS):
        test = has_any(text, terms)
        if name == "gdp_growth":
            test = test | (text.contains("gdp") & text.contains("growth"))
        chosen = F.when(test, name).otherwise(chosen)
    return step.withColumn("__value", chosen).select(*df.columns, F.col("__value").alias(out))


SPAN = r"(?i)(?:FY\s*)?20?(\d{2})[-/](?:20)?(\d{2})"
SINGLE = r"(?i)\bFY\s*(\d{2,4})\b"
QUARTER = r"(?i)\b(?:(Q[1-4])|(?:[1-4]Q))\s*(?:of\s*)?(?:FY\s*)?(\d{2,4}(?:[-/]\d{2,4})?)"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
MONTH_YEAR = rf"(?i)^({MONTHS})\.?\s+(20\d\d)$"
#: Date formats in the order in which they are tried.
DATES = ("MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMMM, yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy")


def fiscal_year(text: Column) -> Column:
    """FYyyyy-yy of a span of years or of a single fiscal year; null where there is none."""
    n = F.regexp_extract(text, SINGLE, 1).try_cast("int")
    end = F.when(n < 100, n + 2000).otherwise(n)
    return F.coalesce(
        F.when(text.rlike(SPAN), F.concat(F.lit("FY20"), F.regexp_extract(text, SPAN, 1), F.lit("-"), F.regexp_extract(text, SPAN, 2))),
        F.when(n.isNotNull(), F.concat(F.lit("FY"), (end - 1).cast("string"), F.lit("-"), F.right(end.cast("string"), F.lit(2)))),
    )


def with_period(df: DataFrame, period: str = "period", as_of: str = "as_of", out: str = "normalized") -> DataFrame:
    """df with struct(period, type); type: fiscal_year, quarter, date, as_of or unknown. Granularities are never mixed."""
    step = df.withColumn("__raw", stripped(F.coalesce(F.col(period), F.lit("")))).withColumn("__other", stripped(F.coalesce(F.col(as_of), F.lit(""))))
    step = step.withColumn("__target", F.coalesce(filled(F.col("__raw")), F.col("__other")))
    target, plain, other = F.col("__target"), F.col("__plain"), F.col("__other")
    part = F.regexp_extract(target, QUARTER, 2)
    step = step.withColumn("__part", F.when(F.length(part).isin(2, 4), F.concat(F.lit("FY"), part)).otherwise(part))
    step = step.withColumn("__plain", stripped(F.regexp_replace(target, r"(\d+)(?:st|nd|rd|th)\b", "$1"))).withColumn("__fy", fiscal_year(target))
    step = step.withColumn("__date", F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in DATES]))
    kind = F.when(F.col("__raw") != "", "date").otherwise("as_of")
    label = F.upper(F.coalesce(found(target, QUARTER, 1), F.concat(F.lit("Q"), F.substring(target, 1, 1))))
    month = F.try_to_timestamp(F.concat_ws(" ", F.substring(F.regexp_extract(plain, MONTH_YEAR, 1), 1, 3), F.regexp_extract(plain, MONTH_YEAR, 2)), F.lit("MMM yyyy"))
    year = found(target, r"\b(20\d\d)\b", 1)
    of = lambda value, name: F.struct(value.alias("period"), name.alias("type"))
    value = (
        F.when(target == "", of(F.lit(None).cast("string"), F.lit("unknown")))
        .when(target.rlike(QUARTER), of(F.concat(F.coalesce(fiscal_year(F.col("__part")), F.col("__part")), F.lit("-"), label), F.lit("quarter")))
        .when(F.col("__fy").isNotNull(), of(F.col("__fy"), F.lit("fiscal_year")))
        .when(F.col("__date").isNotNull(), of(F.date_format("__date", "yyyy-MM-dd"), kind))
        .when(plain.rlike(MONTH_YEAR), of(F.date_format(month, "yyyy-MM-dd"), kind))
        .when(year.isNotNull(), of(year, F.when((other != "") | F.lower(target).contains("as of"), "as_of").otherwise("date")))
        .otherwise(of(target, F.lit("unknown")))
    )
    return step.withColumn("__value", value).select(*df.columns, F.col("__value").alias(out))


#: What is read as a number; a cast alone would also take '1d' and 'nan'.
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def with_value(df: DataFrame, value_num: str = "value_num", value_raw: str = "value_raw", unit: str = "unit", out: str = "normal") -> DataFrame:
    """df with struct(value, unit): numbers in base units; value is null where the value is a text."""
    written = stripped(F.regexp_replace(value_raw, ",", ""))
    parsed = F.coalesce(F.col(value_num), F.when(written.rlike(DECIMAL), written.try_cast("double")))
    step = df.withColumn("__v", parsed).withColumn("__u", F.lower(stripped(F.col(unit)))).withColumn("__words", F.split("__u", r"\s+"))
    v, u, words = F.col("__v"), F.col("__u"), F.col("__words")
    percent = u.rlike("^(%|percent|per cent|pct)")
    # factor to the base unit, and places to round to
    factor = (
        F.when(percent, 1.0)
        .when(u.contains("crore") | F.array_contains(words, "cr") | (u == "cr."), 10.0)
        .when(u.contains("million") | F.array_contains(words, "mn") | u.contains("inr m"), 1.0)
        .when(u.contains("lakh") | u.contains("lac"), 0.1)
        .when(u.contains("billion"), 1000.0)
    )
    step, factor = step.withColumn("__f", factor), F.col("__f")
    whole = factor.isNull() & u.isin("inr", "₹", "rs", "rs.", "rupees")
    value = F.when(v.isNull(), None).when(whole, rounded(v / 1000000.0, 6)).otherwise(rounded(v * F.coalesce(factor, F.lit(1.0)), 4))
    name = F.when(v.isNull(), None).when(percent, "percent").when(whole | factor.isNotNull(), "INR million").otherwise(u)
    return step.withColumn("__value", F.struct(value.cast("double").alias("value"), name.cast("string").alias("unit"))).select(*df.columns, F.col("__value").alias(out))
