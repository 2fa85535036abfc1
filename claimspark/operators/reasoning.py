"""How two facts relate: an ordered chain of rules, the first that fits decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.constants import RELATIONSHIPS, STATUS_PREDICATES, STATUS_STEMS, VINTAGE_TERMS
from claimspark.functions.compare import low
from claimspark.functions.text import filled, has_any, stripped
from claimspark.operators.facts import value_text


@dataclass
class Rule:
    name: str
    test: Column
    label: str
    confidence: float
    reason: Column


def _forecast(p: str) -> Column:
    in_qualifiers = F.exists(F.coalesce(F.col(f"{p}_qualifiers"), F.array().cast("array<string>")), lambda q: F.lower(q).contains("forecast") | F.lower(q).contains("project"))
    return in_qualifiers | F.lower(F.coalesce(F.col(f"{p}_predicate"), F.lit(""))).contains("project")


def is_status_progression(value_num: Column, value_raw: Column) -> Column:
    return value_num.isNull() & F.coalesce(has_any(F.lower(stripped(value_raw)), STATUS_STEMS), F.lit(False))


# The sentences of reasons.
def rules() -> list[Rule]:
    """In order. Columns are those of ``matching.compared``, and both values as texts."""
    c = F.col
    dim = lambda name, value: c(f"dims.{name}") == value
    value = {p: c(f"__{p}_text") for p in "ab"}
    unit = {p: F.coalesce(c(f"{p}_unit"), F.lit("")) for p in "ab"}
    or_unknown = lambda x: F.coalesce(filled(x), F.lit("unknown"))
    forecast = _forecast("a") | _forecast("b")
    numeric = c("num.is_numeric")
    no_period = filled(c("a_period")).isNull() | filled(c("b_period")).isNull()
    quals = F.concat(*[F.coalesce(c(f"{p}_qualifiers"), F.array().cast("array<string>")) for p in "ab"])
    vintage = F.exists(quals, lambda q: has_any(F.lower(q), VINTAGE_TERMS))
    listed = lambda p: F.when(F.size(F.coalesce(c(f"{p}_qualifiers"), F.array().cast("array<string>"))) > 0, F.array_join(f"{p}_qualifiers", ", ")).otherwise("standard")
    status = low(c("a_canonical_predicate"), c("a_predicate")).isin(*STATUS_PREDICATES)
    progression = is_status_progression(c("a_value_num"), c("a_value_raw")) & is_status_progression(c("b_value_num"), c("b_value_raw"))
    all_same = lambda *names: F.expr(" AND ".join(f"dims.{n} = 'same'" for n in names))
    dated = F.when(filled(c("a_as_of")).isNotNull() & filled(c("b_as_of")).isNotNull(), F.format_string("both disclosures carry the same effective date (%s)", c("a_as_of"))).otherwise("the disclosures are consistent with a single role sequence")
    of_scope = lambda s: F.when(F.coalesce(c("a_scope") == s, F.lit(False)), value["a"]).otherwise(value["b"])
    return [
        Rule("ambiguous_period", dim("period", "unknown") | (~c("per.is_same_period") & ~c("per.is_same_type") & no_period), "UNCERTAIN", 0.75, F.lit("Available source context or table layout leaves reporting period ambiguous, rendering relationship uncertain.")),
        Rule("predicate", dim("predicate", "different"), "UNRELATED", 0.90, F.format_string("Metrics assert different predicates ('%s' vs '%s') and are not meaningfully comparable.", c("a_predicate"), c("b_predicate"))),
        Rule("forecast", forecast & dim("value", "different"), "RECONCILABLE", 0.88, F.format_string("Both figures are independent forward-looking projections from different institutions (%s%s vs %s%s) based on different baseline assumptions.", value["a"], unit["a"], value["b"], unit["b"])),
        Rule("temporal", ~numeric & (dim("period", "different") | ~c("a_as_of").eqNullSafe(c("b_as_of"))), "RECONCILABLE", 0.92, F.format_string("Apparent difference in board status ('%s' vs '%s') is reconciled by temporal context: earlier disclosure dates vs subsequent resignation/cessation dates.", value["a"], value["b"])),
        Rule("progression", ~numeric & all_same("subject", "predicate") & dim("value", "different") & status & progression, "RECONCILABLE", 0.93, F.format_string("Apparent difference in %s ('%s' vs '%s') is a temporal progression for the same entity rather than a conflict: %s, and both values are recognized role-status transitions along one timeline.", c("a_predicate"), value["a"], value["b"], dated)),
        Rule("vintage", dim("value", "different") & dim("qualifiers", "different") & vintage, "RECONCILABLE", 0.95, F.format_string("Both figures refer to the same period, but represent different estimate vintages: %s (%s%s) versus %s (%s%s).", listed("a"), value["a"], unit["a"], listed("b"), value["b"], unit["b"])),
        Rule("scope", dim("scope", "different"), "RECONCILABLE", 0.95, F.format_string("Figures report on different accounting scopes: standalone (%s) versus consolidated (%s).", of_scope("standalone"), of_scope("consolidated"))),
        Rule("rounding", (c("num.status") == "close_rounding") & dim("period", "same"), "CORROBORATES", 0.92, F.format_string("Both sources report consistent figures for the same metric and period, with the minor difference (%.3f%%) explained by rounding across presentation formats.", c("num.relative_diff") * 100)),
        Rule("exact", all_same("value", "period", "scope"), "CORROBORATES", 0.96, F.format_string("Both independent sources corroborate that %s had %s of %s %s for %s.", c("a_subject"), c("a_predicate"), value["a"], unit["a"], F.coalesce(c("a_period"), F.lit("None")))),
        Rule("period_difference", numeric & all_same("subject", "predicate", "scope") & dim("period", "different") & dim("value", "different") & ~forecast, "RECONCILABLE", 0.90, F.format_string("Both figures report the same metric for the same scope, but for different reporting periods (%s versus %s), which explains the value difference (%s versus %s %s).", or_unknown(c("a_period")), or_unknown(c("b_period")), value["a"], value["b"], unit["a"])),
        Rule("contradiction", all_same("subject", "predicate", "period", "scope") & dim("value", "different") & ~forecast, "CONTRADICTS", 0.85, F.format_string("Assertions address the same metric, period (%s), and scope, but make incompatible claims: %s %s versus %s %s.", F.coalesce(c("a_period"), F.lit("None")), value["a"], unit["a"], value["b"], unit["b"])),
        Rule("default", F.lit(True), "UNCERTAIN", 0.50, F.lit("Available context is insufficient to determine a conclusive relationship.")),
    ]


def related(compared: DataFrame) -> DataFrame:
    """compared pairs with rule, relationship, confidence and reason."""
    which, all_rules = None, rules()
    for n, r in enumerate(all_rules):
        test = F.coalesce(r.test, F.lit(False))
        which = F.when(test, n) if which is None else which.when(test, n)
    step = compared
    for p in "ab":
        step = step.withColumn(f"__{p}_text", value_text(F.col(f"{p}_value_num"), F.col(f"{p}_value_raw")))
    step = step.withColumn("__n", which)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("__n") + 1)
    reason = None
    for n, r in enumerate(all_rules):
        reason = F.when(F.col("__n") == n, r.reason) if reason is None else reason.when(F.col("__n") == n, r.reason)
    names, labels, confidences = zip(*((r.name, r.label, r.confidence) for r in all_rules), strict=True)
    return step.select(*compared.columns, of(names).alias("rule"), of(labels).alias("relationship"), of(confidences).alias("confidence"), reason.alias("reason"))


def comparisons(compared: DataFrame, judged: DataFrame | None = None, mode: str = "heuristic") -> DataFrame:
    """Rows of the store: id, fact_a_id, fact_b_id, relationship, confidence, reason, dimensions, reasoning_mode.

    ``judged``: the pairs as another mode than the rules has labelled them.
    """
    return (related(compared) if judged is None else judged).select(F.concat_ws("_", "a_id", "b_id").alias("id"), F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "relationship", "confidence", "reason", F.col("dims").alias("dimensions"), F.lit(mode).alias("reasoning_mode"), "rule")


RESPONSE = "relationship string, confidence string, reason string"


def parsed_response(response: Column) -> Column:
    """struct(relationship, confidence, reason) of a provider's JSON text; anything malformed is UNCERTAIN with confidence 0."""
    r = F.from_json(response, RESPONSE)
    name = F.upper(stripped(r["relationship"]))
    confidence = F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0))
    confidence = F.when(F.isnan(confidence), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
    broken = response.isNull() | ~F.coalesce(stripped(response).startswith("{"), F.lit(False)) | r.isNull()
    reason = F.coalesce(filled(stripped(r["reason"])), F.lit("No reason provided by reasoning provider."))
    return F.when(broken, F.struct(F.lit("UNCERTAIN").alias("relationship"), F.lit(0.0).alias("confidence"), F.lit("Malformed reasoning response.").alias("reason"))).otherwise(
        F.struct(F.when(name.isin(*RELATIONSHIPS), name).otherwise("UNCERTAIN").alias("relationship"), confidence.alias("confidence"), reason.alias("reason"))
    )
