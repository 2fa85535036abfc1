"""Comparisons of two facts: numbers, periods, qualifiers and the seven dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.constants import ROUNDING_TOLERANCE
from claimspark.functions.text import filled, rounded, stripped


def number_comparison(v1: Column, u1: Column, v2: Column, u2: Column, tolerance: float = ROUNDING_TOLERANCE) -> Column:
    """struct(is_numeric, status, absolute_diff, relative_diff). A null value is a text."""
    diff = rounded(F.abs(v1 - v2), 6)
    most = F.greatest(F.abs(v1), F.abs(v2))
    relative = F.when(most > 0, rounded(diff / most, 6)).otherwise(F.lit(0.0))
    none = F.lit(None).cast("double")
    out = lambda numeric, status, a, r: F.struct(F.lit(numeric).alias("is_numeric"), F.lit(status).alias("status"), a.alias("absolute_diff"), r.alias("relative_diff"))
    return (
        F.when(v1.isNull() | v2.isNull(), out(False, "categorical", none, none))
        .when(~u1.eqNullSafe(u2), out(True, "incompatible_units", none, none))
        .when(diff < 1e-5, out(True, "exact", diff, relative))
        .when(relative <= tolerance, out(True, "close_rounding", diff, relative))
        .otherwise(out(True, "different", diff, relative))
    )


def period_comparison(p1: Column, t1: Column, p2: Column, t2: Column) -> Column:
    """struct(is_same_period, is_same_type, note)."""
    known = filled(p1).isNotNull() & filled(p2).isNotNull()
    type_ = t1.eqNullSafe(t2)
    same = (F.lower(stripped(p1)) == F.lower(stripped(p2))) & type_
    out = lambda s, t, note: F.struct(s.alias("is_same_period"), t.alias("is_same_type"), note.alias("note"))
    return (
        F.when(~known, out(F.lit(False), F.lit(False), F.lit("One or both periods are unspecified.")))
        .when(same, out(F.lit(True), F.lit(True), F.format_string("Identical %s: %s", t1, p1)))
        .when(~type_, out(F.lit(False), F.lit(False), F.format_string("Different period granularities: %s (%s) vs %s (%s)", t1, p1, t2, p2)))
        .otherwise(out(F.lit(False), F.lit(True), F.format_string("Different %ss: %s vs %s", t1, p1, p2)))
    )


def _word(test: Column, yes: str = "same", no: str = "different") -> Column:
    return F.when(test, yes).otherwise(no)


def _set(q: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(q, lambda x: F.lower(stripped(x)))))


def qualifier_difference(a: Column, b: Column) -> Column:
    """Equal as sets; one side empty is different."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), "same").when((F.size(a) == 0) | (F.size(b) == 0), "different").otherwise(_word(_set(a) == _set(b)))


def _either_known(a: Column, b: Column, none: str) -> Column:
    """same or different where both are known, ``none`` where neither is, else unknown."""
    return F.when(a.isNull() & b.isNull(), none).when(a.isNull() | b.isNull(), "unknown").otherwise(_word(a == b))


def low(*choices: Column) -> Column:
    """The first that isn't empty, stripped and lower-cased; null if all are."""
    return F.lower(stripped(F.coalesce(*[filled(c) for c in choices])))


def dimensions(a: str, b: str, num: Column, per: Column) -> Column:
    """struct of the seven differences between the facts with column prefixes ``a`` and ``b``."""
    of = lambda p, name: F.col(f"{p}{name}")
    both = lambda x, y: (F.coalesce(x, F.lit("")) != "") & (x == y)
    names = ("canonical_subject", "subject"), ("canonical_predicate", "predicate"), ("normalized_unit", "unit"), ("normalized_period", "period")
    subject, predicate, unit, period = [[low(of(p, x), of(p, y)) for p in (a, b)] for x, y in names]
    text = of(a, "value_num").isNull() & of(b, "value_num").isNull()
    value = (
        F.when(num["is_numeric"], _word(num["status"].isin("exact", "close_rounding")))
        .when(text, _word(F.lower(stripped(of(a, "value_raw"))).eqNullSafe(F.lower(stripped(of(b, "value_raw"))))))
        .otherwise("different")
    )
    known = filled(of(a, "normalized_period")).isNotNull() & filled(of(b, "normalized_period")).isNotNull()
    return F.struct(
        _word(F.coalesce(both(*subject), F.lit(False))).alias("subject"),
        _word(F.coalesce(both(*predicate), F.lit(False))).alias("predicate"),
        value.alias("value"),
        _either_known(*unit, "same").alias("unit"),
        F.when(known, _word(per["is_same_period"])).otherwise(_either_known(*period, "unknown")).alias("period"),
        _either_known(low(of(a, "scope")), low(of(b, "scope")), "same").alias("scope"),
        qualifier_difference(of(a, "qualifiers"), of(b, "qualifiers")).alias("qualifiers"),
    )


def raw_dimensions(a: str, b: str) -> Column:
    """struct of the seven differences as the facts have them written: a null, or qualifiers on one side only, is unknown."""
    plain = lambda p, name: F.lower(stripped(F.col(f"{p}{name}").cast("string")))
    value = lambda p: F.lower(stripped(F.coalesce(F.col(f"{p}value_num").cast("string"), F.col(f"{p}value_raw"))))
    of = lambda x, y: F.when(x.isNull() | y.isNull(), "unknown").otherwise(_word(x == y))
    quals = [F.coalesce(F.col(f"{p}qualifiers"), F.array().cast("array<string>")) for p in (a, b)]
    empty = [F.size(q) == 0 for q in quals]
    qualifiers = F.when(empty[0] & empty[1], "same").when(empty[0] | empty[1], "unknown").otherwise(_word(_set(quals[0]) == _set(quals[1])))
    named = [of(plain(a, n), plain(b, n)).alias(n) for n in ("subject", "predicate")]
    return F.struct(*named, of(value(a), value(b)).alias("value"), *[of(plain(a, n), plain(b, n)).alias(n) for n in ("unit", "period", "scope")], qualifiers.alias("qualifiers"))
