"""Checks of table layouts and of the contexts that are proposed for their values: rows of what is wrong, none where all is well.

A context proposes that a value cell of a table belongs to a row label, column headers and a meaning: context_id, page, table_id,
row, value_col, label and value_cell (struct<row, col>), header and sources (arrays of such), raw_value, value (struct<raw,
number, unit_kind, currency>) and resolutions (array<struct<dimension, status, reason>>). Dimensions, statuses and kinds are
strings. Everything is DataFrame expressions over one context or one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What must be resolved of every context, and the status that counts as such.
REQUIRED = ("row_value_association", "header_association", "entity", "period", "unit", "scale")
RESOLVED, CURRENCY = "resolved", "currency"
BOX = ("x0", "y0", "x1", "y1")


def sound_box(*c: Column) -> Column:
    """True for no box at all, and for four finite numbers in order."""
    missing = [x.isNull() for x in c]
    none, some = missing[0] & missing[1] & missing[2] & missing[3], missing[0] | missing[1] | missing[2] | missing[3]
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    ordered = (c[2] >= c[0]) & (c[3] >= c[1])
    return none | (~some & ~odd(c[0]) & ~odd(c[1]) & ~odd(c[2]) & ~odd(c[3]) & ordered)


def cell_violations(cells: DataFrame) -> DataFrame:
    """Rows (table_id, kind, row, col) of cells (table_id, row, col, row_span, col_span, x0, y0, x1, y1) that no table can have:
    bad_span, bad_box, repeated_origin, and overlap of the spans of different origins or repeated ones."""
    span = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row_span") >= 1) & (F.col("col_span") >= 1)
    own = lambda df, kind: df.select("table_id", F.lit(kind).alias("kind"), "row", "col")
    good = cells.where(span)
    twice = good.groupBy("table_id", "row", "col").count().where("count > 1")
    covered = good.select("table_id", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), F.col("col").alias("c"), "col_span")
    covered = covered.select("table_id", "row", F.explode(F.sequence("c", F.col("c") + F.col("col_span") - 1)).alias("col"))
    overlap = covered.groupBy("table_id", "row", "col").count().where("count > 1")
    boxes = cells.where(~sound_box(*map(F.col, BOX)))
    return own(cells.where(~span), "bad_span").unionByName(own(boxes, "bad_box")).unionByName(own(twice, "repeated_origin")).unionByName(own(overlap, "overlap"))


def cell_at(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (table_id, row, col) with the text of the cell that begins there, null where none does."""
    return refs.join(cells.select("table_id", "row", "col", "text"), ["table_id", "row", "col"], "left")


def _status(dimension: str) -> Column:
    """Of the first record of a dimension; null where there is none."""
    return F.get(F.filter("resolutions", lambda r: r["dimension"] == dimension), F.lit(0))["status"]


def _rows(contexts: DataFrame, tests: dict[str, Column]) -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(test, kind) for kind, test in tests.items()]))
    return contexts.select("context_id", F.explode(kinds).alias("kind"))


def context_violations(contexts: DataFrame) -> DataFrame:
    """Rows (context_id, kind): what a context claims without what it takes, or leaves unsaid."""
    names = F.transform("resolutions", lambda r: r["dimension"])
    is_resolved = lambda d: F.coalesce(_status(d) == RESOLVED, F.lit(False))
    value, number, kind, currency = F.col("value"), F.col("value.number"), F.col("value.unit_kind"), F.col("value.currency")
    joined = is_resolved("row_value_association")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = {
        "reason_missing": F.exists("resolutions", lambda r: (r["status"] != RESOLVED) & blank(r["reason"])),
        "dimension_repeated": F.size(names) != F.size(F.array_distinct(names)),
        "association_incomplete": joined & (F.col("label").isNull() | F.col("value_cell").isNull() | F.col("raw_value").isNull()),
        "association_without_value": joined & value.isNull(),
        "header_path_missing": is_resolved("header_association") & (F.size("header") == 0),
        "unit_unresolved": number.isNotNull() & ~is_resolved("unit"),
        "scale_unresolved": number.isNotNull() & ~is_resolved("scale"),
        "value_text_missing": value.isNotNull() & (F.coalesce(F.col("value.raw"), F.lit("")) == ""),
        "number_without_unit": value.isNotNull() & (number.isNull() != kind.isNull()),
        "number_not_finite": number.isNotNull() & (F.isnan(number) | (F.abs(number) == float("inf"))),
        "currency_missing": (kind == CURRENCY) & currency.isNull(),
        "currency_not_allowed": (kind != CURRENCY) & currency.isNotNull(),
        "currency_code_bad": currency.isNotNull() & ~currency.rlike(r"^\p{Lu}{3}$"),
    }
    tests |= {f"missing_{d}": ~F.array_contains(names, d) for d in REQUIRED}
    return _rows(contexts, {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})


def resolved(contexts: DataFrame) -> DataFrame:
    """contexts with is_resolved: all that is required is."""
    test = F.lit(True)
    for d in REQUIRED:
        test &= F.coalesce(_status(d) == RESOLVED, F.lit(False))
    return contexts.withColumn("is_resolved", test)


def provenance_violations(contexts: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (context_id, kind) of references that their table doesn't bear out.

    References are joined with cells by table and origin, each kept with what it is for; a context without references, as an
    unresolved one may be, has no row.
    """
    ref = lambda c, use: F.transform(c, lambda r: F.struct(F.lit(use).alias("use"), r["row"].cast("int").alias("r"), r["col"].cast("int").alias("c")))
    one = lambda c: F.array_compact(F.array(c))
    refs = F.concat(ref(one(F.col("label")), "label"), ref(one(F.col("value_cell")), "value"), ref(F.col("header"), "header"), ref(F.col("sources"), "source"))
    rows = contexts.select("context_id", "page", "table_id", F.col("row").alias("own_row"), "value_col", F.explode(refs).alias("ref")).select("*", F.col("ref.r").alias("row"), F.col("ref.c").alias("col"), "ref.use")
    at = cells.select("table_id", "row", "col", F.col("page").alias("cell_page"), "col_span").dropDuplicates(["table_id", "row", "col"])
    rows = rows.join(at, ["table_id", "row", "col"], "left")
    there, use = F.col("col_span").isNotNull(), F.col("use")
    governs = (F.col("col") <= F.col("value_col")) & (F.col("value_col") < F.col("col") + F.col("col_span")) & (F.col("row") < F.col("own_row"))
    tests = {
        "cell_absent": ~there,
        "other_page": there & (F.col("page") != F.col("cell_page")),
        "label_on_other_row": (use == "label") & (F.col("row") != F.col("own_row")),
        "value_on_other_row": (use == "value") & (F.col("row") != F.col("own_row")),
        "value_in_other_column": (use == "value") & (F.col("col") != F.col("value_col")),
        "header_not_governing": (use == "header") & there & ~governs,
    }
    return _rows(rows, {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}).distinct()
