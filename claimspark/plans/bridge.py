"""Facts, pages and words that are derived from the driver tables, by arithmetic that SQL engines agree on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.text import collapsed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: style, value, unit, period, scope, qualifiers
STYLES = (
    ("A", "v", "INR million", "concat('FY', substr(fy, 3, 2))", "consolidated", ()),
    ("P", "floor(v / 10 + 0.5)", "₹ crore", "concat('FY ', fy)", "consolidated", ()),
    ("S", "w", "INR million", "concat(fy0, '-', substr(fy, 3, 2))", "standalone", ()),
    ("E", "v * 0.98", "INR million", "concat('FY', substr(fy, 3, 2))", "consolidated", ("First Advance Estimate", "estimated")),
    ("F", "v * 1.03", "INR million", "concat('FY', fy0, '/', substr(fy, 3, 2))", "consolidated", ("forecast",)),
    ("R", "v * 1.1", "INR million", "concat('FY', substr(fy, 3, 2))", "consolidated", ()),
    ("C", "v", "INR million", "concat('FY', substr(fy, 3, 2))", "consolidated", ()),
    ("U", "v", "INR million", "cast(null as string)", "consolidated", ()),
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each nation and year as eight documents report it, board changes of customers, and every seventh fact twice."""
    t = lambda name: table(spark, sf_dir, name)
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = t("lineitem").select("l_orderkey", money.alias("money"))
    orders = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = t("nation").select("n_nationkey", "n_name")
    sums = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "year")
        .agg((F.sum("money").cast("decimal(18,2)").cast("double") / 1000.0).alias("v"), (F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("money"))).cast("decimal(18,2)").cast("double") / 1000.0).alias("w"))
        .select("n_name", "v", "w", (F.col("year") + 20).cast("string").alias("fy"), (F.col("year") + 19).cast("string").alias("fy0"))
    )
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("style"), F.expr(value).cast("double").alias("value_num"), F.lit(unit).alias("unit"), F.expr(period).alias("period"), F.lit(scope).alias("scope"), F.array(*map(F.lit, quals)).cast("array<string>").alias("qualifiers")) for n, (s, value, unit, period, scope, quals) in enumerate(STYLES)])
    null = F.lit(None).cast("string")
    numeric = sums.select("*", F.explode(rows).alias("r")).select(
        F.concat_ws("-", "n_name", "fy", "r.style").alias("key"), F.concat(F.lit("doc_"), F.col("r.style")).alias("document_id"), F.concat(F.lit("doc_"), F.col("r.style"), F.lit(".pdf")).alias("document_name"),
        (F.col("fy").cast("int") % 50 + 1).alias("page_number"), F.concat("n_name", F.lit(" Limited revenue")).alias("subject"), F.lit("revenue").alias("predicate"), null.alias("value_raw"), "r.value_num", "r.unit", "r.period", null.alias("as_of"), "r.scope", "r.qualifiers",
    ).where("value_num IS NOT NULL")
    dates = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    status = F.array(F.struct(F.lit("resigned from the Board").alias("value"), F.col("first").alias("on")), F.struct(F.lit("ceased to be a Director").alias("value"), F.col("last").alias("on")))
    board = dates.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("c_name", "c_custkey", F.explode(status).alias("s")).select(
        F.concat_ws("-", "c_name", "s.value").alias("key"), F.lit("doc_D").alias("document_id"), F.lit("doc_D.pdf").alias("document_name"), (F.col("c_custkey") % 50 + 1).cast("int").alias("page_number"), F.concat(F.lit("Mr. "), F.col("c_name")).alias("subject"), F.lit("board status").alias("predicate"),
        F.col("s.value").alias("value_raw"), F.lit(None).cast("double").alias("value_num"), null.alias("unit"), null.alias("period"), F.date_format("s.on", "MMMM dd, yyyy").alias("as_of"), null.alias("scope"), F.array().cast("array<string>").alias("qualifiers"),
    )
    once = numeric.unionByName(board)
    number = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    copies = F.when(number % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = once.select("*", number.alias("number"), F.explode(copies).alias("copy"))
    return twice.select(
        F.substring(F.sha2(F.concat_ws("|", "key", "copy"), 256), 1, 12).alias("id"), (F.col("number") * 2 + F.col("copy")).alias("seq"), "document_id", "document_name", (F.col("page_number") + F.col("copy")).alias("page_number"), "subject", "predicate", "value_raw", "value_num", "unit", "period", "as_of", "scope", "qualifiers",
        F.lit(0.9).alias("confidence"), F.concat_ws(" ", F.lit("evidence"), "key").alias("evidence_text"),
    )


#: What stands below the text of every fourth document, with numbers that follow from its id; below that of the next ones.
REPORT = (
    "\nREVENUE GROWTH\n1 2 3\n4 5 6\nThe board said that real GDP growth moderated to {0}.5 per cent in 2024-25, by second advance figures.\nThat year headline inflation had declined to {1}.2 percent in September 2025.\n"
    "Then revenue from services stood at ₹{2} cr for FY24\nnet loss for FY24 was ₹{3} cr; Ms. Ann Lee ceased to be a Director with effect from May 01, 2024."
)
NOTICE = "\nNotice Of Meeting\nA director was appointed to the board."


def report(doc_id: Column) -> Column:
    parts = re.split(r"\{\d\}", REPORT)
    numbers = (doc_id % 10, doc_id % 7, doc_id + 1, doc_id + 2)
    return F.concat(F.lit(parts[0]), *[x for n, p in zip(numbers, parts[1:], strict=True) for x in (n.cast("string"), F.lit(p))])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-page documents, some of them with a report or a notice below."""
    more = F.when(F.col("doc_id") % 4 == 0, report(F.col("doc_id"))).when(F.col("doc_id") % 4 == 1, NOTICE).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".pdf")).alias("filename"), F.lit(1).alias("page_number"), F.concat(F.coalesce("text", F.lit("")), more).alias("raw_text"), F.lit(False).alias("has_tables"))


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each document whose evidence is 40 characters of it, for every third reversed, and one on a missing page for every fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", collapsed(F.col("text")).alias("t"))
    own = F.substring("t", 5, 40)
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("page_number"),
        F.when(F.col("doc_id") % 3 == 0, F.reverse(own)).otherwise(own).alias("evidence_text"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with row, their place in the order."""
    row = F.expr("int(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", row.alias("row"))


def two_places(c: Column) -> Column:
    """%.2f, by way of a decimal, which is faster, where one holds the number."""
    return F.coalesce(c.try_cast("decimal(18,2)").cast("string"), F.format_string("%.2f", c))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page for each order: a row for each line item, a label at the left and three numbers aligned at the right.

    Words sit a little high or low and numbers a little left or right; after each fourth row is a wider gap, and each third
    row slants, so that its last words are nearer to the next line's than to its own first ones.
    """
    number = lambda c, edge: F.struct((F.lit(float(edge)) + (F.col("l_partkey") % 5 - 2) * 0.5).alias("x1"), two_places(F.col(c)).alias("text"))
    label = F.struct(F.lit(None).cast("double").alias("x1"), F.concat(F.lit("Item"), F.col("l_partkey")).alias("text"))
    cells = F.array(label, number("l_quantity", 250), number("l_extendedprice", 350), number("l_discount", 450))
    word_no = (F.col("row") * 4 + F.col("k")).cast("int")
    slant = F.when(F.col("row") % 3 == 2, F.col("k") * 2.5).otherwise(0.0)
    y0 = 40.0 + 12 * F.col("row") + 30 * F.floor(F.col("row") / 4) + (word_no * 7 % 5) * 0.75 - 1.5 + slant
    width = F.length("w.text") * 5.0
    return placed(spark, sf_dir).select("l_orderkey", "row", F.posexplode(cells).alias("k", "w")).select(
        F.col("l_orderkey").alias("page"), F.coalesce(F.col("w.x1") - width, F.lit(30.0)).alias("x0"), y0.alias("y0"), F.coalesce("w.x1", F.lit(30.0) + width).alias("x1"), (y0 + 9).alias("y1"), F.col("w.text").alias("text"), word_no.alias("word_no")
    )


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: a header cell over three columns, then a label and three values for each line item; some cells
    span too much or nothing, some boxes are upside down or endless."""
    rows = placed(spark, sf_dir)
    head = rows.where("row = 0").selectExpr("l_orderkey AS page", "0 AS row", "1 AS col", "1 AS row_span", "3 AS col_span", "200D AS x0", "20D AS y0", "450D AS x1", "29D AS y1", "'Amounts' AS text")
    own = rows.selectExpr("*", "posexplode(array('label', 'quantity', 'price', 'discount')) AS (col, text)").selectExpr(
        "l_orderkey AS page", "row + 1 AS row", "col", "CASE WHEN l_partkey % 97 = 0 THEN 0 WHEN l_suppkey % 31 = 0 AND col = 2 THEN 2 ELSE 1 END AS row_span", "CASE WHEN l_suppkey % 37 = 0 AND col = 1 THEN 2 ELSE 1 END AS col_span",
        "50D + 100 * col AS x0", "40D + 12 * row AS y0", "CASE WHEN l_partkey % 83 = 0 AND col = 3 THEN double('Infinity') ELSE 90D + 100 * col END AS x1", "CASE WHEN l_partkey % 89 = 0 THEN 30D ELSE 49D + 12 * row END AS y1", "text",
    )
    return head.unionByName(own).selectExpr("concat('t', page) AS table_id", "*")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context for the price of each line item; of some, something is missing, unsaid or points elsewhere."""
    status = lambda d, n: f"named_struct('dimension', '{d}', 'status', CASE WHEN l_partkey % {n} = 0 THEN 'unresolved' ELSE 'resolved' END, 'reason', CASE WHEN l_suppkey % 2 = 0 THEN 'not stated' END)"
    every = ", ".join(status(d, n) for d, n in zip(("row_value_association", "header_association", "entity", "period", "unit"), (41, 43, 47, 53, 59), strict=True))
    return placed(spark, sf_dir).selectExpr(
        "l_orderkey * 1000 + row AS context_id", "l_orderkey + int(l_partkey % 61 = 0) AS page", "concat('t', l_orderkey) AS table_id", "row + 1 AS row", "2 AS value_col",
        "CASE WHEN l_partkey % 11 <> 0 THEN named_struct('row', row + 1 + int(l_partkey % 67 = 0), 'col', 0) END AS label", "CASE WHEN l_partkey % 71 <> 0 THEN named_struct('row', row + 1, 'col', 2 + int(l_partkey % 13 = 0)) END AS value_cell",
        "CASE WHEN l_partkey % 7 = 0 THEN filter(array(named_struct('row', 0, 'col', 1)), x -> false) ELSE array(named_struct('row', CASE WHEN l_partkey % 19 = 0 THEN row + 1 ELSE 0 END, 'col', 1)) END AS header",
        "CASE WHEN l_partkey % 23 = 0 THEN array(named_struct('row', 99, 'col', 0)) ELSE filter(array(named_struct('row', 0, 'col', 0)), x -> false) END AS sources", "CASE WHEN l_partkey % 73 <> 0 THEN string(l_suppkey) END AS raw_value",
        "CASE WHEN l_partkey % 29 <> 0 THEN named_struct('raw', CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'x' END, 'number', CASE WHEN l_suppkey % 19 = 0 THEN double('NaN') WHEN l_suppkey % 23 <> 0 THEN l_extendedprice END, 'unit_kind', CASE WHEN l_suppkey % 5 = 0 THEN 'percent' WHEN l_suppkey % 7 <> 0 THEN 'currency' END, 'currency', CASE WHEN l_suppkey % 11 = 0 THEN 'inr' WHEN l_suppkey % 13 <> 0 THEN 'INR' END) END AS value",
        f"concat(array({every}), CASE WHEN l_partkey % 31 = 0 THEN array({status('unit', 2)}) ELSE array({status('scale', 37)}) END) AS resolutions",
    )
