"""Table layout from word boxes: lines, cells, anchors, runs of rows, and checks; whole tables are read in ``grids``.

Words are rows (page, x0, y0, x1, y1, text, word_no). A page's words are the unit of work; windows are over one page or
one line of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimspark.functions.text import stripped
from claimspark.operators import chunks
from claimspark.operators.geometry import BREAK_HEIGHT, BREAK_PITCH, MARKERS, NUMERIC, PERIOD, PLACEHOLDERS
from claimspark.operators.streams import each_chunk

ANCHORS = "page long, anchor long, edge double, lines long"
GRID = "page long, line long, word_no int, anchor long, text string"


def token_class(text: Column) -> Column:
    """placeholder, period, numeric or text. Footnote markers are no part of a token, nor is punctuation around a period."""
    t = stripped(F.coalesce(text, F.lit("")))
    unmarked = lambda c: stripped(F.regexp_replace(c, MARKERS, ""))
    bare = unmarked(F.regexp_replace(t, r"^[()\[\]{}.,;:]+|[()\[\]{}.,;:]+$", ""))
    number = F.regexp_replace(unmarked(t), "[−–]", "-")
    of = lambda c: F.lower(c).isin(*PLACEHOLDERS)
    return F.when(of(t), "placeholder").when(bare.rlike("(?i)" + PERIOD), "period").when(~of(unmarked(t)) & number.rlike("(?i)" + NUMERIC), "numeric").otherwise("text")


def valid_words(words: DataFrame) -> DataFrame:
    """Words whose box has four ordered numbers and some height, and whose text isn't blank."""
    return words.where((F.col("x1") >= F.col("x0")) & (F.col("y1") > F.col("y0")) & F.col("text").rlike(r"(?U)\S"))


def word_lines(words: DataFrame, share: float = 0.45) -> DataFrame:
    """page, x0, y0, x1, y1, text, word_no, height (the page's median) and line of the valid words.

    From the top, a word joins the first line whose mean centre is within max(1, share of the median height) of its own, and
    moves that mean; else it begins a line. Lines are numbered by their final means.
    """

    return of_words(words, [partial(chunks.with_lines, share=share)], "page long, x0 double, y0 double, x1 double, y1 double, text string, word_no int, height double, line long")


def of_words(words: DataFrame, steps: list[Callable[[dict], dict]], schema: str, together: bool = False) -> DataFrame:
    """What steps of ``chunks`` make of the valid words, in one pass."""
    boxes = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    own = valid_words(words).select(F.col("page").cast("long").alias("page"), F.col("word_no").cast("int").alias("word_no"), *boxes, "text")
    return each_chunk(own, steps, schema, together)


def line_cells(lines: DataFrame, least: float = 7.0, times: float = 1.25) -> DataFrame:
    """Cells (page, line, cell, x0, x1, text): words of a line joined while gaps stay under max(least, times x median height)."""
    line = W.partitionBy("page", "line")
    order = line.orderBy("x0", "word_no")
    limit = F.greatest(F.lit(least), F.lit(times) * F.col("height"))
    new = F.coalesce(F.col("x0") - F.lag("x1").over(order) >= F.col("__l"), F.lit(True)).cast("int")
    step = lines.withColumn("__l", limit).withColumn("__n", new).withColumn("cell", F.sum("__n").over(order) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")
    return step.groupBy("page", "line", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), text.alias("text"))


_PLACED = ("page", "line", "x0", "x1", "text", "word_no", "height")


def numeric_anchors(lines: DataFrame, least: int = 3) -> DataFrame:
    """page, anchor, edge and lines: right edges of numbers in clusters, cut where the next is further from the running median
    than max(2.5, 0.45 heights), on ``least`` lines or more."""
    return each_chunk(lines.select(*_PLACED), [partial(chunks.anchors_of, least=least)], ANCHORS)


def row_runs(lines: DataFrame) -> DataFrame:
    """Rows (page, line, top, run): a run ends where the pitch to the next line is over 3 times the least neighbouring one, or 4
    heights where there is none, and over 1.5 heights."""
    rows = lines.groupBy("page", "line").agg(F.min("y0").alias("top"), F.max("height").alias("height"))
    order = W.partitionBy("page").orderBy("line")
    step = rows.withColumn("pitch", F.col("top") - F.lag("top").over(order))
    beside = lambda c: F.when(c > 0, c)
    near = F.least(beside(F.lag("pitch").over(order)), beside(F.lead("pitch").over(order)))
    step = step.withColumn("__ref", F.coalesce(near, 4 * F.col("height")))
    apart = (F.col("pitch") > BREAK_PITCH * F.col("__ref")) & (F.col("pitch") > BREAK_HEIGHT * F.col("height"))
    return step.withColumn("__n", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("__n").over(order)).select("page", "line", "top", "run")


def aligned_grid(lines: DataFrame, least: int = 3) -> DataFrame:
    """Cells (page, line, word_no, anchor, text): each number at the nearest anchor, if its right edge is within reach; a
    placeholder within 1.8 times that, unless it stands left of the columns."""
    return each_chunk(lines.select(*_PLACED), [partial(chunks.grid_of, least=least)], GRID)


def continued(grid: DataFrame, least: int = 2) -> DataFrame:
    """Rows (page, line, columns) of the lines that share ``least`` columns or more with the line after them; columns: how many."""
    rows = grid.groupBy("page", "line").agg(F.collect_set("anchor").alias("own"))  # as many as columns
    order = W.partitionBy("page").orderBy("line")
    both = rows.withColumn("next", F.lead("line").over(order)).withColumn("columns", F.size(F.array_intersect("own", F.lead("own").over(order))))
    return both.where((F.col("next") == F.col("line") + 1) & (F.col("columns") >= least)).select("page", "line", "columns")


def measured(pages: DataFrame, measure: Callable[[str], int], most_words: int = 3000, most_chars: int = 20000) -> DataFrame:
    """pages (with words, chars and source) and drawings, which ``measure`` counts by source, only on pages that aren't ruled out by
    their text; null on others, and where it fails."""

    @F.arrow_udf("int")
    def count(sources: pa.Array) -> pa.Array:
        out = []
        for s in sources.to_pylist():
            try:
                out.append(measure(s))
            except Exception:
                out.append(None)
        return pa.array(out, pa.int32())

    small = F.coalesce((F.col("words") <= most_words) & (F.col("chars") <= most_chars), F.lit(False))
    return pages.where(small).withColumn("drawings", count("source")).unionByName(pages.where(~small).withColumn("drawings", F.lit(None).cast("int")))


def overlap_share(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Of the first box's area, the share that lies in the second."""
    wide = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    high = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area > 0, wide * high / area).otherwise(F.lit(0.0))


def without_covered(candidates: DataFrame, tables: DataFrame, most: float = 0.5) -> DataFrame:
    """Candidates (page, x0, y0, x1, y1, ...) of which no table of the page covers more than ``most``."""
    t = tables.select(F.col("page").alias("__p"), *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    covered = overlap_share(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *[F.col(f"__{c}") for c in ("x0", "y0", "x1", "y1")]) > most
    return candidates.join(t, (F.col("page") == F.col("__p")) & covered, "left_anti")


def workload_skip_reason(drawings: Column, words: Column, chars: Column, errors: Column) -> Column:
    """Why the bordered-table detector is skipped; null: it isn't."""
    return (
        F.when(F.size(F.coalesce(errors, F.array().cast("array<string>"))) > 0, "measurement_failed")
        .when(words.isNull() | chars.isNull(), "measurement_unavailable")
        .when(words > 3000, "too_many_words")
        .when(chars > 20000, "too_many_characters")
        .when(drawings.isNull(), "drawings_unavailable")
        .when(drawings == 0, "no_drawings")
        .when(drawings > 30, "too_many_drawings")
    )


def layout_ids(candidates: DataFrame) -> DataFrame:
    """candidates with table_id by reading order on the page: y0, x0 (nulls last), method, then text."""
    last = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    n = F.row_number().over(W.partitionBy("page").orderBy(last("y0"), last("x0"), "method", "text"))
    return candidates.withColumn("table_id", F.format_string("p%d-t%02d", F.col("page"), n - 1))
