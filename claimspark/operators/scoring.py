"""Page scores, the candidate gate, and totals by document.

What a page holds is counted in one pass over Arrow batches, because expressions would be repeated in each filter above them.
Whitespace, digits and word characters are Unicode's: other characters are first replaced by ASCII ones of their kind.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.constants import CANDIDATE_SCORE, KEYWORDS
from claimspark.functions.text import rounded

# Over ASCII text, in lower case but for the first. A word's first character comes first, and then that none stands before
# it, so that the search skips to such characters.
NUMBER = re.compile(r"\d(?<!\w\d)\d*(?:\.\d+)?\b", re.A)
PERCENTAGE = re.compile(r"[%p](?:(?<=%)\b|(?<=p)(?<!\wp)er ?cent\b)", re.A)
CURRENCY = re.compile(r"[$iurcmbl](?:(?<=\$)|(?<=i)nr\b|(?<=u)sd\b|(?<=r)s|(?<=c)rore\b|(?<=m)illion\b|(?<=b)illion\b|(?<=l)akh\b)", re.A)
DATE = re.compile(r"[f2qmad](?<!\w[f2qmad])(?:(?<=f)y\d{2,4}\b|(?<=2)0\d{2}-\d{2,4}\b|(?<=q)[1-4]\b|(?<=m)arch \d{1,2}\b|(?<=a)pril\b|(?<=d)ecember\b)", re.A)
_WORD, _ASCII_WORD = re.compile(r"\w+"), re.compile(r"\w+", re.A)
#: Characters that Python takes for whitespace and Unicode doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# What ignoring case makes of these, and one currency for another.
_FOLDED = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i", "₹": "$"}
_LETTER = "\x01"


class _Kinds(dict):
    """ASCII stand-ins, by code point: _ for a part of a word, 9 for a digit, a line feed for a line's end, else a zero."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        circled = 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F149 or 0x1F150 <= code <= 0x1F169 or 0x1F170 <= code <= 0x1F189
        word = kind[0] in "LM" or kind in ("Nl", "Pc") or circled or c in "\u200c\u200d"
        self[code] = c if code < 128 else "9" if kind == "Nd" else "_" if word else "\n" if c in "\x85\u2028\u2029" else "\0"
        return self[code]


class _Cases(dict):
    """A for a capital, a for a small letter, a stand-in for any other one, else a space."""

    def __missing__(self, code: int) -> str:
        self[code] = {"Lu": "A", "Ll": "a"}.get(kind := unicodedata.category(chr(code)), _LETTER if kind[0] == "L" else " ")
        return self[code]


_PLAIN, _CASES = _Kinds(), _Cases()
_KINDS = _Kinds({ord(k): v for k, v in _FOLDED.items()})


def is_heading(line: str) -> bool:
    """Two to eight words, all in upper case or all in title case."""
    if not 2 <= len(line.split(None, 9)) <= 8:
        return False
    if line.isascii():
        return line.isupper() or line.istitle()
    line = line.translate(_CASES)
    return "A" in line and ("a" not in line or not re.search(rf"[Aa{_LETTER}]A|(?:^|[^Aa{_LETTER}])a", line))


def keywords_in(text: str, keywords: tuple[str, ...], low: str | None = None, words: list[str] | None = None) -> list[str]:
    """Those of the keywords that stand in a text as whole words; low and words: an ASCII text's."""
    own = text.lower() if low is None else low
    plain = own if own.isascii() else own.translate(_PLAIN)
    there = set(_ASCII_WORD.findall(plain) if words is None else words)

    def said(k: str) -> bool:
        if _ASCII_WORD.fullmatch(k):
            return k in there
        return bool(re.search(rf"\b{re.escape(k)}\b", plain, re.A) if k.isascii() else re.search(rf"\b{re.escape(k)}\b", own))

    return [k for k in keywords if said(k)]


def counted(text: str, keywords: tuple[str, ...]) -> tuple:
    """blank, tokens, numbers, percentages, currencies, dates, tabular lines, headings and keywords of a text."""
    text = _SEPARATORS.sub("\0", text)
    plain = text if text.isascii() else text.translate(_KINDS)
    low = plain.lower()
    words = _WORD.findall(low if plain is text else text)
    numbers = [len(NUMBER.findall(x)) for x in plain.splitlines()]
    count = lambda pattern: len(pattern.findall(low))
    found = keywords_in(text, keywords, low, words) if plain is text else keywords_in(text, keywords)
    return not text.strip(), len(words), sum(numbers), count(PERCENTAGE), count(CURRENCY), count(DATE), sum(n >= 3 for n in numbers), sum(map(is_heading, text.splitlines())), found


COUNTS = "blank boolean, tokens int, numbers int, percentage_count int, currency_count int, date_fiscal_count int, tabular_lines int, headings int, keyword_matches array<string>"


def score_pages(pages: DataFrame, keywords: tuple[str, ...] = KEYWORDS, threshold: float = CANDIDATE_SCORE) -> DataFrame:
    """pages with the parts of their score, total_score and is_candidate. Blank pages score zero.

    Scores are sums of halves and tenths, rounded half up to two places before they meet the threshold.
    """
    names = [c.split()[0] for c in COUNTS.split(", ")]
    kinds = [pa.bool_(), *[pa.int32()] * 7, pa.list_(pa.string())]

    @F.arrow_udf(COUNTS)
    def count(texts: pa.Array) -> pa.Array:
        rows = [counted(t, keywords) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    # not deterministic, so that no filter is pushed below and makes Spark count twice
    base = pages.withColumn("__c", count.asNondeterministic()(F.coalesce(F.col("raw_text"), F.lit(""))))
    base = base.select(*pages.columns, F.col("__c.blank").alias("__blank"), F.greatest("__c.tokens", F.lit(1)).alias("__tokens"), F.col("__c.numbers").alias("__numbers"), F.col("__c.headings").alias("__headings"), *[f"__c.{c}" for c in names[3:7]], "__c.keyword_matches")
    capped = lambda c, each, most: F.least(F.col(c) * F.lit(each), F.lit(most))
    has_tables = F.coalesce(F.col("has_tables"), F.lit(False)) | (F.col("tabular_lines") >= 2)
    step = base.withColumn("numeric_density", rounded(F.col("__numbers") / F.col("__tokens"), 4))
    step = step.withColumn("table_score", F.when(has_tables, 2.0).otherwise(0.0) + capped("tabular_lines", 0.2, 1.5)).withColumn("heading_score", capped("__headings", 0.3, 1.5)).withColumn("keyword_score", F.least(F.size("keyword_matches") * F.lit(0.8), F.lit(4.0)))
    total = F.least(F.col("numeric_density") * 10.0, F.lit(3.0)) + capped("percentage_count", 0.5, 2.0) + capped("currency_count", 0.4, 2.0) + capped("date_fiscal_count", 0.5, 2.0) + F.col("table_score") + F.col("heading_score") + F.col("keyword_score")
    zero = lambda c, kind: F.when(F.col("__blank"), F.lit(0).cast(kind)).otherwise(c)
    return step.select(
        *pages.columns,
        zero(F.col("numeric_density"), "double").alias("numeric_density"),
        *[zero(F.col(c), "int").alias(c) for c in ("percentage_count", "currency_count", "date_fiscal_count", "tabular_lines")],
        *[zero(rounded(F.col(c), 2), "double").alias(c) for c in ("table_score", "heading_score", "keyword_score")],
        F.when(F.col("__blank"), F.array().cast("array<string>")).otherwise(F.col("keyword_matches")).alias("keyword_matches"),
        zero(rounded(total, 2), "double").alias("total_score"),
        (~F.col("__blank") & (rounded(total, 2) >= threshold)).alias("is_candidate"),
    )


def document_rollup(scored: DataFrame) -> DataFrame:
    """document_id, total_pages, candidate_pages and candidate_rate."""
    n, c = F.count(F.lit(1)), F.sum(F.col("is_candidate").cast("int"))
    return scored.groupBy("document_id").agg(n.alias("total_pages"), c.cast("long").alias("candidate_pages"), rounded(c / n, 4).alias("candidate_rate"))


def keyword_hits(scored: DataFrame) -> DataFrame:
    return scored.select("document_id", "page_number", F.posexplode("keyword_matches").alias("position", "keyword"))
