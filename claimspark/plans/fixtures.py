"""Literal inputs of queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_TEXTS = (
    ("northmoor-annual-report-fy24.pdf", "Summary\nRevenue from operations on standalone basis for FY24 stood at ₹51,200.40 million as against ₹44,310.75 million for FY23. The loss for FY24 stood at ₹910.25 million as against ₹1,450.60 million for FY23.\n"
     "Revenue from operations on consolidated basis for FY24 stood at ₹63,900.10 million as against ₹55,120.35 million for FY23. The loss for FY24 stood at ₹1,230.80 million as against ₹2,040.15 million for FY23."),
    ("country-note.pdf", "Real GDP growth moderated to 5.9 per cent in 2023-24, by second advance figures.\nIn FY2023/24, private consumption growth was steady at 4.1 percent. Headline inflation had come down to 2.3 percent in March 2024, after a long rise."),
    ("outlook.pdf", "Trade was brisk: real GDP grew by 5.8 percent in FY2023/24, a first advance figure. Unemployment is projected to fall to 6.2 per cent in June 2025. Core inflation had eased again to 3.1 percent."),
    ("northmoor-presentation.pdf", "Revenue from services stood at approximately ₹6,390 cr for FY24\nnet loss for FY24 was ₹123 cr\nThe loss for the year was INR 1,230.80 million"),
    ("harbour-prospectus.pdf", "Ines Maria Falk — Non-Executive Nominee Director; Mr. Tomas Ruiz, Non-Executive Director, resigned from the Board with effect from June 12, 2023; Ms. Dora Lind ceased to be a Director with effect from October 03, 2023."),
    ("harbour-board.pdf", "Ms. Vera Holm was appointed as Non-Executive Independent Director for a period of 5 years with effect from April 02, 2024. The agency was appointed as monitor."),
    ("blank.pdf", " \n "),
)


def pages(spark: SparkSession) -> DataFrame:
    rows = [(f"d{n}", name, 1, text, False) for n, (name, text) in enumerate(PAGE_TEXTS)]
    return spark.createDataFrame(rows, "document_id string, filename string, page_number int, raw_text string, has_tables boolean")


def _word(page: int, n: int, text: str, x0: float, y0: float, wide: float = 6.0, high: float = 9.0) -> tuple:
    return (page, x0, y0, x0 + wide * len(text), y0 + high, text, n)


WORDS = "page long, x0 double, y0 double, x1 double, y1 double, text string, word_no int"


def card_words(spark: SparkSession) -> DataFrame:
    """Two cards of one label with headings at their left, a card of another label, and prose."""
    cards = (("NORTH", "NET SALES", "1,200", 40.0), ("SOUTH", "NET SALES", "950.5", 140.0), ("WEST", "ORDER BOOK", "88", 240.0))
    rows = []
    for heading, label, value, y in cards:
        one, two = label.split()
        rows += [_word(1, len(rows), heading, 30.0, y), _word(1, len(rows) + 1, one, 150.0, y), _word(1, len(rows) + 2, two, 174.0, y), _word(1, len(rows) + 3, value, 150.0, y + 16)]
    return spark.createDataFrame([*rows, _word(1, 99, "prose", 30.0, 400.0)], WORDS)
