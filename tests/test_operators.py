import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from claimspark.functions.compare import number_comparison
from claimspark.functions.normalize import with_entity, with_period, with_predicate, with_value
from claimspark.operators import chunks, geometry, layout
from claimspark.operators.extraction import claims_of, entity_name, qualifiers_in
from claimspark.operators.facts import FACTS, dedupe, ground, normalize
from claimspark.operators.matching import candidate_pairs, compared
from claimspark.operators.reasoning import related
from claimspark.operators.scoring import score_pages
from claimspark.operators.store import ClaimStore
from claimspark.plans import catalogue
from claimspark.plans.fixtures import PAGE_TEXTS
from claimspark.sources import shared
from claimspark.sources.pages import PAGES
from claimspark.streaming.ingest import start


def fact(id, doc, subject, predicate, value, unit=None, period=None, as_of=None, scope=None, qualifiers=(), page=1):
    text = isinstance(value, str)
    return (id, int(id, 36), doc, doc, page, subject, predicate, value if text else None, None if text else float(value), unit, period, as_of, scope, list(qualifiers), 0.9, f"evidence of {id}")


GDP_A = fact("g1", "d1", "India real GDP growth", "growth rate", 6.5, "per cent", "2024-25", qualifiers=["Second Advance Estimates"])
GDP_B = fact("g2", "d2", "India real GDP", "growth rate", 6.5, "percent", "FY2024/25")
GDP_C = fact("g3", "d3", "India real GDP growth", "growth rate", 6.4, "percent", "FY25", qualifiers=["First Advance Estimate"])
REV_S = fact("r1", "d1", "Delhivery Limited revenue from operations", "revenue", 74540.82, "INR million", "FY24", scope="standalone")
REV_C = fact("r2", "d1", "Delhivery Limited revenue from operations", "revenue", 81415.38, "INR million", "FY 2023-24", scope="consolidated")
REV_P = fact("r3", "d2", "Delhivery revenue from services", "revenue", 8142.0, "₹ crore", "FY24", scope="consolidated", qualifiers=["excluding traded goods"])
DIR_0 = fact("p1", "d1", "Suvir Suren Sujan", "role", "Non-Executive Nominee Director", as_of="2022")
DIR_1 = fact("p2", "d2", "Suvir Suren Sujan", "board status", "resigned from the Board", as_of="August 24, 2023")
DIR_2 = fact("p3", "d3", "Suvir Suren Sujan", "board status", "ceased to be a Director", as_of="August 24, 2023")
FC_A = fact("f1", "d1", "India real GDP growth", "projected growth rate", 6.5, "percent", "2025-26", qualifiers=["forecast"])
FC_B = fact("f2", "d2", "India real GDP growth", "projected growth rate", 6.6, "percent", "FY2025/26", qualifiers=["forecast", "baseline scenario"])
ACT_1 = fact("a1", "d1", "India real GDP growth", "growth rate", 6.5, "per cent", "2024-25", scope="actual", qualifiers=["audited"])
ACT_2 = fact("a2", "d2", "India real GDP growth", "growth rate", 7.8, "per cent", "2024-25", scope="actual", qualifiers=["audited"])
NONE = fact("n1", "d4", "India real GDP growth", "growth rate", 6.5, "percent")

EXPECTED = [
    (GDP_A, GDP_B, "CORROBORATES"), (GDP_A, GDP_C, "RECONCILABLE"), (REV_S, REV_C, "RECONCILABLE"), (REV_C, REV_P, "CORROBORATES"), (DIR_0, DIR_1, "RECONCILABLE"),
    (DIR_1, DIR_2, "RECONCILABLE"), (FC_A, FC_B, "RECONCILABLE"), (ACT_1, ACT_2, "CONTRADICTS"), (GDP_B, NONE, "UNCERTAIN"),
]


def test_labels_of_known_pairs(spark):
    rows = {f[0]: f for pair in EXPECTED for f in pair[:2]}
    pairs = related(compared(candidate_pairs(normalize(spark.createDataFrame(list(rows.values()), FACTS)))))
    got = {(r["a_id"], r["b_id"]): r for r in pairs.select("a_id", "b_id", "relationship", "rule", "confidence", "reason").collect()}
    for a, b, label in EXPECTED:
        r = got[min(a[0], b[0]), max(a[0], b[0])]
        assert r["relationship"] == label, (a[0], b[0], r)
        assert r["reason"] and 0 < r["confidence"] < 1
    assert got["p2", "p3"]["rule"] == "progression" and got["r2", "r3"]["rule"] == "rounding"


def test_different_predicates_are_unrelated(spark):
    """A pair that blocking never makes."""
    facts = normalize(spark.createDataFrame([GDP_A, REV_P], FACTS))
    side = lambda id, p: facts.where(F.col("id") == id).select(*[F.col(c).alias(f"{p}_{c}") for c in facts.columns])
    row = related(compared(side("g1", "a").crossJoin(side("r3", "b")).withColumn("b_period", F.lit("2024-25")))).first()
    assert (row["rule"], row["relationship"], row["confidence"]) == ("predicate", "UNRELATED", 0.9)


@pytest.mark.parametrize(
    "subject, predicate, entity, canonical",
    [
        ("Delhivery Limited revenue from operations", "revenue", "Delhivery", "revenue"), ("India real GDP growth", "growth rate", "India", "gdp_growth"), ("India core inflation", "inflation rate", "India", "inflation"),
        ("India unemployment", "unemployment rate", "India", "unemployment_unemployment_rate"), ("delhivery loss", "loss", "delhivery loss", "loss"), ("delhivery net loss", "loss for the year", "delhivery", "net_profit_loss"), ("Mr. Sandeep Kumar Barasia", "board status", "Sandeep Kumar Barasia", "board_role"),
    ],
)
def test_entities_and_predicates(spark, subject, predicate, entity, canonical):
    df = spark.createDataFrame([(subject, predicate, None)], "subject string, predicate string, document_name string")
    r = with_predicate(with_entity(df), "predicate", F.col("entity.remainder"), "p").first()
    assert (r["entity"]["entity"], r["p"]) == (entity, canonical)


def test_periods_and_units(spark):
    cases = {("FY24", None): ("FY2023-24", "fiscal_year"), ("Q4 FY24", None): ("FY2023-24-Q4", "quarter"), ("4Q FY24", None): ("FY2023-24-Q4", "quarter"), ("September 2025", None): ("2025-09-01", "date"), (None, "July 01, 2024"): ("2024-07-01", "as_of"), (None, None): (None, "unknown"), ("soon", None): ("soon", "unknown")}
    rows = with_period(spark.createDataFrame(list(cases), "period string, as_of string")).collect()
    assert {(r["period"], r["as_of"]): tuple(r["normalized"]) for r in rows} == cases
    units = {(8142.0, None, "₹ crore"): (81420.0, "INR million"), (5.0, None, "lakh"): (0.5, "INR million"), (1500000.0, None, "₹"): (1.5, "INR million"), (None, "1,234", None): (1234.0, None), (None, "resigned", "x"): (None, None)}
    rows = with_value(spark.createDataFrame(list(units), "value_num double, value_raw string, unit string")).collect()
    assert {(r["value_num"], r["value_raw"], r["unit"]): tuple(r["normal"]) for r in rows} == units


def test_numbers(spark):
    rows = [(1.0, "a", 1.0, "a"), (2491.86, "a", 2490.0, "a"), (1.0, "a", 2.0, "a"), (1.0, "a", 1.0, "b"), (None, "a", 1.0, "a"), (0.0, None, 0.0, None)]
    df = spark.createDataFrame(rows, "v1 double, u1 string, v2 double, u2 string").withColumn("n", number_comparison(*map(F.col, ("v1", "u1", "v2", "u2"))))
    assert [r["n"]["status"] for r in df.collect()] == ["exact", "close_rounding", "different", "incompatible_units", "categorical", "exact"]


def test_dedupe_and_grounding(spark):
    rows = [REV_S, ("r9", 9_999_999, *REV_S[2:4], 7, *REV_S[5:]), REV_C]
    got = {r["id"]: r["qualifiers"] for r in dedupe(normalize(spark.createDataFrame(rows, FACTS))).collect()}
    assert got == {"r1": ["duplicate-evidence: p.7"], "r2": []}
    pages = spark.createDataFrame([("d1", "f", 1, "Some\n evidence   of r1 here", False)], PAGES)
    assert {r["id"]: r["verified"] for r in ground(spark.createDataFrame(rows, FACTS), pages).collect()} == {"r1": True, "r9": False, "r2": False}


def claims(n):
    return {(c["subject"], c["value"], c.get("period"), c.get("scope")) for c in claims_of(PAGE_TEXTS[n][1], PAGE_TEXTS[n][0])}


def test_comparative_highlights():
    revenue = {(v, p, s) for subject, v, p, s in claims(0) if subject.endswith("revenue")}
    loss = {(v, p, s) for subject, v, p, s in claims(0) if subject.endswith("loss")}
    assert revenue >= {(44310.75, "FY23", "standalone"), (55120.35, "FY23", "consolidated")}
    assert loss == {(910.25, "FY24", "standalone"), (1450.60, "FY23", "standalone"), (1230.80, "FY24", "consolidated"), (2040.15, "FY23", "consolidated")}


def test_other_claims():
    assert ("India headline inflation", 2.3, "March 2024", None) in claims(1) and ("India private consumption growth", 4.1, "FY2023/24", None) in claims(1)
    assert {(c["value"], tuple(c["qualifiers"])) for c in claims_of(PAGE_TEXTS[2][1], "") if "qualifiers" in c and "inflation" in c["subject"]} == {(3.1, ("core",))}
    found = claims_of(PAGE_TEXTS[4][1], PAGE_TEXTS[4][0])
    assert {(c["subject"].split()[0], c["predicate"], c["as_of"]) for c in found} == {("Ines", "role", "2022"), ("Tomas", "board status", "June 12, 2023"), ("Dora", "board status", "October 03, 2023")}
    assert [c["qualifiers"] for c in claims_of(PAGE_TEXTS[5][1], PAGE_TEXTS[5][0])] == [["5 year term"]]
    assert claims_of(" \n", "x") == claims_of(None, None) == []


def test_entities_and_qualifiers_as_expressions(spark):
    names = {"01-delhivery-annual-report-fy24.pdf": "delhivery", "": "Unknown Entity", None: "Unknown Entity", "acme_of_big_north_2023-24.pdf": "acme big north"}
    got = spark.createDataFrame([(n,) for n in names], "n string").withColumn("e", entity_name(F.col("n"))).collect()
    assert {r["n"]: r["e"] for r in got} == names
    near = {"the first advance and second advance, revised": ["First Advance Estimate", "revised"], "second advance, provisional": ["Second Advance Estimates", "provisional"], "": [], None: []}
    got = spark.createDataFrame([(n,) for n in near], "n string").withColumn("q", qualifiers_in(F.col("n"))).collect()
    assert {r["n"]: r["q"] for r in got} == near


def test_scores(spark):
    text = "REVENUE GROWTH\nRevenue 1 2 3\nLoss 4 5 6\nThe board appointed a director. Profit of ₹5 crore in FY24, 10 per cent margin."
    rows = [("a", "f", 1, text, False), ("b", "f", 1, " \n ", True)]
    got = {r["document_id"]: r for r in score_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got["a"]["is_candidate"] and got["a"]["tabular_lines"] == 2 and got["a"]["keyword_score"] == 4.0
    assert not got["b"]["is_candidate"] and got["b"]["total_score"] == 0


def test_layout(spark):
    assert geometry.assign_in_order([200.0, 300.0], [205.0, 300.0], 30) == ([0, 1], True)
    assert geometry.assign_in_order([250.0], [240.0, 260.0], 30)[1] is False
    assert geometry.assign_in_order([100.0], [200.0], 30) == ([None], True)
    kinds = {"Q4 2024": "period", "Q5 2024": "text", "1200": "numeric", "—": "placeholder", "2024*": "period", "(1,234)": "numeric"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string").withColumn("k", layout.token_class(F.col("t")))
    assert {r["t"]: r["k"] for r in df.collect()} == kinds


def test_store_and_stream(spark, tmp_path):
    rows = [("d1", "northmoor-annual-report.pdf", 1, PAGE_TEXTS[0][1] + "\nProfit growth of 12 per cent, board director appointed, FY24 margin crore million.", False), ("d2", "blank.pdf", 1, "", False)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/in")
    store = ClaimStore(spark, f"{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(PAGES).parquet(f"{tmp_path}/in")
        start(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
        first = store.health()
    assert first["documents"] == 2 and first["facts"] >= 6 and first["comparisons"] > 0
    store.save("facts", store.read("facts"))
    assert store.health() == first


def test_rules_are_linear_and_find_what_their_patterns_find():
    """Long texts without punctuation, and short ones where places to begin compete."""
    from claimspark.operators.extraction import RULES

    short = (
        "a real GDP grew by 5.5 per cent xreal GDP grew by 6 percent in FY24", " 9 real GDP growth stood at 7% ", "x revenue from y revenue was ₹ 1 crore revenue from a b stood at INR 3 mn. revenue from was INR 2 mn",
        "Mr. Al Bo, Non-Executive Director ceased to be a Director with effect from May 01, 2024 An, Director, resigned from the Board with effect from May 02, 2024", "McDonald Van de Holm Ann Lee — Executive Director",
    )
    for text in short:
        for r in RULES:
            assert [m.span() for m in r.find(r.pattern, text)] == [m.span() for m in r.pattern.finditer(text)], (r.name, text)
    began = time.process_time()
    for word in ("alpha ", "Alpha ", "real ", "revenue from "):
        assert not claims_of(word * 40_000, "x.pdf")
    assert time.process_time() - began < 20


def test_scores_are_counted_once(spark):
    """A filter on scores repeats no counting; letters, digits and marks beyond ASCII count as such."""
    texts = ("1 2 3\n٤ 5 6", "İNR Rſ laKh mıllioń", "Über Uns\nÄPFEL UND\näpfel und", "gdṕ pat_ pat", "a\x1cb\x85c")
    rows = score_pages(spark.createDataFrame([(str(n), t, False) for n, t in enumerate(texts)], "document_id string, raw_text string, has_tables boolean"))
    got = {r["document_id"]: r for r in rows.collect()}
    assert got["0"]["tabular_lines"] == 2 and got["1"]["currency_count"] == 3 and got["2"]["heading_score"] == 0.6 and got["3"]["keyword_matches"] == ["pat"]
    plan = rows.where("is_candidate").select(F.explode("keyword_matches"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_lines_in_columns_are_those_of_a_page_at_a_time(spark):
    """Odd pages: one word, wide gaps, equal boxes, a page longer than a batch; words in any order, some invalid, and a null page."""
    random.seed(3)
    rows = [(p, float(x := random.randint(0, 90)), y := random.randint(0, 60) / 4, x + random.randint(1, 30) * 1.0, y + random.choice((2.0, 9.0)), random.choice(("1.5", "7", "Item", "na", "INR 5", "FY24", "£ 3")), n) for p in range(40) for n in range(1 + p % 13 * (30 if p == 12 else 1))]
    odd = [(1, 5.0, 1.0, 4.0, 9.0, "x", 900), (1, 5.0, 1.0, 6.0, 9.0, "  ", 901), (1, 5.0, 1.0, 6.0, 9.0, None, 902), (None, 5.0, 1.0, 6.0, 9.0, "x", 903)]
    words = spark.createDataFrame(random.sample(rows, len(rows)) + odd, "page long, x0 double, y0 double, x1 double, y1 double, text string, word_no int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    lines = layout.word_lines(words)
    got = {(r["page"], r["word_no"]): (r["line"], r["height"]) for r in lines.collect()}
    anchors = {(r["page"], r["anchor"]): (r["edge"], r["lines"]) for r in layout.numeric_anchors(lines).collect()}
    cells = sorted(map(tuple, layout.line_cells(lines).select("page", "line", "cell", "x0", "x1", "text").collect()))
    steps = layout.of_words(words, [chunks.with_lines, chunks.cells_of], "page long, line long, cell long, x0 double, x1 double, text string")
    assert sorted(map(tuple, steps.collect())) == cells
    runs = layout.of_words(words, [chunks.with_lines, chunks.runs_of], "page long, line long, top double, run long")
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, layout.row_runs(lines).collect()))
    grid, wanted = layout.of_words(words, [chunks.with_lines, chunks.grid_of, chunks.continued_of], "page long, line long, columns int"), layout.continued(layout.aligned_grid(lines))
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, wanted.collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, edges = {}, {}
    for p in range(40):
        own = sorted((r for r in rows if r[0] == p), key=lambda r: r[6])
        height = statistics.median(r[4] - r[2] for r in own)
        placed = [(k, w) for k, line in enumerate(geometry.lines_of([(r[1:5], (r[5], r[6])) for r in own], max(1.0, 0.45 * height))) for w in line]
        want |= {(p, w[1][1]): (k, height) for k, w in placed}
        clusters = geometry.clusters_of([(w[0][2], k) for k, w in placed if geometry.numeric(w[1][0])], max(2.5, 0.45 * height), key=lambda v: v[0])
        found = [c for c in clusters if len({k for _, k in c}) >= 3]
        edges |= {(p, n): (statistics.median(x for x, _ in c), len({k for _, k in c})) for n, c in enumerate(found)}
    assert got == want and anchors == edges


def test_words_are_dealt_out_once(spark, sf_dir):
    """One shuffle and sort, of line items; no table of lines is written."""
    before = dict(shared._WRITTEN)
    for name in ("word_lines", "line_cells", "numeric_anchors", "aligned_grid", "shared_columns", "row_pitch_runs", "layout_order_ids", "bbox_overlap"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Sort [") == plan.count("MapInArrow") == 1, name
    assert shared._WRITTEN == before
