"""Tables of pages: grids, bridges, period headers, cards, bordered cells and diagnostics."""

import itertools
import random

import pytest

from claimspark.operators import contracts, geometry, grids, layout
from claimspark.plans import fixtures

NUMBERS = (("1,204", "1,180"), ("310", "295"), ("87", "91"), ("45", "42"))


def word(text, y, left=None, right=None, centre=None, high=9.0):
    wide = 5.0 * len(text)
    x0 = left if left is not None else right - wide if right is not None else centre - wide / 2
    return ((x0, y, x0 + wide, y + high), text)


def rows(first, start, pitch=12.0, label="Item", count=3, edges=(250.0, 350.0)):
    out = []
    for i in range(count):
        y = start + pitch * i
        out += [word(f"{label}{first + i}", y, left=30.0), *[word(t, y, right=x) for t, x in zip(NUMBERS[i % 4], edges)]]
    return out


def header(y, centres=(200.0, 300.0), texts=("2023", "2024")):
    return [word(t, y, centre=c) for t, c in zip(texts, centres)]


def codes(table):
    return {c for c, _ in table.notes}


def texts(table):
    return {(c.row, c.col): c.text for c in table.cells}


def test_right_aligned_table_with_centred_header():
    (table,), _ = grids.tables_of(header(28) + rows(0, 40, count=4))
    own = texts(table)
    assert own[0, 1] == "2023" and own[0, 2] == "2024"
    assert [own[r, c] for r in (1, 2) for c in (0, 1, 2)] == ["Item0", "1,204", "1,180", "Item1", "310", "295"]
    assert table.method == grids.GEOMETRY and not {"period_header_conflict", "period_header_not_associated"} & codes(table)


@pytest.mark.parametrize("blank", [0, 1])
def test_subheading_stays_inside(blank):
    words = rows(0, 40) + [word("SEGMENT", 76, left=30.0), word("BETA", 76, left=70.0)] + rows(3, 88 + 12 * blank)
    tables, _ = grids.tables_of(words)
    assert len(tables) == 1 and "internal_subheading_retained" in codes(tables[0])
    assert (3, 0) in texts(tables[0]) and texts(tables[0])[3, 0] == "SEGMENT BETA" and len({c.row for c in tables[0].cells}) == 7


@pytest.mark.parametrize("gap, fused", [(45.0, True), (45.5, False)])
def test_bridge_spans_five_heights_at_most(gap, fused):
    last = 40 + 2 * 12 + 9
    words = rows(0, 40) + [word("Other", last + 10, left=30.0), word("lines", last + 10, left=60.0)] + rows(3, last + gap)
    tables, _ = grids.tables_of(words)
    assert len(tables) == (1 if fused else 2)


def test_rows_after_a_wide_gap_begin_another_table():
    tables, _ = grids.tables_of(rows(0, 40) + rows(3, 40 + 3 * 12 + 40))
    assert [len({c.row for c in t.cells}) for t in tables] == [3, 3]
    tables, notes = grids.tables_of(rows(0, 40) + rows(3, 150, count=2))
    assert len(tables) == 1


@pytest.mark.parametrize("shift, conflict", [(0, False), (9, False), (70, True)])
def test_headers_that_drift_from_their_columns(shift, conflict):
    """Labels of all widths leave no gap that recurs, so that the numbers' right edges make the grid."""
    words = header(28, (200.0, 300.0 - shift))
    for i, wide in enumerate((2, 30, 12, 22)):
        words += [word("l" * wide, 40 + 12 * i, left=30.0), *[word(t, 40 + 12 * i, right=x) for t, x in zip(NUMBERS[i], (250.0, 350.0))]]
    (table,), notes = grids.tables_of(words)
    assert ("gap_grid_abstained", "info") in notes and "aligned_numeric_structure" in codes(table)
    assert ("period_header_conflict" in codes(table)) == conflict
    assert (texts(table).get((0, 1)) == "2023") != conflict


def test_periods_and_numbers():
    assert [geometry.period(t) for t in ("Q4 2024", "Q1 FY24", "Q4 2024*", "FY 2023/24", "31/12/2024", "Q5 2024", "Q 4 2024", "1200", "£38m")] == [True] * 5 + [False] * 4
    assert [geometry.numeric(t) for t in ("1200", "£38m", "(1,234)", "−5", "12.5%", "3 per cent", "2024", "—", "n/a", "text", "")] == [True] * 6 + [False] * 5
    assert geometry.periods_in("Q4 2024 and FY 2023 so".split()) == [(0, 2), (3, 5)]


def test_lines_by_running_mean_and_anchors_by_running_median():
    drift = [((10.0 * i, 3.0 * i, 10.0 * i + 8, 3.0 * i + 9), f"w{i}") for i in range(6)]
    assert [len(line) for line in geometry.lines_of(drift, 4.05)] == [2, 2, 2]
    assert geometry.clusters_of([1.0, 2.0, 3.0, 4.0, 5.0, 9.0], 2.0) == [[1.0, 2.0, 3.0, 4.0], [5.0], [9.0]]
    assert geometry.edges_of([0.0, 0.5, 10.0, 10.8, 20.0]) == [0.25, 10.4, 20.0]
    assert geometry.rhythm([0.0, 12.0, 24.0, 70.0, 82.0], 9.0) == ([12.0, 12.0, 12.0, 46.0], {2})


def test_label_cards(spark):
    found = grids.page_layout(fixtures.card_words(spark))
    own = {(r["row"], r["col"]): r["text"] for r in grids.table_cells(found).where(f"method = '{grids.GROUPS}'").collect()}
    assert own == {(0, 0): "NORTH", (0, 1): "NET SALES", (0, 2): "1,200", (1, 0): "SOUTH", (1, 1): "NET SALES", (1, 2): "950.5"}
    assert "repeated_label_value_groups" in {r["code"] for r in grids.diagnostics(found).collect()}


def test_bordered_cells_with_a_merged_header(spark):
    cells = [(0, 0, "Name", (0.0, 0.0, 50.0, 10.0)), (0, 1, "Years", (50.0, 0.0, 170.0, 10.0)), (0, 2, None, None)]
    cells += [(1, k, t, (a, 10.0, b, 20.0)) for k, (t, a, b) in enumerate((("a", 0.0, 50.0), ("1", 50.0, 130.0), ("2", 130.0, 170.0)))]
    table = grids.bordered_table(cells)
    assert {(c.row, c.col, c.cols, c.text) for c in table.cells} == {(0, 0, 1, "Name"), (0, 1, 2, "Years"), (1, 0, 1, "a"), (1, 1, 1, "1"), (1, 2, 1, "2")}
    assert codes(table) == {"non_rectangular_or_merged_grid"}
    assert grids.bordered_table(cells[:-1]) is None and codes(grids.bordered_table([(0, 0, "x", None)])) == {"cell_geometry_missing", "single_row_layout"}
    rows = [(1, 0, r, c, t, *(b or (None,) * 4)) for r, c, t, b in cells]
    bordered = spark.createDataFrame(rows, "page long, table_no int, row int, col int, text string, x0 double, y0 double, x1 double, y1 double")
    out = grids.page_layout(spark.createDataFrame([], fixtures.WORDS), bordered)
    assert {r["table_id"] for r in grids.table_cells(out).collect()} == {"p1-t00"}
    assert contracts.cell_violations(grids.table_cells(out)).count() == 0


def test_bordered_tables_win_over_word_grids():
    words = rows(0, 40, count=4)
    whole = [(0, 0, "all", (0.0, 0.0, 400.0, 100.0))]
    tables, _ = grids.tables_of(words, {0: whole})
    assert [t.method for t in tables] == [grids.BORDERED]


def test_odd_pages(spark):
    assert grids.tables_of([]) == ([], [("borderless_insufficient_words", "info")])
    bad = [((5.0, 5.0, 1.0, 9.0), "x"), ((0.0, 0.0, float("nan"), 9.0), "y"), ((0.0, 0.0, 5.0, 9.0), "  "), ((0.0, 0.0, 5.0, 0.0), "z"), ((None,) * 4, "n"), ((0.0, 0.0, 5.0, 9.0), "ok")]
    assert grids.tables_of(bad) == ([], [("borderless_insufficient_geometry", "info")])
    assert grids.page_layout(spark.createDataFrame([], fixtures.WORDS)).count() == 0
    assert geometry.clipped((-1.0, 0.0, 5.0, 5.0), (0.0, 0.0, 10.0, 10.0)) == (0.0, 0.0, 5.0, 5.0) and geometry.clipped((-2.0, 0.0, 5.0, 5.0), (0.0, 0.0, 10.0, 10.0)) is None


def test_drawings_are_measured_where_the_text_allows(spark):
    pages = spark.createDataFrame([("a", 10, 100), ("b", 5000, 100), ("c", 10, None), ("bad", 1, 1)], "source string, words int, chars int")

    def count(source):
        return {"a": 7}[source]

    assert {r["source"]: r["drawings"] for r in layout.measured(pages, count).collect()} == {"a": 7, "b": None, "c": None, "bad": None}


def test_header_assignment_like_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        tokens = sorted(rng.uniform(0, 100) for _ in range(rng.randrange(4)))
        columns = sorted(rng.uniform(0, 100) for _ in range(rng.randrange(1, 4)))
        ways = []
        for n in range(min(len(tokens), len(columns)) + 1):
            for t in itertools.combinations(range(len(tokens)), n):
                for c in itertools.combinations(range(len(columns)), n):
                    far = [abs(tokens[i] - columns[j]) for i, j in zip(t, c)]
                    if all(d <= 30 for d in far):
                        ways.append((-n, round(sum(far), 6), dict(zip(t, c))))
        best = min(ways, key=lambda w: w[:2])
        found, unique = geometry.assign_in_order(tokens, columns, 30.0)
        assert (-sum(c is not None for c in found), round(sum(abs(tokens[i] - columns[c]) for i, c in enumerate(found) if c is not None), 6)) == best[:2]
        assert unique == (sum(w[:2] == best[:2] for w in ways) == 1)


def test_a_kind_of_rows_is_made_alone_and_nothing_is_stored(spark, sf_dir):
    """Notes without cells, cells without notes, each in one pass over words that no sort follows."""
    from claimspark.operators import grids
    from claimspark.plans import bridge, catalogue
    from claimspark.sources import shared

    before = dict(shared._WRITTEN)
    both = grids.page_layout(bridge.words(spark, sf_dir))
    own = {"table_candidates": grids.table_cells(both), "table_diagnostics": grids.diagnostics(both)}
    for name, want in own.items():
        got = catalogue.QUERIES[name](spark, sf_dir)
        assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert shared._WRITTEN == before


def test_columns_apart_are_assigned_without_the_table():
    """Where no token is within reach of two columns, each takes its nearest one: like the table of all choices."""
    import random

    from claimspark.operators import geometry

    random.seed(7)
    for _ in range(3000):
        columns = sorted(random.sample(range(0, 400, 50), random.randint(1, 4)))
        positions = sorted(random.randint(-60, 460) + random.choice((0, 0.5)) for _ in range(random.randint(0, 7)))
        assert geometry._nearest(positions, columns, 20.0) in (None, geometry._by_table(positions, columns, 20.0))
        assert geometry.assign_in_order(positions, columns, 20.0) == geometry._by_table(positions, columns, 20.0)
    assert geometry._nearest([1.0, 48.0, 55.0], [0.0, 50.0], 20.0) == ([0, 1, None], True)
    assert geometry._nearest([1.0], [0.0, 10.0], 20.0) is geometry._nearest([5.0, 1.0], [0.0], 9.0) is geometry._nearest([0.1], [0.0], 9.0) is None
