"""Tables of a page: grids from word boxes, cells of bordered tables, label cards, and what was found wanting.

A page is the unit of work. Its words and bordered cells are dealt by page, come to one task in order, and are read there as
a stream, a page at a time; nothing of a page depends on another. Words are grouped into lines; a grid is read off the gaps
that recur between words, or else off the right edges that numbers share; rows go on in a run while columns and rhythm
do. What the geometry can't decide is left as it is and noted.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators.geometry import Box, Item, around, assign_in_order, clusters_of, covered, edges_of, joined, lines_of, middle, numeric, parts_of, period, periods_in, placeholder, rhythm, sound
from claimspark.operators.streams import each_page

# Names of methods.
BORDERED, GEOMETRY, GROUPS = "pymupdf_find_tables", "word_geometry", "label_value_groups"
# A bridge spans at most the greater of these factors of pitch and of height; header offsets spread by at most
# this share of a column.
BRIDGE_PITCH, BRIDGE_HEIGHT, SPREAD = 3.5, 5.0, 0.6


def _upper_share(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def group_label(text: str) -> bool:
    return 2 <= len(text.split()) <= 5 and len(text) <= 64 and not numeric(text) and not period(text) and not set(text) & set(".,;:!?") and _upper_share(text) >= 0.68


def group_heading(text: str) -> bool:
    return 1 <= len(text.split()) <= 4 and len(text) <= 48 and not numeric(text) and _upper_share(text) >= 0.68


@dataclass
class Row:
    line: int
    cells: dict[int, Item]  # by column
    rest: list[Item] = field(default_factory=list)

    def box(self) -> Box:
        return around([b for b, _ in [*self.cells.values(), *self.rest]])


def runs_of(rows: list[Row], height: float, heads: Callable[[Row], bool], bridge: Callable[[Row, Row], list[Row] | None]) -> list[list[Row]]:
    """Rows in runs. A run goes on in the next line if two columns and the rhythm do, or across one or two lines that
    ``bridge`` takes as headings; a row that ``heads`` what follows begins a run."""
    if not rows:
        return []
    boxes = [r.box() for r in rows]
    references, breaks = rhythm([b[1] for b in boxes], height)
    out = [[rows[0]]]
    for i, (above, row) in enumerate(pairwise(rows)):
        apart, headings = row.line - above.line, None
        if not heads(row) and len(above.cells.keys() & row.cells.keys()) >= 2:
            if apart == 1 and i not in breaks:
                headings = []
            elif apart in (2, 3) and boxes[i + 1][1] - boxes[i][3] <= max(BRIDGE_PITCH * references[i], BRIDGE_HEIGHT * height):
                headings = bridge(above, row)
        if headings is None:
            out.append([row])
        else:
            out[-1] += [*headings, row]
    return out


# candidates ----------------------------------------------------------------------------------------------------------
@dataclass
class Cell:
    row: int
    col: int
    text: str
    box: Box | None
    rows: int = 1
    cols: int = 1


@dataclass
class Candidate:
    method: str
    box: Box | None
    cells: list[Cell]
    notes: list[tuple[str, str]] = field(default_factory=list)  # code, severity

    def note(self, code: str, severity: str = "warning") -> None:
        self.notes.append((code, severity))


def realigned(cells: list[Cell]) -> tuple[list[Cell], bool, bool]:
    """Cells with period headers moved to the value columns that they are centred over, in reading order; whether any
    moved, and whether a header row was in conflict and left as it was."""
    if not any(c.col > 0 and periods_in(c.text.split()) for c in cells):  # as on most pages
        return sorted(cells, key=lambda c: (c.row, c.col)), False, False
    values = [c for c in cells if c.col > 0 and not period(c.text)]
    columns = sorted({c.col for c in values})
    if len(columns) < 2:
        return cells, False, False
    spans = {k: [c.box for c in values if c.col == k and c.box] for k in columns}
    centres = [middle(around(spans[k])) if spans[k] else 0.0 for k in columns]
    moved = conflict = False
    out = []
    for row in sorted({c.row for c in cells}):
        own = [c for c in cells if c.row == row]
        beside = [c for c in own if c.col > 0]
        labels = [len(periods_in(c.text.split())) for c in beside]
        heads = sorted((c for c in beside if period(c.text)), key=lambda c: middle(c.box) if c.box else c.col)
        if beside and all(labels) and max(labels) > 1:
            conflict = True
        elif len(heads) >= 2 and len(heads) == len(columns):
            if uneven([x - (middle(c.box) if c.box else 0.0) for c, x in zip(heads, centres, strict=True)], centres):
                conflict = True
            else:
                for c, k in zip(heads, columns, strict=True):
                    moved |= c.col != k
                    c.col = k
        out += own
    return sorted(out, key=lambda c: (c.row, c.col)), moved, conflict


def spacing(columns: list[float]) -> float:
    return median(b - a for a, b in pairwise(columns)) if len(columns) > 1 else 0.0


def uneven(offsets: list[float], columns: list[float]) -> bool:
    """Whether headers lie too differently from their columns to be one for each."""
    return len(offsets) > 1 and spacing(columns) > 0 and max(offsets) - min(offsets) > SPREAD * spacing(columns)


@dataclass
class Page:
    items: list[Item]
    height: float
    lines: list[list[Item]]
    bordered: list[Candidate]

    @property
    def cut(self) -> float:
        return max(7.0, 1.25 * self.height)

    def free(self, box: Box, share: float) -> bool:
        return not any(covered(box, t.box) > share for t in self.bordered if t.box)


def gap_grid(page: Page) -> tuple[list[Candidate], list[tuple[str, str]]]:
    """Grids whose columns are parted by gaps that recur on half of the lines; else grids of right edges."""
    if len(page.items) < 6:
        return [], [("borderless_insufficient_words", "info")]
    if len(page.lines) < 3:
        return [], [("borderless_insufficient_rows", "info")]
    parts = [[joined(p) for p in parts_of(line, page.cut)] for line in page.lines]
    gaps = [(a[0][2] + b[0][0]) / 2 for line in parts for a, b in pairwise(line)]
    bounds = [median(c) for c in clusters_of(gaps, max(3.0, 1.1 * page.height)) if len(c) >= max(2, (len(parts) + 1) // 2)]
    if not bounds:
        return [], [("borderless_no_repeated_columns", "info")]
    column = lambda item: bisect_left(bounds, middle(item[0]))
    rows, conflicts = [], False
    for n, line in enumerate(parts):
        cells = {column(p): p for p in line}
        if len(cells) < len(line):
            conflicts = True
        elif len(cells) >= 2:
            rows.append(Row(n, cells))
    notes = [("ambiguous_column_boundary", "warning")] if conflicts else []
    valued = lambda row: any(k > 0 and numeric(t) for k, (_, t) in row.cells.items())

    def heads(row: Row) -> bool:
        beside = [t for k, (_, t) in row.cells.items() if k > 0]
        return len(beside) >= 2 and all(map(period, beside)) and 0 in row.cells and not numeric(row.cells[0][1])

    def bridge(above: Row, row: Row) -> list[Row] | None:
        between = [(n, parts[n]) for n in range(above.line + 1, row.line)]
        plain = all(len(p) == 1 and column(p[0]) == 0 and not numeric(p[0][1]) and not period(p[0][1]) for _, p in between)
        beside = 0 in above.cells and 0 in row.cells and abs(above.cells[0][0][0] - row.cells[0][0][0]) <= max(20.0, 4 * page.height)
        return [Row(n, {0: p[0]}) for n, p in between] if plain and beside else None

    found = []
    enough = len(rows) >= 3 and sum(map(valued, rows)) >= 2
    for run in runs_of(rows, page.height, heads, bridge) if enough else []:
        box = around([r.box() for r in run])
        if len(run) < 3 or sum(map(valued, run)) < 2 or not page.free(box, 0.5):
            continue
        cells, moved, conflict = realigned([Cell(i, k, t, b) for i, r in enumerate(run) for k, (b, t) in sorted(r.cells.items())])
        table = Candidate(GEOMETRY, box, cells)
        table.note("borderless_repeated_structure", "info")
        if moved:
            table.note("period_header_alignment", "info")
        if conflict:
            table.note("period_header_conflict")
        if any(r.cells.keys() == {0} for r in run):
            table.note("internal_subheading_retained", "info")
        wide = len({k for r in run for k in r.cells})
        for r in run[:-1]:
            if wide >= 3 and len(r.cells) < wide and not any(numeric(t) for _, t in r.cells.values()):
                table.note("ambiguous_header_span")
        found.append(table)
    if found:
        return found, notes
    found, more = edge_grid(page)
    if found:
        return found, [*notes, ("gap_grid_abstained", "info")]
    return [], [*notes, ("borderless_candidate_abstained" if enough else "borderless_structure_insufficient", "info"), *more]


def edge_grid(page: Page) -> tuple[list[Candidate], list[tuple[str, str]]]:
    """Grids whose columns are right edges that numbers share on three lines or more."""
    reach, height = max(2.5, 0.45 * page.height), page.height
    placed = [(box[2], n) for n, line in enumerate(page.lines) for box, t in line if numeric(t)]
    if len(placed) < 6:
        return [], []
    anchors = sorted(median(x for x, _ in c) for c in clusters_of(placed, reach, key=lambda v: v[0]) if len({n for _, n in c}) >= 3)
    if len(anchors) < 2:
        return [], [("aligned_numeric_columns_insufficient", "info")]
    rows = []
    for n, line in enumerate(page.lines):
        held: dict[int, list[Item]] = {}
        rest = []
        for item in line:
            k = min(range(len(anchors)), key=lambda i: abs(anchors[i] - item[0][2]))
            away = abs(anchors[k] - item[0][2])
            stands = placeholder(item[1]) and away <= 1.8 * reach and item[0][0] >= anchors[0] - reach
            if stands or numeric(item[1]) and away <= reach:
                held.setdefault(k, []).append(item)
            else:
                rest.append(item)
        if len(held) >= 2 and all(len(v) == 1 for v in held.values()):
            rows.append(Row(n, {k: v[0] for k, v in held.items()}, rest))
    if len(rows) < 3:
        return [], [("aligned_numeric_rows_insufficient", "info")]
    headers = []
    for n, line in enumerate(page.lines):
        near = lambda i, line=line: line[i + 1][0][0] - line[i][0][2] <= page.cut
        tokens = [joined(line[a:b]) for a, b in periods_in([t for _, t in line], near)]
        if len(tokens) >= 2:
            headers.append((n, tokens))

    def bridge(above: Row, row: Row) -> list[Row] | None:
        between = [(n, page.lines[n]) for n in range(above.line + 1, row.line)]
        labels = all(not numeric(t) and not period(t) and box[2] < anchors[0] - reach for _, line in between for box, t in line)
        ends = [max((b[2] for b, _ in r.rest), default=None) for r in (above, row)]
        alike = None not in ends and abs(ends[0] - ends[1]) <= 4 * reach
        fits = row.line - above.line <= max(3, round(28.0 / max(height, 1.0)))
        return [Row(n, {}, line) for n, line in between] if labels and alike and fits else None

    found, loose = [], False
    for run in runs_of(rows, height, lambda r: False, bridge):
        frequent = [k for k in range(len(anchors)) if sum(k in r.cells for r in run) >= max(3, (len(run) + 1) // 2)]
        if len(run) < 3 or len(frequent) < 2:
            loose = True
            continue
        table = _edge_table(page, run, anchors, frequent, reach)
        if table.cells and page.free(table.box, 0.5):
            _with_headers(table, run, headers, [anchors[k] for k in frequent], [k - frequent[0] + 1 for k in frequent], height)
            if any(len(r.cells) < len(frequent) for r in run):
                table.note("incomplete_numeric_row", "info")
            found.append(table)
    notes = [("aligned_numeric_block_dropped", "warning")] if loose else []
    return found, notes if found else [*notes, ("aligned_numeric_candidate_abstained", "info")]


def _edge_table(page: Page, run: list[Row], anchors: list[float], frequent: list[int], reach: float) -> Candidate:
    left = anchors[frequent[0]] - reach
    table = Candidate(GEOMETRY, None, [])
    table.note("aligned_numeric_structure", "info")
    if any(not r.cells for r in run):
        table.note("internal_subheading_retained", "info")
    for n, row in enumerate(run):
        kept = [k for k in frequent if k in row.cells]
        labels = row.rest if not row.cells else [w for w in row.rest if w[0][0] < left] if len(kept) >= 2 else []
        if labels:
            box, text = joined(labels)
            table.cells.append(Cell(n, 0, text, box))
            before = page.lines[row.line - 1] if row.cells and row.line else []
            close = before and abs(sum(before[0][0][1::2]) - sum(labels[0][0][1::2])) / 2 <= 1.5 * page.height
            if close and len(text.split()) <= 2 and len(" ".join(t for b, t in before if b[0] < left).split()) >= 2:
                table.note("possible_wrapped_row_label")
        if len(kept) >= 2:
            table.cells += [Cell(n, k - frequent[0] + 1, row.cells[k][1], row.cells[k][0]) for k in kept]
    if table.cells:
        table.box = around([c.box for c in table.cells])
    return table


def _with_headers(table: Candidate, run: list[Row], headers: list[tuple[int, list[Item]]], columns: list[float], numbers: list[int], height: float) -> None:
    """Give the table the one line of period labels that governs its columns, as its first row."""
    if not headers:
        return
    reach = max(12.0, 2.5 * height, 0.6 * spacing(columns))
    top = min(b[1] for b, _ in run[0].cells.values())
    above = [tokens for _, tokens in headers if 0 <= top - around([b for b, _ in tokens])[3] <= max(48.0, 6 * height)]
    matched = lambda tokens: assign_in_order([middle(b) for b, _ in tokens], columns, reach)
    tokens, whole_page = above[0] if len(above) == 1 else None, False
    if len(above) > 1:
        table.note("ambiguous_period_header")
    elif not above and len(headers) == 1:
        of, unique = matched(headers[0][1])
        if unique and sum(c is not None for c in of) == len(columns):
            tokens, whole_page = headers[0][1], True
    if tokens is None:
        table.note("period_header_not_associated")
        return
    of, unique = matched(tokens)
    pairs = [(t, c) for t, c in enumerate(of) if c is not None]
    left_over = len(pairs) < len(tokens)
    if not unique or len(tokens) == len(columns) and left_over or uneven([columns[c] - middle(tokens[t][0]) for t, c in pairs], columns):
        table.note("period_header_conflict")
    elif len(pairs) < 2:
        table.note("period_header_not_associated")
    else:
        for c in table.cells:
            c.row += 1
        table.cells = [Cell(0, numbers[c], tokens[t][1], tokens[t][0]) for t, c in pairs] + table.cells
        if whole_page:
            table.note("period_headers_associated_by_page_grid", "info")
            table.note("period_header_outside_candidate_region", "info")
        else:
            table.box = around([table.box, *(tokens[t][0] for t, _ in pairs)])
            table.note("period_headers_associated_by_alignment", "info")
        if left_over:
            table.note("period_header_incomplete", "info")


def label_groups(page: Page) -> tuple[list[Candidate], list[tuple[str, str]]]:
    """Cards of a label with a number below it and a heading at its left, for labels that stand on several cards."""
    if len(page.items) < 10:
        return [], []
    h = page.height
    words = [(n, p) for n, line in enumerate(page.lines) for p in parts_of(line, max(18.0, 2.2 * h))]
    if not any(group_label(joined(p)[1]) for _, p in words):
        return [], []
    parts = [(n, p, *joined(p)) for n, p in words]
    cards: dict[str, list[tuple[Item | None, Item, Item]]] = {}
    for n, _, box, text in parts:
        if not group_label(text):
            continue
        below = []
        for m, words, at, _ in parts:
            numbers = [w for w in words if numeric(w[1])]
            down = at[1] - box[3]
            if m > n and -1.0 <= down <= max(18.0, 3.5 * h) and len(numbers) == 1 and abs(numbers[0][0][0] - box[0]) <= max(24.0, 3.0 * h):
                below.append((down, m, numbers[0]))
        if not below:
            continue
        beside = [(at, t) for _, _, at, t in parts if abs((at[1] + at[3]) - (box[1] + box[3])) / 2 <= max(8.0, h) and at[2] < box[0] - max(30.0, 3.0 * h) and group_heading(t)]
        heading = max(beside, key=lambda i: (i[0][2], -i[0][0]), default=None)
        cards.setdefault(" ".join(text.split()).casefold(), []).append((heading, (box, text), min(below, key=lambda b: b[:2])[2]))
    found = []
    for _, group in sorted(cards.items()):
        if len(group) < 2 or sum(c[0] is not None for c in group) < 2:
            continue
        group.sort(key=lambda c: (c[1][0][1], c[1][0][0], c[2][0][1]))
        cells = [Cell(n, k, i[1], i[0]) for n, card in enumerate(group) for k, i in enumerate(card) if i is not None]
        box = around([c.box for c in cells])
        if page.free(box, 0.75):
            found.append(Candidate(GROUPS, box, cells, [("repeated_label_value_groups", "info"), ("group_semantics_unresolved", "info")]))
    return found, [("label_value_groups_insufficient_repetition", "info")] if cards and not found else []


def bordered_table(cells: list[tuple[int, int, str, Box | None]]) -> Candidate | None:
    """A table from the detector's (row, col, text, box): rows, columns and spans follow from the boxes' edges."""
    slots = (max(c[0] for c in cells) + 1) * (max(c[1] for c in cells) + 1) if cells else 0
    if not slots or len(cells) != slots:
        return None
    boxed = [(t, b) for _, _, t, b in cells if b is not None and sound(b)]
    if not boxed:
        table = Candidate(BORDERED, None, [Cell(r, c, t or "", None) for r, c, t, _ in sorted(cells, key=lambda c: c[:2])])
        table.note("cell_geometry_missing")
    else:
        down, across = (edges_of([v for _, b in boxed for v in (b[i], b[i + 2])]) for i in (1, 0))
        at = lambda v, edges: max(0, sum(e <= v for e in edges) - 1)
        spans = lambda a, b, edges: max(1, sum(a < hi and b > lo for lo, hi in pairwise(edges)))
        own = [Cell(at((b[1] + b[3]) / 2, down), at(middle(b), across), t or "", b, spans(b[1], b[3], down), spans(b[0], b[2], across)) for t, b in boxed]
        table = Candidate(BORDERED, around([b for _, b in boxed]), sorted(own, key=lambda c: (c.row, c.col)))
    if len(table.cells) != slots:
        table.note("non_rectangular_or_merged_grid", "info")
    if max(c[0] for c in cells) == 0:
        table.note("single_row_layout")
    return table


def tables_of(words: list[Item], bordered: dict[int, list[tuple[int, int, str, Box | None]]] | None = None) -> tuple[list[Candidate], list[tuple[str, str]]]:
    """A page's candidates in reading order, and what concerns the whole page."""
    tables, notes = [], []
    for _, cells in sorted((bordered or {}).items()):
        table = bordered_table(cells)
        if table is None:
            notes.append(("empty_find_tables_result", "warning"))
        else:
            tables.append(table)
    items = [(b, t) for b, t in words if sound(b) and b[3] > b[1] and t and t.strip()]
    if len(words) >= 6 and len(items) < 6:
        notes.append(("borderless_insufficient_geometry", "info"))
    elif len(words) < 6:
        notes.append(("borderless_insufficient_words", "info"))
    else:
        height = median(b[3] - b[1] for b, _ in items)
        page = Page(items, height, lines_of(items, max(1.0, 0.45 * height)), list(tables))
        for reader in (gap_grid, label_groups):
            found, more = reader(page)
            tables += found
            notes += more
    far = (math.inf, math.inf)
    tables.sort(key=lambda t: ((t.box[1], t.box[0]) if t.box else far, t.method, [(c.row, c.col, c.box or (), c.text) for c in t.cells]))
    return tables, notes


# pages of a DataFrame ------------------------------------------------------------------------------------------------
LAYOUT = (
    "page long, table_id string, method string, row int, col int, row_span int, col_span int, text string, "
    "x0 double, y0 double, x1 double, y1 double, code string, severity string"
)


def _rows_of(page: int, words: list, cells: dict, kinds: tuple[str, ...] = ("cells", "notes")) -> Iterator[tuple]:
    tables, notes = tables_of(words, cells)
    none = (None,) * 10
    for n, t in enumerate(tables):
        name = f"p{page}-t{n:02d}"
        for c in t.cells if "cells" in kinds else ():
            yield (page, name, t.method, c.row, c.col, c.rows, c.cols, c.text, *(c.box or (None,) * 4), None, None)
        for note in t.notes if "notes" in kinds else ():
            yield (page, name, t.method, *none[1:], *note)
    for note in notes if "notes" in kinds else ():
        yield (page, None, *none, *note)


def page_layout(words: DataFrame, bordered: DataFrame | None = None, together: bool = False, kinds: tuple[str, ...] = ("cells", "notes")) -> DataFrame:
    """Rows of LAYOUT: the cells of each page's tables (code null) and diagnostics (row null), page-wide ones without table_id.

    words: page, x0, y0, x1, y1, text, word_no. bordered: cells of tables that a detector found, page, table_no, row, col, text
    and a box, which may be null. Boxes that aren't sound and blank words are left out; a page without words has a diagnostic
    only if it has bordered cells. A page's words meet in one task, as many as a page holds. ``together``: they do already, one page
    after another. ``kinds``: which rows are made, cells or notes or both.
    """
    if bordered is None:

        def read_words(page: int, rows: list[tuple]) -> Iterator[tuple]:
            if together:
                rows.sort(key=lambda r: (r[0] is not None, r[0]))
            return _rows_of(page, [((x0, y0, x1, y1), text) for _, x0, y0, x1, y1, text in rows], {}, kinds)

        own = words.select("page", "word_no", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
        return each_page(own, ["word_no"], read_words, LAYOUT, together)

    none = F.lit(None).cast("int")
    rows = words.select("page", F.lit(1).alias("kind"), none.alias("table_no"), none.alias("row"), none.alias("col"), "word_no", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
    own = bordered.select("page", F.lit(0).alias("kind"), "table_no", "row", "col", F.lit(0).alias("word_no"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
    rows = rows.unionByName(own)

    def read(page: int, rows: list[tuple]) -> Iterator[tuple]:
        held, tables = [], {}
        for kind, no, row, col, _, x0, y0, x1, y1, text in rows:
            if kind:
                held.append(((x0, y0, x1, y1), text))
            else:
                tables.setdefault(no, []).append((row, col, text, None if x0 is None else (x0, y0, x1, y1)))
        return _rows_of(page, held, tables, kinds)

    return each_page(rows, ["kind", "table_no", "row", "col", "word_no"], read, LAYOUT)


def table_cells(layout: DataFrame) -> DataFrame:
    return layout.where("row IS NOT NULL").drop("code", "severity")


def diagnostics(layout: DataFrame) -> DataFrame:
    return layout.where("code IS NOT NULL").select("page", "table_id", "method", "code", "severity")
