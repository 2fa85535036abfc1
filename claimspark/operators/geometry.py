"""Tokens, boxes, lines and rows of one page, in plain Python."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise
from statistics import median

Box = tuple[float, float, float, float]
Item = tuple[Box, str]

# Tokens that stand for no value, and the patterns of footnote markers, numbers and periods.
PLACEHOLDERS = ("", "-", "–", "—", "−", "·", "...", "…", "n/a", "na", "n.a.", "not available", "nil")
MARKERS = r"[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡]+$"
NUMERIC = r"^\(?\s*[+-]?\s*(?:(?:GBP|USD|EUR|INR|JPY|CNY)\s*)?[£$€₹¥]?\s*\d[\d,]*(?:\.\d+)?\s*(?:%|percent|per\s+cent|pp|p\.p\.?|pence|p|thousand|million|billion|mn|bn|[kmb])?\s*\)?$"
PERIOD = r"^(?:(?:FY\s*)?(?:19|20)\d{2}(?:\s*[-/–—]\s*\d{2,4})?|FY\s*\d{2,4}|Q[1-4](?:\s*(?:FY)?\s*\d{2,4})?|\d{1,2}/\d{1,2}/(?:19|20)\d{2})$"
# A break is a pitch over the first factor times its neighbours' and over the second times the text height.
BREAK_PITCH, BREAK_HEIGHT = 3.0, 1.5
_NUMERIC, _PERIOD, _MARKERS = re.compile(NUMERIC, re.I), re.compile(PERIOD, re.I), re.compile(MARKERS)
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+")  # numeric, and no period


def placeholder(text: str) -> bool:
    return text.strip().casefold() in PLACEHOLDERS


def _unmarked(text: str) -> str:
    return _MARKERS.sub("", text.strip()).strip()


@lru_cache(4096)  # a page asks for a token's kind many times
def period(text: str) -> bool:
    return not _DECIMAL.fullmatch(text) and bool(_PERIOD.match(_unmarked(text.strip().strip("()[]{}.,;:"))))


@lru_cache(4096)
def numeric(text: str) -> bool:
    if _DECIMAL.fullmatch(text):
        return True
    bare = _unmarked(text)
    return bool(bare) and not placeholder(bare) and not period(bare) and bool(_NUMERIC.match(bare.replace("−", "-").replace("–", "-")))


def periods_in(words: list[str], near: Callable[[int], bool] = lambda i: True) -> list[tuple[int, int]]:
    """(first, end) of the period labels among ``words``, from the left, the longest of up to three words each; ``near(i)``:
    word i may go on in the next."""
    found, i = [], 0
    if len(words) == 1:
        return [(0, 1)] if period(words[0]) else []
    while i < len(words):
        wide = next((n for n in (3, 2, 1) if i + n <= len(words) and all(map(near, range(i, i + n - 1))) and period(" ".join(words[i : i + n]))), 0)
        if wide:
            found.append((i, i + wide))
        i += wide or 1
    return found


# boxes ---------------------------------------------------------------------------------------------------------------
def sound(box: tuple) -> bool:
    x0, y0, x1, y1 = box
    if x0 is None or y0 is None or x1 is None or y1 is None:
        return False
    return math.isfinite(x0) and math.isfinite(y0) and math.isfinite(x1) and math.isfinite(y1) and box[2] >= box[0] and box[3] >= box[1]


def around(boxes: list[Box]) -> Box:
    if len(boxes) == 1:
        return boxes[0]
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return min(x0), min(y0), max(x1), max(y1)


def covered(a: Box, b: Box) -> float:
    """Of the first box's area, the share that lies in the second."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return max(0.0, wide) * max(0.0, high) / area if area else 0.0


def clipped(box: Box, page: Box, slack: float = 1.5) -> Box | None:
    """Cut to the page where it is out by little; None where it is out by more."""
    if box[0] < page[0] - slack or box[1] < page[1] - slack or box[2] > page[2] + slack or box[3] > page[3] + slack:
        return None
    return max(page[0], box[0]), max(page[1], box[1]), min(page[2], box[2]), min(page[3], box[3])


def middle(box: Box) -> float:
    return (box[0] + box[2]) / 2


def edges_of(values: list[float], apart: float = 1.0) -> list[float]:
    """Grid lines: values no further than ``apart`` from the last one are averaged with it."""
    out: list[float] = []
    for v in sorted(values):
        if out and v - out[-1] <= apart:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out


def clusters_of(values: list, tolerance: float, key: Callable = lambda v: v) -> list[list]:
    """Sorted values, cut where the next lies further than the tolerance above the median of the cluster so far."""
    out: list[list] = []
    for v in sorted(values):
        if out and key(v) - (key(out[-1][len(out[-1]) // 2]) + key(out[-1][(len(out[-1]) - 1) // 2])) / 2 <= tolerance:  # sorted, so the middle
            out[-1].append(v)
        else:
            out.append([v])
    return out


# lines and rows ------------------------------------------------------------------------------------------------------
def lines_of(items: list[Item], tolerance: float) -> list[list[Item]]:
    """Lines from the top, words from the left. A word, by its centre, joins the first line whose mean centre is near: that can
    only be the last, since centres only grow and an earlier line was out of reach when the last began."""
    groups: list[list[Item]] = []
    total, count = 0.0, 0
    for c, _, item in sorted([((w[0][1] + w[0][3]) / 2, w[0][0], w) for w in items], key=lambda w: w[:2]):
        if count and c - total / count <= tolerance:
            groups[-1].append(item)
            total, count = total + c, count + 1
        else:
            groups.append([item])
            total, count = 0.0 + c, 1
    for g in groups:
        g.sort(key=lambda w: w[0][0])
    return groups


def parts_of(line: list[Item], gap: float) -> list[list[Item]]:
    out: list[list[Item]] = []
    for item in line:
        if out and item[0][0] - out[-1][-1][0][2] < gap:
            out[-1].append(item)
        else:
            out.append([item])
    return out


def joined(items: list[Item]) -> Item:
    if len(items) == 1:
        return items[0]
    return around([b for b, _ in items]), " ".join(t for _, t in items)


def rhythm(tops: list[float], height: float) -> tuple[list[float], set[int]]:
    """Of each gap between rows: the pitch that it is held against, the least neighbouring one, and which gaps are breaks."""
    pitches = [b - a for a, b in pairwise(tops)]
    references = []
    for i in range(len(pitches)):
        beside = [p for p in pitches[max(0, i - 1) : i] + pitches[i + 1 : i + 2] if p > 0]
        references.append(min(beside, default=4.0 * height))
    return references, {i for i, (p, r) in enumerate(zip(pitches, references, strict=True)) if p > BREAK_PITCH * r > 0 and p > BREAK_HEIGHT * height}


def assign_in_order(positions: list[float], columns: list[float], reach: float) -> tuple[list[int | None], bool]:
    """Tokens to columns, order kept: as many as can be within reach, then the least total distance; and whether the best is unique."""
    return _nearest(positions, columns, reach) or _by_table(positions, columns, reach)


def _nearest(positions: list[float], columns: list[float], reach: float) -> tuple[list[int | None], bool] | None:
    """Where no token is within reach of two columns and all are in order, each column takes its nearest token. None where that
    isn't so, where two are as near, or where distances may need rounding."""
    if any(b - a <= 2 * reach for a, b in pairwise(columns)) or any(b < a for a, b in pairwise(positions)):
        return None
    out: list[int | None] = [None] * len(positions)
    best: dict[int, tuple[float, int]] = {}
    ties: set[int] = set()
    for i, p in enumerate(positions):
        for j, c in enumerate(columns):
            d = abs(p - c)
            if d <= reach:
                if not float(d * 512).is_integer():
                    return None
                if j not in best or d <= best[j][0]:
                    ties.add(j) if j in best and d == best[j][0] else ties.discard(j)
                    best[j] = (d, i)
                break
    for j, (_, i) in best.items():
        out[i] = j
    return (out, True) if not ties else None


def _by_table(positions: list[float], columns: list[float], reach: float) -> tuple[list[int | None], bool]:
    n, m = len(positions), len(columns)
    best: list[list[tuple[int, float, int]]] = [[(0, 0.0, 1)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d = abs(positions[i - 1] - columns[j - 1])
            a, b, c = best[i - 1][j], best[i][j - 1], best[i - 1][j - 1]
            options = {(a[0], round(-a[1], 9)), (b[0], round(-b[1], 9))}
            ways: dict[tuple, int] = {}
            both = best[i - 1][j - 1]
            for k in options:  # leave out the token or the column; both at once would count twice
                ways[k] = sum(x[2] for x in (a, b) if (x[0], round(-x[1], 9)) == k) - (both[2] if (both[0], round(-both[1], 9)) == k else 0)
            if d <= reach:
                k = (c[0] + 1, round(-(c[1] + d), 9))
                ways[k] = ways.get(k, 0) + c[2]
            top = max(ways)
            best[i][j] = (top[0], -top[1], ways[top])
    out: list[int | None] = [None] * n
    i, j = n, m
    while i and j:
        here = best[i][j]
        d = abs(positions[i - 1] - columns[j - 1])
        c = best[i - 1][j - 1]
        if d <= reach and (c[0] + 1, round(c[1] + d, 9)) == (here[0], round(here[1], 9)):
            out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif best[i - 1][j][:1] == here[:1] and round(best[i - 1][j][1], 9) == round(here[1], 9):
            i -= 1
        else:
            j -= 1
    return out, best[n][m][2] == 1
