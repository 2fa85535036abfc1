"""Steps of layout over whole pages in columns: what is a loop over words runs over plain numbers, all else over arrays.

A chunk is a dict of arrays, one entry a word or cell; ``pid`` numbers the chunk's pages, which come one after another. Each
step takes a chunk and returns one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from claimspark.operators.geometry import BREAK_HEIGHT, BREAK_PITCH, numeric, placeholder

Chunk = dict


def taken(c: Chunk, at: np.ndarray, names: tuple[str, ...] | None = None) -> Chunk:
    return {k: c[k].take(pa.array(at)) if isinstance(c[k], pa.Array) else c[k][at] for k in names or c}


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which entries begin a group of equal keys, of sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _within(group: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers from 0 within groups, of running numbers and where groups begin."""
    begins = np.flatnonzero(first)
    return group - np.repeat(group[begins], np.diff(np.append(begins, len(group))))


def _medians(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of sorted runs of values."""
    high = values[begins + sizes // 2]
    return np.where(sizes % 2 == 1, high, (values[begins + (sizes - 1) // 2] + high) / 2)


def with_lines(c: Chunk, share: float = 0.45) -> Chunk:
    """The words with height, their page's median, and line, in order of page, line and x0.

    A word, by its centre, joins its page's last line if that line's mean centre is near: centres only grow, so an earlier one
    stays out of reach.
    """
    begins = np.flatnonzero(firsts(c["pid"]))
    sizes = np.diff(np.append(begins, len(c["pid"])))
    high = c["y1"] - c["y0"]
    heights = _medians(high[np.lexsort((high, c["pid"]))], begins, sizes)
    centre = (c["y0"] + c["y1"]) / 2
    order = np.lexsort((c["word_no"], c["x0"], centre, c["pid"]))
    at, lines = centre[order].tolist(), []
    for b, n, near in zip(begins.tolist(), sizes.tolist(), np.maximum(1.0, share * heights).tolist(), strict=True):
        line, total, count = 0, 0.0, 0
        for v in at[b : b + n]:
            if count and v - total / count > near:
                line, total, count = line + 1, 0.0, 0
            total += v
            count += 1
            lines.append(line)
    c = taken(c, order) | {"height": np.repeat(heights, sizes), "line": np.array(lines, np.int64)}
    return taken(c, np.lexsort((c["x0"], c["line"], c["pid"])))


def cells_of(c: Chunk, least: float = 7.0, times: float = 1.25) -> Chunk:
    """Words of a line joined while gaps stay under max(least, times x height)."""
    c = taken(c, np.lexsort((c["word_no"], c["x0"], c["line"], c["pid"])))
    row = firsts(c["pid"], c["line"])
    new = row.copy()
    new[1:] |= c["x0"][1:] - c["x1"][:-1] >= np.maximum(least, times * c["height"][1:])
    at = np.flatnonzero(new)
    words = pa.ListArray.from_arrays(pa.array(np.append(at, len(new)), pa.int32()), c["text"])
    low, high = (lambda k: np.minimum.reduceat(c[k], at)), (lambda k: np.maximum.reduceat(c[k], at))
    cell = _within(np.cumsum(new) - 1, row)[at]
    return taken(c, at, ("pid", "page", "line")) | {"cell": cell, "x0": low("x0"), "x1": high("x1"), "y0": low("y0"), "y1": high("y1"), "text": pc.binary_join(words, " ")}


def _kinds(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are numeric and which placeholders. Plain decimals and plain words are told apart by patterns."""
    like = lambda p: pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False)
    number, stands = like(r"^[0-9]+\.[0-9]+$"), np.zeros(len(text), bool)
    plain = number | like("^[A-Za-z]{2}") & ~like("^(?i:gb|us|eu|in|jp|cn|na|ni|no)")
    for i in np.flatnonzero(~plain):
        t = text[i].as_py()
        number[i], stands[i] = numeric(t), placeholder(t)
    return number, stands


def anchors_of(c: Chunk, least: int = 3) -> Chunk:
    """Right edges of numbers in clusters on ``least`` lines or more, numbered within their page."""
    return _anchors(c, _kinds(c["text"])[0], least)


def _reach(height: np.ndarray) -> np.ndarray:
    return np.maximum(2.5, 0.45 * height)


def _anchors(c: Chunk, number: np.ndarray, least: int) -> Chunk:
    own = {k: c[k][number] for k in ("pid", "page", "line", "x1", "height")}
    own = taken(own, np.lexsort((own["line"], own["x1"], own["pid"])))
    first = firsts(own["pid"])
    edges, page = own["x1"].tolist(), first.tolist()
    begin, new = 0, []
    for i, (x, turn, reach) in enumerate(zip(edges, page, _reach(own["height"]).tolist(), strict=True)):
        n = i - begin
        if turn or x - (edges[begin + n // 2] if n % 2 else (edges[begin + n // 2 - 1] + edges[begin + n // 2]) / 2) > reach:
            begin = i
            new.append(i)
    begins = np.array(new, np.int64)
    sizes = np.diff(np.append(begins, len(edges)))
    cluster = np.repeat(np.arange(len(begins)), sizes)
    order = np.lexsort((own["line"], cluster))
    lines = np.bincount(cluster[order][firsts(cluster[order], own["line"][order])], minlength=len(begins))
    kept = lines >= least
    out = {k: own[k][begins][kept] for k in ("pid", "page")} | {"edge": _medians(own["x1"], begins, sizes)[kept] if len(begins) else own["x1"], "lines": lines[kept]}
    return out | {"anchor": _within(np.arange(len(out["pid"])), firsts(out["pid"])) if len(out["pid"]) else out["lines"]}


def grid_of(c: Chunk, least: int = 3) -> Chunk:
    """Each number at the nearest anchor, if its right edge is within reach; a placeholder within 1.8 times that, unless it stands
    left of the columns."""
    number, stands = _kinds(c["text"])
    anchors = _anchors(c, number, least)
    pages = int(c["pid"][-1]) + 1 if len(c["pid"]) else 0
    count = np.bincount(anchors["pid"], minlength=pages)
    begin = np.cumsum(count) - count
    c = taken(c, np.flatnonzero((number | stands) & (count[c["pid"]] > 0))) | {"number": number[(number | stands) & (count[c["pid"]] > 0)]}
    own, reach = c["pid"], _reach(c["height"])
    best, nearest = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
    for k in range(int(count.max(initial=0))):
        away = np.full(len(own), np.inf)
        there = count[own] > k
        away[there] = np.abs(anchors["edge"][begin[own[there]] + k] - c["x1"][there])
        nearer = away < best
        best[nearer], nearest[nearer] = away[nearer], k
    left = anchors["edge"][begin[own]] - reach if len(own) else reach
    kept = np.flatnonzero(np.where(c["number"], best <= reach, (best <= 1.8 * reach) & (c["x0"] >= left)))
    return taken(c | {"anchor": nearest}, kept)


def continued_of(c: Chunk, least: int = 2) -> Chunk:
    """Lines that share ``least`` anchors or more with the line after them."""
    order = np.lexsort((c["anchor"], c["line"], c["pid"]))
    order = order[firsts(c["pid"][order], c["line"][order], c["anchor"][order])]
    if not len(order):
        return {k: c[k] for k in ("page", "line")} | {"columns": c["line"].astype(np.int32)}
    pid, line, anchor = (c[k][order] for k in ("pid", "line", "anchor"))
    wide, high = int(anchor.max()) + 1, int(line.max()) + 2
    both = np.isin((pid * high + line + 1) * wide + anchor, (pid * high + line) * wide + anchor)
    at = np.flatnonzero(firsts(pid, line))
    columns = np.add.reduceat(both.astype(np.int32), at)
    return {"page": c["page"][order][at][columns >= least], "line": line[at][columns >= least], "columns": columns[columns >= least]}


def runs_of(c: Chunk) -> Chunk:
    """Lines with their top and run: a run ends where the pitch is over 3 times the least neighbouring one, or 4 heights where there
    is none, and over 1.5 heights."""
    at = np.flatnonzero(firsts(c["pid"], c["line"]))
    top, height, first = np.minimum.reduceat(c["y0"], at), np.maximum.reduceat(c["height"], at), firsts(c["pid"][at])
    pitch = np.where(first, np.nan, np.diff(top, prepend=np.nan))
    beside = np.where(pitch > 0, pitch, np.inf)  # first lines have none
    near = np.minimum(np.where(first, np.inf, np.append(np.inf, beside[:-1])), np.where(np.append(first[1:], True), np.inf, np.append(beside[1:], np.inf)))
    apart = (pitch > BREAK_PITCH * np.where(np.isinf(near), 4 * height, near)) & (pitch > BREAK_HEIGHT * height)
    return taken(c, at, ("page", "line")) | {"top": top, "run": _within(np.cumsum(apart), first)}


def beside_of(c: Chunk) -> Chunk:
    """Of each cell with one to its left, that one's number and the share of it that the other, 60 wider, covers."""
    at = np.flatnonzero(~firsts(c["pid"], c["line"]))
    own, left = taken(c, at), taken(c, at - 1, ("cell", "x0", "x1", "y0", "y1"))
    wide = np.maximum(0.0, np.minimum(own["x1"], left["x1"] + 60) - np.maximum(own["x0"], left["x0"]))
    high = np.maximum(0.0, np.minimum(own["y1"], left["y1"]) - np.maximum(own["y0"], left["y0"]))
    area = (own["x1"] - own["x0"]) * (own["y1"] - own["y0"])
    share = np.divide(wide * high, area, out=np.zeros(len(area)), where=area > 0)
    return own | {"other": left["cell"], "share": share}


def with_ids(c: Chunk) -> Chunk:
    """Cells of one method with table_id by reading order on the page: y0, x0, then text."""
    order = np.lexsort((c["x0"], c["y0"], c["pid"]))
    same = ~firsts(c["pid"][order], c["y0"][order], c["x0"][order])
    if same.any():
        own = pa.table({"pid": c["pid"], "y0": c["y0"], "x0": c["x0"], "text": c["text"].cast(pa.binary())})
        order = pc.sort_indices(own, [(k, "ascending") for k in own.column_names]).to_numpy()
    c = taken(c, order)
    n = _within(np.arange(len(order)), firsts(c["pid"])) if len(order) else order
    text = lambda v: pa.array(v).cast(pa.string())
    return c | {"table_id": pc.binary_join_element_wise("p", text(c["page"]), "-t", pc.utf8_lpad(text(n), 2, "0"), "")}
