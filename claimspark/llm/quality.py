"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is linear in its features. Each preference pair, a document labelled good and one labelled bad, is
won with the logistic of the difference of worths; the loss over all pairs of all labelled documents is minimized. Pairs
are never made: the loss of a pair depends on two worths only, so that documents are summed by their worth on a grid, and
pairs of grid points are weighed by their documents. Sums are made by a pass over the table of features; their number is
that of the grid. The threshold is a quantile of training scores, found by rank: the share of bad documents there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import dropped, fold_of, small_batches, table, written

#: Points of the grid of worths, on which a document counts at the two beside it; bins that curvature is summed in, which
#: decides only how soon the steps get there.
POINTS, BINS = 1024, 128
#: Of the squared weights, over the square root of the number of labelled rows; Newton steps at most, and the change that ends them.
RIDGE, STEPS, CLOSE = 0.02, 60, 1e-7
#: Worths that are gathered to find the one of a rank; while more are left, they are counted in bins.
GATHERED = 10_000
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MILD = b".,'-"
LOUD = bytes(set(PUNCTUATION) - set(MILD))
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def text_features(text: str | None) -> list[float]:
    """Of a whole text; an empty or null one has zeros and its own mark."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, k = len(raw), len(words)
    if not k:
        return [0.0] * 13 + [1.0]
    less = lambda chars: (n - len(raw.translate(None, chars))) / n
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    same_next = sum(map(bytes.__eq__, words, words[1:])) if k > 1 else 0
    most = max(Counter(words).values())
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!") + 1
    return [
        min(6.0, math.log1p(k)) / 6,
        min(1.0, 8 * less(LOUD)),
        min(1.0, 20 * less(DIGITS)),
        min(1.0, 3 * less(UPPER)),
        min(1.0, 20 * raw.count(b"!") / n),
        min(1.0, 10 * raw.count(b"|") / n),
        distinct / k,
        min(1.0, 2 * same_next / k),
        most / k,
        1 - len(set(lines)) / max(1, len(lines)),
        min(2.0, (n - k) / k / 6),
        min(1.0, k / stops / 40),
        min(1.0, math.log1p(k / (len(lines) or 1)) / 6),
        0.0,
    ]


N_FEATURES = 14


def expand(x: np.ndarray) -> np.ndarray:
    """Features and the squares of their distances from the middle."""
    return np.column_stack([x, (x - 0.5) ** 2])


N_WIDE = 2 * N_FEATURES


@dataclass
class Model:
    weights: np.ndarray
    #: Worth at the quantile, and how many logits a unit of worth is.
    cut: float
    scale: float
    at: float

    def worths(self, features: np.ndarray) -> np.ndarray:
        """A row's worth depends on that row alone, to the last bit."""
        return (expand(features.reshape(-1, N_FEATURES)) * self.weights).sum(axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """From 0 to 1; ``at`` where the worth is that of the quantile."""
        z = (self.worths(features) - self.cut) * self.scale + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of(features, labels)``, ``size`` numbers, over the batches of rows (f, y)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += of(_matrix(b.column(0)), b.column(1).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "x"])

    got = rows.select("f", "y").mapInArrow(each, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _range(rows: DataFrame, model: Model) -> tuple[float, float]:
    """The least and the largest worth."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = model.worths(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([w.min()]), pa.array([w.max()])], ["low", "high"])

    got = rows.select("f").mapInArrow(each, "low double, high double").agg(F.min("low"), F.max("high")).first()
    return got[0], got[1]


def _grid_sums(worth: np.ndarray, wide: np.ndarray, y: np.ndarray, low: float, step: float) -> np.ndarray:
    """Of bad and good rows: numbers and sums of features at grid points; numbers, sums and sums of products in bins."""
    out = []
    at = np.clip((worth - low) / step, 0, POINTS - 1)
    point = np.minimum(at.astype(np.int64), POINTS - 2)
    right = at - point
    bins = (at * (BINS / POINTS)).astype(np.int64)
    ones = np.column_stack([np.ones(len(wide)), wide])
    for good in (False, True):
        own = (y == 1) == good
        fine, p, r, x = np.zeros((POINTS, 1 + N_WIDE)), point[own], right[own], ones[own]
        for j in range(1 + N_WIDE):
            fine[:, j] = np.bincount(p, (1 - r) * x[:, j], POINTS) + np.bincount(p + 1, r * x[:, j], POINTS)
        coarse = np.zeros((BINS, 1 + N_WIDE, 1 + N_WIDE))
        for k in np.unique(bins[own]).tolist():
            inside = x[bins[own] == k]
            coarse[k] = inside.T @ inside
        out += [fine.reshape(-1), coarse.reshape(-1)]
    return np.concatenate(out)


def _loss(sums: np.ndarray, low: float, step: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs, its gradient and its curvature."""
    n, m = POINTS * (1 + N_WIDE), BINS * (1 + N_WIDE) ** 2
    bad, good = (sums[k : k + n].reshape(POINTS, -1) for k in (0, n + m))
    in_bad, in_good = (sums[k : k + m].reshape(BINS, 1 + N_WIDE, -1) for k in (n, 2 * n + m))
    pairs = bad[:, 0].sum() * good[:, 0].sum()
    ahead = step * (np.arange(POINTS)[:, None] - np.arange(POINTS))  # of the good one's worth
    lost = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
    loss = good[:, 0] @ np.logaddexp(0, -ahead) @ bad[:, 0] / pairs
    gradient = ((good[:, 0] @ lost) @ bad[:, 1:] - (lost @ bad[:, 0]) @ good[:, 1:]) / pairs
    p = 1 / (1 + np.exp(np.clip(step * POINTS / BINS * (np.arange(BINS)[:, None] - np.arange(BINS)), -500, 500)))
    p *= 1 - p
    cross = in_good[:, 0, 1:].T @ p @ in_bad[:, 0, 1:]
    own = np.tensordot(p @ in_bad[:, 0, 0], in_good[:, 1:, 1:], 1) + np.tensordot(in_good[:, 0, 0] @ p, in_bad[:, 1:, 1:], 1)
    return loss, gradient, (own - cross - cross.T) / pairs


def _of_rank(rows: DataFrame, model: Model, rank: int, low: float, high: float) -> float:
    """The worth that ``rank`` others precede in order, exactly."""
    below = 0
    while True:
        edges = np.linspace(low, high, POINTS + 1)
        counts = _summed(rows, lambda f, y: np.bincount(_bin(model.worths(f), edges), minlength=POINTS + 2).astype(float), POINTS + 2)  # noqa: B023
        if low == high:
            return low
        upto = np.cumsum(counts[1:-1])
        k = min(int(np.searchsorted(upto, rank - below, side="right")), POINTS - 1)
        below += int(upto[k - 1]) if k else 0
        left, n = edges[k], int(counts[1 + k])
        # a bin is from its left edge to before the next, the last bin to its right edge
        right = edges[k + 1] if k == POINTS - 1 and edges[k + 1] == high else np.nextafter(edges[k + 1], -np.inf)
        if n <= GATHERED or left >= right:
            break
        low, high = left, right
    if left >= right:
        return float(left)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.worths(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(w[(w >= left) & (w <= right)])], ["w"])

    found = np.sort(rows.select("f").mapInArrow(inside, "w double").toArrow().column(0).to_numpy())
    return float(found[min(rank - below, len(found) - 1)])


def _bin(worth: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 below all bins, then the number of the bin from 1, and one more above all."""
    found = np.searchsorted(edges, worth, side="right")
    found[worth == edges[-1]] = len(edges) - 1
    return found


def learn(rows: DataFrame, at: float = 0.3) -> Model:
    """Worths from all pairs of rows (f, y), a table; without both labels, all worths are equal."""
    zero = Model(np.zeros(N_WIDE), 0.0, 1.0, at)
    counts = {r["good"]: r["count"] for r in rows.groupBy((F.col("y") == 1).alias("good")).count().collect()}
    if len(counts) < 2:
        return zero
    n = sum(counts.values())
    ridge = RIDGE / n**0.5
    mean = _summed(rows, lambda f, y: expand(f).sum(axis=0), N_WIDE) / n  # pairs have differences only

    def sums(model: Model) -> tuple[float, np.ndarray, np.ndarray]:
        low, high = _range(rows, model)
        step = max(high - low, 1e-9) / (POINTS - 1)
        loss, gradient, curve = _loss(_summed(rows, lambda f, y: _grid_sums(model.worths(f), expand(f) - mean, y, low, step), 2 * (POINTS * (1 + N_WIDE) + BINS * (1 + N_WIDE) ** 2)), low, step)
        w = model.weights
        return loss + ridge / 2 * w @ w, gradient + ridge * w, curve + ridge * np.eye(N_WIDE)

    model, now = zero, sums(zero)
    for _ in range(STEPS):
        change = -np.linalg.solve(now[2], now[1])
        part = 1.0
        while True:
            ahead = Model(model.weights + part * change, 0.0, 1.0, at)
            then = sums(ahead)
            if then[0] <= now[0] or part * np.abs(change).max() < CLOSE:
                break
            part /= 2
        better = now[0] - then[0]
        if better > 0:
            model, now = ahead, then
        if better < 1e-10 or part * np.abs(change).max() < CLOSE:
            break
    model = Model(np.round(model.weights, 9), 0.0, 1.0, at)  # whatever order sums were made in
    low, high = _range(rows, model)
    rank = (n - 1) * (counts[False] / n)
    lower = _of_rank(rows, model, math.floor(rank), low, high)
    upper = lower if rank == math.floor(rank) else _of_rank(rows, model, math.floor(rank) + 1, low, high)
    model.cut = lower + (upper - lower) * (rank - math.floor(rank))
    return model


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([text_features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.select(*keep, of("text").alias("f"))


def fit(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> Model:
    """Learn from every labelled document outside the held-out fifth."""
    return fit_features(features(docs, ["doc_id"]), labels, at)


def fit_features(of: DataFrame, labels: DataFrame, at: float = 0.3) -> Model:
    """Learn from rows (doc_id, f), features of documents. An id with several labels takes the largest; null labels and ids are left out."""
    small_batches(of.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    usable = usable.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = written(of.select(F.col("doc_id").cast("long").alias("doc_id"), "f").join(usable, "doc_id").select("f", "y"), "labelled-features")
    model = learn(rows, at)
    dropped(rows)
    return model


def with_score(docs: DataFrame, model: Model, column: str = "quality") -> DataFrame:
    """docs and a column of scores from 0 to 1 of whole texts; null texts count as empty.

    A score follows from the text alone: equal texts have equal scores, each repeated row has its own, and a null doc_id
    makes no difference. A column named as the new one is replaced, others stay. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(np.array([text_features(t) for t in texts.to_pylist()])), pa.float64())

    return docs.withColumn(column, score(F.col("text")))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, nulls and repeats included, as ``with_score`` has it; a null doc_id isn't held out."""
    small_batches(spark)
    own = written(features(table(spark, sf_dir, "documents"), ["doc_id"]), "features")
    model = fit_features(own, table(spark, sf_dir, "labels"))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for f in batches:
            yield pa.array(model.scores(_matrix(f)), pa.float64())

    scored = own.select("doc_id", score("f").alias("score"))
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
