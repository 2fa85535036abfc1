"""Mixing sources to target weights, by soft membership.

A classifier, fitted on a bounded sample of a labelled table, gives each document its posterior over domains. Document
rates, nonnegative, are then fitted so that the expected tokens of each domain, the sum over documents of rate x tokens
x posterior, match target shares of the corpus: least squares by projected gradient with momentum. In the metric that
weighs a document by its tokens, a step changes a rate by the product of its posterior with one vector of the domains'
residuals. So a document's rate follows from its posterior and the steps so far: an iteration is one pass over the
table of posteriors that sums tokens by domain, nothing is rewritten, and only as many numbers as domains reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import LABELLED_ROWS, labelled_texts, small_batches, table, written

#: Hashed pairs of bytes that a text is described by.
BUCKETS = 512
#: Domains of the query: languages of documents of quality, and the rest; and what they should make up of the tokens.
TARGETS = {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, "junk": 0.05}
#: Steps at most, how near each domain's share must come, and steps without progress after which the fit is as near as it gets.
STEPS, CLOSE, PATIENCE = 600, 1e-4, 60


def pair_shares(text: str | None) -> tuple[np.ndarray, int]:
    """Square roots of the shares of hashed byte pairs in a whole text, and its number of words."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    words = int((blank[:-1] > blank[1:]).sum() + (not blank[0])) if len(data) else 0
    if len(data) < 2:
        return np.zeros(BUCKETS, np.float32), words
    pairs = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
    pairs = (pairs * np.uint32(2654435761)) >> np.uint32(23)
    return np.sqrt(np.bincount(pairs, minlength=BUCKETS) / len(pairs)).astype(np.float32), words


#: Texts whose shares are held at once; only a bound on memory.
BLOCK = 256


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0)))

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def described(texts: list[str | None], model: Classifier) -> tuple[list[int], np.ndarray]:
    """Numbers of words and posteriors of texts, a block at a time."""
    n, p = [], [np.zeros((0, len(model.domains)))]
    for at in range(0, len(texts), BLOCK):
        found = [pair_shares(t) for t in texts[at : at + BLOCK]]
        n += [k for _, k in found]
        p.append(model.posteriors(np.array([x for x, _ in found], np.float64)))
    return n, np.concatenate(p)


def learn(x: np.ndarray, y: np.ndarray, domains: list[str], steps: int = 300, ridge: float = 1e-4) -> Classifier:
    """Multinomial logistic regression by accelerated gradient. With no rows, posteriors are equal."""
    k, n = len(domains), len(x)
    model = Classifier(domains, np.zeros((BUCKETS + 1, k)))
    if not n:
        return model
    wide = np.column_stack([x, np.ones(n, np.float32)]).astype(np.float32)
    truth = np.eye(k, dtype=np.float32)[y]
    rate = 2.0 * n / np.linalg.norm(wide.T @ wide, 2)
    w = before = np.zeros((BUCKETS + 1, k), np.float32)
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - before)
        z = wide @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        before, w = w, ahead - rate * (wide.T @ (p - truth) / n + ridge * ahead).astype(np.float32)
    model.weights = w.astype(np.float64)
    return model


def fit(labelled: DataFrame, domains: list[str]) -> Classifier:
    """From rows (text, domain), a bounded table. Other domains are left out."""
    small_batches(labelled.sparkSession)

    @F.arrow_udf("array<float>")
    def shares(texts: pa.Array) -> pa.Array:
        return pa.array([pair_shares(t)[0] for t in texts.to_pylist()], pa.list_(pa.float32()))

    got = labelled.where(F.col("domain").isin(domains)).select("domain", shares("text").alias("x")).collect()  # bounded
    got.sort(key=lambda r: (r["domain"], r["x"]))
    return learn(np.array([r["x"] for r in got], np.float32).reshape(-1, BUCKETS), np.array([domains.index(r["domain"]) for r in got], np.int64), domains)


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with n_tokens and p, the posterior over the model's domains, in place of columns of those names. Null texts are empty."""
    docs = docs.drop("n_tokens", "p")
    small_batches(docs.sparkSession)
    kind = pa.struct([("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<n_tokens:long,p:array<double>>")
    def of(texts: pa.Array) -> pa.Array:
        words, p = described(texts.to_pylist(), model)
        return pa.array([{"n_tokens": n, "p": q} for n, q in zip(words, p.tolist(), strict=True)], kind)

    return docs.select("*", of("text").alias("__of")).select(*docs.columns, F.col("__of.n_tokens").alias("n_tokens"), F.col("__of.p").alias("p"))


def rates_after(p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and the point ahead of them at which the next gradient is taken, after steps (momentum, change)."""
    rate = ahead = np.ones(len(p))
    for momentum, change in steps:
        new = np.maximum(0.0, ahead - p @ change)
        ahead = np.maximum(0.0, new + momentum * (new - rate))
        rate = new
    return rate, ahead


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def solve(table_of: DataFrame, targets: np.ndarray, most: int = STEPS, close: float = CLOSE) -> list[tuple[float, np.ndarray]]:
    """Steps whose rates make the expected token shares of the domains equal to ``targets``, as nearly as they can be.

    Targets that no rates reach, or not within ``most`` steps, are reported by a warning with what remains.
    """
    k = len(targets)

    def sums(steps: list) -> np.ndarray:
        """Of the rates and of the point ahead: tokens of each domain; at first also the Gram matrix of the posteriors."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * k + k * k)
            for b in batches:
                n, p = b.column(0).to_numpy().astype(np.float64), _matrix(b.column(1), k)
                rate, ahead = rates_after(p, steps)
                total[:k] += (n * rate) @ p
                total[k : 2 * k] += (n * ahead) @ p
                if not steps:
                    total[2 * k :] += ((p * n[:, None]).T @ p).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

        rows = table_of.select("n_tokens", "p").mapInArrow(of, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(2 * k + k * k)
        for r in rows:
            out[r["i"]] = r["x"]
        return out

    steps: list[tuple[float, np.ndarray]] = []
    tokens = scale = 0.0
    t, last = 1.0, np.inf
    nearest, idle = np.inf, 0
    for _ in range(most + 1):
        found = sums(steps)
        if not steps:
            tokens = found[:k].sum()
            if not tokens:
                return []
            scale = float(np.linalg.eigvalsh(found[2 * k :].reshape(k, k) / tokens)[-1])
        off = found[:k] / tokens - targets
        away = float(np.abs(off).max())
        nearest, idle = (away, 0) if away < 0.99 * nearest else (nearest, idle + 1)
        if away < close:
            break
        if idle == PATIENCE or len(steps) == most:
            warnings.warn(f"shares of tokens differ from their targets by {np.round(off, 5).tolist()} after {len(steps)} steps", stacklevel=2)
            break
        loss = float(off @ off)
        if loss > last:  # momentum starts afresh when it overshoots
            t = 1.0
        last = loss
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        steps.append(((was - 1) / t, (found[k : 2 * k] / tokens - targets) / scale))
    return steps


def with_rates(docs: DataFrame, model: Classifier, targets: dict[str, float], column: str = "rate") -> DataFrame:
    """docs with n_tokens, domain (the likeliest) and the fitted rate: how often the document should be seen.

    Every row has its own rate, repeated rows equal ones; a text without words has no tokens and doesn't weigh in the
    fit, but has a rate by its posterior. Null texts are empty, and a text of any length is read whole. An empty table gives
    an empty result; columns of ``docs`` named as one of the new ones are replaced.
    """
    docs = docs.drop("n_tokens", "domain", column)
    weights = np.array([targets[d] for d in model.domains], np.float64)
    weights /= weights.sum()
    spark = docs.sparkSession
    memo = written(with_posteriors(docs.select("text"), model).select("n_tokens", "p"), "posteriors")
    small_batches(spark)
    steps = solve(memo, weights)
    small_batches(spark)
    kind = pa.struct([("n_tokens", pa.int64()), ("domain", pa.string()), ("rate", pa.float64())])

    @F.arrow_udf("struct<n_tokens:long,domain:string,rate:double>")
    def final(texts: pa.Array) -> pa.Array:
        words, p = described(texts.to_pylist(), model)
        rates = rates_after(p, steps)[0].tolist()
        return pa.array([{"n_tokens": n, "domain": model.domains[i], "rate": r} for n, i, r in zip(words, p.argmax(axis=1), rates, strict=True)], kind)

    return docs.select("*", final("text").alias("__final")).select(*docs.columns, F.col("__final.n_tokens").alias("n_tokens"), F.col("__final.domain").alias("domain"), F.col("__final.rate").alias(column))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and domain of a bounded sample of labelled documents: the language where quality is 1, else junk."""
    rows = labelled_texts(docs, labels, "quality", F.lit(True), LABELLED_ROWS, ("lang",))
    return rows.select("text", F.when(F.col("y") == 1, F.col("lang")).otherwise(F.lit("junk")).alias("domain"))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's id and source, with n_tokens, domain and rate; nulls, ties and repeated rows: as with_rates has them."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled(docs, table(spark, sf_dir, "labels")), list(TARGETS))
    return with_rates(docs.select("doc_id", "source", "text"), model, TARGETS).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with n_tokens, domain and rate; nulls, repeated rows, clashing names and empty tables: as with_rates has them."""
    return with_rates(docs, fit(labelled(docs, table(spark, sf_dir, "labels")), list(TARGETS)), TARGETS)
