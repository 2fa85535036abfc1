"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Benchmark items are a stated query set: they are taken in blocks of bounded bytes, and each block is held against all
documents, so that what a task holds of the benchmark never grows with it. Every n-gram of an item is a seed, however
many documents hold it, so copies are found alike whether an item has leaked into one document or into most. Items that
share frequent n-grams with a document are sorted out by bounds that no alignment over the threshold can break: how
many of the item's words the document holds at all, and within as many words as an alignment can span. The rest is
aligned there. Words are matched by hash; the score is the alignment's share of a perfect one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import small_batches, table
from claimspark.llm.grams import gram_hashes, word_hashes

GRAM = 3
#: Bytes of item texts that one pass holds.
BLOCK_BYTES = 8 << 20
#: Shares of a perfect alignment from which a document counts as contaminated.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
HITS = "doc_id long, item_id long, score double, start_word int, end_word int"


@dataclass
class Items:
    """A block of the benchmark: words of each item, and its n-grams, sorted, with their items and places."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray


def block_of(rows: list[tuple[int, str | None]], gram: int = GRAM) -> Items:
    """Items of fewer words than an n-gram have no seeds: only a text of just these words holds them. Empty and null ones are in none."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    words = [word_hashes(t) for _, t in rows]
    grams = [gram_hashes(w, gram) for w in words]
    item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    return Items([r[0] for r in rows], words, every[order], item[order], place[order])


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best score, and where its alignment starts and ends in ``words``."""
    n = len(words)
    at = np.arange(n + 1)
    h, start = np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for w in item:
        new, origin = np.zeros(n + 1, np.int64), at.copy()
        diagonal = h[:-1] + np.where(words == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        take = np.maximum(diagonal, up)
        origin[1:] = np.where(take > 0, np.where(diagonal >= up, start[:-1], start[1:]), at[1:])
        new[1:] = np.maximum(take, 0)
        # a gap along the words: the largest earlier cell less its distance
        shifted = new - GAP * at
        run = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == run, at, 0))
        along = run + GAP * at
        longer = along > new
        origin = np.where(longer, origin[source], origin)
        new = np.where(longer, along, new)
        h, start = new, origin
        top = int(h.argmax())
        if h[top] > best[0]:
            best = (int(h[top]), int(start[top]), top)
    return best


def regions(held: np.ndarray, span: int, least: float) -> list[tuple[int, int]]:
    """(start, end) of the runs of places that lie in windows of ``span`` places with ``least`` or more held ones."""
    n = len(held)
    sums = np.concatenate([[0], np.cumsum(held)])
    ends = np.minimum(np.arange(n) + span, n)
    begins = np.flatnonzero(sums[ends] - sums[:n] >= least)
    if not len(begins):
        return []
    new = np.flatnonzero(begins[1:] > ends[begins[:-1]]) + 1
    return list(zip(begins[np.append(0, new)].tolist(), ends[begins[np.append(new - 1, -1)]].tolist(), strict=True))


def leaks_in(text: str | None, seeds: Items, threshold: float = THRESHOLD, gram: int = GRAM) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, word after the last) of each item that the text holds a copy of.

    A copy shares two n-grams with its item, or the only one that the item has. An item of fewer words is held by a text that
    has these words and no others.
    """
    words = word_hashes(text)
    if len(words) < gram:
        return [(n, 1.0, 0, len(words)) for n, item in zip(seeds.ids, seeds.words, strict=True) if len(words) and np.array_equal(item, words)]
    grams = gram_hashes(words, gram)
    if not len(seeds.grams):
        return []
    distinct = np.unique(grams)
    first, last = np.searchsorted(seeds.grams, distinct), np.searchsorted(seeds.grams, distinct, side="right")
    counts = last - first
    row = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(row):
        return []
    shared, places = np.unique(seeds.item[row], return_counts=True)  # a row is a place of an item
    sizes = np.array([len(seeds.words[i]) for i in shared.tolist()])
    some = places >= np.minimum(2, sizes - gram + 1)
    shared, sizes = shared[some], sizes[some]
    if not len(shared):
        return []
    known = np.unique(words)
    every = np.concatenate([seeds.words[i] for i in shared.tolist()])
    occurs = known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every
    within = np.add.reduceat(occurs.astype(np.int64), np.cumsum(sizes) - sizes)
    out = []
    for i, m in zip(shared[within >= threshold * sizes].tolist(), sizes[within >= threshold * sizes].tolist(), strict=True):
        item = seeds.words[i]
        # matches - 1/2 (mismatches + gaps) >= threshold x m: so many matches at least, and so many words' gaps at most
        span = m + int(2 * m * (1 - threshold))
        best: tuple[int, int, int] | None = None
        for low, high in regions(np.isin(words, item), span, threshold * m):
            score, s, e = align(item, words[low:high])
            if best is None or score > best[0]:
                best = (score, low + s, low + e)
        if best and best[0] >= threshold * MATCH * m:
            out.append((seeds.ids[i], best[0] / (MATCH * m), best[1], best[2]))
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items (id, text) in blocks of about ``most`` bytes, dealt by the hash of their ids."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if r[0] is not None]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score and the words of each copy of an item, edited ones included, that a document holds.

    Null and empty texts and items are in no row, nor are items with a null id; a null doc_id stays
    null; repeated documents each have their rows, and several items of one id are all looked for. Other columns are
    ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    found = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for part in blocks(benchmark):
        seeds = block_of(part)

        def search(batches: Iterator[pa.RecordBatch], seeds: Items = seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(d, *leak) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for leak in leaks_in(text, seeds, threshold)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in HITS.split(", ")])

        hits = rows.mapInArrow(search, HITS)
        found = hits if found is None else found.unionByName(hits)
    small_batches(spark)
    return found if found is not None else spark.createDataFrame([], HITS)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items, as ``contaminated`` has them."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _holds_any(seeds: Items, threshold: float):
    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([bool(leaks_in(t, seeds, threshold)) for t in texts.to_pylist()], pa.bool_())

    return of


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no copy of a benchmark item. Rows without doc_id are judged by their own texts too."""
    kept = docs
    for part in blocks(table(spark, sf_dir, "benchmark")):
        seeds = block_of(part)
        kept = kept.where(~_holds_any(seeds, threshold)("text"))
    small_batches(spark)
    return kept
