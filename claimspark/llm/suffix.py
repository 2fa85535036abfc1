"""Removal of repeated substrings by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too; or, where first occurrences are kept, if
such a string starts earlier too, by doc_id and place. The windows of a text fall into runs by their minimizers
(``windows``), so that equal windows of all documents meet at one minimizer:

1. A run whose minimizer occurs once holds nothing repeated. Runs of equal content are repeated as a whole; they are
   counted by content hash, and copies are never compared one by one.
2. What is left are runs that share a minimizer but differ, as at the edges of shared passages. They are cut on a grid
   of GRID window starts that is anchored at the minimizer. All windows of a grid cell hold the same LENGTH - GRID + 1
   bytes, the cell's core. Cells are dealt by their core's hash, so that a hot minimizer is split by content; a core
   that occurs once holds nothing repeated. A core of more than HOT cells, as where a much-quoted passage begins, is
   split further by the bytes beside it: each window of its cells is known by its hash, and windows are counted as runs
   are, so that no task gathers the holders of a passage.
3. A shard of the other cells is written as one sequence in which a core is a single symbol, and the bytes on either side
   are symbols of their own: each window is GRID symbols, and equal windows are equal substrings. The shard's suffix array
   is made by induced sorting (``sais``); permuted common prefixes of GRID or more mark repeated windows.

A document is known by its doc_id and a 64-bit hash of its text, a run by its minimizer's hash and its own, 128 bits in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimspark.llm.common import dropped, small_batches, table, written
from claimspark.llm.sais import repeated, repeated_later
from claimspark.llm.windows import runs

LENGTH, GRID = 400, 32
#: Of the pipeline stage, which looks for passages of over 50 words: of all strings of 51 words in the texts at hand, one in
#: a hundred is shorter.
STAGE_LENGTH = 240
#: Symbols of a shard that one suffix array is made of, about; a core's cells stay together.
SHARD = 1 << 18
#: Cells of a core that stay together at most; they make up to twice a shard.
HOT = 8192


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 and k2, which know a document; a null doc_id comes last."""
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.withColumns({"__k1": k1, "__k2": F.xxhash64(F.coalesce("text", F.lit("")))})


def _runs_of(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode("utf-8", "replace") for x in b.column(2).to_pylist()]
            r = runs(texts, length)
            own = [b.column(i).take(pa.array(r["text"])) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(r[k].astype(np.int32)) for k in ("start", "n", "anchor")), *(pa.array(r[k]) for k in ("gram", "c1"))],
                ["k1", "k2", "start", "n", "anchor", "gram", "c1"],
            )

    return of


RUNS = "k1 long, k2 long, start int, n int, anchor int, gram long, c1 long"
CELLS = "core long, k1 long, k2 long, s int, low int, high int, left binary, right binary"
SPANS = "k1 long, k2 long, s int, e int"
WINDOWS = "core long, c1 long, k1 long, k2 long, s int"


def _cells_of(length: int, grid: int):
    """From rows (k1, k2, text, wanted runs): cells of the runs, with the bytes on both sides of their cores."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for k1, k2, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                for w in wanted:
                    anchor = w["start"] + w["anchor"]
                    p, stop = w["start"], w["start"] + w["n"]
                    while p < stop:
                        k = (anchor - p) // grid  # starts from anchor - grid k - grid + 1 to anchor - grid k
                        first = anchor - grid * k - grid + 1
                        last = min(stop, first + grid)  # not included
                        low, high = p - first, last - 1 - first
                        core_at, core_end = first + grid - 1, first + length
                        core = xxhash.xxh64_intdigest(raw[core_at:core_end], (w["gram"] + k) & 0xFFFFFFFFFFFFFFFF)
                        core -= (core >> 63) << 64
                        for column, value in zip(out, (core, k1, k2, p, low, high, raw[p:core_at], raw[core_end : last - 1 + length]), strict=True):
                            column.append(value)
                        p = last
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in CELLS.split(", ")])

    return of


def _windows_of(grid: int):
    """From cells: a row for each window, known by its core and a hash of its bytes beside the core and of its place."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core, low, high = (b.column(i).to_numpy() for i in (0, 4, 5))
            hashes = []
            for c, a, z, left, right in zip(core.tolist(), low.tolist(), high.tolist(), b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True):
                hashes += [xxhash.xxh64_intdigest(left[j - a :] + right[:j], (c + j) & 0xFFFFFFFFFFFFFFFF) for j in range(a, z + 1)]
            times = high - low + 1
            own = np.repeat(np.arange(len(core)), times)
            starts = b.column(3).to_numpy()[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            columns = [pa.array(core[own]), pa.array(np.array(hashes, np.uint64).view(np.int64)), *(b.column(i).take(pa.array(own)) for i in (1, 2)), pa.array(starts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WINDOWS.split(", ")])

    return of


def _shard_spans(cells: pa.Table, length: int, grid: int, keep_first: bool) -> list[tuple[int, int, int]]:
    """(cell, start, end) of series of windows of a shard's cells that go."""
    _, ids = np.unique(cells.column(0).to_numpy(), return_inverse=True)
    ids = ids.reshape(-1)
    k1, k2, starts = (cells.column(i).to_numpy() for i in (1, 2, 3))
    lefts, rights = cells.column(6).to_pylist(), cells.column(7).to_pylist()
    left = np.array([len(x) for x in lefts])
    right = np.array([len(x) for x in rights])
    sizes = left + right + 2  # the core and a separator
    begins = np.cumsum(sizes) - sizes
    t = np.zeros(int(sizes.sum()) + 1, np.int64)
    core_at = begins + left
    bytes_in = np.ones(len(t) - 1, bool)
    bytes_in[core_at] = False
    bytes_in[begins + sizes - 1] = False
    t[:-1][bytes_in] = np.frombuffer(b"".join(x for pair in zip(lefts, rights, strict=True) for x in pair), np.uint8).astype(np.int64) + 2
    t[core_at] = 258 + ids
    t[begins + sizes - 1] = 1
    cell = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(cell)) - begins[cell]
    # a window never holds a separator, so what is equal over ``grid`` symbols from a window's start is a window
    if keep_first:  # a later place in a document has a higher rank, as has a later document; repeated rows have equal ranks
        place = starts[cell] + inside
        order = np.lexsort((place, k2[cell], k1[cell]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(k1[cell][order]) != 0) | (np.diff(k2[cell][order]) != 0) | (np.diff(place[order]) != 0)
        rank = np.zeros(len(t), np.int64)
        rank[order] = np.cumsum(new)
        again = repeated_later(t, grid, rank)
    else:
        again = repeated(t, grid)
    ok = np.zeros(len(t), bool)
    ok[: len(cell)] = again[:-1] & (inside <= left[cell]) & (inside + grid < sizes[cell])
    hits = np.flatnonzero(ok)
    if not len(hits):
        return []
    new = np.concatenate([[True], (hits[1:] != hits[:-1] + 1) | (cell[hits[1:]] != cell[hits[:-1]])])
    first, last = hits[new], hits[np.append(np.flatnonzero(new)[1:] - 1, len(hits) - 1)]
    c = cell[first]
    return list(zip(c.tolist(), (starts[c] + inside[first]).tolist(), (starts[c] + inside[last] + length).tolist(), strict=True))


def _shards_of(length: int, grid: int, shard: int, keep_first: bool):
    """From cells sorted by core: spans."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        symbols = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, symbols
            whole = pa.Table.from_batches(held).combine_chunks()
            cores = whole.column(0).to_numpy()
            upto = len(cores) if last else int(np.searchsorted(cores, cores[-1]))
            if upto == 0:
                held = whole.to_batches()
                return
            rest = whole.slice(upto)
            held = rest.to_batches() if rest.num_rows else []
            symbols = rest.num_rows * 2 * grid
            cores = cores[:upto]
            _, inverse, counts = np.unique(cores, return_inverse=True, return_counts=True)
            keep = np.flatnonzero(counts[inverse.reshape(-1)] > 1)  # a core that occurs once holds nothing repeated
            if not len(keep):
                return
            cells = whole.take(pa.array(keep))
            found = _shard_spans(cells, length, grid, keep_first)
            if found:
                c, s, e = (np.array(x) for x in zip(*found, strict=True))
                own = [cells.column(i).to_numpy()[c] for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["k1", "k2", "s", "e"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                symbols += b.num_rows * 2 * grid
                if symbols >= shard:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return of


def _again(rows: DataFrame, counted: DataFrame, by: list[str], place: str, keep_first: bool) -> DataFrame:
    """Of ``rows``, those that ``counted`` has several times by ``by``; without the first of each, if that is kept."""
    several = counted.where("times > 1")
    if not keep_first:
        return rows.join(several.select(*by), by, "left_semi")
    several = several.select(*by, F.struct("one.k1", "one.k2", f"one.{place}").alias("one"))
    return rows.join(several, by).where(F.struct("k1", "k2", place) != F.col("one")).drop("one")


def repeated_spans(docs: DataFrame, length: int = LENGTH, grid: int = GRID, shard: int = SHARD, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """k1, k2 (of documents that lose anything) and spans, an array of (s, e) in bytes that cover what goes."""
    small_batches(docs.sparkSession)
    texts = keyed(docs.select("doc_id", "text")).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text")
    found = written(texts.mapInArrow(_runs_of(length), RUNS), "runs")
    count = F.count(F.lit(1)).alias("times")
    by = ["gram", "c1"]
    contents = found.groupBy(*by).agg(count, F.min(F.struct("k1", "k2", "start", "n", "anchor")).alias("one"))
    grams = contents.groupBy("gram").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("differing"), F.sum((F.col("times") == 1).cast("long")).alias("alone")).where("total > 1")
    shared = written(contents.join(grams, "gram").where("times > 1 OR differing > 1"), "shared")
    whole = _again(found, shared, by, "start", keep_first).select("k1", "k2", F.col("start").alias("s"), (F.col("start") + F.col("n") + (length - 1)).alias("e"))
    whole = written(whole.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "whole")
    dropped(found)
    # each content's first run stands for it; where none is alone, all go anyway, unless first ones are kept
    wanted = shared.where("differing > 1" if keep_first else "differing > 1 AND alone > 0")
    wanted = wanted.select("one.k1", "one.k2", F.struct(F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.anchor").alias("anchor"), "gram").alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))  # as many as runs of one text
    cells = written(texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_cells_of(length, grid), CELLS), "cells")
    dropped(shared)
    cores = cells.groupBy("core").agg(F.count(F.lit(1)).alias("cells")).where("cells > 1")
    crowded = written(cores.where(F.col("cells") > hot).select("core"), "crowded")
    edges = cells.join(crowded, "core", "left_anti").repartition("core").sortWithinPartitions("core").mapInArrow(_shards_of(length, grid, shard, keep_first), SPANS)
    windows = cells.join(crowded, "core", "left_semi").mapInArrow(_windows_of(grid), WINDOWS)
    counted = windows.groupBy("core", "c1").agg(count, F.min(F.struct("k1", "k2", "s")).alias("one"))
    many = _again(windows, counted, ["core", "c1"], "s", keep_first).select("k1", "k2", "s", (F.col("s") + length).alias("e"))
    edges = edges.unionByName(many).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    both = whole.unionByName(written(edges, "edges"))
    dropped(cells, crowded)
    return both.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # as many as a document's runs and cells


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans cover."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def with_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """docs and a column __spans; nothing that goes: null.

    All copies lose what they share; with ``keep_first`` the first, by doc_id and place, keeps it. A null doc_id comes last.
    Repeated rows of one id and text are copies of each other like any other; with ``keep_first`` they are one document, and
    each keeps what the first keeps. Null texts are empty; texts shorter than ``length`` lose nothing; a text of any length
    is read in pieces. An empty table gives an empty result; columns besides doc_id and text stay as they are, and a column
    named as one of those that this adds (__k1, __k2, __spans) is replaced.
    """
    docs = docs.drop("__k1", "__k2", "__spans")
    spans = repeated_spans(docs, length, keep_first=keep_first).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    return keyed(docs).join(spans, ["__k1", "__k2"], "left").select(*docs.columns, "__spans")


DIGESTS = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


@F.arrow_udf(DIGESTS)
def digests(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        raw, removed = (text or "").encode("utf-8", "replace"), merged(found)
        out.append({"n_bytes": len(raw), "n_removed": sum(e - s for s, e in removed), "n_spans": len(removed), "kept_sha256": hashlib.sha256(_kept(raw, removed)).hexdigest()})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


@F.arrow_udf(StringType())
def kept_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Characters of which no byte is removed."""
    return pa.array([t if not s else _kept(t.encode("utf-8", "replace"), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    small_batches(spark)
    return docs.withColumn("d", digests("text", "__spans")).select("doc_id", "d.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = STAGE_LENGTH) -> DataFrame:
    """Texts without what is repeated, but for its first occurrence; documents of which nothing is left go.

    Other columns stay as they are; n_chars of a text that is cut is its new length. A null or empty text stays. Repeated
    rows, null ids, ties and empty tables: as ``with_spans`` has them.
    """
    rows = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))  # whatever they are named
    found = with_spans(rows, length, keep_first=True)
    cut = found.withColumn("kept", kept_text("text", "__spans")).where(F.col("__spans").isNull() | (F.trim("kept") != ""))
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__spans").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])
