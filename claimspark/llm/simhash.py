"""SimHash near-duplicates: fingerprints, bit-sliced comparison within blocks, connected components.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 2 of any 5 parts, so each fingerprint is dealt
into 10 blocks, one for each pair of parts, and no link is lost. Within a block, fingerprints are stored as bit planes:
64 fingerprints make one machine word a bit. A probe's distances to all 64 are counted at once with carry-save counters
(ones, twos, over), plane by plane, and a group of 64 is abandoned when all of it is over the radius. Blocks of many
different fingerprints are cut into tiles, and pairs of tiles are compared in different tasks. A task passes on a
spanning forest of the links that it finds, never all pairs of a group of copies.

The pipeline stage links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Two such sets
share one of the first hashes of each, of a number that follows from the size, by any order that all sets share. The order
here puts hashes that few documents hold first, so that postings of these prefixes bring all such pairs together and few
others. Postings are the blocks of the bit-sliced comparison, within a wide radius. Sizes and places leave fewer candidates:
where the first hash that two sets share has places i and j, they share no more than what follows these places. Links are
candidates whose sets are similar enough. First each set meets one set of each posting, that which has the fewest rarer
hashes, as the original of edited copies does; after that only sets of different components meet, so a group of near
copies never makes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from claimspark.llm.common import dropped, small_batches, table, written
from claimspark.llm.components import components
from claimspark.llm.grams import gram_hashes, spaced_word_hashes

SHINGLE = 3
RADIUS = 3
#: (first bit, number of bits) of the parts
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Of the pipeline stage: words of a shingle, the least Jaccard similarity, and the most differing bits of a candidate. At
#: a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3.
STAGE_SHINGLE, SIMILAR, STAGE_RADIUS = 5, 0.8, 22
#: Of the order of hashes: those that the most documents hold come last, so many at most (8 bytes each go to every task). A
#: task names what a share of its documents holds. Whatever they are, results are the same; only their cost differs.
FREQUENT, NAMED, COUNTED = 1 << 16, 1 / 2000, 1 << 21
#: Hashes that a task holds before they are counted; only a bound on memory.
MERGED = 1 << 18
#: Fingerprints of a block that one task compares with as many others.
TILE = 2048
#: Hashes that are counted at once; only a bound on memory.
HASHES = 1 << 16


def _shingles(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in pieces; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and the six ASCII spaces only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: -shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    for at in range(0, len(starts), HASHES):
        yield np.array([digest(view[a:b], seed) for a, b in zip(starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist(), strict=True)], np.uint64)


def _majority(pieces: Iterator[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in pieces:
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Bits that over half of the shingles' hashes have. A text without words has fingerprint 0."""
    return _majority(_shingles(text, shingle, seed))


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; a text of fewer words is one shingle, one without words has none."""
    words = spaced_word_hashes(text)
    return np.unique(gram_hashes(words, min(shingle, len(words)))) if len(words) else words


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """As signed 64-bit numbers."""
    out = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
    return pa.array(out.view(np.int64))


def _words(n: int) -> int:
    return (n + 63) // 64


def bit_planes(values: np.ndarray) -> np.ndarray:
    """[64, words]: bit i of word w of plane b is bit b of value 64 w + i."""
    padded = np.zeros(_words(len(values)) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Counters:
    """Carry-save counters of a bit each, 64 lanes a word, that say which lanes have counted over ``radius``.

    They start so far up that the count after ``radius`` runs over.
    """

    def __init__(self, n: int, radius: int) -> None:
        ahead = (1 << radius.bit_length()) - 1 - radius
        self.bits = [np.full(n, FULL if ahead >> i & 1 else 0, np.uint64) for i in range(radius.bit_length())]
        self.over = np.zeros(n, np.uint64)

    def add(self, d: np.ndarray) -> None:
        for i, have in enumerate(self.bits):
            self.bits[i], d = have ^ d, have & d
        self.over |= d

    def keep(self, live: np.ndarray) -> None:
        self.bits, self.over = [x[live] for x in self.bits], self.over[live]


def near_masks(probes: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """[probes, words]: bit i of word w says that value 64 w + i differs from the probe in at most ``radius`` bits."""
    n, w = len(probes), planes.shape[1]
    rows, cols = np.divmod(np.arange(n * w), w)
    counters, at = Counters(n * w, radius), np.arange(n * w)
    result = np.zeros(n * w, np.uint64)
    for b in range(64):
        flip = np.uint64(0) - ((probes[rows] >> np.uint64(b)) & np.uint64(1))
        counters.add(planes[b][cols] ^ flip)
        if b % 8 == 7:
            live = counters.over != FULL
            if not live.all():  # abandon the groups of 64 that are all over the radius
                rows, cols, at = (x[live] for x in (rows, cols, at))
                counters.keep(live)
                if not len(rows):
                    return result.reshape(n, w)
    result[at] = ~counters.over
    return result.reshape(n, w)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that keep together what links within the radius do: among ``left``, or between ``left`` and ``right``."""
    alike = right is None
    values = left if alike else np.concatenate([left, right])
    n, split = len(values), 0 if alike else len(left)
    target = bit_planes(values if alike else right)
    valid = (1 << n) - 1
    step = max(1, (1 << 17) // max(1, target.shape[1]))
    adjacent: list[int] = []
    probes = left
    for a in range(0, len(probes), step):
        masks = near_masks(probes[a : a + step], target, radius)
        adjacent += [int.from_bytes(m.tobytes(), "little") << split & valid for m in masks]
    if not alike:  # and back, from right to left
        planes = bit_planes(left)
        mine = (1 << split) - 1
        step = max(1, (1 << 17) // max(1, planes.shape[1]))
        for a in range(0, len(right), step):
            adjacent += [int.from_bytes(m.tobytes(), "little") & mine for m in near_masks(right[a : a + step], planes, radius)]
    return _spanning(adjacent, values)


def _spanning(adjacent: list[int], values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, by breadth-first search over rows of an adjacency matrix held as whole numbers."""
    links, unseen = [], (1 << len(values)) - 1
    while unseen:
        root = (unseen & -unseen).bit_length() - 1
        unseen &= ~(1 << root)
        todo = [root]
        while todo:
            v = todo.pop()
            new = adjacent[v] & unseen
            unseen &= ~new
            while new:
                low = new & -new
                u = low.bit_length() - 1
                new ^= low
                links.append((int(values[v]), int(values[u])))
                todo.append(u)
    return links


def _lanes(values: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Of values in blocks of 2 to 64, one after another: the lanes of the block that are within the radius, without its own.

    A block is one word of bit planes, so many blocks are compared at once.
    """
    block = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    lane = (np.arange(len(block)) - np.repeat(first, sizes)).astype(np.uint64)
    # a value's own lane and the unused lanes are over from the start
    valid = np.where(sizes == 64, FULL, (np.uint64(1) << sizes.astype(np.uint64) % np.uint64(64)) - np.uint64(1)).astype(np.uint64)
    counters = Counters(len(block), radius)
    counters.over |= ~valid[block] | (np.uint64(1) << lane)
    rows, at, probes = block, np.arange(len(block)), values
    result = np.zeros(len(block), np.uint64)
    for b in range(64):
        plane = np.bitwise_or.reduceat(((values >> np.uint64(b)) & np.uint64(1)) << lane, first)
        counters.add(plane[rows] ^ (np.uint64(0) - ((probes >> np.uint64(b)) & np.uint64(1))))
        if b % 8 == 7:
            live = counters.over != FULL
            if not live.all():
                rows, at, probes = (x[live] for x in (rows, at, probes))
                counters.keep(live)
                if not len(rows):
                    return result
    result[at] = ~counters.over
    return result


def _set_lanes(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane of each bit that is set."""
    hit = np.flatnonzero(masks)
    bits = np.unpackbits(masks[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, lanes = np.nonzero(bits)
    return hit[r], lanes


def _gathered(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places from each start to its end, one block after another."""
    sizes = ends - starts
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _small_blocks(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many blocks of 2 to 64 values at once."""
    sizes = ends - starts
    block = np.repeat(np.arange(len(starts)), sizes)
    values = fps[_gathered(starts, ends)]
    result = _lanes(values, sizes, radius)
    first = np.cumsum(sizes) - sizes
    a, lanes = _set_lanes(result)
    other = first[block[a]] + lanes
    # many links among few values, as among copies, are thinned to a spanning forest
    degree = np.bincount(block[a], minlength=len(starts))
    dense = degree > 4 * sizes
    thinned = [x for k in np.flatnonzero(dense) for x in _spanning(result[first[k] : first[k] + sizes[k]].tolist(), values[first[k] : first[k] + sizes[k]])]
    keep = (a < other) & ~dense[block[a]]
    more = np.array(thinned, np.uint64).reshape(-1, 2)
    return np.concatenate([values[a[keep]], more[:, 0]]), np.concatenate([values[other[keep]], more[:, 1]])


def links_in_blocks(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """From rows (key, tile_a, tile_b, side, fp) sorted by the first four: links (a, b)."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64))], ["a", "b"])

    rest = None
    for batch in [*batches, None] if isinstance(batches, list) else _and_none(batches):
        if batch is not None:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        key, ta, tb, side, fp = rest
        fp = fp.astype(np.int64).view(np.uint64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
        bounds = np.concatenate([[0], cut, [len(key)]])
        if batch is not None:  # the last block may go on
            bounds, tail = bounds[:-1], bounds[-2]
            rest = [x[tail:] for x in rest]
        else:
            rest = None
        starts, ends = bounds[:-1], bounds[1:]
        sizes = ends - starts
        tiled = np.zeros(len(starts), bool) if not len(starts) else ta[starts] != tb[starts]
        small = (sizes > 1) & (sizes <= 64) & ~tiled
        if small.any():
            s, e = starts[small], ends[small]
            for i in range(0, len(s), 4096):
                a, b = _small_blocks(fp, s[i : i + 4096], e[i : i + 4096], radius)
                if len(a):
                    yield out(a, b)
        for k in np.flatnonzero((sizes > 64) & ~tiled | tiled & (sizes > 1)):
            own = fp[starts[k] : ends[k]]
            if tiled[k]:
                of = side[starts[k] : ends[k]]
                left, right = own[of == 0], own[of == 1]
                links = forest(left, right, radius) if len(left) and len(right) else []
            else:
                links = forest(own, None, radius)
            if links:
                a, b = np.array(links, np.uint64).T
                yield out(a, b)


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps: a table of distinct fingerprints in column fp. Links (a, b) that connect all that differ in at most ``radius`` bits."""
    keys = []
    for t, pair in enumerate(combinations(PARTS, 2)):
        key = F.lit(t).cast("long")
        for first, n in pair:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << n) - 1).cast("long")))
        keys.append(key)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = dealt.join(counts, "key").select("key", "fp", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("mine", mine)
    dealt = dealt.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp")
    dealt = dealt.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "side")
    return dealt.mapInArrow(lambda batches: links_in_blocks(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other; rows with a null doc_id take part and get the
    component of their texts, whose id is null only if no row of it has one. Repeated rows stay. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("fp")), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = written(near_links(groups.select("fp"), radius), "links")
    of = components(links)
    joined = groups.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts: hashes that a share of a task's documents holds, and how many do."""
    known, counts, docs = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    held: list[np.ndarray] = []
    size = 0

    def merge() -> None:
        nonlocal known, counts, held, size
        new, times = np.unique(np.concatenate(held) if held else known[:0], return_counts=True)
        held, size = [], 0
        at = np.searchsorted(known, new)
        old = np.zeros(len(new), bool)
        inside = at < len(known)
        old[inside] = known[at[inside]] == new[inside]
        counts[at[old]] += times[old]
        known, counts = np.insert(known, at[~old], new[~old]), np.insert(counts, at[~old], times[~old])
        if len(known) > COUNTED:  # those that fewest documents hold are forgotten
            most = np.argpartition(counts, -COUNTED // 2)[-COUNTED // 2 :]
            most.sort()
            known, counts = known[most], counts[most]

    for b in batches:
        for t in b.column(0).to_pylist():
            held.append(shingle_set(t))
            size += len(held[-1])
            docs += 1
            if size >= MERGED:
                merge()
    merge()
    often = counts >= max(2, docs * NAMED)
    yield pa.RecordBatch.from_arrays([pa.array(known[often].view(np.int64)), pa.array(counts[often])], ["key", "n"])


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Hashes that many documents hold, at most ``most``, rarer ones first; counted over all documents."""
    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most).collect()
    return np.array([r["key"] for r in rows[::-1]], np.int64).view(np.uint64)


SETS = "k1 long, k2 long, id long, n int, fp long, prefix array<long>"


def _sets_of(frequent: np.ndarray):
    """From rows (k1, k2, text): the text's set, by its id (a hash of all its hashes), size, fingerprint and prefix."""
    order = np.argsort(frequent)
    known = frequent[order]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, fps, prefixes = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_set(t)
                ids.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes()))
                sizes.append(len(h))
                fps.append(_majority(iter([h])))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, order[at], -1), kind="stable")]
                prefixes.append(h[: prefix_length(len(h))].view(np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = pa.array(np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32))
            values = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), longs(ids), pa.array(sizes, pa.int32()), longs(fps), pa.ListArray.from_arrays(offsets, values)], ["k1", "k2", "id", "n", "fp", "prefix"])

    return of


def prefix_length(n: int, similar: float = SIMILAR) -> int:
    """So many of the first hashes of a set of ``n`` hold one that any set as similar as that has among its own."""
    return n - math.ceil(similar * n - 1e-9) + 1 if n else 0


def least_shared(n: Column, m: Column) -> Column:
    """How many hashes sets of ``n`` and ``m`` share at least, if they are SIMILAR."""
    return F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (n + m) - 1e-9)


def _hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).astype("<u8").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "hashes"])


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, ta, tb, side, id, n, fp, root, pos) sorted by the first three: pairs (a, b) of near fingerprints, of different roots."""
    rest = None
    for batch in _and_none(batches):
        if batch is not None:
            cols = [batch.column(i).to_numpy() for i in range(9)]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        key, ta, tb, side, ids, n, fp, root, pos = rest
        fp = fp.astype(np.int64).view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1, [len(key)]])
        if batch is not None:  # the last block may go on
            bounds = bounds[:-1]
            rest = [x[bounds[-1] :] for x in rest]
        if len(bounds) < 2:
            continue
        starts, ends = bounds[:-1], bounds[1:]
        mixed = np.minimum.reduceat(root[: bounds[-1]], starts) < np.maximum.reduceat(root[: bounds[-1]], starts)
        small = mixed & (ends - starts <= 64) & (ta[starts] == tb[starts])
        pairs = []

        def met(i: np.ndarray, j: np.ndarray) -> None:
            near = (root[i] != root[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= np.ceil(SIMILAR / (1 + SIMILAR) * (n[i] + n[j]) - 1e-9))
            if near.any():
                pairs.append((ids[i[near]], ids[j[near]]))

        for at in range(0, int(small.sum()), 4096):
            s, e = starts[small][at : at + 4096], ends[small][at : at + 4096]
            places = _gathered(s, e)
            a, lanes = _set_lanes(_lanes(fp[places], e - s, STAGE_RADIUS))
            first = np.repeat(np.cumsum(e - s) - (e - s), e - s)
            b = first[a] + lanes
            met(places[a[a < b]], places[b[a < b]])
        for k in np.flatnonzero(mixed & ~small):
            own = np.arange(starts[k], ends[k])
            alike = ta[starts[k]] == tb[starts[k]]
            left, right = (own, own) if alike else (own[side[own] == 0], own[side[own] == 1])
            if not len(left) or not len(right):
                continue
            planes = bit_planes(fp[right])
            for at in range(0, len(left), 256):
                masks = near_masks(fp[left[at : at + 256]], planes, STAGE_RADIUS)
                row, lanes = _set_lanes(masks.reshape(-1))
                i, j = left[at + row // planes.shape[1]], row % planes.shape[1] * 64 + lanes
                i, j = i[j < len(right)], right[j[j < len(right)]]
                met(i[i < j] if alike else i, j[i < j] if alike else j)
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


@F.arrow_udf(BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= SIMILAR - 1e-9 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


def similar_roots(own: DataFrame, texts: DataFrame, tile: int = TILE) -> DataFrame:
    """node and root of the sets (ids) that links of similarity SIMILAR or more connect. own: SETS, of all rows; texts: k1, k2, text."""
    groups = own.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "fp", "prefix")))
    prefixes = groups.select(F.posexplode("prefix").alias("pos", "key"), "id", "n", "fp")
    counts = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(prefixes.join(counts, "key"), "postings")
    firsts = own.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("row"))

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sets are similar; sets are made anew from the texts of one document each."""
        pairs = written(pairs, "candidates")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        rows = ids.join(firsts, "id").select("id", "row.k1", "row.k2")
        sets = written(texts.join(rows, ["k1", "k2"]).select("id", "text").mapInArrow(_hashes_of, "id long, hashes binary").dropDuplicates(["id"]), "sets-of-candidates")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b")), "b")
        links = written(both.where(_similar("of_a", "of_b")).select("a", "b"), "links")
        dropped(pairs, sets)
        return links

    centres = shared.groupBy("key").agg(F.min(F.struct("pos", "id", "n", "fp")).alias("first"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= STAGE_RADIUS) & (F.least(F.col("n") - F.col("pos"), F.col("first.n") - F.col("first.pos")) >= least_shared(F.col("n"), F.col("first.n")))
    stars = shared.join(centres, "key").where((F.col("id") != F.col("first.id")) & near)
    stars = stars.select(F.least("first.id", "id").alias("a"), F.greatest("first.id", "id").alias("b")).distinct()
    links = checked(stars)
    roots = written(components(links), "roots")
    dealt = written(shared.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    dropped(shared)
    # of a posting in which all have one root, nothing is left to find
    mixed = dealt.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    tiles = dealt.join(mixed, "key", "left_semi").select("key", "id", "n", "fp", "root", "pos", F.ceil(F.col("members") / tile).cast("int").alias("tiles"))
    tiles = tiles.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiles = tiles.select("key", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "n", "fp", "root", "pos")
    met = tiles.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb").mapInArrow(_candidates, "a long, b long").distinct()
    rest = checked(met)
    dropped(dealt)
    # links between components are few; they join the components' roots
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    between = rest.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = written(components(between).select(F.col("node").alias("root"), F.col("root").alias("whole")), "joined-roots")
    known = roots.join(joined, "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
    new = joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("whole").alias("root"))
    return known.unionByName(new)


def similar_components(docs: DataFrame) -> DataFrame:
    """k1, k2 and component (a number) of every row; keyed: docs with k1, k2 and text. Texts without words are alike."""
    small_batches(docs.sparkSession)
    own = written(docs.select("k1", "k2", "text").mapInArrow(_sets_of(frequent_shingles(docs)), SETS), "sets")
    of = similar_roots(own, docs.select("k1", "k2", "text"))
    return own.select("k1", "k2", "id").join(of.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("component"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id, of several the one with the least hash of its text.

    Rows are told apart by doc_id and text, so different texts of one id, or of none, are documents of their own; a null
    doc_id comes last, and repeated rows count once. Null and empty texts are alike. Other columns stay as they are, whatever
    their names; of repeated rows that differ in other columns, any one stays. An empty table gives an empty result.
    """
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keys = {"k1": k1, "k2": F.xxhash64(F.coalesce("text", F.lit("")))}
    found = similar_components(docs.select(*(v.alias(k) for k, v in keys.items()), "text"))
    kept = found.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("row")).select(F.col("row.k1").alias("__k1"), F.col("row.k2").alias("__k2"))
    own = docs.select(F.struct(*docs.columns).alias("row"), *(v.alias(f"__{k}") for k, v in keys.items()))
    return own.join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select("row.*")
