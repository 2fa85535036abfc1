"""Windows of a text grouped by their minimizers.

Every window of ``length`` bytes has a minimizer: of its k-grams that with the smallest hash, the leftmost of equal
ones. Equal windows have equal minimizers at equal places. A run is a maximal series of window starts of one document
with the same minimizer occurrence, so all windows of all documents fall into runs, equal windows into runs of equal
minimizers, and two windows of one run are never equal.
"""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 16
#: Positions within one pass; longer texts are cut into pieces that overlap by a window less one byte.
POSITION_BITS = 26
PASS_BYTES = 1 << 22
PIECE_BYTES = 1 << 25


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position."""
    x = data.astype(np.uint16)
    x = x[:-1] | x[1:] << np.uint16(8)
    x = x.astype(np.uint32)
    x = x[:-2] | x[2:] << np.uint32(16)
    x = x.astype(np.uint64)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += x[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Of each run: text (its index), start, n (window starts), anchor (of the minimizer from the start), gram and the content's hash c1, c2."""
    out: dict[str, list] = {k: [] for k in ("text", "start", "n", "anchor", "gram", "c1", "c2")}
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE_BYTES):
            piece = t[at : at + PIECE_BYTES + length - 1] if len(t) > PIECE_BYTES else t
            if len(piece) < length:
                continue
            held.append((i, at, piece))
            size += len(piece)
            if size >= PASS_BYTES:
                _pass(held, length, out)
                held, size = [], 0
    if held:
        _pass(held, length, out)
    kinds = {"gram": np.int64, "c1": np.int64, "c2": np.int64}
    return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in out.items()}


def _pass(held: list, length: int, out: dict[str, list]) -> None:
    joined = b"".join(p for _, _, p in held)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    grams = gram_hashes(data)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    keys = grams & ~mask
    keys |= np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, length - GRAM + 1)
    where = (least & mask).astype(np.int64)
    valid = np.zeros(len(where) + 1, bool)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        valid[a : b - length + 1] = True
    valid = valid[: len(where)]
    first = valid.copy()
    first[1:] &= (where[1:] != where[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    stops = np.flatnonzero(last) + 1
    of = np.searchsorted(ends, starts, side="right")
    anchor = where[starts]
    view, digest = memoryview(joined), xxhash.xxh3_128_digest
    content = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), (stops + length - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
    offset = np.array([at for _, at, _ in held])
    out["text"].append(np.array([i for i, _, _ in held])[of])
    out["start"].append(starts - begins[of] + offset[of])
    out["n"].append(stops - starts)
    out["anchor"].append(anchor - starts)
    out["gram"].append(grams[anchor].view(np.int64))
    out["c1"].append(content[:, 0])
    out["c2"].append(content[:, 1])
