"""Word shingles as 64-bit hashes, from the UTF-8 bytes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lodestat.llm.common import BLOCK_BYTES, blocks, mix64, splitmix

WIDTH = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BYTE = splitmix(256, 11)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = splitmix(WIDTH + 1, 13) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n - 1) and their inverses modulo 2^64, kept for blocks of usual size."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = (np.full(size, x, dtype=np.uint64) for x in (base, inverse))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 4 * BLOCK_BYTES:
            return up[:n], down[:n]
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of lower-cased ``body`` (A-Z only) and the index of its text; texts begin at ``starts``."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[body]
    solid = ~SPACE[low]
    begins = starts[starts < n]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.logical_not(solid[:-1], out=fresh[1:])
    fresh[begins] = True
    ends = np.empty(n, bool)
    ends[-1] = True
    np.logical_not(solid[1:], out=ends[:-1])
    ends[begins[begins > 0] - 1] = True
    a, b = np.flatnonzero(solid & fresh), np.flatnonzero(solid & ends) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[low] * up[:n], out=total[1:])
    return mix64((total[b] - total[a]) * down[a]), np.searchsorted(starts, a, side="right") - 1


def long_words(body: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, cut at white space into blocks."""
    out, at = [], 0
    first = np.zeros(1, np.int64)
    while at < len(body):
        stop = min(at + BLOCK_BYTES, len(body))
        if stop < len(body):
            gaps = np.flatnonzero(SPACE[body[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # a word longer than a block
                later = SPACE[body[stop:]]
                stop = stop + int(later.argmax()) + 1 if later.any() else len(body)
        out.append(word_hashes(body[at:stop], first)[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sequence(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WIDTH`` words."""
    n = len(words) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    return mix64(sum(words[i : i + n] * STEP[i] for i in range(WIDTH)))


def one_set(words: np.ndarray, runs: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct shingles of a text; fewer words than ``WIDTH`` are one shingle, no words none."""
    if len(words) >= WIDTH:
        return np.unique(sequence(words) if runs is None else runs)
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix64(np.sum(np.append(words, np.uint64(len(words))) * np.append(STEP[: len(words)], STEP[WIDTH]), keepdims=True))


def shingle_sets(body: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The set of every text of a batch, in order."""
    for start, stop in blocks(offsets):
        part = body[offsets[start] : offsets[stop]]
        if stop - start == 1 and len(part) > BLOCK_BYTES:
            yield one_set(long_words(part))
            continue
        words, owner = word_hashes(part, offsets[start:stop] - offsets[start])
        edges = np.searchsorted(owner, np.arange(stop - start + 1))
        runs = sequence(words)
        for i in range(stop - start):
            a, b = edges[i], edges[i + 1]
            yield one_set(words[a:b], runs[a : b - WIDTH + 1] if b - a >= WIDTH else None)
