"""Words and word shingles of blocks of texts, as 64-bit hashes that are held against the bytes where results hang on them."""

from __future__ import annotations

import numpy as np

from .common import GOLDEN, eight_bytes, mix, ranges

BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def lower_case(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every word (a run of bytes but white space, ASCII letters lower-cased) and its text's row."""
    starts, ends, row = word_spans(data, offsets)
    return word_hashes(lower_case(data), starts, ends), ends - starts, row


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where every word starts and ends, and its text's row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = ~((data == 32) | (data >= 9) & (data <= 13))
    head = black.copy()
    head[1:] &= ~black[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    head[cut] |= black[cut]
    starts = np.flatnonzero(head)
    stop = np.ones(n + 1, bool)
    stop[:n] = ~black
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Words can be built that share one, so a hash only routes; see differing()."""
    n = len(low)
    if not n:
        return np.zeros(0, np.uint64)
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, INVERSE, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def differing(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether two words with one hash differ in their bytes."""
    order = np.argsort(hashes)
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return False
    a, b, size = order[same], order[same + 1], ends - starts
    if (size[a] != size[b]).any():
        return True
    eight = eight_bytes(low)
    head = eight[starts] >> (np.uint64(8) * np.maximum(8 - size, 0).astype(np.uint64))
    tail = eight[np.maximum(ends - 8, starts)]
    long = size > 8  # up to eight bytes are all in the head, up to sixteen in head and tail
    if (head[a] != head[b]).any() or (tail[a[long[a]]] != tail[b[long[a]]]).any():
        return True
    a, b = a[size[a] > 16], b[size[a] > 16]
    return bool((low[ranges(starts[a], size[a])] != low[ranges(starts[b], size[b])]).any())


def exact_shingles(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingle set itself."""
    own = text.lower().split()
    return set(zip(*(own[k:] for k in range(size)), strict=False)) if len(own) >= size else {tuple(own)} if own else set()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles, the number of its distinct shingles, and whether that is
    more: then two of its shingles share a hash. Equal hashes are held against the words' bytes."""
    starts, ends, row = word_spans(data, offsets)
    low = lower_case(data)
    hashes = word_hashes(low, starts, ends)
    flat, bounds, at = shingles_of(hashes, row, len(offsets) - 1, size)
    exact = not differing(low, starts, ends, hashes)
    sets, sizes, shared = [], np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, bool)
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        order = lo + np.argsort(flat[lo:hi])
        own = flat[order]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        sets.append(own[new])
        sizes[i] = len(sets[-1])
        again = np.flatnonzero(~new)
        one, two = at[order[again]], at[order[again - 1]]
        if not exact or any((hashes[one + k] != hashes[two + k]).any() for k in range(size)):
            sizes[i] = len(exact_shingles(data[offsets[i] : offsets[i + 1]].tobytes(), size))
            shared[i] = sizes[i] != len(sets[-1])
    return sets, sizes, shared


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `size` words, and the offsets of each text's in them. A text with fewer words is one
    shingle; a text without words has none."""
    hashes, _, row = words(data, offsets)
    return shingles_of(hashes, row, len(offsets) - 1, size)[:2]


def shingles_of(hashes: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingles() of words, and the first word of each shingle."""
    n_words = np.bincount(row, minlength=rows).astype(np.int64)
    first = np.cumsum(n_words) - n_words
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    if not len(hashes):
        return np.zeros(0, np.uint64), ends, np.zeros(0, np.int64)
    at = np.repeat(first - ends[:-1], count) + np.arange(ends[-1])
    room = np.repeat(first + n_words, count)  # where the text's words end
    out = np.full(len(at), GOLDEN, np.uint64) * np.uint64(size)
    for k in range(size):
        inside = at + k < room
        out = np.where(inside, mix(out * BASE + hashes[np.minimum(at + k, len(hashes) - 1)]), out)
    return out, ends, at
