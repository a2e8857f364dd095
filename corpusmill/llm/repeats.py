"""Bucket pointers over the bytes of one text, for the repeated-substring operator."""

from __future__ import annotations

import numpy as np

#: Bytes of a string that counts as repeated, and of the grams that anchors are chosen by.
LENGTH, GRAM = 100, 32
#: Low bits that hold a place while anchors are sought; longer texts are read in overlapping blocks.
PLACE = 24
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of a pair of buckets."""
    x = a * _M1
    x ^= x >> np.uint64(29)
    x += b
    x *= _M2
    x ^= x >> np.uint64(32)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def pointers(raw: np.ndarray) -> dict[int, np.ndarray]:
    """For 32 and 64 bytes, the bucket of every place: 4-byte buckets are the bytes themselves; each
    refinement pairs a place's bucket with that of a later offset, from the level before."""
    wide = raw.astype(np.uint64)
    at = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
    out, size = {}, 4
    while size < 64:
        at = mix(at[:-size], at[size:])
        size *= 2
        out[size] = at
    return {GRAM: out[32], 64: out[64]}


def window_ids(p: dict[int, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the LENGTH bytes from each start."""
    a, b = p[64][starts], p[64][starts + (LENGTH - 64)]
    return mix(a, b), mix(b ^ _M3, a)


def cells(p: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: (anchor's bucket, hull's bucket, first start, runs' windows, anchor).

    A window's anchor is the place of its least gram, the first of equals: equal windows have it at the same
    offset. A run's hull is all the bytes of its windows."""
    grams = p[GRAM]
    n, width = len(grams), LENGTH - GRAM + 1
    low = np.uint64((1 << PLACE) - 1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n - width + 1], least[width - size :][: n - width + 1])
    anchor = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, len(anchor)))
    a = anchor[first]
    length = count + (LENGTH - 1)
    wide = p[64]
    hull = mix(mix(wide[first], wide[first + (length - 64) // 2]), wide[first + length - 64])
    hull = mix(hull, (length * 256 + (a - first)).astype(np.uint64))
    return grams[a], hull, first, count, a


#: Offsets between a window's start and its anchor run from 0 to LENGTH - GRAM; nodes hold at most so many of them.
NODE = 18


def _range_id(p: dict[int, np.ndarray], start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bucket of 64 to 128 bytes."""
    return mix(mix(p[64][start], p[64][start + length - 64]), length.astype(np.uint64))


def nodes(p: dict[int, np.ndarray], first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs split at fixed offsets from their anchor: (core's bucket, hull's bucket, first start, windows).

    The core is what every window with such offsets holds, whether the run has it or not; so equal windows
    lie in nodes of one core."""
    out = []
    for low in range(0, LENGTH - GRAM + 1, NODE):
        high = min(low + NODE - 1, LENGTH - GRAM)
        far, near = np.minimum(anchor - first, high), np.maximum(anchor - first - count + 1, low)
        some = far >= near
        a, far, near = anchor[some], far[some], near[some]
        core = mix(_range_id(p, a - low, np.full(len(a), LENGTH - (high - low))), np.full(len(a), low, np.uint64))
        hull = mix(_range_id(p, a - far, far - near + LENGTH), far.astype(np.uint64))
        out.append((core, hull, a - far, far - near + 1))
    return tuple(np.concatenate(x) for x in zip(*out))
