"""XXH64 of many byte spans at once (the published algorithm, in array arithmetic)."""

from __future__ import annotations

import numpy as np

#: Fixed values of the algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans go through the xxhash library.
LONG = 4096


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """uint64 XXH64 of data[start:end] for each span."""
    starts, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    half = np.ndarray((len(buf) - 3,), "<u4", buf, 0, (1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(starts), s + P5, np.uint64)
        big = np.flatnonzero((size >= 32) & (size <= LONG))
        if len(big):
            v = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            k = 0
            while True:
                on = np.flatnonzero(size[big] >= 32 * (k + 1))
                if not len(on):
                    break
                at = starts[big[on]] + 32 * k
                for j in range(4):
                    v[j][on] = _round(v[j][on], wide[at + 8 * j])
                k += 1
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                h = (h ^ _round(np.zeros(len(big), np.uint64), v[j])) * P1 + P4
            acc[big] = h
        acc += size.astype(np.uint64)
        at, rest = starts + (size & ~31), size & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            acc[on] = _rotl(acc[on] ^ _round(np.zeros(len(on), np.uint64), wide[at[on] + 8 * k]), 27) * P1 + P4
        at, rest = at + (rest & ~7), rest & 7
        on = np.flatnonzero(rest >= 4)
        acc[on] = _rotl(acc[on] ^ half[at[on]].astype(np.uint64) * P1, 23) * P2 + P3
        at, rest = at + (rest & ~3), rest & 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            acc[on] = _rotl(acc[on] ^ buf[at[on] + k].astype(np.uint64) * P5, 11) * P1
        acc = (acc ^ acc >> np.uint64(33)) * P2
        acc = (acc ^ acc >> np.uint64(29)) * P3
        acc = acc ^ acc >> np.uint64(32)
    far = np.flatnonzero(size > LONG)
    if len(far):
        import xxhash

        raw = memoryview(buf)
        acc[far] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(starts[far].tolist(), size[far].tolist(), strict=True)]
    return acc
