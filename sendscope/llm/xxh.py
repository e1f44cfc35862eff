"""XXH64 of many short byte strings at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import U

# The hash's primes (fixed values of its specification).
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                     0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer strings are hashed one by one by the xxhash library.
LONG = 160


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of buf[start:end] for each pair; strings of one length
    are worked on together."""
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(buf) + 1,), "<u8", data, 0, (1,))
    w4 = np.ndarray((len(buf) + 5,), "<u4", data, 0, (1,))
    out, size = np.zeros(len(starts), np.uint64), ends - starts
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    s = U(seed)
    start = [int(seed) + int(P1) + int(P2), int(seed) + int(P2), int(seed), int(seed) - int(P1)]
    lanes = [U(x % (1 << 64)) for x in start]
    for at in np.split(order, cuts) if len(order) else []:
        n, p = int(size[at[0]]), starts[at]
        if n > LONG:
            out[at] = [xxhash.xxh64_intdigest(buf[a: a + n].tobytes(), seed) for a in p.tolist()]
            continue
        k = 0
        if n >= 32:
            v = [np.full(len(at), x, np.uint64) for x in lanes]
            while k + 32 <= n:
                for i in range(4):
                    v[i] = _round(v[i], w8[p + k + 8 * i])
                k += 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros(1, np.uint64), x)) * P1 + P4
        else:
            h = np.full(len(at), s, np.uint64) + P5
        h += U(n)
        while k + 8 <= n:
            h = _turn(h ^ _round(np.zeros(1, np.uint64), w8[p + k]), 27) * P1 + P4
            k += 8
        if k + 4 <= n:
            h = _turn(h ^ (w4[p + k].astype(np.uint64) * P1), 23) * P2 + P3
            k += 4
        while k < n:
            h = _turn(h ^ (data[p + k].astype(np.uint64) * P5), 11) * P1
            k += 1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        out[at] = h ^ (h >> U(32))
    return out
