"""64-bit hashes of the words of many texts at once, in numpy.

A word's hash is the sum over its bytes of a random 64-bit value of the byte times a power of an odd number that goes
with the byte's place in the word. Running sums over all bytes give it for every word in a few passes.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes that one pass holds in 64-bit numbers; a longer word makes a longer pass.
PASS = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def byte_values() -> np.ndarray:
    return mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) + np.uint64(BASE))


@functools.lru_cache(2)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data, cut at blanks."""
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + PASS)
        if stop < len(data):  # a pass ends at a blank
            cut = next((i + 1 for i in range(stop - 1, at, -1) if BLANKS[data[i]]), 0) if stop - at <= PASS else 0
            while not cut and stop < len(data):
                stop += 1
                cut = stop if BLANKS[data[stop - 1]] else 0
            stop = cut or len(data)
        a, b, h = _pass(np.frombuffer(data, np.uint8, stop - at, at))
        starts.append(a + at)
        ends.append(b + at)
        hashes.append(h)
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _pass(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~BLANKS[x]
    flips = np.diff(inside)
    a, b = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
    n = max(PASS, 1 << int(len(x)).bit_length())
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(byte_values()[x] * powers(BASE, n)[: len(x)], out=sums[1:])
    return a, b, mix((sums[b] - sums[a]) * powers(INVERSE, n)[a] + (b - a).astype(np.uint64))
