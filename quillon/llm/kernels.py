"""Array kernels over the UTF-8 bytes of many texts at once.

A text's words are runs of bytes outside \\x20 and \\x09-\\x0D; as UTF-8 never
uses those bytes inside a longer sequence, they equal the code point pattern
``[^\\x20\\x09-\\x0D]+``. Equality of words, lines and shingles is judged on
64-bit hashes: a polynomial over random byte values, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every bit depends on all."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i from 0 to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 21)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    v = VALUES[data]
    v *= powers(len(data))[0][: len(data)]
    np.cumsum(v, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes, wherever it stands."""
    h = sums[ends] - sums[starts]
    h *= powers(len(sums))[1][starts]
    h += (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h)


def starts_of(off: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions where a text starts."""
    at = np.zeros(n + 1, bool)
    at[off] = True
    return at


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words."""
    n = len(data)
    inside = ~SPACE[data]
    edge = starts_of(off, n)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def windows3(h: np.ndarray) -> np.ndarray:
    """Hash of each three consecutive word hashes, over text borders as well."""
    if len(h) < 3:
        return np.empty(0, np.uint64)
    x = h[:-2] * U(0xA0761D6478BD642F)
    x += mix(h[1:-1] + U(0xE7037ED1A0B428DB))
    x = mix(x)
    x += mix(h[2:] ^ U(0x8EBC6AF09C88C6E3))
    return mix(x)


def duplicated(key: np.ndarray) -> np.ndarray:
    """Flags of the entries whose value stands more than once."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the line feed) and text numbers of all \\n-split lines; an empty text has one."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(off, breaks, "right") - 1
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([breaks, off[1:]])
    text = np.concatenate([np.arange(n), of])
    end_text = np.concatenate([of, np.arange(n)])
    a = np.lexsort((starts, text))
    b = np.lexsort((ends, end_text))
    return starts[a], ends[b], text[a]
