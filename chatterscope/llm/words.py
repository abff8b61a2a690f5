"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def separators(white_only: bool) -> np.ndarray:
    """Whether a byte separates words: ASCII white space, or any ASCII but letters and digits."""
    table = np.zeros(256, bool)
    if white_only:
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


WHITE = separators(True)
MARKS = separators(False)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] (64 random bits for each byte) for many ranges, empty ones included."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def hashes(texts: list[bytes], separates: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order. ASCII letters are lowered first.

    After the words follow, for each number in `prefixes`, the hashes of so many first bytes of the
    words that are longer; they differ from those of whole words.
    """
    joined = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = separates[joined]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)], out=total[1:])
    found = mix((total[end] - total[start]) * inverse[start])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    if not prefixes:
        return found, owner
    all_found, all_owner = [found], [owner]
    for k in prefixes:
        longer = end - start > k
        at = start[longer]
        all_found.append(mix((total[at + k] - total[at]) * inverse[at] + np.uint64(k)))
        all_owner.append(owner[longer])
    return np.concatenate(all_found), np.concatenate(all_owner)


def shingles(found: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` words, index of its text). A text with fewer words, but some, has
    one shingle, the whole sequence."""
    count = np.bincount(owner, minlength=n_texts)
    first = np.cumsum(count) - count
    n = max(len(found) - width + 1, 0)
    out = found[:n].copy()
    for k in range(1, width):
        out = mix(out * np.uint64(_BASE) + found[k : k + n])
    whole = owner[:n] == owner[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
    out, whose = out[whole], owner[:n][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        made = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            h = int(count[t])
            for w in found[first[t] : first[t] + count[t]].tolist():
                h = ((h ^ w) * _BASE + 1) & _MASK
            made[i] = h
        out, whose = np.concatenate([out, mix(made)]), np.concatenate([whose, short])
    return out, whose
