"""Rolling hashes in numpy: 64-bit polynomial hashes over random byte values, any span in constant time."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
KEPT = (1 << 19) + 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits; one-to-one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i, modulo 2**64, for i < n; tables of up to KEPT are kept."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    made = {}
    for name, b in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
        out = np.full(n if n > KEPT else KEPT, b, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            made[name] = np.cumprod(out, dtype=np.uint64)
    if n <= KEPT:
        _powers.update(made)
    return made["up"][:n], made["down"][:n]


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes; the length counts, so an empty span differs from no other by chance alone."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def ngram(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, from the first word of each."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= U(0xA0761D6478BD642F)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: of the keys that occur twice or more, and of those that occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


#: Bytes of short spans that are compared at once; longer spans are compared one by one.
COMPARED, SHORT = 1 << 17, 1 << 12


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of equal size at a and at b hold the same bytes."""
    out = np.ones(len(a), bool)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = np.array_equal(raw[a[k] : a[k] + size[k]], raw[b[k] : b[k] + size[k]])
    short = np.flatnonzero(size <= SHORT)
    end = np.cumsum(size[short])
    lo = 0
    while lo < len(short):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + COMPARED, "right")))
        own = short[lo:hi]
        n = size[own]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(a[own], n) + step] != raw[np.repeat(b[own], n) + step]
        if differ.any():
            out[own[np.repeat(np.arange(len(own)), n)[differ]]] = False
        lo = hi
    return out


def firsts(keys: np.ndarray) -> np.ndarray:
    """For each key where it occurs first."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first[inverse]


def named(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span that only spans of the same bytes share: where hashes agree, bytes are compared."""
    size, out = end - start, firsts(Spans(raw).of(start, end))
    other = np.flatnonzero(out != np.arange(len(out)))
    alike = size[out[other]] == size[other]
    alike[alike] = same_bytes(raw, start[out[other[alike]]], start[other[alike]], size[other[alike]])
    if not alike.all():  # spans of one hash that differ: their bytes tell them apart
        own: dict = {}
        for k in np.flatnonzero(np.isin(out, out[other[~alike]])).tolist():
            out[k] = own.setdefault(raw[start[k] : end[k]].tobytes(), k)
    return out


def named_windows(ids: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of n ids from the places at on that only equal windows of the same row share."""
    out = firsts(ngram(mix(ids.astype(np.uint64)), n)[at] ^ mix(row[at].astype(np.uint64) + U(1)))
    other = np.flatnonzero(out != np.arange(len(out)))
    a, b = at[out[other]], at[other]
    alike = row[a] == row[b]
    for k in range(n):
        alike &= ids[a + k] == ids[b + k]
    if not alike.all():
        own: dict = {}
        for k in np.flatnonzero(np.isin(out, out[other[~alike]])).tolist():
            out[k] = own.setdefault((row[at[k]], *ids[at[k] : at[k] + n].tolist()), k)
    return out


#: The six separators of words: space and \x09 to \x0D.
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, *range(0x09, 0x0E)]] = True


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+ of concatenated rows; no word crosses rows."""
    inside = ~IS_SEP[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1
