"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on a batch of texts at once: the texts are joined into one
array of code points, and words, shingles and windows are found and hashed
with array arithmetic, so the cost per character is a few nanoseconds.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters handled at once; a longer text is a batch of its own.
BATCH_CHARS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: close to uniform for any distinct inputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """True for the code points that are letters or digits."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def char_hashes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown to the largest batch seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", BASE_INV)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in one array, and each text's offset in it (one more at the end)."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), off


def prefix_hashes(cp: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of hash(cp[j]) * BASE**j over j < i, modulo 2**64."""
    up, _ = _POWERS.upto(len(cp) + 1)
    p = np.zeros(len(cp) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(char_hashes()[cp] * up[: len(cp)], dtype=np.uint64, out=p[1:])
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans start..end, equal for equal content wherever it stands."""
    _, down = _POWERS.upto(len(p))
    with np.errstate(over="ignore"):
        return mix64((p[end] - p[start]) * down[start])


def batches(texts: list[str]):
    """Ranges of texts with about BATCH_CHARS characters each."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of letters and digits within each text: start, end, text number."""
    is_word = alnum_table()[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], is_word[:-1])) if len(cp) else is_word
    after = np.concatenate((is_word[1:], [False])) if len(cp) else is_word
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingles(texts: list[str], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of n_words successive words of the lower-cased texts:
    text number and hash, sorted by both."""
    docs, values = [], []
    for a, b in batches(texts):
        cp, off = codepoints([t.lower() for t in texts[a:b]])
        start, end, doc = words(cp, off)
        if len(start) < n_words:
            continue
        h = span_hashes(prefix_hashes(cp), start, end)
        n = len(h) - n_words + 1
        s = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n_words):
                s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        s = mix64(s)
        whole = doc[:n] == doc[n_words - 1 :]
        d, s = doc[:n][whole], s[whole]
        at = np.searchsorted(d, np.arange(b - a + 1))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            s[x:y].sort()
        keep = np.ones(len(s), bool)
        keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        docs.append(d[keep] + a)
        values.append(s[keep])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(values)


class Routes:
    """Keeps keys that many texts share from meeting in one task.

    A key's rows come together where it is told whether two owners have it. Where a task
    sees that for itself (``SURE`` rows of two owners in a batch), it sends two rows of
    two owners there for the sake of the other tasks, and the rest, with all later rows
    of the key, elsewhere. So the place of a key gets a few rows from each task."""

    SURE, KNOWN, WAYS = 8, 1 << 20, 4096

    def __init__(self) -> None:
        self.known = np.zeros(0, np.uint64)

    def of(self, keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """0 for rows that are to be counted by key, above 0 for rows of keys that are shared."""
        route = np.zeros(len(keys), np.int32)
        if not len(keys):
            return route
        way = lambda at: 1 + (mix64(owners[at].view(np.uint64)) % np.uint64(self.WAYS)).astype(np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            old = np.flatnonzero(self.known[at] == keys)
            route[old] = way(old)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        past = np.append(first[1:], len(keys))
        many = np.flatnonzero((past - first >= self.SURE) & (route[order[first]] == 0))
        sure = []
        for i, j in zip(first[many].tolist(), past[many].tolist()):
            rows = order[i:j]
            low, high = rows[np.argmin(owners[rows])], rows[np.argmax(owners[rows])]
            if owners[low] != owners[high]:
                route[rows] = way(rows)
                route[low] = route[high] = 0
                sure.append(keys[low])
        if sure and len(self.known) < self.KNOWN:
            self.known = np.union1d(self.known, np.array(sure, np.uint64))
        return route
