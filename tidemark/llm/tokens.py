"""Vectorised word tables: whole batches of texts become NumPy arrays of word hashes.

A word is a maximal run of characters other than space and the controls \\x09-\\x0D, so a
text splits in UTF-8 just as it does in code points. Null texts have no words. Hashes are
64-bit and depend on nothing but the word's bytes: equal in every process and at every size.
Work goes piece by piece (``PIECE`` bytes), so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD1342543DE82EF95)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Lower-cases and takes ASCII punctuation and controls as space: for matches that should survive reformatting.
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of h over the whole word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            self.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE_INV)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte positions of the words in buf."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[buf], [True]]).view(np.int8)))
    return edge[0::2], edge[1::2]


def _hash_piece(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _POWERS.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


class Words:
    """The words of some texts: hash and byte bounds (in buf, the folded texts) by word; ``at[i]:at[i+1]`` are text i's."""

    __slots__ = ("at", "buf", "end", "hash", "start")

    def __init__(self, texts: list[bytes], lower: bool = False, fold: np.ndarray | None = None) -> None:
        """lower: A-Z count as a-z. fold: what each byte counts as, in place of that."""
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(sizes)])
        data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        if lower or fold is not None:
            buf = (_LOWER if fold is None else fold)[buf]
        self.buf = buf
        hashes, starts, ends, lo = [], [], [], 0
        while lo < len(buf):
            hi = min(len(buf), lo + PIECE)
            while hi < len(buf) and not _IS_SPACE[buf[hi - 1]]:  # never cut a word
                hi += 1
            s, e = bounds(buf[lo:hi])
            hashes.append(_hash_piece(buf[lo:hi], s, e))
            starts.append(s + lo)
            ends.append(e + lo)
            lo = hi
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.at = np.searchsorted(self.start, first)

    def text_of(self) -> np.ndarray:
        """The index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def encode(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8, null as empty; lone surrogates pass, so any string does."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one text, and the position of its first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for i in range(1, k):
        h *= _STEP
        h += w.hash[i : i + n]
    text = w.text_of()
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(h[at]), at


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Per text: its distinct k-word shingles, sorted; one shingle of all words if they are fewer."""
    h, at = windows(w, k)
    cut = np.searchsorted(at, w.at)
    out = []
    for i in range(len(w.at) - 1):
        if cut[i] < cut[i + 1]:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif w.at[i] < w.at[i + 1]:
            own = w.hash[w.at[i] : w.at[i + 1]]
            one = own[:1].copy()
            for x in own[1:]:
                one = one * _STEP + x
            out.append(mix(one + _U(len(own))))
        else:
            out.append(np.zeros(0, _U))
    return out


def chunks(sizes: Iterable[int], most: int = 2 * PIECE) -> Iterator[slice]:
    """Runs of rows whose sizes sum to at most ``most`` (a larger row stands alone)."""
    lo, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if i >= lo:
        yield slice(lo, i + 1)
