"""Words, n-gram hashes and winnowing over slices of UTF-8 texts, in numpy.

A slice of texts is one byte buffer with a separator after each text.  Separators become
spaces and A-Z becomes a-z by one ``bytes.translate``; everything after that is vectorised.
Memory is in proportion to the slice (256 KiB, or one longer text).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 1 << 18), base, U)]))
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def lowering(is_separator) -> bytes:
    """A translation table: separators to a space, A-Z to a-z."""
    return bytes(0x20 if is_separator(b) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


#: Words of letters, digits and all non-ASCII bytes.
ALNUM = lowering(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: Words between ASCII white space.
SPACED = lowering(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)


@dataclass
class Words:
    data: bytes  # translated; texts are separated by a space
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    text: np.ndarray  # index of each word's text within the slice
    bounds: np.ndarray  # first word of each text, and the number of words
    offsets: np.ndarray  # first byte of each text
    hashes: np.ndarray  # 64 bits a word

    def span(self, a: int, b: int) -> list[bytes]:
        """Words a to b (exclusive)."""
        return self.data[self.starts[a] : self.ends[b - 1]].split() if b > a else []


def words(texts: list[bytes | None], separators: bytes) -> Words:
    data = b" ".join(t or b"" for t in texts).translate(separators) + b" "
    buf = np.frombuffer(data, np.uint8)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    inside = np.zeros(len(buf) + 1, np.int8)
    np.not_equal(buf, 0x20, out=inside[1:].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.append(np.searchsorted(starts, offsets), len(starts))
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * powers(_BASE, len(buf)), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(buf))[starts] + (ends - starts).astype(U))
    return Words(data, starts, ends, text, bounds, offsets, hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (of a buffer; the caller drops runs that cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = hashes[:n].copy()
        for j in range(1, k):
            h = mix(h * U(0xD6E8FEB86659FD93) + hashes[j : j + n])
        return h


def within(text: np.ndarray, k: int) -> np.ndarray:
    """Whether the run of k words that starts at each word stays in one text."""
    n = len(text) - k + 1
    return text[:n] == text[k - 1 :] if n > 0 else np.zeros(0, bool)


def winnow(g: np.ndarray, text: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the rightmost minimum hash of every window of w consecutive k-grams of a text."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        nxt = g[j : j + n]
        lower = nxt <= best
        best[lower] = nxt[lower]
        at[lower] = np.flatnonzero(lower) + j
    at = at[within(text, k + w - 1)]
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def found(sorted_keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the probes that are among the keys, and the first key equal to each."""
    if not len(sorted_keys) or not len(probe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sorted_keys, probe)
    hit = np.flatnonzero(sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == probe)
    return hit, at[hit]
