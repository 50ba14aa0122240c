"""Words of many texts at once, as 64-bit hashes, by numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, unless one text has more.
CHUNK = 1_500_000
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 2**64)
_POWERS = {r: np.ones(1, np.uint64) for r in (_RADIX, _INVERSE)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: white space; and everything but ASCII letters and what is not ASCII.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
NO_LETTER = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])


def powers(radix: int, n: int) -> np.ndarray:
    """radix**0 .. radix**(n - 1) modulo 2**64; kept up to some more than a chunk."""
    known = _POWERS[radix]
    while len(known) < n:
        more = known[: n - len(known)] * np.uint64(pow(radix, len(known), 2**64))
        known = np.concatenate([known, more])
    if len(known) > len(_POWERS[radix]) and n <= 2 * CHUNK:
        _POWERS[radix] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; the same bytes have the same hash wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_RADIX, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Of texts k = 0, 1, ..: data, the bytes; start and end of each word in them; first[k] to first[k + 1], the words of text k."""

    def __init__(self, texts: list[str], between: np.ndarray, lower: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data
        sep = between[self.data]
        change = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        self.start, self.end = change[::2], change[1::2]
        at = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.start, self.end)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """A string column in pieces of about `size` bytes: the place of the first row, and texts with "" for null."""
    texts = column.to_pylist()
    at = n = 0
    for k, t in enumerate(texts):
        texts[k] = t = t or ""
        n += len(t)
        if n >= size:
            yield at, texts[at : k + 1]
            at, n = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]
