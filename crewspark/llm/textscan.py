"""Words of many texts at once, on the UTF-8 bytes of an Arrow column, with NumPy.

Separators are ASCII in all our word definitions, so that words found in the bytes are the words
found in the text.  A word is known by a 64-bit tabulation hash of its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from crewspark.llm.common import text_offsets

U = np.uint64
#: Bytes that belong to words: all but blanks; letters, digits and everything that isn't ASCII.
NOT_BLANK = np.array([b not in (0x20, 9, 10, 11, 12, 13) for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

#: Bytes of a word whose values come from a table; those further on are computed.
TABLED = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _byte_values(keys: np.ndarray) -> np.ndarray:
    """A 64-bit value for each (place in the word x 256 + byte), as random as two rounds of mix make it."""
    return mix(mix(keys + U(0x9E3779B97F4A7C15)) ^ U(0x6A09E667F3BCC909))


_TABLE = _byte_values(np.arange(TABLED * 256, dtype=U))


@dataclass
class Scan:
    data: np.ndarray  #: bytes of all texts, folded if so asked
    doc_start: np.ndarray  #: first byte of each text, and the end
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    first: np.ndarray  #: number of words before each text, and of all

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def hashes(self) -> np.ndarray:
        """Tabulation hashes: sums over a word's bytes of a value for each place and byte, so that no
        pattern of letters repeats in them as it does in polynomials modulo a power of two."""
        size = self.ends - self.starts
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(before, size)
        key = (place << 8) | self.data[np.repeat(self.starts, size) + place]
        if len(size) and size.max() > TABLED:
            far = place >= TABLED
            value = _TABLE[np.where(far, 0, key)]
            value[far] = _byte_values(key[far].astype(U))
        else:
            value = _TABLE[key]
        sums = np.zeros(len(value) + 1, dtype=U)
        np.cumsum(value, out=sums[1:])
        return mix(sums[before + size] - sums[before] + size.astype(U))


def scan(column: pa.Array, member: np.ndarray, lower: bool) -> Scan:
    """Words of an Arrow string column; nulls have none."""
    offsets = text_offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = member[data]
    edge = np.empty(len(data) + 1, dtype=bool)  # a word may not go on over this place
    edge[:] = False
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Scan(data, offsets, starts, ends, np.searchsorted(starts, offsets, side="left"))


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two runs, one after the other."""
    return mix(a * U(0xC2B2AE3D27D4EB4F) + (b ^ (b >> U(29))) * U(0x165667B19E3779F9))


def windows(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of all runs of w words, by doubling; the last w - 1 places are left out."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out, done, run, size = None, 0, h, 1
    while True:
        if w & size:
            part = run[done : done + n]
            out = mix(part) if out is None else _after(out, part)
            done += size
        if size * 2 > w:
            return out
        run = _after(run[: len(run) - size], run[size:])
        size *= 2


def window_owner(s: Scan, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that lie in one text, and the texts."""
    n = np.maximum(s.n_words - w + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s.first[:-1][doc]
    return at, doc
