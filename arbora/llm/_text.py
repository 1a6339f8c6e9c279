"""Words of whole Arrow text columns as NumPy arrays: places, 64-bit hashes, and hashes of runs of words.

Word patterns here are sets of ASCII bytes; every byte of a non-ASCII character is a word byte, so the UTF-8
bytes can be scanned without decoding. Hashes are polynomials modulo 2**64, mixed; operators whose results rest
on equality of hashes use two independent ones (128 bits) or compare the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from arbora.llm._spark import strings

U = np.uint64
_BASE, _RUN = U(0x9E3779B97F4A7C15), (U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5))


def byte_set(keep) -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    table[[c for c in range(128) if keep(c)]] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_set(lambda c: c != 32 and not 9 <= c <= 13)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = byte_set(lambda c: 48 <= c <= 57 or 97 <= c <= 122)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


#: Values hashed at a time, so that a step's numbers stay in a core's cache whatever the length of the texts.
STEP = 1 << 16
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; those of an ordinary step (1 MB a base) are kept."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        steps = np.full(max(n, 2 * STEP) + 1, base, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * STEP:
            _powers[int(base)] = have
    return have[: n + 1]


@cache
def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[starts:ends] for each pair, not mixed; equal runs have equal hashes wherever they stand.

    ``starts`` are ascending. Byte values count one more than they are, so that a zero byte tells lengths apart.
    """
    out = np.empty(len(starts), U)
    back = inverse(base)
    cuts = np.searchsorted(starts, np.arange(0, len(values) + STEP, STEP))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part, low = slice(cuts[k], cuts[k + 1]), k * STEP
        high = int(ends[part].max())
        own = values[low:high].astype(U)
        if values.dtype == np.uint8:
            own += U(1)
        n = high - low
        own *= powers(base, n)[:n]
        sums = np.zeros(n + 1, U)
        np.cumsum(own, out=sums[1:])
        at = starts[part] - low
        out[part] = (sums[ends[part] - low] - sums[at]) * powers(back, n)[at]
    return out


def least_in_window(values: np.ndarray, first: np.ndarray, wide: int, last: bool = False) -> np.ndarray:
    """For each window values[first : first + wide] the place of its smallest value; of equal ones the first, or the last."""
    at, low = first.copy(), values[first]
    for k in range(1, wide):
        now = values[first + k]
        better = now <= low if last else now < low
        at[better] = first[better] + k
        low = np.minimum(low, now)
    return at


@dataclass
class Words:
    data: np.ndarray  #: UTF-8 bytes of all texts, lower-cased if asked for
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  #: of the documents' first words, and the number of words
    hashes: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words of the runs of ``length`` words that stay in one document, their documents)."""
        first = np.arange(max(0, len(self.starts) - length + 1))
        doc = self.doc_of_word()
        ok = doc[: len(first)] == doc[length - 1 :] if len(first) else np.zeros(0, bool)
        return first[ok], doc[: len(first)][ok]

    def run_hash(self, first: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
        h = self.hashes if not lane else mix(self.hashes ^ U(0x5851F42D4C957F2D))
        return mix(segment_hash(h, first, first + length, _RUN[lane]) + U(length))


def words_of(column, table: np.ndarray, lower: bool = False) -> Words:
    texts = strings(column)
    n = len(texts)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, np.zeros(1, np.int64), np.zeros(0, U))
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if lower:
        data = _LOWER[data]
    m = np.zeros(len(data) + 1, bool)
    m[:-1] = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = m[:-1]
    cuts = edges[(edges > 0) & (edges < len(data))]
    at_cut = before[cuts]
    before[cuts] = False
    starts = np.flatnonzero(m & ~before)
    before[cuts] = at_cut
    ends = ~m
    ends[cuts] = True
    ends = np.flatnonzero(ends & before)
    offsets = np.searchsorted(starts, edges)
    h = segment_hash(data, starts, ends, _BASE)
    return Words(data, starts, ends, offsets, mix(h + (ends - starts).astype(U)))


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., then the same for the next range, and so on."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
