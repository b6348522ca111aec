"""Words of whole Arrow batches as numpy arrays: places, hashes, windows.

Separators are single ASCII bytes in every operator here, so words are found on
the UTF-8 bytes.  Hashes are two independent 64-bit polynomials; operators that
must be exact compare both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes hashed at once; a longer word is hashed alone.
_SPAN = 1 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of the bytes within the inclusive ranges."""
    flags = np.zeros(256, dtype=bool)
    for first, last in ranges:
        flags[first : last + 1] = True
    return flags


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class _Polynomial:
    """Hash of a run of 64-bit terms by prefix sums of powers, modulo 2**64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(1, 2**63, dtype=np.uint64)) * 8 + 3
        self._base = np.uint64(base % 2**64)
        self._inverse = np.uint64(pow(base, -1, 2**64))
        self._powers = self._inverses = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", self._base), ("_inverses", self._inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._powers[:n], self._inverses[:n]

    def runs(self, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``terms[start:end]`` for every run; equal runs have equal hashes anywhere."""
        powers, inverses = self.powers(len(terms) + 1)
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms * powers[:-1], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverses[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


FIRST, SECOND = _Polynomial(11), _Polynomial(23)


@dataclass
class Words:
    """Words of a batch of texts: ``data[starts[i]:ends[i]]``; text d has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, polynomial: _Polynomial = FIRST, longest: int | None = None) -> np.ndarray:
        """Hash of every word, or of its first ``longest`` bytes."""
        out = np.empty(len(self.starts), np.uint64)
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _SPAN, "right")))
            low = self.starts[i]
            terms = polynomial.table[self.data[low : self.ends[j - 1]]]
            out[i:j] = polynomial.runs(terms, self.starts[i:j] - low, ends[i:j] - low)
            i = j
        return out

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words with one space after each, and where every text begins in that; without those not kept."""
        starts, ends = self.starts, self.ends
        kept = np.ones(len(starts), bool) if keep is None else keep
        lengths = (ends - starts)[kept]
        place = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(place[-1], 0x20, np.uint8)
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        step = np.arange(total)
        target = np.repeat(place[:-1] - before, lengths) + step
        out[target] = self.data[np.repeat(starts[kept] - before, lengths) + step]
        return out, place[np.concatenate([[0], np.cumsum(kept)])[self.first]]

    def words(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist())]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
    else:
        texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """The longest runs of bytes that are no separators, text by text."""
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        filled = offsets[:-1][np.diff(offsets) > 0]
        opens[filled] = inside[filled]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return Words(data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, n: int, polynomial: _Polynomial = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``n`` words within one text, and their hashes."""
    starts = np.arange(max(0, len(hashes) - n + 1))
    end_of_text = np.repeat(first[1:], np.diff(first))
    starts = starts[starts + n <= end_of_text[: len(starts)]] if len(starts) else starts
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _SPAN):
        part = starts[i : i + _SPAN]
        low, high = part[0], part[-1] + n
        out[i : i + _SPAN] = polynomial.runs(hashes[low:high], part - low, part - low + n)
    return starts, out


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``max_bytes`` of text together; a longer text comes alone."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
