"""Byte-level BPE encoding with a rank queue, and decoding.

All distinct pre-tokens of a batch are merged together.  Their bytes form linked
lists; a queue has one bucket per merge rank with the list positions whose pair has
that rank, and a bitmap in levels of 64-bit words tells the lowest rank that has any.
Positions whose pair has changed since are stale and skipped.  A bucket is merged
as a whole, so the steps of a batch are bounded by the ranks in use and not by the
length of its pre-tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from gradeloom.llm.blocks import give_back, result_schema, with_results
from gradeloom.llm.words import slices, text_bytes

# Text whose distinct pre-tokens are merged together, and text of one batch that goes out.
BATCH_BYTES = 8 << 20
OUT_BYTES = 1 << 20
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class RankQueue:
    """Ranks with waiting positions; the lowest is found by first set bits, level by level."""

    def __init__(self, ranks: int) -> None:
        self._buckets: dict[int, list[np.ndarray]] = {}
        self._levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) // 64
            self._levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, positions: np.ndarray) -> None:
        waiting = self._buckets.get(rank)
        if waiting is not None:
            waiting.append(positions)
            return
        self._buckets[rank] = [positions]
        for level in self._levels:
            word, bit = divmod(rank, 64)
            was, level[word] = level[word], level[word] | 1 << bit
            if was:
                return
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else []
        for begin, end in zip(edges, [*edges[1:], len(ranks)]):
            self.push(int(ranks[begin]), positions[begin:end])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions, or nothing if all buckets are empty."""
        if not self._levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self._levels):
            word = level[rank]
            rank = rank * 64 + (word & -word).bit_length() - 1
        at = rank
        for level in self._levels:
            at, bit = divmod(at, 64)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        waiting = self._buckets.pop(rank)
        return rank, waiting[0] if len(waiting) == 1 else np.unique(np.concatenate(waiting))


class Vocabulary:
    """Lookup tables of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (left << 32) | right: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        }
        keys, results = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        # Ranks whose token can form a pair of lower rank have to be merged one at a time.
        self.reopens = np.zeros(self.size, bool)
        for part in (keys >> np.uint64(32), keys & np.uint64(2**32 - 1)):
            self.reopens[part[results < part.astype(np.int64)].astype(np.int64)] = True
        self._shift = np.uint64(64 - max(8, int(2 * len(keys)).bit_length()))
        self._keys = np.full(1 << (64 - int(self._shift)), 2**64 - 1, np.uint64)
        self._results = np.full(len(self._keys), _NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self._keys[slot[left]] == np.uint64(2**64 - 1)]
            self._keys[slot[free]] = keys[free]
            left = left[self._keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) % len(self._keys)
        self._results[slot] = results
        lengths = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda item: item[1])), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank_of_pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair makes, or a number above all ranks."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self._keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self._results[slot[hit]]
            go_on = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[go_on], (slot[go_on] + 1) % len(self._keys)
        return out

    def merge(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pre-tokens ``data[edges[i]:edges[i + 1]]`` one after another, and where each begins."""
        n = len(data)
        symbol = self.of_byte[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        filled = edges[:-1][np.diff(edges) > 0]
        before[filled] = -1
        after[edges[1:][np.diff(edges) > 0] - 1] = n
        owner = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
        pair = np.full(n + 1, _NONE, np.int32)
        inner = np.flatnonzero(after < n)
        pair[inner] = self.rank_of_pair(symbol[inner], symbol[inner + 1])
        queue = RankQueue(self.size)
        open_ = np.flatnonzero(pair[:n] != _NONE)
        queue.push_all(pair[open_], open_)
        while (lowest := queue.pop()) is not None:
            rank, at = lowest
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1 and self.reopens[rank]:
                _, first = np.unique(owner[at], return_index=True)
                rest = np.delete(at, first)
                at = at[first]
                if len(rest):
                    queue.push(rank, rest)
            elif len(at) > 1:
                # Of pairs that share a symbol, the first goes, then the third.
                linked = np.append(False, after[at[:-1]] == at[1:])
                if linked.any():
                    begins = np.flatnonzero(~linked)
                    number = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
                    at = at[number % 2 == 0]
            gone = after[at]
            symbol[at] = rank
            symbol[gone] = -1
            pair[gone] = _NONE
            follow = after[gone]
            after[at] = follow
            inside = follow < n
            before[follow[inside]] = at[inside]
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0]]))
            right = after[changed]
            inside = right < n
            pair[changed[~inside]] = _NONE
            changed, right = changed[inside], right[inside]
            pair[changed] = new = self.rank_of_pair(symbol[changed], symbol[right])
            live = new != _NONE
            if live.any():
                queue.push_all(new[live], changed[live])
        kept = np.flatnonzero(symbol >= 0)
        return symbol[kept], np.searchsorted(kept, edges)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[_ranges(self.begins[ids], self.lengths[ids])]

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of every list of ids, which end at ``ends`` (with a 0 in front)."""
        edges = ends.tolist()
        return pa.array([self.decode(ids[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    keep: Sequence[str] | None = None,
    decoded: str | None = None,
) -> DataFrame:
    """``keep`` columns (all by default) and the token ids of the text.

    ``pattern`` cuts a text into pre-tokens, which are merged one by one; there are no
    special tokens.  With ``decoded``, a column of that name has the bytes that the ids stand
    for, as :func:`decode` gives them, from the same pass.  The driver reads the rank file and
    sends the tables of one vocabulary.  Null and empty texts have no tokens.  Repeated rows
    are encoded alike.  Columns with the names of added ones are replaced.  An empty table
    gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    names = list(df.columns if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pieces_of = shared.value, regex.compile(pattern).findall
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                yield from encoded(part, vocabulary, pieces_of)
        give_back()

    def encoded(part: pa.RecordBatch, vocabulary: Vocabulary, pieces_of: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        used = [
            np.array([number.setdefault(piece, len(number)) for piece in pieces_of(value)] if value else [], np.int32)
            for value in part.column(part.schema.get_field_index(text)).to_pylist()
        ]
        data, edges = text_bytes(pa.array(list(number), pa.string()))
        del number
        tokens, begins = vocabulary.merge(data, edges)
        sizes = np.diff(begins)
        row = 0
        for out in slices(part, text, OUT_BYTES):
            own = used[row : row + out.num_rows]
            row += out.num_rows
            pieces = np.concatenate(own)
            flat = tokens[_ranges(begins[pieces], sizes[pieces])]
            ends = np.concatenate([[0], np.cumsum(sizes[pieces])])[np.cumsum([0, *map(len, own)])]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
            results = {ids: lists}
            if decoded is not None:
                results[decoded] = vocabulary.decode_lists(flat, ends)
            yield with_results(out.select(names), results)

    added = [StructField(ids, ArrayType(IntegerType()))]
    if decoded is not None:
        added.append(StructField(decoded, BinaryType()))
    return df.mapInArrow(run, result_schema(df.select(*names), StructType(added)))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row and the bytes that its token ids stand for; a null list gives no bytes.

    Unknown ids fail.  A column named ``decoded`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield with_results(batch, {decoded: shared.value.decode_lists(flat, ends)})
        give_back()

    return df.mapInArrow(run, result_schema(df, StructType([StructField(decoded, BinaryType())])))
