"""Language model scores by a weighted backoff automaton.

The states are the n-grams of up to ``order - 1`` tokens that occur in the training
texts, the root among them.  A state has an arc for every token seen after it, with the
log-probability of that token, and a failure arc to its longest proper suffix, with the
log of the weight that smoothing leaves to it.  With c the training counts,

    p(w | h) = (c(hw) + strength * p(w | shorter h)) / (c(h) + strength)

so an arc weighs log10 p(w | h) and a failure arc log10(strength / (c(h) + strength)).
At the root, p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

No task holds the whole automaton.  Documents lie in blocks; each block asks for the
counts of the n-grams in its own texts and gets back those that other blocks add to.  From
these it builds the part of the automaton that its texts can reach, and walks through
it from left to right, all texts together and one token of each per step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from gradeloom.llm.blocks import BLOCK, answered, bucket_bits, cut, parts_of_blocks, staged_blocks, texts_of
from gradeloom.llm.words import mixed, windows, words_of

ADD = 0.1
STRENGTH = 4.0
# Larger blocks repeat fewer n-grams; a task holds one block.
LM_BLOCK_BYTES = 14 << 20
# Tokens of a text that are walked in one go; longer texts are walked in several pieces at once.
PIECE = 512
# The end of a text is a token of its own.
_END = np.uint64(0x9AE16A3B2F90404F)

ADDED = StructType(
    [
        StructField("n_tokens", LongType()),
        StructField("n_known", LongType()),
        StructField("train_tokens", LongType()),
        StructField("base_score", DoubleType()),
        StructField("score", DoubleType()),
    ]
)


def packed(values: np.ndarray, deltas: bool = False) -> bytes:
    """Integers by planes of equal bytes, compressed; sorted ones as differences."""
    if deltas and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return zlib.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpacked(blob: bytes, dtype: type, deltas: bool = False) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if deltas else values


class _Tokens:
    """Tokens of a batch of texts and their n-grams."""

    def __init__(self, texts: pa.Array, order: int) -> None:
        words = words_of(texts, lower=True)
        self.first = words.first + np.arange(len(words.first))
        self.hashes = np.insert(words.hashes(), words.first[1:], _END)
        self.order = order

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the last token and key of all runs of ``n`` tokens."""
        if n == 1:
            return np.arange(len(self.hashes)), mixed(self.hashes)
        starts, keys = windows(self.hashes, self.first, n)
        return starts + n - 1, mixed(keys ^ np.uint64(n))

    def per_token(self, flags: np.ndarray) -> np.ndarray:
        return np.repeat(flags, np.diff(self.first))


def _counted(tokens: _Tokens, training: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last places and key numbers of the n-grams; their sorted keys with training counts."""
    places, keys = tokens.grams(n)
    own, number = np.unique(keys, return_inverse=True)
    counts = np.bincount(number[tokens.per_token(training)[places]], minlength=len(own)).astype(np.int64)
    return places, number, own, counts


class Automaton:
    """The states, arcs and failure arcs that the texts of a block can reach.

    State 0 is the root.  Arcs are sorted by (state, token); ``target`` and ``weight`` are
    those of each arc, ``failure`` and ``failure_weight`` those of each state.  Tokens
    that never occur in training leave the root by no arc and come back to it with the
    weight ``unknown``.
    """

    def __init__(
        self,
        tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
        root: np.ndarray,
        unknown: float,
        strength: float,
        size: int,
    ) -> None:
        """``tables`` has, for every n, the last places of the n-grams, their numbers and the counts
        by number; ``root`` the probabilities of the tokens by number; texts have ``size`` tokens together."""
        at = np.full(size, -1)
        at[tables[0][0]] = tables[0][1]
        self.tokens, self.unknown = at, np.log10(unknown)
        n_types = max(1, len(tables[0][2]))
        states = 1
        failure, failure_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, targets, weights = [], [], []
        # What is known of the n-grams one shorter: their numbers by last place, counts, chances and states.
        shorter = np.zeros(size, np.int64)
        shorter_counts, chances, shorter_states = np.ones(1), None, np.zeros(1, np.int64)
        for n, (places, number, counts) in enumerate(tables, 1):
            # Any place where an n-gram stands shows what it is made of.
            shown = np.zeros(len(counts), np.int64)
            shown[number] = places
            suffix = shorter[shown] if n > 1 else np.zeros(len(counts), np.int64)
            history = shorter[shown - 1] if n > 1 else np.zeros(len(counts), np.int64)
            seen = counts > 0
            if n == 1:
                chance = root
            else:
                context = shorter_counts[history]
                # A history that never occurred is no state: its failure arc is free.
                chance = np.where(context > 0, (counts + strength * chances[suffix]) / (context + strength), chances[suffix])
            own = np.zeros(len(counts), np.int64)
            if n < len(tables):
                own[seen] = states + np.arange(int(seen.sum()))
                states += int(seen.sum())
                failure.append(shorter_states[suffix[seen]] if n > 1 else np.zeros(int(seen.sum()), np.int64))
                failure_weight.append(np.log10(strength / (counts[seen] + strength)))
                target = own
            else:
                # The longest n-grams are no states: their arcs end at their suffixes.
                target = shorter_states[suffix]
            keys.append(shorter_states[history][seen] * n_types + at[shown[seen]])
            targets.append(target[seen])
            weights.append(np.log10(chance[seen]))
            shorter = np.full(size, -1)
            shorter[places] = number
            shorter_counts, chances, shorter_states = counts.astype(np.float64), chance, own
        order = np.argsort(key := np.concatenate(keys))
        self.n_types, self.key = n_types, key[order]
        self.target, self.weight = np.concatenate(targets)[order], np.concatenate(weights)[order]
        self.failure, self.failure_weight = np.concatenate(failure), np.concatenate(failure_weight)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more token each, and the weights of the ways there."""
        state, weight = state.copy(), np.zeros(len(state))
        going = np.arange(len(state))
        while len(going):
            key = state[going] * self.n_types + token[going]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[arc] == key if len(self.key) else np.zeros(len(going), bool)
            arc, found = arc[there], going[there]
            weight[found] += self.weight[arc]
            state[found] = self.target[arc]
            going = going[~there]
            lost = going[state[going] == 0]
            weight[lost] += self.unknown
            going = going[state[going] > 0]
            weight[going] += self.failure_weight[state[going]]
            state[going] = self.failure[state[going]]
        return state, weight

    def walk(self, first: np.ndarray, memory: int) -> np.ndarray:
        """Sum of the weights on the way of each text, whose tokens begin at ``first`` (the last end included).

        The state depends on the last ``memory`` tokens only.  So a long text is walked in pieces, all at
        once, each of which takes up its state from the tokens before it.
        """
        sizes = np.diff(first)
        pieces = np.maximum(1, -(-sizes // PIECE))
        text = np.repeat(np.arange(len(sizes)), pieces)
        begin = first[:-1][text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + PIECE, first[1:][text])
        start = np.maximum(begin - memory, first[:-1][text])
        order = np.argsort(start - end, kind="stable")
        text, begin, end, start = text[order], begin[order], end[order], start[order]
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for taken in range(int((end - start).max(initial=0))):
            # Pieces are in order of their length, the longest first.
            live = int(np.searchsorted(start - end, -taken, "left"))
            place = start[:live] + taken
            state[:live], weight = self.step(state[:live], self.tokens[place])
            total[:live] += np.where(place >= begin[:live], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(sizes))


def score_texts(
    df: DataFrame,
    training: str,
    text: str = "text",
    order: int = 2,
    strength: float = STRENGTH,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` columns (all by default) and the scores of every row.

    Rows whose boolean column ``training`` is true are learnt from; null is false.
    Texts are lower-cased (A-Z); tokens are the words and one end.  Adds ``n_tokens``,
    ``n_known`` (tokens that occur in training), ``train_tokens``, ``base_score`` (root
    only) and ``score``, both log10.

    Null and empty texts are one end token.  Repeated rows count repeatedly.  Without
    training rows every token has probability one at the root.  Columns named like an
    added one or ``_block`` are replaced.  An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("the order is one or more")
    names = list(df.columns if keep is None else keep)
    blocks = staged_blocks(df.select(*dict.fromkeys([*names, text, training])), text, LM_BLOCK_BYTES, pack=True)
    asked_columns = blocks.select(BLOCK, text, training)
    bits = bucket_bits(blocks, LM_BLOCK_BYTES)

    def counts_of(batches: Iterator[pa.RecordBatch], orders: Sequence[int], unseen: bool) -> Iterator[pa.RecordBatch]:
        for block, part in parts_of_blocks(batches, text, LM_BLOCK_BYTES):
            tokens, flags = _Tokens(texts_of(part.column(text)), order), _flags(part, training)
            for n in orders:
                _, _, keys, counts = _counted(tokens, flags, n)
                if not unseen:
                    keys, counts = keys[counts > 0], counts[counts > 0]
                parts = cut(keys, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n] * len(parts), pa.int32()),
                        pa.array([b for b, _ in parts], pa.int32()),
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([packed(keys[s], deltas=True) for _, s in parts], pa.binary()),
                        pa.array([packed(counts[s]) for _, s in parts], pa.binary()),
                    ],
                    names=["n", "bucket", BLOCK, "keys", "counts"],
                )

    message = f"n int, bucket int, {BLOCK} long, keys binary, counts binary"

    def totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = [unpacked(x.as_py(), np.uint64, deltas=True) for x in table["keys"]]
        counts = np.concatenate([unpacked(x.as_py(), np.int64) for x in table["counts"]])
        row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        every = np.concatenate(keys)
        found, number = np.unique(every, return_inverse=True)
        return every, np.bincount(number, weights=counts).astype(np.int64)[number], counts, row

    def vocabulary(table: pa.Table) -> pa.Table:
        every, _, counts, _ = totals(table)
        return pa.table({"tokens": [int(counts.sum())], "types": [len(np.unique(every))]})

    learnt = asked_columns.mapInArrow(lambda batches: counts_of(batches, (1,), unseen=False), message)
    size = learnt.groupBy("bucket").applyInArrow(vocabulary, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    n_tokens, n_types = (int(x or 0) for x in size)

    def reply(table: pa.Table) -> pa.Table:
        """Totals of the n-grams of a bucket, to the blocks whose own count is less, by their places among the block's keys there."""
        every, total, counts, row = totals(table)
        blocks, number = table[BLOCK].to_numpy(), row
        if len(np.unique(blocks)) < len(blocks):
            # A block that a scan has cut in two asks twice; its keys are those of both parts.
            blocks, own = np.unique(blocks, return_inverse=True)
            number = own[row]
            order = np.lexsort((every, number))
            every, total, counts, number = every[order], total[order], counts[order], number[order]
            first = np.append(True, (every[1:] != every[:-1]) | (number[1:] != number[:-1]))
            counts = np.add.reduceat(counts, np.flatnonzero(first))
            total, number = total[first], number[first]
        edges = np.searchsorted(number, np.arange(len(blocks) + 1))
        found, blobs = [], []
        for i in range(len(blocks)):
            part = slice(edges[i], edges[i + 1])
            places = np.flatnonzero(total[part] != counts[part])
            if len(places):
                found.append(i)
                blobs.append((packed(places, deltas=True), packed(total[part][places])))
        return pa.table(
            {
                BLOCK: pa.array(blocks[found], pa.int64()),
                "n": table["n"].combine_chunks().slice(0, 1).take(pa.array([0] * len(found), pa.int64())),
                "bucket": table["bucket"].combine_chunks().slice(0, 1).take(pa.array([0] * len(found), pa.int64())),
                "places": pa.array([p for p, _ in blobs], pa.binary()),
                "totals": pa.array([t for _, t in blobs], pa.binary()),
            }
        )

    def finish(docs: pa.RecordBatch, came: pa.Table) -> dict[str, pa.Array]:
        tokens, flags = _Tokens(texts_of(docs.column(text)), order), _flags(docs, training)
        news: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for n, bucket, at, total in zip(came["n"].to_pylist(), came["bucket"].to_pylist(), came["places"], came["totals"]):
            news.setdefault(n, []).append((bucket, unpacked(at.as_py(), np.int64, deltas=True), unpacked(total.as_py(), np.int64)))
        tables = []
        for n in range(1, order + 1):
            places, number, own, counts = _counted(tokens, flags, n)
            for bucket, more, total in news.get(n, ()):
                counts[np.searchsorted(own, np.uint64(bucket) << np.uint64(64 - bits)) + more] = total
            tables.append((places, number, counts))
        whole = n_tokens + ADD * (n_types + 1)
        chances = (tables[0][2] + ADD) / whole
        at, own = tokens.first[:-1], tables[0][1]
        automaton = Automaton(tables, chances, ADD / whole, strength, len(tokens.hashes))

        def per_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, at) if len(at) else x[:0]

        return {
            "n_tokens": pa.array(np.diff(tokens.first).astype(np.int64)),
            "n_known": pa.array(per_text((tables[0][2] > 0)[own].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(at), n_tokens, np.int64)),
            "base_score": pa.array(per_text(np.log10(chances)[own])),
            "score": pa.array(automaton.walk(tokens.first, order - 1)),
        }

    asked = asked_columns.mapInArrow(lambda batches: counts_of(batches, range(1, order + 1), unseen=True), message)
    replies = asked.groupBy("n", "bucket").applyInArrow(reply, f"{BLOCK} long, n int, bucket int, places binary, totals binary")
    scored = answered(blocks, replies, finish, ADDED)
    if text in names:
        scored = _with_texts(scored, text)
    return scored.select(*(name for name in names if name not in ADDED.names), *ADDED.names)


def _with_texts(df: DataFrame, text: str) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, texts_of(batch.column(at)))

    return df.mapInArrow(unpack, StructType([StructField(f.name, StringType()) if f.name == text else f for f in df.schema.fields]))


def _flags(part: pa.RecordBatch, training: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(training)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
