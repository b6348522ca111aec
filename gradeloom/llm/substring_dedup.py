"""Removal of passages that occur more than once, by a count-min prefilter.

A window is ``window`` consecutive words.  Every window has an anchor: the
``anchor`` words in it whose hash is least, the leftmost of them if several are.
Equal windows have equal anchors, and windows that start at different places have
anchors at different places if they are equal, so the count of an anchor is never
below that of a window.  The first pass counts anchors in one count-min sketch per
task and merges the sketches; the second groups exactly those windows whose anchor
is estimated at two or more.  No repeated window is lost, and few others move.

The sketch has a fixed size (``depth`` rows of ``width`` cells of two bits), which
bounds what is sent to the driver and back.  A small sketch only lets more windows
through to the exact pass; widen it with the corpus, to about as many cells as
there are words divided by five.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gradeloom.llm.blocks import (
    BLOCK,
    answered,
    bucket_bits,
    cut,
    numbers,
    parts_of_blocks,
    staged_blocks,
)
from gradeloom.llm.words import SECOND, Words, mixed, windows, words_of

WINDOW = 35
ANCHOR = 8
WIDTH = 1 << 25
DEPTH = 2
# Cells that travel in one row.
_PIECE = 1 << 16
_MANY = 2

ADDED = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("kept", StringType()),
        StructField("removed", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    ]
)


def _anchors(hashes: np.ndarray, starts: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of every window, and the hash of the anchor at every place."""
    places, grams = windows(hashes, first, anchor)
    at = np.zeros(len(hashes), np.uint64)
    at[places] = grams
    # The upper bits order, the lower ones are the place: the least is leftmost.
    bits = np.uint64(max(1, len(hashes)).bit_length())
    low = np.full(len(hashes), np.uint64(2**64 - 1))
    low[places] = (grams >> bits << bits) | places.astype(np.uint64)
    span, reach = window - anchor + 1, 1
    while reach * 2 <= span:
        low[:-reach] = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    least = np.minimum(low[starts], low[starts + span - reach])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), at


def _cells(grams: np.ndarray, width: int, depth: int) -> list[np.ndarray]:
    step = mixed(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return [((grams + step * np.uint64(row)) & np.uint64(width - 1)).astype(np.int64) for row in range(depth)]


def _pack(cells: np.ndarray) -> bytes:
    four = cells.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    four = np.frombuffer(packed, np.uint8)
    return np.stack([four >> shift & 3 for shift in (0, 2, 4, 6)], axis=1).ravel()


def _merged_sketch(blocks: DataFrame, text: str, window: int, anchor: int, width: int, depth: int) -> np.ndarray:
    """Counts of anchors, up to two; at most ``depth * width / 4`` bytes reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(depth * width, np.uint8)
        for _, part in parts_of_blocks(batches, text):
            words = words_of(part.column(text))
            hashes = words.hashes()
            starts, _ = windows(hashes, words.first, window)
            places, grams = _anchors(hashes, starts, words.first, window, anchor)
            # A place counts once, however many windows it anchors.
            grams, times = np.unique(grams[np.unique(places)], return_counts=True)
            for row, cells in enumerate(_cells(grams, width, depth)):
                own, inverse = np.unique(cells + row * width, return_inverse=True)
                total = np.minimum(_MANY, np.bincount(inverse, weights=times)).astype(np.uint8)
                sketch[own] = np.minimum(_MANY, sketch[own] + total)
        for piece in range(0, depth * width, _PIECE):
            cells = sketch[piece : piece + _PIECE]
            if cells.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece // _PIECE], pa.int32()), pa.array([_pack(cells)], pa.binary())], names=["piece", "cells"]
                )

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(_PIECE, np.uint8)
        for packed in table["cells"]:
            total = np.minimum(_MANY, total + _unpack(packed.as_py()))
        return pa.table({"piece": table["piece"][:1], "cells": pa.array([_pack(total)], pa.binary())})

    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    schema = "piece int, cells binary"
    pieces = blocks.coalesce(tasks).mapInArrow(count, schema).groupBy("piece").applyInArrow(merge, schema)
    packed = np.zeros(depth * width // 4, np.uint8)
    for piece, cells in pieces.toLocalIterator():
        packed[piece * _PIECE // 4 : (piece + 1) * _PIECE // 4] = np.frombuffer(cells, np.uint8)
    return packed


def _estimated_repeated(packed: np.ndarray, width: int, depth: int, grams: np.ndarray) -> np.ndarray:
    many = np.ones(len(grams), bool)
    for row, cells in enumerate(_cells(grams, width, depth)):
        cells = cells + row * width
        many &= (packed[cells >> 2] >> ((cells & 3) * 2).astype(np.uint8) & 3) >= _MANY
    return many


def _suspects(words: Words, packed: np.ndarray, window: int, anchor: int, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows estimated repeated."""
    hashes = words.hashes()
    starts, keys = windows(hashes, words.first, window)
    places, grams = _anchors(hashes, starts, words.first, window, anchor)
    many = np.zeros(len(hashes), bool)
    used = np.unique(places)
    many[used] = _estimated_repeated(packed, width, depth, grams[used])
    suspect = many[places]
    return starts[suspect], keys[suspect]


def remove_repeated_passages(
    df: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    width: int = WIDTH,
    depth: int = DEPTH,
) -> DataFrame:
    """Every row with the words outside repeated windows.

    Adds ``n_words``, ``n_removed``, ``kept`` (the kept words joined by one space)
    and ``removed`` (places of the removed words, the end exclusive).  A word goes if
    a window over it has the same words as a window that starts elsewhere, in the same
    text or another; all such windows go.  Windows are judged on the input.

    Null and empty texts have no words and keep ``""``.  Repeated rows are repeated
    windows.  Texts shorter than a window are kept whole.  A column of ``df`` with the
    name of an added one is replaced.  An empty table gives an empty result.
    """
    if width & (width - 1) or width < _PIECE:
        raise ValueError(f"width has to be a power of two from {_PIECE} on")
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has at least one word and at most the window's")
    spark = df.sparkSession
    blocks = staged_blocks(df, text)
    texts = blocks.select(BLOCK, text)
    sketch = spark.sparkContext.broadcast(_merged_sketch(texts, text, window, anchor, width, depth))
    bits = bucket_bits(blocks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in parts_of_blocks(batches, text):
            words = words_of(part.column(text))
            starts, keys = _suspects(words, sketch.value, window, anchor, width, depth)
            other = SECOND.runs(words.hashes(SECOND), starts, starts + window)
            order = np.lexsort((other, keys))
            keys, other = keys[order], other[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])
            at = np.flatnonzero(new)
            times = np.minimum(np.diff(np.append(at, len(keys))), _MANY).astype(np.uint8)
            keys, other = keys[at], other[at]
            parts = cut(keys, bits)
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in parts], pa.int32()),
                        pa.array([block] * len(parts), pa.int64()),
                        *(pa.array([x[s].tobytes() for _, s in parts], pa.binary()) for x in (keys, other, times)),
                    ],
                    names=["bucket", BLOCK, "keys", "other", "times"],
                )

    def only_once(table: pa.Table) -> pa.Table:
        """The windows of a bucket that occur once, for the block that has them."""
        keys, row = numbers(table["keys"], np.uint64)
        other, _ = numbers(table["other"], np.uint64)
        times, _ = numbers(table["times"], np.uint8)
        order = np.lexsort((other, keys))
        keys, other, row, times = keys[order], other[order], row[order], times[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])
        last = np.append(new[1:], True)
        single = new & last & (times == 1)
        keys, row = keys[single], row[single]
        order = np.argsort(row, kind="stable")
        keys, row = keys[order], row[order]
        rows, at = np.unique(row, return_index=True)
        parts = np.split(keys, at[1:]) if len(rows) else []
        return pa.table(
            {BLOCK: table[BLOCK].take(pa.array(rows)), "single": pa.array([x.tobytes() for x in parts], pa.binary())}
        )

    def strike(docs: pa.RecordBatch, came: pa.Table) -> dict[str, pa.Array]:
        words = words_of(docs.column(text))
        starts, keys = _suspects(words, sketch.value, window, anchor, width, depth)
        single, _ = numbers(came["single"], np.uint64)
        if len(single):
            single = np.sort(single)
            at = np.minimum(np.searchsorted(single, keys), len(single) - 1)
            starts = starts[single[at] != keys]
        return _struck(words, starts, window)

    asked = texts.mapInArrow(ask, f"bucket int, {BLOCK} long, keys binary, other binary, times binary")
    single = asked.groupBy("bucket").applyInArrow(only_once, f"{BLOCK} long, single binary")
    return answered(blocks, single, strike, ADDED)


def _struck(words: Words, starts: np.ndarray, window: int) -> dict[str, pa.Array]:
    """Result columns of a block whose windows at ``starts`` are repeated."""
    edges = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    gone = np.cumsum(edges)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(gone)])
    joined, place = words.joined(~gone)
    raw = joined.tobytes()
    # Runs of removed words, cut where a text ends.
    text_of = np.repeat(np.arange(len(words.counts)), words.counts)
    opens, closes = gone.copy(), gone.copy()
    same = text_of[1:] == text_of[:-1]
    opens[1:] &= ~(gone[:-1] & same)
    closes[:-1] &= ~(gone[1:] & same)
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    base = words.first[text_of[opens]]
    spans = pa.StructArray.from_arrays(
        [pa.array((opens - base).astype(np.int32)), pa.array((closes - base).astype(np.int32))], names=["start", "end"]
    )
    offsets = np.searchsorted(opens, words.first).astype(np.int32)
    return {
        "n_words": pa.array(words.counts.astype(np.int64)),
        "n_removed": pa.array((before[words.first[1:]] - before[words.first[:-1]]).astype(np.int64)),
        "kept": pa.array([raw[s : max(s, e - 1)].decode() for s, e in zip(place[:-1].tolist(), place[1:].tolist())], pa.string()),
        "removed": pa.ListArray.from_arrays(pa.array(offsets), spans),
    }
