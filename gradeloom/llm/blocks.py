"""Documents dealt into blocks of bounded size, and keyed messages between blocks.

A block is some neighbouring rows.  Rows are written once with the random id of
their block, so that it stays the same when tasks are run again.  Blocks tell each
other about hashed keys through buckets of the key space: a block sends one row per
bucket with the sorted keys it has there.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gradeloom.llm.words import slices
from gradeloom.staging import stage

BLOCK = "_block"
BLOCK_BYTES = 4 << 20
# Text whose keys share a bucket, which one task holds at a time.
BUCKET_BYTES = 16 << 20


def staged_blocks(df: DataFrame, text: str = "text", max_bytes: int | None = None, pack: bool = False) -> DataFrame:
    """Write ``df`` with a column ``_block``; a block has about ``max_bytes`` of text, or one longer text.

    With ``pack`` the texts become compressed binaries, for operators that only read them in
    Python; see :func:`texts_of`.
    """
    limit = BLOCK_BYTES if max_bytes is None else max_bytes
    marked = result_schema(df, StructType([StructField(BLOCK, LongType())]))
    if pack:
        marked = StructType([StructField(f.name, BinaryType()) if f.name == text else f for f in marked.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, block = limit, 0
        for batch in batches:
            for part in slices(batch, text, limit):
                more = part.column(part.schema.get_field_index(text)).nbytes
                if size + more > limit:
                    size, block = 0, uuid.uuid4().int >> 65
                size += more
                added = {BLOCK: pa.array(np.full(part.num_rows, block))}
                if pack:
                    values = part.column(part.schema.get_field_index(text)).to_pylist()
                    added[text] = pa.array([None if v is None else zstandard.compress(v.encode(), 9) for v in values], pa.binary())
                made = with_results(part, added)
                yield made.select(marked.names)

    return stage(df.mapInArrow(deal, marked), "blocks")


def texts_of(column: pa.Array) -> pa.Array:
    """The texts of a column, packed or not."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        return column
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([None if v is None else unpack(v) for v in column.to_pylist()], pa.binary()).cast(pa.string())


def parts_of_blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one block at a time, with the block; a scan may cut a block in two."""
    for batch in batches:
        blocks = batch.column(batch.schema.get_field_index(BLOCK)).to_numpy()
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
        for begin, end in zip(edges, [*edges[1:], len(blocks)]):
            for part in slices(batch.slice(begin, end - begin), text, max_bytes or BLOCK_BYTES):
                yield int(blocks[begin]), part


def bucket_bits(blocks: DataFrame, max_bytes: int | None = None) -> int:
    """Bits of a key that choose its bucket, one for about ``BUCKET_BYTES`` of the text in all blocks, whatever its size."""
    n = blocks.select(BLOCK).distinct().count()
    return max(4, (n * (BLOCK_BYTES if max_bytes is None else max_bytes) // BUCKET_BYTES).bit_length())


def cut(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Buckets of sorted keys that have any, with the places of their keys."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate([[0], edges, [len(keys)]])
    return [(b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist()]


def numbers(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Arrays stored as binaries put together, and the row of every element."""
    blobs = [np.frombuffer(x or b"", dtype) for x in column.to_pylist()]
    sizes = [len(x) for x in blobs]
    return (np.concatenate(blobs) if blobs else np.zeros(0, dtype)), np.repeat(np.arange(len(blobs)), sizes)


def answered(
    blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.RecordBatch, pa.Table], dict[str, pa.Array]], added: StructType
) -> DataFrame:
    """Rows of every block with the columns that ``finish`` makes of them and of what came back for it."""
    rows = blocks.drop(*(name for name in added.names if name != BLOCK))
    names = [name for name in rows.columns if name != BLOCK]

    def both(own: pa.Table, came: pa.Table) -> pa.Table:
        # Answers only come back to blocks that have rows.
        batches = own.select(names).combine_chunks().to_batches()
        batch = batches[0] if batches else own.select(names).schema.empty_table().to_batches()[0]
        return pa.Table.from_batches([with_results(batch, finish(batch, came))])

    schema = StructType([*(f for f in rows.schema.fields if f.name != BLOCK), *added.fields])
    return rows.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(both, schema)


def give_back() -> None:
    """Return the memory that a finished task no longer needs: Python workers live on and wait for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_results(batch: pa.RecordBatch, results: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns added; they take the place of columns of the same name."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in results]
    columns = kept + list(results.items())
    return pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])


def result_schema(df: DataFrame, added: StructType) -> StructType:
    """Schema of :func:`with_results`."""
    return StructType([*(f for f in df.schema.fields if f.name not in added.names), *added.fields])

