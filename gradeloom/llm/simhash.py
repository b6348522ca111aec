"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

A fingerprint is cut into ``pieces``.  Two fingerprints that differ in at most
``max_bits`` bits differ in at most as many pieces, so they agree on some choice of
``pieces - max_bits`` of them.  Fingerprints meet under every choice of pieces and
are verified there by Hamming distance.  A bucket gives a forest of its links, not
its pairs.  Buckets above ``max_bucket`` fingerprints are dealt out again: their
remaining bits are cut into ``max_bits + 1`` pieces, one of which has to agree, until
all buckets are small.  Equal fingerprints count once, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradeloom.llm.blocks import result_schema, with_results
from gradeloom.llm.components import components
from gradeloom.llm.words import slices, words_of
from gradeloom.staging import stage

SEED = 42
MAX_BUCKET = 4096
_SLICE_BYTES = 1 << 20
_CHUNK = 1 << 17
# Runs up to this length are compared for all buckets of a batch at once.
_SHORT = 16


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """A fingerprint of each text; a bit is set if it is in over half of the hashes of its shingles."""
    words = words_of(texts, lower=True)
    joined, place = words.joined()
    data = joined.tobytes()
    ends_in = np.cumsum(words.ends - words.starts + 1) - 1
    starts_in = ends_in - (words.ends - words.starts)
    counts = words.counts
    n = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    text_of = np.repeat(np.arange(len(n)), n)
    begin = words.first[:-1][text_of] + np.arange(len(text_of)) - np.repeat(np.cumsum(n) - n, n)
    end = np.minimum(begin + shingle, words.first[1:][text_of]) - 1
    bits = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(begin), _CHUNK):
        part = slice(i, i + _CHUNK)
        spans = zip(starts_in[begin[part]].tolist(), ends_in[end[part]].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(data[s:e], SEED) for s, e in spans], np.uint64)
        flags = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
        owners, at = np.unique(text_of[part], return_index=True)
        bits[owners] += np.add.reduceat(flags, at, axis=0, dtype=np.int64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return ((bits * 2 > n[:, None]) * powers).sum(axis=1, dtype=np.uint64)


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``fingerprint``, 64 bits as a long.

    Texts are lower-cased (A-Z); their words are joined by one space.  A text of fewer
    words than a shingle is one shingle; null and wordless texts have fingerprint 0.
    """
    names = list(df.columns if keep is None else keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, _SLICE_BYTES):
                found = fingerprints_of(part.column(part.schema.get_field_index(text)), shingle).view(np.int64)
                yield with_results(part.select(names), {"fingerprint": pa.array(found)})

    return df.mapInArrow(add, result_schema(df.select(*names), StructType([StructField("fingerprint", LongType())])))


def _masks(free: int, pieces: int) -> list[int]:
    """The set bits of ``free`` in runs of about equal size."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    edges = [len(bits) * i // pieces for i in range(pieces + 1)]
    return [sum(bits[a:b]) for a, b in zip(edges, edges[1:]) if a < b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether fingerprints differ in at most ``max_bits`` bits."""
    return np.bitwise_count(left ^ right) <= max_bits


def _forest(prints: np.ndarray, run: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within each run of a sorted batch."""
    label = np.arange(len(run))
    edges = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(edges, len(run)))
    pairs = [np.zeros((2, 0), np.int64)]
    for lag in range(1, min(_SHORT, int(sizes.max(initial=1)))):
        a = np.flatnonzero(run[:-lag] == run[lag:])
        a = a[_near(prints[a], prints[a + lag], max_bits)]
        pairs.append(np.stack([a, a + lag]))
    a, b = np.concatenate(pairs, axis=1)
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        # The roots hang together too, not only the two ends.
        for x in (label[a], label[b], a, b):
            np.minimum.at(label, x, least)
        while (label[label] != label).any():
            label = label[label]
    for begin, size in zip(edges[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist()):
        # Whoever is reached is compared only with those not reached yet.
        own = prints[begin : begin + size]
        left = np.arange(size)
        while len(left):
            root, left = left[0], left[1:]
            todo = [root]
            while todo and len(left):
                near = _near(own[left], own[todo.pop()], max_bits)
                label[begin + left[near]] = begin + root
                todo += left[near].tolist()
                left = left[~near]
            label[begin + root] = begin + root
    linked = np.flatnonzero(label != np.arange(len(run)))
    return linked, label[linked]


def _links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of fingerprints within the buckets (mask, value) of ``keyed``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mask", "value", "fingerprint"]
        held = {name: np.zeros(0, np.int64) for name in names}

        def linked(end: int) -> pa.RecordBatch:
            own = {name: x[:end] for name, x in held.items()}
            new = np.append(True, (own["mask"][1:] != own["mask"][:-1]) | (own["value"][1:] != own["value"][:-1]))
            prints = own["fingerprint"]
            a, b = _forest(prints.view(np.uint64), np.cumsum(new), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["a", "b"])

        for batch in batches:
            held = {name: np.concatenate([x, batch.column(name).to_numpy()]) for name, x in held.items()}
            # The last bucket may go on in the next batch.
            mask, value = held["mask"], held["value"]
            same = (mask == mask[-1]) & (value == value[-1]) if len(mask) else np.zeros(0, bool)
            end = int(np.argmax(same)) if len(same) else 0
            if end:
                yield linked(end)
                held = {name: x[end:] for name, x in held.items()}
        if len(held["mask"]):
            yield linked(len(held["mask"]))

    # With a given number, adaptive execution leaves every bucket in one partition.
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(partitions, "mask", "value").sortWithinPartitions("mask", "value", "fingerprint")
    return dealt.mapInArrow(compare, "a long, b long")


def fingerprint_links(
    distinct: DataFrame, max_bits: int = 3, pieces: int | None = None, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """Links (a, b) that connect all ``fingerprint`` values within ``max_bits`` bits of each other."""
    spark = distinct.sparkSession
    pieces = 2 * max_bits if pieces is None else pieces
    if not max_bits < pieces <= 64:
        raise ValueError("there have to be more pieces than bits that may differ")
    masks = [sum(chosen) for chosen in combinations(_masks((1 << 64) - 1, pieces), pieces - max_bits)]
    rows = distinct.select("fingerprint", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    found = []
    while True:
        keyed = rows.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
        large = stage(keyed.groupBy("mask", "value").count().filter(F.col("count") > max_bucket).drop("count"), "large")
        present = [m for (m,) in large.select("mask").distinct().collect()]
        if not present:
            found.append(_links(keyed, max_bits))
            break
        found.append(_links(keyed.join(large, ["mask", "value"], "left_anti"), max_bits))
        finer = [
            (mask, _signed((mask % (1 << 64)) | piece))
            for mask in present
            for piece in _masks(~mask % (1 << 64), max_bits + 1)
        ]
        crowded = keyed.join(large, ["mask", "value"], "left_semi").select("fingerprint", "mask")
        table = spark.createDataFrame(finer, "mask long, finer long")
        rows = stage(crowded.join(F.broadcast(table), "mask").selectExpr("fingerprint", "finer AS mask").distinct(), "finer")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicate_groups(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    max_bits: int = 3,
    pieces: int | None = None,
    max_bucket: int = MAX_BUCKET,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row with its ``fingerprint``, its group and whether it is the one to keep.

    ``component_id`` is the least ``doc_id`` whose fingerprint is reachable over
    links of at most ``max_bits`` bits, the row itself included.  ``first_of_group``
    is true for exactly one row of each group, one with that id.

    Repeated rows are in one group.  Null and wordless texts have fingerprint 0 and are
    linked like any other.  Null ids are never the least unless the group has no other.
    Columns of ``df`` named like an added one, ``_row`` or ``_node`` are replaced.  An empty
    table gives an empty result.
    """
    marked = with_fingerprints(df, text, shingle, keep).drop("component_id", "first_of_group")
    marked = marked.withColumn("_row", F.monotonically_increasing_id()).withColumn("_node", F.col("fingerprint"))
    marked = stage(marked, "fingerprints")
    least = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_row").alias("row")))
    distinct = stage(marked.groupBy("_node").agg(least.alias("least")), "distinct_fingerprints")
    links = fingerprint_links(distinct.select(F.col("_node").alias("fingerprint")), max_bits, pieces, max_bucket)
    roots = components(links).withColumnRenamed("node", "_node")
    placed = distinct.select("_node", "least").join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    groups = stage(placed.groupBy("root").agg(F.min("least").alias("group_least")), "groups")
    of_node = placed.join(groups, "root").selectExpr("_node", "group_least.id AS component_id", "group_least.row AS _first")
    return (
        marked.join(of_node, "_node")
        .withColumn("first_of_group", F.col("_row") == F.col("_first"))
        .drop("_row", "_first", "_node")
    )


def hex_fingerprint(name: str = "fingerprint") -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(name), 16, "0"))
