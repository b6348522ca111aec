"""Word vectors from counts of words that stand near each other.

Everything is a table: weighted counts of pairs, their log ratios to chance, and
vectors as sums of signed hashed dimensions.  No model passes through the driver, and
neither the vocabulary nor a sentence has a largest size.

Words, pairs and entries of vectors are dealt out to buckets of words.  A task hands on one row for
each bucket with all it has for it, as compressed numbers: frequent words by their
place in the list of frequent words, others by their place in a list in the row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.staging import stage

# Log ratios are kept in steps of one in 2**20, so that their sums do not depend on their order.
STEPS = 1 << 20
# So many of the most frequent words at most are known to every task.
HEAD = 500_000
# Pairs that a task adds up at a time, in parts of so many, and different ones that it hands on at a time.
PAIRS_AT_ONCE = 1 << 23
KEYS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 1 << 16
# Entries of vectors that a task holds until it hands them on.
ENTRIES_AT_ONCE = 1 << 21
# Words that are dealt out together.
DESCRIBED_AT_ONCE = 1 << 18
# Buckets at least, and occurrences and words that a bucket gets on average at most.
LEAST_BUCKETS, BUCKET_PLACES, BUCKET_WORDS = 1 << 8, 1 << 21, 1 << 15

# What a row for a bucket holds.
PAIRS, WORDS, ENTRIES, OPEN = range(4)
PARCEL = "bucket int, kind int, parts array<binary>"


class Head(NamedTuple):
    """The most frequent words, the first most often, with what is known of them.

    All words with ``least`` occurrences are here.  ``buckets`` is the number of buckets.
    """

    words: pa.StringArray
    totals: np.ndarray
    marks: np.ndarray
    least: int
    buckets: int

    def home(self, words: pa.StringArray, ids: np.ndarray) -> np.ndarray:
        """Bucket of each word; ``ids`` are places in the head, or at least its size."""
        home = ids % self.buckets
        rare = np.flatnonzero(ids >= len(self.words))
        home[rare] = [zlib.crc32(word) % self.buckets for word in words.take(pa.array(rare)).cast(pa.binary()).to_pylist()]
        return home

    def ids(self, words: pa.StringArray) -> np.ndarray:
        """Place of each word in the head; other words get the numbers behind it in their order."""
        ids = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        rare = ids < 0
        ids[rare] = len(self.words) + np.arange(np.count_nonzero(rare))
        return ids


def count_neighbours(sentences: DataFrame, window: int = 5, words: str = "words") -> DataFrame:
    """``a``, ``b`` (a <= b) and the weight ``n`` of all pairs of words within ``window`` words of a sentence.

    Neighbours count ``window``, the next ones less by one, and so on; a word that meets
    itself counts for both.  Null words stand in the way but are in no pair.  The words
    are counted when this is called.
    """
    spoken = _spoken(sentences, words)
    head = _head(_word_sums(spoken, window), 1)
    at_hand = spoken.sparkSession.sparkContext.broadcast(head)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            high, low, n, rare = _added(rows[PAIRS], bucket, at_hand.value)
            known = pa.concat_arrays([at_hand.value.words, rare])
            for at in range(0, len(n), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                x, y = (known.take(pa.array(side[some])) for side in (high, low))
                less = pc.less(x, y)
                sides = [pc.if_else(less, x, y), pc.if_else(less, y, x)]
                yield pa.RecordBatch.from_arrays([*sides, pa.array(n[some])], names=["a", "b", "n"])

    return _met(_pairs(spoken, window, at_hand, both=False)).mapInArrow(add_up, "a string, b string, n bigint")


def _spoken(sentences: DataFrame, words: str) -> DataFrame:
    return sentences.select(F.col(words).cast("array<string>").alias("words"))


def _word_sums(spoken: DataFrame, window: int) -> DataFrame:
    """``word``, ``n`` (occurrences) and ``total`` (the sum of its pairs, those with itself twice) of all words."""
    if window < 1:
        raise ValueError("the window has to reach one word at least")
    at_once = max(PAIRS_AT_ONCE // window, 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _held(batches, at_once):
            for coded, ids, n_own, pairs in _near(lists, window, at_once):
                n_words = len(coded)
                n = np.bincount(ids[:n_own][ids[:n_own] >= 0], minlength=n_words)
                total = np.zeros(n_words, np.int64)
                for weight, *sides in pairs:
                    for side in sides:
                        total += weight * np.bincount(side, minlength=n_words)
                for at in range(0, n_words, ROWS_AT_ONCE):
                    some = slice(at, at + ROWS_AT_ONCE)
                    yield pa.RecordBatch.from_arrays([coded[some], pa.array(n[some]), pa.array(total[some])], names=["word", "n", "total"])

    partial = spoken.mapInArrow(count, "word string, n bigint, total bigint")
    return stage(partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "words")


def _head(sums: DataFrame, size: int) -> Head:
    """The most frequent words, as many as have the same or more occurrences and are not more than ``HEAD``."""
    groups = sorted(sums.groupBy("n").agg(F.count("*").alias("n_words")).collect(), reverse=True)
    n_words, least = 0, groups[0][0] + 1 if groups else 0
    for n, more in groups:
        if n_words + more > HEAD:
            break
        n_words, least = n_words + more, n
    found = sums.filter(F.col("n") >= least).select("word", "n", "total", _mark("word", size).alias("mark")).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    buckets = max(LEAST_BUCKETS, sum(n * k for n, k in groups) // BUCKET_PLACES, sum(k for _, k in groups) // BUCKET_WORDS)
    words = found.column("word").cast(pa.string()).combine_chunks()
    return Head(words, *(found.column(x).to_numpy().astype(np.int64) for x in ("total", "mark")), least, buckets)


def _held(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[list[pa.ListArray]]:
    """Sentences of at least ``at_once`` words together, and the last ones."""
    held, n_held = [], 0
    for batch in batches:
        held.append(batch.column(0))
        n_held += len(held[-1].flatten())
        if n_held >= at_once:
            yield held
            held, n_held = [], 0
    if held:
        yield held


def _near(lists: list[pa.ListArray], window: int, at_once: int) -> Iterator[tuple]:
    """For each ``at_once`` words: different words, their places in these (null: -1), how many are counted here, and
    for each distance the weight and both sides of the pairs that begin here."""
    flat = pa.concat_arrays([x.flatten() for x in lists])
    sizes = np.concatenate([x.value_lengths().fill_null(0).to_numpy() for x in lists])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    reach = min(window, int(sizes.max(initial=0)) - 1)

    def pairs(ids: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in range(1, reach + 1):
            first, second = ids[:-k][:at_once], ids[k:][:at_once]
            near = (place[:-k][:at_once] == place[k:][:at_once]) & (first >= 0) & (second >= 0)
            yield window + 1 - k, first[near], second[near]

    for begin in range(0, len(flat), at_once):
        # The last words also meet those behind them.
        coded = flat.slice(begin, at_once + reach).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        ranks = np.empty(len(order) + 1, np.int64)
        ranks[order.to_numpy()] = np.arange(len(order))
        ranks[len(order)] = -1
        ids = ranks[coded.indices.fill_null(len(order)).to_numpy()]
        yield coded.dictionary.take(order), ids, at_once, pairs(ids, sentence[begin : begin + at_once + reach])


def _counted(lists: list[pa.ListArray], window: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Weights of the pairs in some sentences, added up over each ``at_once`` words; ``a`` and ``b`` share a dictionary in order."""
    for known, _, _, pairs in _near(lists, window, at_once):
        bits, more = len(known).bit_length(), window.bit_length()
        # Sorted in place and added up in parts, since nothing else of a task is as large.
        keys, n_keys = np.empty(window * at_once if len(known) else 0, np.int64), 0
        for weight, first, second in pairs:
            pair = np.minimum(first, second) << bits | np.maximum(first, second)
            keys[n_keys : n_keys + len(pair)] = pair << more | weight
            n_keys += len(pair)
        keys = keys[:n_keys]
        keys.sort()
        found = [_totals(*_halves(keys[at : at + KEYS_AT_ONCE], more)) for at in range(0, n_keys, KEYS_AT_ONCE)]
        del keys
        # A pair on the edge of two parts is in both.
        pair, totals = _totals(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ()))))
        del found
        sides = [pa.DictionaryArray.from_arrays(pa.array(side.astype(np.int32)), known) for side in _halves(pair, bits)]
        counted = pa.RecordBatch.from_arrays([*sides, pa.array(totals)], names=["a", "b", "n"])
        del pair, totals, sides
        yield counted


def _halves(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands above and in the last bits."""
    return keys >> bits, keys & ((1 << bits) - 1)


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their values, from keys in order."""
    if not len(keys):
        return keys, values
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(values, starts)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their values."""
    key, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, values))
    order = np.argsort(key, kind="stable")
    return _totals(key[order], value[order])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, the bytes of one weight together."""
    folded = (values << 1) ^ (values >> 63)
    width = max(1, (int(folded.max(initial=0)).bit_length() + 7) // 8)
    planes = folded.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width]
    return width.to_bytes(1, "little") + _pressed(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_freed(data[1:]), np.uint8).reshape(data[0], -1)
    folded = np.zeros((planes.shape[1], 8), np.uint8)
    folded[:, : data[0]] = planes.T
    folded = folded.view("<i8").ravel()
    return (folded >> 1) ^ -(folded & 1)


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _freed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def _packed_words(words: pa.StringArray) -> list[bytes]:
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    return [_packed(lengths), _pressed(b"".join(words.cast(pa.binary()).to_pylist()))]


def _unpacked_words(lengths: bytes, letters: bytes) -> pa.StringArray:
    ends = np.append(0, np.cumsum(_unpacked(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(_freed(letters)))


def _parcels(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    buckets, kinds, parts = zip(*rows) if rows else ((), (), ())
    columns = [pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(parts, pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "parts"])


def _met(parcels: DataFrame) -> DataFrame:
    return parcels.repartition("bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[list[bytes]]]]]:
    """Every bucket with the parts of its rows by their kind."""
    bucket, rows = None, [[], [], [], []]
    for batch in batches:
        for at, kind, parts in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "parts"))):
            if at != bucket and bucket is not None:
                yield bucket, rows
                rows = [[], [], [], []]
            bucket = at
            rows[kind].append(parts)
    if bucket is not None:
        yield bucket, rows


def _pairs(spoken: DataFrame, window: int, at_hand, both: bool) -> DataFrame:
    """Rows of pairs, each in the bucket of its rarer word, or pairs of two rare words in those of ``both``."""
    at_once = max(PAIRS_AT_ONCE // window, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _held(batches, at_once):
            for counted in _counted(lists, window, at_once):
                yield _parcels(list(_dealt(counted, at_hand.value, both)))

    return spoken.mapInArrow(deal, PARCEL)


def _dealt(counted: pa.RecordBatch, head: Head, both: bool) -> Iterator[tuple[int, int, list[bytes]]]:
    known, n = counted.column("a").dictionary, counted.column("n").to_numpy()
    ids = head.ids(known)
    home = head.home(known, ids)
    n_head = len(head.words)
    bits = (n_head + len(known)).bit_length()
    first, second = (counted.column(x).indices.to_numpy() for x in ("a", "b"))
    rarer = ids[first] > ids[second]
    high, low = np.where(rarer, first, second), np.where(rarer, second, first)
    key = home[high]
    for side in (high, low):
        key <<= bits
        key |= ids[side]
    if both:
        again = (ids[low] >= n_head) & (home[high] != home[low])
        more = (home[low[again]] << bits | ids[high[again]]) << bits | ids[low[again]]
        key, n = np.append(key, more), np.append(n, n[again])
    del first, second, rarer, high, low
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    rare = np.flatnonzero(ids >= n_head)
    cuts = np.searchsorted(key, np.arange(head.buckets + 1) << 2 * bits)
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        some = slice(cuts[bucket], cuts[bucket + 1])
        high, low = _halves(key[some] - (bucket << 2 * bits), bits)
        used = np.unique(np.concatenate([side[side >= n_head] for side in (high, low)]))
        high, low = (np.where(side < n_head, side, n_head + np.searchsorted(used, side)) for side in (high, low))
        keys = _place(high, head) << (n_head + len(used)).bit_length() | low
        words = known.take(pa.array(rare[used - n_head]))
        yield bucket, PAIRS, [_packed(np.diff(keys, prepend=0)), _packed(n[some]), *_packed_words(words)]


def _place(ids: np.ndarray, head: Head) -> np.ndarray:
    """Numbers of words of one bucket without gaps: those of the head, and then the others."""
    n_head = len(head.words)
    return np.where(ids < n_head, ids // head.buckets, ids - n_head + n_head // head.buckets + 1)


def _at_place(places: np.ndarray, bucket: int, head: Head) -> np.ndarray:
    n_head = len(head.words)
    top = n_head // head.buckets + 1
    return np.where(places < top, places * head.buckets + bucket, places - top + n_head)


def _together(words: list[pa.StringArray]) -> tuple[list[np.ndarray], pa.StringArray]:
    """Place of the words of each list among all different ones, and these."""
    coded = pa.concat_arrays([pa.array([], pa.string()), *words]).dictionary_encode()
    ends = np.cumsum([len(x) for x in words])
    return np.split(coded.indices.to_numpy().astype(np.int64), ends)[:-1], coded.dictionary


def _added(rows: list[list[bytes]], bucket: int, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Both sides and the weights of the different pairs of a bucket, and the words behind those of the head."""
    n_head = len(head.words)
    places, rare = _together([_unpacked_words(*parts[2:]) for parts in rows])
    bits, keys, weights = (n_head + len(rare)).bit_length(), [], []
    for (pairs, n, *_), own in zip(rows, places):
        high, low = _halves(np.cumsum(_unpacked(pairs)), (n_head + len(own)).bit_length())
        high = _at_place(high, bucket, head)
        for side in (high, low):
            late = side >= n_head
            side[late] = n_head + own[side[late] - n_head]
        keys.append(high << bits | low)
        weights.append(_unpacked(n))
    key, n = _summed(keys, weights)
    return *_halves(key, bits), n, rare


def _number(word: str | Column, begin: int, digits: int) -> Column:
    """Hexadecimal digits of the word's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.col(word).cast("binary")), begin, digits), 16, 10).cast("long")


def _mark(word: str | Column, size: int) -> Column:
    """The dimension of a word, from 1 on, below zero for those that are taken away."""
    return F.when(_number(word, 9, 1) < 8, 1).otherwise(-1) * (_number(word, 1, 8) % size + 1)


def _entry_parts(keys: np.ndarray, steps: np.ndarray, words: pa.StringArray) -> list[bytes]:
    return [_packed(np.diff(keys, prepend=0)), _packed(steps), *_packed_words(words)]


def _described(sums: DataFrame, at_hand) -> DataFrame:
    """Rows of words for their buckets: places of those in the head, ``n`` of all, sums and marks of the others."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            held.append(batch)
            n_held += batch.num_rows
            if n_held >= DESCRIBED_AT_ONCE:
                yield _parcels(list(_word_parcels(held, at_hand.value)))
                held, n_held = [], 0
        if held:
            yield _parcels(list(_word_parcels(held, at_hand.value)))

    return sums.mapInArrow(describe, PARCEL)


def _word_parcels(batches: list[pa.RecordBatch], head: Head) -> Iterator[tuple[int, int, list[bytes]]]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    words = rows.column("word").combine_chunks()
    n, total, mark = (rows.column(x).to_numpy() for x in ("n", "total", "mark"))
    ids = head.ids(words)
    home = head.home(words, ids)
    order = np.lexsort((ids, home))
    cuts = np.searchsorted(home[order], np.arange(head.buckets + 1))
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        some = order[cuts[bucket] : cuts[bucket + 1]]
        rare = some[ids[some] >= len(head.words)]
        known = ids[some[: len(some) - len(rare)]]
        yield bucket, WORDS, [*map(_packed, (known, n[some], total[rare], mark[rare])), *_packed_words(words.take(pa.array(rare)))]


class _Described(NamedTuple):
    """The words of a bucket: places of those in the head, then the others with their sums and marks; ``n`` of all."""

    known: np.ndarray
    n: np.ndarray
    words: pa.StringArray
    totals: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, rows: list[list[bytes]]) -> _Described:
        known, n, totals, marks = ([_unpacked(parts[k]) for parts in rows] for k in range(4))
        joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        ends = [len(x) for x in known]
        n = [x[:end] for x, end in zip(n, ends)] + [x[end:] for x, end in zip(n, ends)]
        words = pa.concat_arrays([pa.array([], pa.string()), *(_unpacked_words(*parts[4:]) for parts in rows)])
        return cls(joined(known), joined(n), words, joined(totals), joined(marks))

    def at(self, words: pa.StringArray) -> np.ndarray:
        """Place of each word among the others, -1 for words of other buckets."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)


def _steps(n: np.ndarray, whole: int, total: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Steps of the log ratio to chance, none below zero."""
    ratio = n * float(whole) / (total.astype(np.float64) * met)
    return np.floor(np.log(np.maximum(ratio, 1)) * STEPS + 0.5).astype(np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], head: Head, size: int, whole: int) -> Iterator[pa.RecordBatch]:
    """From pairs to entries of vectors, added up as far as a task has them.

    Pairs of two rare words are in the buckets of both, where only one sum is known: it goes
    to the bucket of the other word.
    """
    n_head = len(head.words)
    no_words = pa.array([], pa.string())
    held, late = [], []

    def flush_held() -> Iterator[tuple[int, int, list[bytes]]]:
        key, steps = _summed([x for x, _ in held], [x for _, x in held])
        ids, dim = np.divmod(key, size)
        order = np.argsort(ids % head.buckets, kind="stable")
        home, keys, steps = (ids % head.buckets)[order], (_place(ids, head) * size + dim)[order], steps[order]
        cuts = np.searchsorted(home, np.arange(head.buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[bucket], cuts[bucket + 1])
            yield bucket, ENTRIES, _entry_parts(keys[some], steps[some], no_words)

    def flush_late() -> Iterator[tuple[int, int, list[bytes]]]:
        home, n, total, mark = (np.concatenate(x) for x in list(zip(*late))[:4])
        words = pa.concat_arrays([x[4] for x in late])
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(head.buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[bucket] : cuts[bucket + 1]]
            yield bucket, OPEN, [_packed(n[some]), _packed(total[some]), _packed(mark[some]), *_packed_words(words.take(pa.array(some)))]

    for bucket, rows in _by_bucket(batches):
        described = _Described.of(rows[WORDS])
        high, low, n, rare = _added(rows[PAIRS], bucket, head)
        at = described.at(rare)
        total = np.concatenate([head.totals, np.append(described.totals, 0)[at]])
        mark = np.concatenate([head.marks, np.append(described.marks, 0)[at]])
        apart = (high >= n_head) & (low >= n_head) & (high != low)
        if apart.any():
            x, y, weight = high[apart], low[apart], n[apart]
            home = head.home(rare, np.arange(n_head, n_head + len(rare)))
            for own, other in ((x, y), (y, x)):
                here = home[own - n_head] == bucket
                own, other = own[here], other[here]
                late.append((home[other - n_head], weight[here], total[own], mark[own], rare.take(pa.array(other - n_head))))
        high, low, n = high[~apart], low[~apart], n[~apart]
        same = high == low
        steps = _steps(np.where(same, 2 * n, n), whole, total[high], total[low])
        high, low, same, steps = (x[steps > 0] for x in (high, low, same, steps))
        signed = lambda met: (np.abs(mark[met]) - 1, np.sign(mark[met]) * steps)
        dim, found = signed(low)
        # A bucket has all words of its pairs' first side.
        used = np.unique(high[high >= n_head])
        own = np.where(high < n_head, high, n_head + np.searchsorted(used, high))
        key, found = _summed([_place(own, head) * size + dim], [found])
        outgoing = [(bucket, ENTRIES, _entry_parts(key, found, rare.take(pa.array(used - n_head))))]
        dim, found = signed(high)
        held.append(((low * size + dim)[~same], found[~same]))
        if sum(len(x) for x, _ in held) >= ENTRIES_AT_ONCE:
            held[:] = [_summed([x for x, _ in held], [x for _, x in held])]
            if len(held[0][0]) >= ENTRIES_AT_ONCE // 2:
                outgoing += flush_held()
                held.clear()
        if sum(len(x[0]) for x in late) >= ROWS_AT_ONCE * 8:
            outgoing += flush_late()
            late.clear()
        yield _parcels(outgoing)
    if held:
        yield _parcels(list(flush_held()))
    if late:
        yield _parcels(list(flush_late()))


def _filled(batches: Iterator[pa.RecordBatch], head: Head, size: int, whole: int) -> Iterator[pa.RecordBatch]:
    """From entries to the vectors of all words of a bucket."""
    for bucket, rows in _by_bucket(batches):
        described = _Described.of(rows[WORDS])
        n_known, top = len(described.known), len(head.words) // head.buckets + 1
        row_of = np.full(top, -1)
        row_of[described.known // head.buckets] = np.arange(n_known)
        flat = np.zeros(len(described.n) * size, np.int64)
        for keys, steps, *words in rows[ENTRIES]:
            place, dim = np.divmod(np.cumsum(_unpacked(keys)), size)
            row = np.concatenate([row_of, n_known + described.at(_unpacked_words(*words))])[place]
            flat[row * size + dim] += _unpacked(steps)
        for parts in rows[OPEN]:
            n, total, mark = map(_unpacked, parts[:3])
            at = described.at(_unpacked_words(*parts[3:]))
            steps = _steps(n, whole, described.totals[at], total)
            np.add.at(flat, (n_known + at) * size + np.abs(mark) - 1, np.sign(mark) * steps)
        words = pa.concat_arrays([head.words.take(pa.array(described.known)), described.words])
        at_once = max(ROWS_AT_ONCE // size, 1)
        for at in range(0, len(words), at_once):
            values = flat[at * size : (at + at_once) * size] / STEPS
            ends = pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32))
            columns = [words[at : at + at_once], pa.array(described.n[at : at + at_once]), pa.ListArray.from_arrays(ends, pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "vector"])


def _only(spoken: DataFrame, kept: DataFrame) -> DataFrame:
    """Sentences with nulls for all words but the kept ones."""
    rows = stage(spoken.withColumn("_row", F.monotonically_increasing_id()), "sentences")
    places = rows.select("_row", F.posexplode("words").alias("pos", "word"))
    met = places.join(kept.select("word", F.lit(True).alias("_kept")), "word", "left")
    place = F.struct("pos", F.when(F.col("_kept"), F.col("word")).alias("word"))
    said = met.groupBy("_row").agg(F.sort_array(F.collect_list(place))["word"].alias("words"))
    return stage(said.select("words"), "kept")


def train_word_vectors(
    sentences: DataFrame, size: int = 100, window: int = 5, min_count: int = 1, words: str = "words"
) -> DataFrame:
    """``word``, ``n`` (occurrences) and ``vector`` of ``size`` doubles for every word.

    The weight of a word's neighbour is ln(n(a, b) * N / (n(a) * n(b))) where that is positive,
    with n(a) the sum of a word's pairs and N that of all words.  A neighbour adds its
    weight to one dimension or takes it away, by its MD5, so that the products of vectors are
    those of the weights on average.  Words below ``min_count`` have no vector and are nobody's
    neighbour; a word without a neighbour has the zero vector.  The result does not depend on
    partitions; an empty table gives an empty result.
    """
    spoken = _spoken(sentences, words)
    sums = _word_sums(spoken, window)
    if min_count > 1:
        spoken = _only(spoken, sums.filter(F.col("n") >= min_count))
        sums = _word_sums(spoken, window)
    whole = sums.agg(F.sum("total")).first()[0] or 0
    head = _head(sums, size)
    at_hand = spoken.sparkSession.sparkContext.broadcast(head)
    marked = sums.withColumn("mark", _mark("word", size))
    pairs = _pairs(spoken, window, at_hand, both=True)
    met = _met(pairs.unionByName(_described(marked.filter(F.col("n") < head.least), at_hand)))
    entries = met.mapInArrow(lambda batches: _weighed(batches, at_hand.value, size, whole), PARCEL)
    met = _met(entries.unionByName(_described(marked, at_hand)))
    return met.mapInArrow(lambda batches: _filled(batches, at_hand.value, size, whole), "word string, n bigint, vector array<double>")
