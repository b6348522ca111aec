"""Spelling variants: words one edit apart, found by an index of variable-length grams.

The gram dictionary is a tree of grams of ``MIN_GRAM`` to ``MAX_GRAM`` characters.  A gram
stays as it is unless it is frequent; then only its extensions count.  So at each
place of a word (an end mark behind it) exactly one gram of the dictionary begins, and
it depends on no character but its own.

One edit affects only the grams that cover its place.  A word of n places of which at
most k cover any one character has n - k grams in common with every near word.  So
of its rarest k + 1 grams, in an order that is the same for all words, one is among the
rarest of the near word too, unaffected.  Lists are merged for these grams only.
A common gram left of the edit has the same beginning of the word before it, and one
right of it the same end behind it, so these belong to the key of a list.

Words of a list are compared pair by pair.  A list above ``MAX_LIST`` is dealt out again: one
half of what its words do not share is equal where the edit is in the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.words import FIRST, SECOND, mixed, slices
from gradeloom.staging import stage

MIN_GRAM, MAX_GRAM = 2, 5
# Most grams that the driver and every task hold; the bound of a frequent gram follows from it.
MAX_FREQUENT = 200_000
MAX_LIST = 128
MAX_ROUNDS = 100
_END = 0x110000
_SLICE_BYTES = 1 << 20
_PAIRS = 1 << 18

_LISTED = "key long, word string, n long, size int, head int, tail int, base int, cut int, heads long, tails long"
_FIELDS = [field.split()[0] for field in _LISTED.split(", ")]


class _Batch:
    """Characters of some words, each word with an end mark behind it."""

    def __init__(self, words: pa.Array) -> None:
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        self.sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(self.sizes + 1)
        self.starts, self.stops = ends - self.sizes - 1, ends
        joined = "".join(f"{word} " for word in words.to_pylist())
        letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        letters[ends - 1] = _END
        self.terms = mixed(letters + np.uint64(1))

    def prefix(self, which: np.ndarray, length: np.ndarray) -> np.ndarray:
        return SECOND.runs(self.terms, self.starts[which], self.starts[which] + length)

    def rest(self, which: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Hash of a word from a place on, with its end mark."""
        return SECOND.runs(self.terms, self.starts[which] + begin, self.stops[which])


def _places(batch: _Batch) -> tuple[np.ndarray, np.ndarray]:
    """Word of every character, and where it stands."""
    word = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
    return word, np.arange(len(word)) + word


@dataclass(frozen=True)
class GramDictionary:
    """Hashes of the frequent grams, sorted, and how often each occurs; all other grams are leaves."""

    hashes: np.ndarray
    counts: np.ndarray
    longest: int

    def counted(self, hashes: np.ndarray) -> np.ndarray:
        """How often a frequent gram occurs, 0 for the others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)

    def grams(self, batch: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, place and end of the one gram at every character, and its hash."""
        word, begin = _places(batch)
        stop = batch.stops[word]
        end = np.minimum(begin + MIN_GRAM, stop)
        gram = FIRST.runs(batch.terms, begin, end)
        go_on = np.arange(len(word))
        for length in range(MIN_GRAM, self.longest):
            go_on = go_on[(end[go_on] == begin[go_on] + length) & (end[go_on] < stop[go_on])]
            go_on = go_on[self.counted(gram[go_on]) > 0]
            end[go_on] += 1
            gram[go_on] = FIRST.runs(batch.terms, begin[go_on], end[go_on])
        return word, begin, end, gram


def gram_dictionary(words: DataFrame, max_frequent: int = MAX_FREQUENT) -> GramDictionary:
    """The dictionary of a table of different words, by the grams that more of their places have than a bound.

    With g places in all, a length has fewer than g / t grams that occur more than t times.  The
    bound t is chosen so that all lengths together stay below ``max_frequent``.
    """
    places, shortest = words.agg(F.sum(F.length("word")), F.min(F.length("word"))).first()
    if shortest is not None and shortest <= MIN_GRAM:
        raise ValueError(f"words of {shortest} characters are too short for grams of {MIN_GRAM}")
    longest = min(MAX_GRAM, (shortest or MAX_GRAM + 1) - 1)
    bound = -(-(longest - MIN_GRAM + 1) * (places or 0) // max_frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "word", _SLICE_BYTES):
                batch = _Batch(part.column("word"))
                word, begin = _places(batch)
                for length in range(MIN_GRAM, longest + 1):
                    inside = begin + length <= batch.stops[word]
                    hashes = FIRST.runs(batch.terms, begin[inside], begin[inside] + length)
                    found, counts = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    grams = words.select("word").mapInArrow(counted, "gram long, n long")
    rows = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > bound).collect()
    hashes = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return GramDictionary(hashes[order], np.array([r.n for r in rows], np.int64)[order], longest)


def _bits(values: np.ndarray) -> np.ndarray:
    """A bit for each number below 64, none for larger ones."""
    return np.where(values < 64, np.uint64(1) << np.minimum(values, 63).astype(np.uint64), np.uint64(0))


def _list_key(batch: _Batch, word: np.ndarray, head: np.ndarray, tail: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Key of the words that share a beginning and an end of these lengths, in the class ``base``."""
    begins, ends = batch.prefix(word, head), batch.rest(word, batch.sizes[word] - tail)
    kind = head.astype(np.uint64) << np.uint64(32) ^ tail.astype(np.uint64) ^ (base + 1).astype(np.uint64) << np.uint64(48)
    return mixed(mixed(begins + kind) ^ ends)


def _listed(part: pa.RecordBatch, dictionary: GramDictionary) -> pa.RecordBatch:
    """The lists of every word: one before and one behind each of its grams that are looked up."""
    batch = _Batch(part.column("word"))
    word, begin, end, gram = dictionary.grams(batch)
    # Characters lie one place further on for every end mark before them.
    first = batch.starts - np.arange(len(batch.starts))
    ends = np.minimum(end, batch.stops[word] - 1) - word
    cover = np.bincount(begin - word, minlength=len(word) + 1) - np.bincount(ends, minlength=len(word) + 1)
    affected = np.maximum.reduceat(np.cumsum(cover)[: len(word)], first) if len(word) else np.zeros(0, np.int64)
    order = np.lexsort((gram, dictionary.counted(gram), word))
    rank = np.empty(len(word), np.int64)
    same = np.zeros(len(word), bool)
    same[1:] = (gram[order[1:]] == gram[order[:-1]]) & (word[order[1:]] == word[order[:-1]])
    # Equal grams of a word are looked up together: all have the rank of their first.
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(len(word))))
    chosen = np.flatnonzero(rank - first[word] <= affected[word])
    word, begin, end = word[chosen], (begin - batch.starts[word])[chosen], (end - batch.starts[word])[chosen]
    size = batch.sizes[word]
    before, behind = end <= size, begin > 0
    heads, tails = np.zeros(len(batch.sizes), np.uint64), np.zeros(len(batch.sizes), np.uint64)
    np.bitwise_or.at(heads, word[before], _bits(end[before]))
    np.bitwise_or.at(tails, word[behind], _bits((size - begin)[behind]))
    owner = np.concatenate([word[before], word[behind]])
    head = np.concatenate([end[before], np.zeros(behind.sum(), np.int64)])
    tail = np.concatenate([np.zeros(before.sum(), np.int64), (size - begin)[behind]])
    base = np.full(len(owner), -1)
    columns = {
        "key": _list_key(batch, owner, head, tail, base).view(np.int64),
        "size": batch.sizes[owner],
        "head": head,
        "tail": tail,
        "base": base,
        "cut": np.where(head > 0, head, -tail),
        "heads": heads[owner].view(np.int64),
        "tails": tails[owner].view(np.int64),
    }
    return _rows(part, owner, columns)


def _rows(source: pa.RecordBatch, owner: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of the lists: words and counts from ``source``, the rest as given or from there."""
    taken = source.take(pa.array(owner))
    arrays = []
    for name in _FIELDS:
        kind = pa.int32() if name in ("size", "head", "tail", "base", "cut") else pa.int64()
        arrays.append(pa.array(columns[name]).cast(kind) if name in columns else taken.column(taken.schema.get_field_index(name)))
    return pa.RecordBatch.from_arrays(arrays, names=_FIELDS)


def _dealt_again(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of large lists in the two lists of their halves, for near words of the same size and of one more or less."""
    batch = _Batch(rows.column("word"))
    size, head, tail, base = (rows.column(name).to_numpy().astype(np.int64) for name in ("size", "head", "tail", "base"))
    which = np.arange(rows.num_rows)
    owner = np.concatenate([which, which[base < 0]])
    # The class of a pair is the size of its shorter word.
    base = np.concatenate([np.where(base < 0, size, base), size[base < 0] - 1])
    head, tail = head[owner], tail[owner]
    free = base - head - tail
    owner, base, head, tail, free = (x[free >= 0] for x in (owner, base, head, tail, free))
    half = np.where(free > 1, (free + 1) // 2, 0)
    split = free > 1
    owner, heads, tails, base = (
        np.concatenate(pair)
        for pair in (
            (owner, owner[split]),
            (head + half, head[split]),
            (tail, (base - head - half)[split]),
            (base, base[split]),
        )
    )
    key = _list_key(batch, owner, heads, tails, base).view(np.int64)
    return _rows(rows, owner, {"key": key, "head": heads, "tail": tails, "base": base})


def _lowest(bits: np.ndarray) -> np.ndarray:
    """Number of the lowest set bit, larger than the size of any word without one."""
    bits = bits.view(np.uint64)
    lowest = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    return np.where(bits == 0, np.int64(1) << 32, lowest)


def _near(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the near pairs within each list of sorted rows, each pair in one of the lists it shares."""
    batch = _Batch(rows.column("word"))
    key, size, base, cut, heads, tails = (rows.column(n).to_numpy() for n in ("key", "size", "base", "cut", "heads", "tails"))
    new = np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]))
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(key))
    # A word meets the words of its list after it that are as long or longer by one.
    goes_on = np.append((key[edges[1:]] == key[edges[:-1]]) & (size[edges[1:]] == size[edges[:-1]] + 1), False)
    reach = np.where(goes_on, np.append(ends[1:], 0), ends)[np.cumsum(new) - 1]
    count = np.where((base < 0) | (size == base), reach - np.arange(len(key)) - 1, 0)
    total = np.cumsum(count)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        own = count[at:to]
        left = np.repeat(np.arange(at, to), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        at = to
        common_head, common_tail = _lowest(heads[left] & heads[right]), _lowest(tails[left] & tails[right])
        here = np.where(cut[left] > 0, common_head == cut[left], common_tail == -cut[left]) | (np.abs(cut[left]) > 63)
        here &= cut[left] == cut[right]
        left, right, common_head = left[here], right[here], common_head[here]
        low, high = np.zeros(len(left), np.int64), size[left].astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = batch.prefix(left, middle) == batch.prefix(right, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        longer = size[right] > size[left]
        skip = np.minimum(low + np.where(longer, 0, 1), size[left])
        near = batch.rest(left, skip) == batch.rest(right, low + 1 - (~longer & (low == size[left])))
        near &= (cut[left] > 0) | (common_head > low)
        yield left[near], right[near]


def _paired(batches: Iterator[pa.RecordBatch], max_list: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of lists that lie together; rows of large lists come back for the next round, without a pair."""
    held: pa.RecordBatch | None = None
    large = None

    def answered(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal large
        if not rows.num_rows:
            return
        key, base = rows.column("key").to_numpy(), rows.column("base").to_numpy()
        head, tail = rows.column("head").to_numpy(), rows.column("tail").to_numpy()
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(edges, len(key)))
        splits = (base[edges] < 0) | (base[edges] - head[edges] - tail[edges] > 1)
        again = np.repeat((sizes > max_list) & splits, sizes) | (key == large if large is not None else False)
        large = int(key[-1]) if again[-1] else None
        crowd = rows.filter(pa.array(again))
        if crowd.num_rows:
            dealt = _dealt_again(crowd)
            empty = [pa.nulls(dealt.num_rows, pa.string()), pa.nulls(dealt.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([*dealt.columns, *empty], names=[*_FIELDS, "other", "other_n"])
        rest = rows.filter(pa.array(~again))
        if rest.num_rows:
            for left, right in _near(rest):
                if len(left):
                    a, b = rest.take(pa.array(left)), rest.take(pa.array(right))
                    yield pa.RecordBatch.from_arrays(
                        [*a.columns, b.column("word"), b.column("n")], names=[*_FIELDS, "other", "other_n"]
                    )

    for batch in batches:
        rows = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        if not rows.num_rows:
            continue
        key = rows.column("key").to_numpy()
        end = int(np.argmax(key == key[-1]))
        # A list that goes on is held until it is known to be large.
        base, head, tail = (rows.column(name)[rows.num_rows - 1].as_py() for name in ("base", "head", "tail"))
        open_large = key[-1] == large if large is not None and end == 0 else False
        if open_large or (rows.num_rows - end > max_list and (base < 0 or base - head - tail > 1)):
            end = rows.num_rows
        yield from answered(rows.slice(0, end))
        held = rows.slice(end)
    if held is not None:
        yield from answered(held)


def near_words(words: DataFrame, max_frequent: int = MAX_FREQUENT, max_list: int = MAX_LIST) -> DataFrame:
    """All pairs of different words one inserted, deleted or replaced code point apart, once each.

    ``words`` has different words as ``word`` and their number as ``n``; a pair has ``word``, ``n``,
    ``other`` and ``other_n``.  Words need more than ``MIN_GRAM`` characters; null words fail.  An
    empty table gives an empty result.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(gram_dictionary(words, max_frequent))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "word", _SLICE_BYTES):
                yield _listed(part, shared.value)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = words.select("word", "n").mapInArrow(listed, _LISTED)
    found = None
    for _ in range(MAX_ROUNDS):
        # With a given number, adaptive execution leaves every list in one partition.
        dealt = rows.repartition(partitions, "key").sortWithinPartitions("key", "size")
        met = stage(dealt.mapInArrow(lambda batches: _paired(batches, max_list), f"{_LISTED}, other string, other_n long"), "met")
        pairs = met.filter("other IS NOT NULL").select("word", "n", "other", "other_n")
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.filter("other IS NULL").select(*_FIELDS)
        if not rows.head(1):
            break
    else:
        raise RuntimeError(f"lists were not small after {MAX_ROUNDS} rounds")
    # Compared by hashes so far; words beyond 63 characters may meet more than once.
    return found.filter(F.levenshtein("word", "other", 1) == 1).distinct()


def spelling_variants(words: DataFrame, ratio: int = 10, max_frequent: int = MAX_FREQUENT, max_list: int = MAX_LIST) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is
    at least ``ratio`` times the word's own, else null, like ``form_n``.  ``root`` is the last word
    on the way over forms, the word itself without a form.  Counts grow on that way, so it ends.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms could go round in circles")
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_words(words, max_frequent, max_list), "pairs")
    turned = pairs.selectExpr("other AS word", "other_n AS n", "word AS other", "n AS other_n")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other")))
    near = pairs.unionByName(turned).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    large = -F.col("best.minus") >= ratio * F.col("n")
    formed = stage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, F.col("best.other")).alias("form"),
            F.when(large, -F.col("best.minus")).alias("form_n"),
        ),
        "formed",
    )
    ways = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(MAX_ROUNDS):
        onward = ways.selectExpr("word AS root", "root AS further")
        ways = stage(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        if not ways.filter("moved").head(1):
            break
        ways = ways.drop("moved")
    return formed.join(ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
