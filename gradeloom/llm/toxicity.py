"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier is logistic over words and beginnings of words: whether a text has one, and
whether it has it ``OFTEN`` times or more.  It learns from confirmed toxic
texts and from unlabelled ones, of which a share ``prior`` is taken to be toxic.  With
mean losses P+ and P- of the toxic texts as toxic and as clean, and U- of the
unlabelled texts as clean, the risk is

    prior * P+  +  max(0, U- - prior * P-)

The second term estimates the loss of the clean texts.  Where it gets negative,
which only overfitting can do, the step goes against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradeloom.llm.blocks import result_schema, with_results
from gradeloom.llm.words import NOT_ALNUM, mixed, slices, words_of
from gradeloom.staging import stage

# Bounds of the training sample and of the model, whatever the size of the corpus.
MAX_TOXIC = 2000
MAX_UNLABELLED = 6000
MAX_FEATURES = 2048
# Bytes of the beginnings of words that count as features besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
OFTEN = 3
MIN_TEXTS = 3
# Standard errors by which the share of a word has to differ between the samples.
MIN_Z = 4.0
# Least share of toxic texts that have it, and estimated share of toxic ones among its texts.
MIN_SHARE = 0.02
MIN_PRECISION = 0.4
_SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted feature hashes, two weights of each (present, present often), and the weight of every text."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and hashes of all words, and of all beginnings of longer words."""
    words = words_of(texts, NOT_ALNUM, lower=True)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    yield owner, words.hashes()
    for length in BEGINNINGS:
        longer = words.ends - words.starts > length
        yield owner[longer], mixed(words.hashes(longest=length)[longer] ^ np.uint64(length))


def _counted_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of all different features of each text."""
    owner, hashes = (np.concatenate(x) for x in zip(*_features(texts)))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def class_prior(labelled: DataFrame, toxic: str = "toxic") -> float:
    """Share of toxic rows among those with a label; 0 without any."""
    share = labelled.agg(F.avg(F.col(toxic).cast("double"))).first()[0]
    return float(share or 0.0)


def _drawn(keys: DataFrame, key: str, rows: int, seed: str) -> DataFrame:
    """The ``rows`` keys with the least hashes."""
    keys = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    return keys.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)


def train_toxicity(
    df: DataFrame,
    confirmed: DataFrame,
    prior: float,
    text: str = "text",
    key: str = "doc_id",
    max_toxic: int = MAX_TOXIC,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
    steps: int = 800,
    rate: float = 0.1,
    penalty: float = 1e-4,
    seed: int = 7,
) -> ToxicityModel:
    """Learn from the rows whose key is in ``confirmed`` and from all rows as unlabelled ones.

    At most ``max_toxic`` and ``max_unlabelled`` keys are drawn by their hashes, null ones
    never; only keys are sorted, and only texts of drawn keys are read on.  Features are the words in ``MIN_TEXTS`` drawn texts or more
    whose shares in the two samples differ clearly and by a factor, the clearest first.  Without a confirmed row the model
    gives every text the prior.
    """
    texts = df.select(key, text)
    drawn = (
        (_drawn(confirmed, key, max_toxic, f"toxic {seed}"), 1),
        (_drawn(df, key, max_unlabelled, f"unlabelled {seed}"), 0),
    )
    # Of rows that share a drawn key, that of the least hash, so that the sample has its bound.
    one = F.min_by(text, F.xxhash64(text)).alias(text)
    toxic, other = (
        texts.join(F.broadcast(keys), key, "left_semi").groupBy(key).agg(one).select(text, F.lit(label).alias("_toxic"))
        for keys, label in drawn
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, _SLICE_BYTES):
                owner, hashes, counts = _counted_features(part.column(text))
                edges = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (hashes.view(np.int64), counts >= OFTEN)]
                yield pa.RecordBatch.from_arrays([part.column("_toxic"), *lists], names=["_toxic", "features", "often"])

    schema = "_toxic int, features array<long>, often array<boolean>"
    sample = stage(toxic.unionByName(other).mapInArrow(listed, schema), "toxicity_sample")
    sizes = {t: n for t, n in sample.groupBy("_toxic").count().collect()}
    bias = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    if not sizes.get(1):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros((0, 2)), bias)
    n_toxic, n_other = sizes[1], sizes.get(0, 1)
    zipped = sample.select("_toxic", F.inline(F.arrays_zip("features", "often")))
    in_toxic, in_other = F.col("_toxic"), 1 - F.col("_toxic")
    often = F.col("often").cast("int")
    counted = zipped.groupBy("features").agg(
        F.sum(in_toxic).alias("p1"), F.sum(in_other).alias("q1"), F.sum(in_toxic * often).alias("p2"), F.sum(in_other * often).alias("q2")
    )

    def clear(p: str, q: str) -> Column:
        """Standard errors between the shares in the samples, null for a feature that is of no use."""
        in_p, in_q, n = F.col(p) / n_toxic, F.col(q) / n_other, F.col(p) + F.col(q)
        both = n / (n_toxic + n_other)
        z = (in_p - in_q) / (F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_other)) + 1e-12)
        return F.when(
            (n >= MIN_TEXTS) & (z >= MIN_Z) & (in_p >= MIN_SHARE) & (prior * in_p >= MIN_PRECISION * in_q), z
        )

    chosen = (
        counted.withColumn("z", F.greatest(clear("p1", "q1"), clear("p2", "q2")))
        .filter("z IS NOT NULL")
        .orderBy(F.desc("z"), "features")
        .limit(max_features)
        .select("features")
    )
    # At most MAX_FEATURES hashes and, for every drawn text, numbers below that.
    known = np.sort(np.array([w for (w,) in chosen.collect()], np.int64).view(np.uint64))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            found, number = _looked_up(known, lists.flatten().to_numpy().view(np.uint64))
            many = batch.column("often").flatten().to_numpy(zero_copy_only=False)[found].astype(bool)
            columns, owner = np.concatenate([2 * number, 2 * number[many] + 1]), np.concatenate([owner[found], owner[found][many]])
            order = np.argsort(owner, kind="stable")
            parts = np.split(columns[order].astype(np.uint16), np.searchsorted(owner[order], np.arange(1, len(lists))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_toxic"), pa.array([x.tobytes() for x in parts], pa.binary())], names=["_toxic", "columns"]
            )

    rows = sample.mapInArrow(numbered, "_toxic int, columns binary").collect()
    groups = [[np.frombuffer(w, np.uint16).astype(np.int64) for t, w in rows if t == label] for label in (1, 0)]
    weights, bias = _fitted(groups[0], groups[1], 2 * len(known), prior, bias, steps, rate, penalty)
    return ToxicityModel(known, weights.reshape(-1, 2), bias)


def _looked_up(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` of the known words, and their numbers."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    found = np.flatnonzero(known[at] == hashes)
    return found, at[found]


def _fitted(
    toxic: list[np.ndarray],
    other: list[np.ndarray],
    n_features: int,
    prior: float,
    bias: float,
    steps: int,
    rate: float,
    penalty: float,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam, each step over both samples."""
    theta = np.zeros(n_features + 1)
    theta[-1] = bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    places = [(np.concatenate(t), np.repeat(np.arange(len(t)), [len(x) for x in t])) if t else None for t in (toxic, other)]

    def risk(which: int, sign: float) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss of a sample as label ``sign``, and its gradient."""
        if places[which] is None:
            return 0.0, np.zeros_like(theta)
        (flat, owner), n = places[which], len((toxic, other)[which])
        margin = sign * (theta[-1] + np.bincount(owner, weights=theta[flat], minlength=n))
        loss = 1 / (1 + np.exp(np.clip(margin, -50, 50)))
        slope = -sign * loss * (1 - loss) / n
        gradient = np.bincount(flat, weights=slope[owner], minlength=len(theta)).astype(float)
        gradient[-1] += slope.sum()
        return float(loss.mean()), gradient

    for step in range(1, steps + 1):
        _, as_toxic = risk(0, 1.0)
        loss_p, as_clean = risk(0, -1.0)
        loss_u, unlabelled = risk(1, -1.0)
        rest = unlabelled - prior * as_clean
        gradient = prior * as_toxic + rest if loss_u >= prior * loss_p else -rest
        gradient[:-1] += penalty * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        # All words are commoner in toxic texts, so a text without any is toxic no more often than all.
        theta[-1] = min(theta[-1], bias)
    return theta[:-1], float(theta[-1])


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Every row with the probability that its whole text is toxic.

    Null and empty texts have the score of a text without words.  Repeated rows score
    alike.  A column named ``score`` is replaced.  An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = shared.value.features, shared.value.weights, shared.value.bias
        for batch in batches:
            for part in slices(batch, text, _SLICE_BYTES):
                found = []
                for owner, hashes in _features(part.column(part.schema.get_field_index(text))):
                    at, number = _looked_up(known, hashes)
                    found.append(owner[at] * max(1, len(known)) + number)
                pairs, counts = np.unique(np.concatenate(found), return_counts=True)
                owner, number = np.divmod(pairs, max(1, len(known)))
                gain = weights[number, 0] + np.where(counts >= OFTEN, weights[number, 1], 0.0)
                margin = bias + np.bincount(owner, weights=gain, minlength=part.num_rows)
                yield with_results(part, {score: pa.array(1 / (1 + np.exp(-np.clip(margin, -50, 50))), pa.float64())})

    return df.mapInArrow(run, result_schema(df, StructType([StructField(score, DoubleType())])))
