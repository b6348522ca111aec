"""Quality rules whose cutoffs have a bound on the share of good texts they reject.

A rule rejects texts whose measure is above a cutoff.  For every stratum and rule the
cutoffs of a fixed grid are tested from the most lenient on: a cutoff passes if, with
the good labelled texts that it rejects, an exact binomial test excludes that it rejects
a share of ``alpha / rules`` or more; the first that fails ends the sequence.  The
level is ``delta`` divided by the number of strata and rules, so that with probability
``1 - delta`` all cutoffs that pass keep their bound at once, and all rules together
reject at most ``alpha`` of the good texts of any stratum.  Of the cutoffs that pass and
reject more bad labelled texts than good ones, the most lenient that rejects nearly as
many bad texts as any of them is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradeloom.llm.blocks import result_schema, with_results
from gradeloom.llm.words import byte_set, mixed, slices, text_bytes, windows, words_of

ALPHA = 0.03
DELTA = 0.05
# Share of the most bad texts that the chosen cutoff rejects at least.
NEARLY = 0.98
_SLICE_BYTES = 1 << 20

_SHARES = (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)
_LENGTHS = (60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)
# Cutoffs to test for each rule, the most lenient first.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": _SHARES,
    "repeats": _SHARES,
    "dup_lines": _SHARES,
    "capitals": _SHARES,
    "exclamations": _SHARES,
    "word_length": _LENGTHS,
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")
_SYMBOLS = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_CAPITALS = byte_set((ord("A"), ord("Z")))
_EXCLAMATIONS = byte_set((ord("!"), ord("!")))


def _measured(texts: pa.Array) -> dict[str, pa.Array]:
    words = words_of(texts)
    n = len(words.counts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(flags)])
        return before[words.offsets[1:]] - before[words.offsets[:-1]]

    inside = np.zeros(len(words.data) + 1, np.int64)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    in_word = np.cumsum(inside)[:-1] > 0
    # A code point has one byte that does not continue another.
    code_points = in_word & ((words.data & 0xC0) != 0x80)
    starts, keys = windows(words.hashes(), words.first, 3)
    owner = np.searchsorted(words.first, starts, "right") - 1
    _, number, counts = np.unique(mixed(keys) ^ mixed(owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    edges = np.zeros(len(words.starts) + 1, np.int64)
    again = starts[counts[number] > 1]
    np.add.at(edges, again, 1)
    np.add.at(edges, again + 3, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    raw, offsets = words.data.tobytes(), words.offsets.tolist()
    lines, dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        # bytes.split() without a separator cuts at the same six characters.
        found = [line for line in raw[offsets[i] : offsets[i + 1]].split(b"\n") if line.split(None, 1)]
        lines[i], dup_lines[i] = len(found), len(found) - len(set(found))
    values = {
        "n_words": words.counts,
        "word_chars": per_text(code_points),
        "n_symbols": per_text(_SYMBOLS[words.data]),
        "n_lines": lines,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated[words.first[1:]] - repeated[words.first[:-1]],
        "n_capitals": per_text(_CAPITALS[words.data]),
        "n_exclamations": per_text(_EXCLAMATIONS[words.data]),
    }
    return {name: pa.array(value.astype(np.int64)) for name, value in values.items()}


def measure_quality(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and the counts in ``MEASURES`` of the whole text.

    ``n_lines`` counts the lines with a word and ``n_dup_lines`` those of them that equal an
    earlier line; ``n_repeat_words`` counts the words in 3-word windows that occur twice or
    more in the text.  Null and empty texts have zeros.  Columns named like an added one
    are replaced.  An empty table gives an empty result.
    """
    names = list(df.columns if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, _SLICE_BYTES):
                yield with_results(part.select(names), _measured(part.column(part.schema.get_field_index(text))))

    added = StructType([StructField(name, LongType()) for name in MEASURES])
    return df.mapInArrow(run, result_schema(df.select(*names), added))


def rule_values() -> dict[str, Column]:
    """What each rule compares with its cutoff; 0 for texts without words."""
    per_word = lambda name: F.when(F.col("n_words") > 0, F.col(name) / F.col("n_words")).otherwise(0.0)
    return {
        "symbols": per_word("n_symbols"),
        "repeats": per_word("n_repeat_words"),
        "dup_lines": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0),
        "capitals": F.when(F.col("word_chars") > 0, F.col("n_capitals") / F.col("word_chars")).otherwise(0.0),
        "exclamations": per_word("n_exclamations"),
        "word_length": per_word("word_chars"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p, exactly but for rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log((n - i[1:] + 1) / i[1:]) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certified(rejected_good: Sequence[int], n_good: int, alpha: float, level: float) -> int:
    """How many cutoffs, from the most lenient on, pass one after another."""
    for place, k in enumerate(rejected_good):
        if n_good == 0 or binomial_tail(int(k), int(n_good), alpha) > level:
            return place
    return len(rejected_good)


def choose_cutoffs(
    labelled: DataFrame,
    stratum: str,
    good: str,
    rules: Mapping[str, Sequence[float]] = RULES,
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule from measured rows with a boolean column ``good``.

    The rows are one aggregation; the driver gets one row per stratum.  A rule without a
    cutoff that passes is left out: too few labels mean no rejection.  Rows with a null
    ``good`` do not count.  Null is a stratum of its own.
    """
    values = rule_values()
    sums = [
        F.sum(((F.col(good) == wanted) & (values[rule] > cutoff)).cast("long")).alias(f"{kind}_{rule}_{i}")
        for rule, cutoffs in rules.items()
        for i, cutoff in enumerate(cutoffs)
        for kind, wanted in (("good", True), ("bad", False))
    ]
    rows = labelled.filter(F.col(good).isNotNull()).groupBy(stratum).agg(F.sum(F.col(good).cast("long")).alias("n_good"), *sums).collect()
    level = delta / max(1, len(rows) * len(rules))
    result: dict[str | None, dict[str, float]] = {}
    for row in rows:
        chosen = {}
        for rule, cutoffs in rules.items():
            passed = certified([row[f"good_{rule}_{i}"] for i in range(len(cutoffs))], row["n_good"], alpha / len(rules), level)
            found = [(row[f"bad_{rule}_{i}"], row[f"good_{rule}_{i}"]) for i in range(passed)]
            useful = [i for i, (bad, good_) in enumerate(found) if bad > good_]
            if useful:
                most = max(found[i][0] for i in useful)
                chosen[rule] = cutoffs[next(i for i in useful if found[i][0] >= NEARLY * most)]
        result[row[stratum]] = chosen
    return result


def apply_cutoffs(measured: DataFrame, stratum: str, cutoffs: Mapping[str | None, Mapping[str, float]], rejected_by: str = "rejected_by") -> DataFrame:
    """Every row with the list of the rules that reject it; unknown strata reject nothing."""
    values = rule_values()
    lists = []
    for rule in RULES:
        above = F.lit(False)
        for name, chosen in cutoffs.items():
            if rule in chosen:
                above = above | (F.col(stratum).eqNullSafe(F.lit(name)) & (values[rule] > chosen[rule]))
        lists.append(F.when(above, F.lit(rule)))
    return measured.withColumn(rejected_by, F.filter(F.array(*lists), lambda rule: rule.isNotNull()))
