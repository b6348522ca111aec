"""Exact, repeatable samples and orders that do not depend on the partitioning.

A row's rank is the MD5 of seed, purpose and key.  To take n rows, the n-th
smallest hash is found by counting hash prefixes; the sample is then a plain
filter, so no row is moved.  The purpose keeps draws apart that share a seed:
otherwise a sample of a sample would pick the same low hashes again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.operators.joins import KEY, anti_join_by_key
from gradeloom.operators.row_index import with_row_index

SEED = 42
# Hex digits counted at a time, and how many counts then reach the driver at most.
_STEP = 4
_MAX_COUNTS = 16**_STEP
_DIGITS = 32
_HASH = "_hash"
# What identifies a row once augmented copies share the id of their original.
ROW_KEY = (KEY, "origin", "copy_no")


def sample_hash(seed: int, purpose: str, key: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *parts))


@dataclass
class _Cut:
    """Rows whose hash starts below ``prefix`` are in; ``open`` rows with it are needed."""

    prefix: str
    needed: int
    available: int


def _prefix_counts(hashes: DataFrame, prefix: str, digits: int) -> list[tuple[str, int]]:
    counts = (
        hashes.filter(F.col(_HASH).startswith(prefix))
        .groupBy(F.substring(_HASH, 1, digits).alias("prefix"))
        .count()
    )
    return sorted((row["prefix"], row["count"]) for row in counts.collect())


def _find_cut(hashes: DataFrame, size_of_sample: Callable[[int], int]) -> _Cut | None:
    """Count prefixes of 4, 8 and all digits until the cut is found.

    Within 8 digits, few different hashes are left whatever the table's size;
    if there are few rows within 4 digits, the second step is left out.
    """
    counts = _prefix_counts(hashes, "", _STEP)
    needed = size_of_sample(sum(n for _, n in counts))
    if needed == 0:
        return None
    while True:
        for prefix, available in counts:
            if needed <= available:
                break
            needed -= available
        if needed == available or len(prefix) == _DIGITS:
            return _Cut(prefix, needed, available)
        few = available <= _MAX_COUNTS or len(prefix) > _STEP
        counts = _prefix_counts(hashes, prefix, _DIGITS if few else 2 * _STEP)


def _sample(
    df: DataFrame, size_of_sample: Callable[[int], int], seed: int, purpose: str, key: Sequence[str] | None
) -> DataFrame:
    key = list(key or df.columns)
    hashed = df.withColumn(_HASH, sample_hash(seed, purpose, key))
    cut = _find_cut(hashed.select(_HASH), size_of_sample)
    if cut is None:
        return df.limit(0)
    prefix = F.substring(_HASH, 1, len(cut.prefix))
    if cut.needed == cut.available:
        return hashed.filter(prefix <= cut.prefix).drop(_HASH)
    # Several rows share the key at the cut and only some of them are needed.
    below = hashed.filter(prefix < cut.prefix).drop(_HASH)
    tied = hashed.filter(prefix == cut.prefix).drop(_HASH)
    if set(key) != set(df.columns):
        return below.unionByName(_sample(tied, lambda _: cut.needed, seed, f"{purpose}:tie", None))
    # They are equal in every column, so any of them will do.
    numbered = with_row_index(tied, name="_copy")
    return below.unionByName(numbered.filter(F.col("_copy") < cut.needed).drop("_copy"))


def sample_n(
    df: DataFrame,
    n: int,
    seed: int = SEED,
    key: Sequence[str] | None = None,
    on_short: str = "clamp",
    purpose: str = "n",
) -> DataFrame:
    """Exactly n rows without replacement.

    With fewer than n rows, "clamp" returns all of them and "error" fails.
    ``key`` names the columns that identify a row; the default is all columns.
    """
    if n < 0:
        raise ValueError("cannot draw a negative number of rows")

    def size_of_sample(size: int) -> int:
        if n > size and on_short == "error":
            raise ValueError(f"cannot draw {n} of {size} rows without replacement")
        return min(n, size)

    return _sample(df, size_of_sample, seed, purpose, key)


def sample_frac(
    df: DataFrame, frac: float, seed: int = SEED, key: Sequence[str] | None = None, purpose: str = "frac"
) -> DataFrame:
    """Exactly ``frac`` of the rows, a half rounded to the even neighbour."""
    if not 0 <= frac <= 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return _sample(df, lambda size: round(frac * size), seed, purpose, key)


def shuffle_rows(
    df: DataFrame, seed: int = SEED, key: Sequence[str] | None = None, purpose: str = "shuffle"
) -> DataFrame:
    """Seeded random order, kept as the last column ``row_idx``.

    Rows are sorted by the hash of their key, then by a hash of the row and by their
    place, so that copies spread over several tasks.
    """
    key = list(key or df.columns)
    hashed = df.withColumn(_HASH, sample_hash(seed, purpose, key)).withColumn("_tie", F.xxhash64(*df.columns))
    return with_row_index(hashed.drop("row_idx"), _HASH, "_tie").drop(_HASH, "_tie")


def filter_class(df: DataFrame, label: int) -> DataFrame:
    return df.filter(F.col("label") == label)


def concat(*dfs: DataFrame) -> DataFrame:
    """All rows of all frames by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def with_row_key(df: DataFrame, origin: str) -> DataFrame:
    """Add what is missing of ``origin`` and ``copy_no``.

    Ids repeat in lists that name a row twice; the position in the list then
    tells the copies apart.
    """
    copy_no = F.col("row_idx").cast("string") if "row_idx" in df.columns else F.lit("")
    missing = {"origin": F.lit(origin), "copy_no": copy_no}
    return df.withColumns({name: value for name, value in missing.items() if name not in df.columns})


def rebalance(
    df: DataFrame,
    augmented: DataFrame,
    down_ratio: float = 3,
    up_ratio: float = 2.5,
    seed: int = SEED,
    key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """Change the class balance of a training set, in random order.

    All P positives stay.  Augmented rows are added until there are
    ``P * up_ratio`` positives or no more augmented rows, and
    ``P * down_ratio`` negatives are drawn, which must exist.
    """
    df, augmented = with_row_key(df, "orig"), with_row_key(augmented, "aug")
    ones, zeros = filter_class(df, 1), filter_class(df, 0)
    positives = ones.count()
    added = sample_n(augmented, int(positives * up_ratio - positives), seed, key, purpose="up")
    kept = sample_n(zeros, round(positives * down_ratio), seed, key, on_short="error", purpose="down")
    return shuffle_rows(concat(ones, added, kept), seed, key)


def split_train_valid(
    df: DataFrame, frac: float = 0.8, seed: int = SEED, key: Sequence[str] = ROW_KEY, id_column: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """Draw rows for training; rows of all other ids are for validation.

    A row that was not drawn but shares its id with one that was is in neither,
    so that no id is on both sides.
    """
    train = sample_frac(df, frac, seed, key, purpose="split")
    return train, anti_join_by_key(df, train, id_column)


def split_by_id(
    df: DataFrame, frac: float = 0.8, seed: int = SEED, id_column: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """Draw whole ids for training; all other rows are for validation, and none is lost.

    Ids are taken in the order of their hashes until the next one would go past ``frac`` of the rows;
    that one is taken if at least half of it is needed.  Rows without an id are one id.  Both
    sides are plain filters.
    """
    if not 0 <= frac <= 1:
        raise ValueError("the fraction must lie between 0 and 1")
    hashed = df.withColumn(_HASH, sample_hash(seed, "split_id", [id_column]))
    cut = _find_cut(hashed.select(_HASH), lambda size: round(frac * size))
    if cut is None:
        return df.limit(0), df
    prefix = F.substring(_HASH, 1, len(cut.prefix))
    # A cut within an id has the whole hash as its prefix.
    drawn = prefix <= cut.prefix if 2 * cut.needed >= cut.available else prefix < cut.prefix
    return hashed.filter(drawn).drop(_HASH), hashed.filter(~drawn).drop(_HASH)


def lost_rows(df: DataFrame, train: DataFrame, valid: DataFrame) -> int:
    """Rows that ``split_train_valid`` gave to neither side."""
    return df.count() - train.count() - valid.count()
