"""Training, scoring and search of two-class text models, whose weights are a table.

A text's features are its words, each with the root of its share of the text, and one
feature that all texts have, with the value 1.  A model has a weight per feature; a text's
margin is the sum of value times weight.  The most frequent features are looked up where the
texts are, the others meet their weights by a join.  Training takes one gradient over all
rows per epoch and goes on from the last weights; trials are columns of the same table,
so that a search reads the rows once per epoch, however many trials there are.
"""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.functions.arrays import argmax
from gradeloom.functions.text import text_or_nan, words
from gradeloom.operators.metrics import GOOD_F1, evaluate_scores
from gradeloom.operators.sampling import sample_hash
from gradeloom.sources.run_store import commit_run, read_runs, read_weights
from gradeloom.staging import stage

# The search space and the number of trials.
LEARNING_RATES = (1e-5, 4e-5)
BATCH_SIZES = (6,)
EPOCHS = (2, 3, 4, 6)
TRIALS = 25
# Epochs, rate and batch size of a single training run.
DEFAULT_EPOCHS = 4
DEFAULT_RATE = 2e-5
DEFAULT_BATCH = 6
# After these epochs a trial goes on only if its F1 is no worse than the median of all trials.
RUNGS = (2, 4)
# The rates are those of a large network; one layer over texts of unit length takes longer steps.
STEP = 5e6
# Weights and margins are kept to so many decimals, so that the order of sums does not matter.
DECIMALS = 9
# The feature of all texts.
BIAS = ""
# So many of the most frequent features are looked up in place, from a broadcast table.
HEAD = 200_000
# Rows whose entries a task holds at a time, and gradients that it hands on at a time.
ROWS_AT_ONCE = 2_000
ENTRIES_AT_ONCE = 1 << 16

_SCORE_COLUMNS = "logits array<double>, prediction int"


def _features(text: Column) -> Column:
    """The different words of a text, how often it has them, and how many words it has."""

    @F.arrow_udf("struct<size int, features array<string>, counts array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        return _by_parts(_counted, texts)

    return run(words(text))


def _by_parts(run: Callable[[pa.Array], pa.Array], rows: pa.Array) -> pa.Array:
    parts = [run(rows.slice(at, ROWS_AT_ONCE)) for at in range(0, max(len(rows), 1), ROWS_AT_ONCE)]
    return pa.concat_arrays(parts)


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of ``n`` rows of the ``values``, whose ``rows`` ascend."""
    offsets = np.zeros(n + 1, "int32")
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _rows_of(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _counted(texts: pa.Array) -> pa.Array:
    coded = texts.flatten().dictionary_encode()
    different = max(len(coded.dictionary), 1)
    keys, counts = np.unique(_rows_of(texts) * different + coded.indices.to_numpy(), return_counts=True)
    rows, features = np.divmod(keys, different)
    return pa.StructArray.from_arrays(
        [
            pc.list_value_length(texts).cast("int32"),
            _lists(rows, len(texts), coded.dictionary.take(pa.array(features))),
            _lists(rows, len(texts), pa.array(counts.astype("int32"))),
        ],
        names=["size", "features", "counts"],
    )


@dataclass(frozen=True)
class _Head:
    """The most frequent features, at most ``HEAD`` of them, and that of all texts; they are looked up in place.

    Features of fewer than ``least`` rows are rare, unless the head is the ``whole`` vocabulary.
    """

    names: pa.Array
    least: int
    whole: bool

    @property
    def bias(self) -> int:
        """Place of the feature of all texts; -1 if a model of no rows lacks it."""
        return pc.index(self.names, BIAS).as_py()

    def holds(self) -> Column:
        return F.lit(True) if self.whole else (F.col("n") >= self.least) | (F.col("feature") == BIAS)

    def matrix(self, weights: DataFrame, columns: Sequence[str]) -> np.ndarray:
        """The weights of the head, a line for each of the ``columns``."""
        found = weights.filter(self.holds()).select("feature", *columns).toArrow()
        at = pc.index_in(found.column("feature").cast("string"), value_set=self.names).to_numpy()
        matrix = np.zeros((len(columns), len(self.names)))
        for line, name in zip(matrix, columns):
            line[at] = found.column(name).fill_null(0.0).to_numpy()
        return matrix


def _head_of(weights: DataFrame) -> _Head:
    least, held, whole = 0, 0, True
    # There are few different counts, as they add up to the number of entries.
    for n, features in sorted(weights.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        if held + features > HEAD:
            whole = False
            break
        least, held = n, held + features
    if not (whole or held):
        least = np.iinfo("int64").max
    head = _Head(pa.array([], "string"), int(least), whole)
    names = weights.filter(head.holds()).select("feature").toArrow().column(0).cast("string")
    return replace(head, names=pa.concat_arrays([head.names, *names.chunks]))


_RARE = "array<struct<feature string, value double>>"


def _coded(head: _Head) -> Callable[[Column], Column]:
    """Features as their places in the head, and the rare ones with their values."""

    def code(part: pa.Array) -> pa.Array:
        size, features, counts = part.flatten()
        rows, n, counts = _rows_of(features), len(part), counts.flatten()
        names = features.flatten()
        ids = pc.index_in(names, value_set=head.names)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        far = np.zeros(len(rows), bool) if head.whole else ~known
        values = np.sqrt(counts.to_numpy()[far] / size.to_numpy()[rows[far]])
        rare = pa.StructArray.from_arrays([names.filter(pa.array(far)), pa.array(values)], names=["feature", "value"])
        return pa.StructArray.from_arrays(
            [
                size,
                _lists(rows[known], n, ids.drop_null()),
                _lists(rows[known], n, counts.filter(pa.array(known))),
                _lists(rows[far], n, rare),
            ],
            names=["size", "ids", "counts", "rare"],
        )

    @F.arrow_udf(f"struct<size int, ids array<int>, counts array<int>, rare {_RARE}>")
    def run(found: pa.Array) -> pa.Array:
        return _by_parts(code, found)

    return run


def _entries(code: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the head and value of every entry of the head."""
    size, ids, counts, _ = code.flatten()
    rows = _rows_of(ids)
    return rows, ids.flatten().to_numpy(), np.sqrt(counts.flatten().to_numpy() / size.to_numpy()[rows])


def _near(code: pa.Array, matrix: np.ndarray, bias: int) -> np.ndarray:
    """What the features of the head add to the margin of every row, a column for each line of the matrix."""
    rows, ids, values = _entries(code)
    sums = np.empty((len(code), len(matrix)))
    for k, line in enumerate(matrix):
        sums[:, k] = np.bincount(rows, line[ids] * values, len(code))
        if bias >= 0:
            sums[:, k] += line[bias]
    return sums


def _near_margins(matrix: np.ndarray, head: _Head) -> Callable[[Column], Column]:
    """The sums over the head as an array, and the rare features."""
    bias, width = head.bias, len(matrix)

    def look(part: pa.Array) -> pa.Array:
        offsets = np.arange(len(part) + 1, dtype="int32") * width
        sums = pa.ListArray.from_arrays(pa.array(offsets, "int32"), pa.array(_near(part, matrix, bias).ravel()))
        return pa.StructArray.from_arrays([sums, part.field("rare")], names=["near", "rare"])

    @F.arrow_udf(f"struct<near array<double>, rare {_RARE}>")
    def run(code: pa.Array) -> pa.Array:
        return _by_parts(look, code)

    return run


@dataclass(frozen=True)
class LinearModel:
    """Weights as ``feature``, ``n`` (training rows that have it) and ``weight``."""

    weights: DataFrame


def _far(rare: DataFrame, weights: DataFrame, names: Sequence[str], head: _Head) -> DataFrame:
    """Per ``row`` of ``rare`` (row, feature, value) the sums over its rare features, which meet their weights by feature."""
    tail = weights.filter(~head.holds()).select("feature", *names)
    return rare.join(tail, "feature").groupBy("row").agg(*(F.sum(F.col("value") * F.col(name)).alias(name) for name in names))


def _with_margins(rows: DataFrame, far: DataFrame | None, names: Sequence[str]) -> DataFrame:
    """``rows`` (with ``row`` and ``near``) and the margin of each of the ``names`` columns of weights.

    Unknown features add nothing.  ``far`` is None where no feature is rare.
    """
    if far is not None:
        rows = rows.join(far, "row", "left")
    more = [F.lit(0.0) if far is None else F.coalesce(name, F.lit(0.0)) for name in names]
    margins = [F.round(F.get("near", F.lit(i)) + x, DECIMALS).alias(name) for i, (name, x) in enumerate(zip(names, more))]
    return rows.select(*(c for c in rows.columns if c not in ("near", *names)), *margins)


def _chance(margin: Column) -> Column:
    """Probability of class 1."""
    return 1 / (1 + F.exp(-margin))


def prior_bias(share: float | None) -> float:
    """The margin at which class 1 has its share of the training rows, so that training starts from there."""
    share = min(max(0.5 if share is None else share, 1e-3), 1 - 1e-3)
    return round(math.log(share / (1 - share)), DECIMALS)


def _learn(
    rows: DataFrame,
    rare: DataFrame | None,
    weights: DataFrame | None,
    trials: dict[str, Trial],
    bias: float,
    n_rows: int,
    vocabulary: DataFrame,
    head: _Head,
) -> DataFrame:
    """Weights after one more epoch, a column for each trial; before the first all are 0 but that of all texts, ``bias``.

    A feature's gradient is averaged over the rows that have it, or over a batch if those
    are fewer.  Tasks add up the gradients of the head; those of rare features meet by feature.
    """
    names, place, size = list(trials), head.bias, len(head.names)
    matrix = None if weights is None else head.matrix(weights, names)
    labelled = rows.filter("label IS NOT NULL").select("row", F.col("label").cast("double").alias("label"), "code")
    if weights is None or rare is None:
        labelled = labelled.select("label", "code")
    else:
        met = labelled.join(_far(rare, weights, names, head), "row", "left")
        labelled = met.select("label", "code", F.array(*(F.coalesce(name, F.lit(0.0)) for name in names)).alias("far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes, met = np.zeros((len(names), size)), np.zeros(size, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                code = part.column("code")
                if matrix is None:
                    margins = np.full((len(code), len(names)), bias)
                else:
                    margins = _near(code, matrix, place)
                    if "far" in part.schema.names:
                        margins += part.column("far").flatten().to_numpy().reshape(margins.shape)
                    margins = margins.round(DECIMALS)
                with np.errstate(over="ignore"):
                    errors = 1 / (1 + np.exp(-margins)) - part.column("label").to_numpy()[:, None]
                owners, ids, values = _entries(code)
                met[ids] = True
                met[place] = True
                for k, line in enumerate(slopes):
                    line += np.bincount(ids, values * errors[owners, k], size)
                    line[place] += errors[:, k].sum()
                lists = code.field("rare")
                features, values = lists.flatten().flatten()
                if len(features):
                    products = values.to_numpy()[:, None] * errors[_rows_of(lists)]
                    yield from _gradients(features, products.T, names)
        ids = np.flatnonzero(met)
        yield from _gradients(head.names.take(pa.array(ids)), slopes[:, ids], names)

    gradients = labelled.mapInArrow(run, ", ".join(["feature string", *(f"{name} double" for name in names)]))
    sums = gradients.groupBy("feature").agg(*(F.sum(name).alias(name) for name in names))
    if weights is None:
        old = vocabulary
        before = {name: F.when(F.col("feature") == BIAS, bias).otherwise(0.0) for name in trials}
    else:
        old = weights.select("feature", "n", *(F.col(name).alias(f"old_{name}") for name in trials))
        before = {name: F.col(f"old_{name}") for name in trials}
    # Words of most texts move little, or their many small steps would add up to a swing of all margins.
    rarity = F.pow(F.log(F.lit(float(n_rows)) / F.col("n")) / math.log(max(n_rows, 2)), F.lit(2.0))
    steps = {
        name: F.lit(trial.learning_rate * STEP) * rarity / F.greatest(F.col("n"), F.lit(trial.batch_size))
        for name, trial in trials.items()
    }
    learnt = [F.round(before[name] - steps[name] * F.col(name), DECIMALS).alias(name) for name in trials]
    return stage(old.join(sums, "feature", "left").select("feature", "n", *learnt), "weights")


def _gradients(features: pa.Array, lines: np.ndarray, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(features), ENTRIES_AT_ONCE):
        part = slice(at, at + ENTRIES_AT_ONCE)
        yield pa.RecordBatch.from_arrays([features[part], *(pa.array(line[part]) for line in lines)], ["feature", *names])


@dataclass
class Epoch:
    epoch: int
    eval_loss: float
    eval_f1: float
    eval_accuracy: float


def _evaluate(
    epoch: int, rows: DataFrame, rare: DataFrame | None, weights: DataFrame, names: Sequence[str], head: _Head
) -> dict[str, Epoch]:
    """Loss and metrics of all trials in one scan."""
    near = _near_margins(head.matrix(weights, names), head)(F.col("code"))
    looked = rows.select("row", "label", near["near"].alias("near"))
    met = _with_margins(looked, None if rare is None else _far(rare, weights, names, head), names)
    cells = []
    for name in names:
        right = F.when(F.col("label") == 1, _chance(F.col(name))).otherwise(1 - _chance(F.col(name)))
        said = F.col(name) > 0
        cells += [
            F.avg(-F.log(F.greatest(right, F.lit(1e-15)))),
            F.count_if(said & (F.col("label") == 1)),
            F.count_if(said & (F.col("label") == 0)),
            F.count_if(~said & (F.col("label") == 1)),
            F.count("*"),
        ]
    values = met.agg(*cells).first()
    found = {}
    for i, name in enumerate(names):
        loss, tp, fp, fn, n = values[5 * i : 5 * i + 5]
        precision, recall = (tp / part if part else 0.0 for part in (tp + fp, tp + fn))
        f1 = 2 * (precision * recall) / (precision + recall) if precision + recall else 0.0
        found[name] = Epoch(epoch, math.nan if loss is None else loss, f1, (n - fp - fn) / n if n else 0.0)
    return found


def _found(df: DataFrame) -> DataFrame:
    """Rows with a number of their own and the features of their texts."""
    return df.select(F.monotonically_increasing_id().alias("row"), "label", _features(F.col("text")).alias("found"))


def _prepared(found: DataFrame, head: _Head) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their coded features, written once, and the rare ones as rows, if there are any."""
    rows = stage(found.select("row", "label", _coded(head)(F.col("found")).alias("code")), "features")
    return rows, None if head.whole else rows.select("row", F.inline("code.rare"))


def _fit(
    train: DataFrame, valid: DataFrame, trials: dict[str, Trial], rungs: Sequence[int]
) -> tuple[dict[str, list[Epoch]], DataFrame, _Head]:
    """The epochs of every trial, a table with the weights of its best epoch as a column each, and its head."""
    found = stage(_found(train), "words")
    every = F.explode(F.concat(F.array(F.lit(BIAS)), "found.features")).alias("feature")
    vocabulary = stage(found.select(every).groupBy("feature").agg(F.count("*").alias("n")), "vocabulary")
    head = _head_of(vocabulary)
    (rows, rare), (valid_rows, valid_rare) = _prepared(found, head), _prepared(_found(valid), head)
    logs: dict[str, list[Epoch]] = {name: [] for name in trials}
    tables: list[DataFrame] = []
    going = dict(trials)
    n_rows, share = rows.agg(F.count("*"), F.avg(F.col("label").cast("double"))).first()
    bias = prior_bias(share)
    for epoch in range(1, max(trial.epochs for trial in trials.values()) + 1):
        tables.append(_learn(rows, rare, tables[-1] if tables else None, going, bias, n_rows, vocabulary, head))
        for name, result in _evaluate(epoch, valid_rows, valid_rare, tables[-1], list(going), head).items():
            logs[name].append(result)
        if epoch in rungs:
            middle = statistics.median(logs[name][-1].eval_f1 for name in going)
            going = {name: trial for name, trial in going.items() if logs[name][-1].eval_f1 >= middle}
        going = {name: trial for name, trial in going.items() if trial.epochs > epoch}
        if not going:
            break
    best = {name: min(log, key=lambda e: (e.eval_loss, e.epoch)).epoch for name, log in logs.items()}
    # All tables have the features of the training rows.
    chosen = None
    for epoch, table in enumerate(tables, 1):
        names = [name for name in trials if best[name] == epoch]
        if names:
            part = table.select("feature", *(["n"] if chosen is None else []), *names)
            chosen = part if chosen is None else chosen.join(part, "feature")
    return logs, stage(chosen.select("feature", "n", *trials), "weights"), head


def train_text_classifier(
    train: DataFrame,
    valid: DataFrame,
    epochs: int = DEFAULT_EPOCHS,
    rate: float = DEFAULT_RATE,
    batch_size: int = DEFAULT_BATCH,
) -> tuple[LinearModel, DataFrame]:
    """Fit a text model and keep the epoch with the lowest validation loss.

    Every epoch is one pass over the rows that starts from the weights of the last one.
    Returns the model and the evaluation after every epoch.  Rows need a ``text`` and a
    ``label`` of 0 or 1.
    """
    trial = Trial("single", rate, batch_size, epochs)
    logs, weights, _ = _fit(train, valid, {"weight": trial}, ())
    log = train.sparkSession.createDataFrame(
        [tuple(asdict(e).values()) for e in logs["weight"]],
        "epoch int, eval_loss double, eval_f1 double, eval_accuracy double",
    )
    return LinearModel(weights), log


def score(model: LinearModel, df: DataFrame) -> DataFrame:
    """Add ``logits`` and ``prediction``; ``row_idx`` keeps the order of the input.

    The logits are minus and plus half the margin.  Columns of ``df`` keep their names; those of
    the names added are replaced.
    """
    kept = [c for c in df.columns if c not in ("logits", "prediction")]
    head = _head_of(model.weights)
    look = _near_margins(head.matrix(model.weights, ["weight"]), head)
    looked = look(_coded(head)(_features(F.col("text")))).alias("looked")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), looked)
    far = None
    if not head.whole:
        # Written once, since rows and rare features are read on their own.
        rows = stage(rows, "texts")
        far = _far(rows.select("row", F.inline("looked.rare")), model.weights, ["weight"], head)
    met = _with_margins(rows.select("row", "kept", "looked.near"), far, ["weight"])
    half = F.col("weight") / 2
    scored = met.select("kept.*", F.array(-half, half).alias("logits"))
    return scored.withColumn("prediction", argmax(F.col("logits")))


def score_with(df: DataFrame, load_scorer: Callable[[], Callable[[pd.Series], np.ndarray]]) -> DataFrame:
    """The same with a caller's scorer, loaded once per task.

    The scorer maps a batch of texts to one row of scores per text.
    """
    plain = df.withColumn("text", text_or_nan(F.col("text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for batch in batches:
            scores = np.asarray(scorer(batch["text"]), dtype="float64").reshape(len(batch), -1)
            yield batch.assign(logits=list(scores), prediction=scores.argmax(axis=1).astype("int32"))

    return plain.mapInPandas(run, f"{schema}, {_SCORE_COLUMNS}")


def constant_scorer(label: int = 0) -> Column:
    """Scores of a model that always says ``label``."""
    return F.array(F.lit(float(label == 0)), F.lit(float(label == 1)))


def hash_scorer(key: Sequence[str], seed: int = 42) -> Column:
    """Scores of a model that guesses, the same for the same key and seed."""
    says_one = F.substring(sample_hash(seed, "score", key), 1, 1) >= "8"
    return F.when(says_one, constant_scorer(1)).otherwise(constant_scorer(0))


def evaluate_baseline(df: DataFrame, scorer: Column | Callable[[], Callable[[pd.Series], np.ndarray]]) -> DataFrame:
    """Counts and metrics of an untrained scorer: a column of scores, or a function as for :func:`score_with`."""
    scored = df.withColumn("logits", scorer) if isinstance(scorer, Column) else score_with(df.drop("logits", "prediction"), scorer)
    return evaluate_scores(scored)


@dataclass(frozen=True)
class Trial:
    run_id: str
    learning_rate: float
    batch_size: int
    epochs: int


def draw_trials(
    trials: int = TRIALS,
    seed: int = 42,
    rates: tuple[float, float] = LEARNING_RATES,
    batch_sizes: Sequence[int] = BATCH_SIZES,
    epochs: Sequence[int] = EPOCHS,
) -> list[Trial]:
    """Random trials: rate log-uniform, the other two from lists."""
    draw = random.Random(seed)
    low, high = (math.log(rate) for rate in rates)
    return [
        Trial(f"run-{i}", math.exp(draw.uniform(low, high)), draw.choice(batch_sizes), draw.choice(epochs))
        for i in range(trials)
    ]


_RUNS = (
    "run_id string, learning_rate double, batch_size int, epochs int, epochs_run int, split string, f1 double, accuracy double"
)


def search_hyperparameters(
    train: DataFrame,
    valid: DataFrame,
    dev: DataFrame,
    final: DataFrame | None = None,
    trials: int | Sequence[Trial] = TRIALS,
    seed: int = 42,
    min_f1: float = GOOD_F1,
    output: str | None = None,
    rungs: Sequence[int] = RUNGS,
) -> DataFrame:
    """Fit all trials together and report the metrics of their best epochs on the validation and dev rows.

    The rows are read once per epoch for all trials.  After the ``rungs``, trials below the median
    F1 stop.  With ``output``, a run whose dev F1 is above ``min_f1`` is committed to the run store
    there, with its scores of the dev rows ("valid") and of ``final``, which need a ``row_idx`` then.
    ``best_run`` on split "valid" picks the result.
    """
    lacking = [
        name for name, df in (("dev", dev), ("final", final)) if df is not None and "row_idx" not in df.columns
    ]
    if output is not None and lacking:
        raise ValueError(f"to store scores, {' and '.join(lacking)} need a row_idx")
    drawn = draw_trials(trials, seed) if isinstance(trials, int) else list(trials)
    # Names of columns, whatever the ids of the runs are.
    named = {f"w{i}": trial for i, trial in enumerate(drawn)}
    logs, weights, head = _fit(train, valid, named, rungs)
    dev_rows, dev_rare = _prepared(_found(dev), head)
    on_dev = _evaluate(0, dev_rows, dev_rare, weights, list(named), head)
    rows = []
    for name, trial in named.items():
        best = min(logs[name], key=lambda e: (e.eval_loss, e.epoch))
        for split, result in (("valid", best), ("dev", on_dev[name])):
            rows.append((*asdict(trial).values(), len(logs[name]), split, result.eval_f1, result.eval_accuracy))
        if output is not None and on_dev[name].eval_f1 > min_f1:
            model = LinearModel(weights.select("feature", "n", F.col(name).alias("weight")))
            scores = {"valid": score(model, dev)} | ({} if final is None else {"final": score(model, final)})
            metrics = {"valid_f1": best.eval_f1, "dev_f1": on_dev[name].eval_f1, "dev_accuracy": on_dev[name].eval_accuracy}
            commit_run(output, trial.run_id, scores, metrics, asdict(trial), weights=model.weights, min_f1=min_f1)
    return train.sparkSession.createDataFrame(rows, _RUNS)


def save_model(model: LinearModel, path: str) -> None:
    """Write the weights; a model that was there before is replaced."""
    model.weights.select("feature", "n", "weight").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel(spark.read.parquet(path))


def load_best(spark: SparkSession, output: str) -> LinearModel:
    """The model of the committed run with the best validation F1, from disk; the smallest run id on ties."""
    best = read_runs(spark, output).orderBy(F.desc(F.col("metrics")["valid_f1"]), "run_id").head()
    if best is None:
        raise ValueError("no run passed the bar")
    return LinearModel(read_weights(spark, output, best["attempt"]))
