"""Language of texts by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes.  In each window one gated recurrent
layer reads the bytes forwards and another backwards; both states at a byte give the
probabilities of the languages there.  The probabilities of a text are the means over
all of its bytes.  The network is trained by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gradeloom.llm.blocks import result_schema, with_results
from gradeloom.llm.words import slices, text_bytes

WINDOW = 64
HIDDEN = 8
# Bounds of the training sample: drawn texts, and windows drawn from each.
MAX_TEXTS = 4000
MAX_WINDOWS = 6
UNKNOWN = "und"
_PAD = 256
_BATCH = 2048
_SLICE_BYTES = 1 << 20

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class LanguageModel:
    """Weights of the network and the languages by number."""

    languages: list[str]
    weights: Weights


def new_weights(hidden: int, languages: int, seed: int, dtype: type = np.float32) -> Weights:
    rng = np.random.default_rng(seed)
    weights: Weights = {}
    for way in ("f", "b"):
        weights[f"{way}_bytes"] = rng.normal(0, 0.3, (257, 3 * hidden))
        weights[f"{way}_state"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        weights[f"{way}_bias"] = np.zeros(hidden)
    weights["out"] = rng.normal(0, hidden**-0.5, (2 * hidden, languages))
    weights["out_bias"] = np.zeros(languages)
    return {name: x.astype(dtype) for name, x in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * x.dtype.type(0.5))
    x += 1
    x *= x.dtype.type(0.5)
    return x


def _read(weights: Weights, way: str, steps: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each byte; ``steps`` is (time, window) in reading order, 256 pads and changes nothing."""
    table, square, bias = weights[f"{way}_bytes"], weights[f"{way}_state"], weights[f"{way}_bias"]
    hidden = len(square)
    state = np.zeros((steps.shape[1], hidden), table.dtype)
    states = np.empty((*steps.shape, hidden), table.dtype)
    for t, now in enumerate(steps):
        own = table[now]
        drive = state @ square
        gates = own[:, : 2 * hidden] + drive[:, : 2 * hidden]
        gates = _sigmoid(gates)
        keep, reset = gates[:, :hidden], gates[:, hidden:]
        keep[now == _PAD] = 1
        inner = drive[:, 2 * hidden :] + bias
        new = np.tanh(own[:, 2 * hidden :] + reset * inner)
        after = new + keep * (state - new)
        if trace is not None:
            trace.append((state, keep, reset, inner, new))
        state = states[t] = after
    return states


def _logits(weights: Weights, way: str, steps: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What one way adds to the logits (time, language, window): as :func:`_read`, but with the windows innermost."""
    table, square = (np.ascontiguousarray(weights[f"{way}_{name}"].T) for name in ("bytes", "state"))
    bias, hidden = weights[f"{way}_bias"][:, None], square.shape[1]
    half = table.dtype.type(0.5)
    state = np.zeros((hidden, steps.shape[1]), table.dtype)
    states = np.empty((len(steps), *state.shape), table.dtype)
    for t, now in enumerate(steps):
        own = np.take(table, now, axis=1, mode="clip")
        drive = square @ state
        gates = own[: 2 * hidden]
        gates += drive[: 2 * hidden]
        gates *= half
        np.tanh(gates, out=gates)
        gates += 1
        gates *= half
        keep, reset = gates[:hidden], gates[hidden:]
        keep[:, now == _PAD] = 1
        new = drive[2 * hidden :]
        new += bias
        new *= reset
        new += own[2 * hidden :]
        np.tanh(new, out=new)
        after = states[t]
        np.subtract(state, new, out=after)
        after *= keep
        after += new
        state = after
    return np.matmul(np.ascontiguousarray(out.T), states)


def probabilities(weights: Weights, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Probabilities (time, window, language), the states, and what training needs."""
    ahead: list = []
    back: list = []
    forward = _read(weights, "f", steps, ahead)
    backward = _read(weights, "b", steps[::-1], back)[::-1]
    states = np.concatenate([forward, backward], axis=2)
    return _soft(states @ weights["out"] + weights["out_bias"]), states, ahead, back


def _soft(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=-1, keepdims=True))
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def loss_and_gradient(weights: Weights, steps: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """Mean cross entropy over all bytes and its gradient by backpropagation through time."""
    probs, states, ahead, back = probabilities(weights, steps)
    real = (steps != _PAD)[:, :, None]
    n = max(1, int(real.sum()))
    right = probs[:, np.arange(steps.shape[1]), labels]
    loss = -float((np.log(right + 1e-30) * real[:, :, 0]).sum()) / n
    error = probs.copy()
    error[:, np.arange(steps.shape[1]), labels] -= 1
    error = error * real / error.dtype.type(n)
    width = states.shape[2]
    gradient = {
        "out": states.reshape(-1, width).T @ error.reshape(-1, error.shape[2]),
        "out_bias": error.sum(axis=(0, 1)),
    }
    to_states = error @ weights["out"].T
    hidden = width // 2
    for way, trace, order, part in (
        ("f", ahead, steps, to_states[:, :, :hidden]),
        ("b", back, steps[::-1], to_states[::-1, :, hidden:]),
    ):
        square = weights[f"{way}_state"]
        d_square, d_bias = np.zeros_like(square), np.zeros_like(weights[f"{way}_bias"])
        own = np.empty((*order.shape, 3 * hidden), square.dtype)
        flow = np.zeros((order.shape[1], hidden), square.dtype)
        for t in range(len(order) - 1, -1, -1):
            state, keep, reset, inner, new = trace[t]
            flow = flow + part[t]
            d_keep = flow * (state - new) * keep * (1 - keep)
            d_new = flow * (1 - keep) * (1 - new * new)
            d_reset = d_new * inner * reset * (1 - reset)
            d_inner = d_new * reset
            drive = np.concatenate([d_keep, d_reset, d_inner], axis=1)
            d_square += state.T @ drive
            d_bias += d_inner.sum(axis=0)
            own[t] = np.concatenate([d_keep, d_reset, d_new], axis=1)
            flow = flow * keep + drive @ square.T
        flat, rows = order.ravel(), own.reshape(-1, 3 * hidden)
        columns = [np.bincount(flat, weights=rows[:, c], minlength=257) for c in range(3 * hidden)]
        gradient[f"{way}_bytes"] = np.stack(columns, axis=1).astype(square.dtype)
        gradient[f"{way}_state"], gradient[f"{way}_bias"] = d_square, d_bias
    return loss, gradient


def _cut(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (window, time) of all texts, padded, and the text of each."""
    counts = -(-np.diff(offsets) // window)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
    places = begin[:, None] + np.arange(window)
    inside = places < offsets[1:][owner][:, None]
    values = data[np.minimum(places, max(0, len(data) - 1))].astype(np.int16)
    return np.where(inside, values, np.int16(_PAD)), owner


def train_language_model(
    df: DataFrame,
    lang: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    max_texts: int = MAX_TEXTS,
    hidden: int = HIDDEN,
    window: int = WINDOW,
    steps: int = 260,
    batch: int = 384,
    rate: float = 0.02,
    seed: int = 5,
) -> LanguageModel:
    """Learn from the texts of at most ``max_texts`` keys that have a language, drawn by hash.

    ``MAX_WINDOWS`` windows from all over each drawn text reach the driver.  Rows with a
    null language, key or text are not used.  Without any the model knows no language.
    """
    usable = df.select(key, lang, text).filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    keys = usable.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(max_texts)
    # Of rows that share a drawn key, that of the least hash, so that the sample has its bound.
    least = F.min_by(F.struct(lang, text), F.struct(F.xxhash64(text), F.col(lang)))
    drawn = usable.join(F.broadcast(keys), key, "left_semi").groupBy(key).agg(least.alias("row")).select(key, "row.*")

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in slices(rows, text, _SLICE_BYTES):
                cut, owner = _cut(*text_bytes(part.column(text)), window)
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i, (language, name) in enumerate(zip(part.column(lang).to_pylist(), part.column(key).to_pylist())):
                    n = first[i + 1] - first[i]
                    at = first[i] + np.unique(np.arange(MAX_WINDOWS) * n // MAX_WINDOWS) if n else []
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(name)] * len(at)), pa.array([language] * len(at)), pa.array([cut[j].tobytes() for j in at])],
                            names=["key", "lang", "window"],
                        )

    found = sorted(tuple(r) for r in drawn.mapInArrow(windows_of, "key string, lang string, window binary").collect())
    languages = sorted({language for _, language, _ in found})
    weights = new_weights(hidden, max(1, len(languages)), seed)
    if len(languages) < 2:
        return LanguageModel(languages, weights)
    texts = np.stack([np.frombuffer(w, np.int16) for _, _, w in found])
    labels = np.array([languages.index(language) for _, language, _ in found])
    # Every language gives as many windows to a batch.
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    rng = np.random.default_rng(seed)
    first = {name: np.zeros_like(x) for name, x in weights.items()}
    second = {name: np.zeros_like(x) for name, x in weights.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(own, -(-batch // len(languages))) for own in by_language])
        _, gradient = loss_and_gradient(weights, texts[chosen].T.astype(np.int64), labels[chosen])
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in gradient.values())))
        now = rate * min(1.0, 2 * (steps - step + 1) / steps)
        for name, g in gradient.items():
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g * g
            rise = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            weights[name] = (weights[name] - now * rise).astype(np.float32)
    return LanguageModel(languages, weights)


def _means(model: LanguageModel, texts: pa.Array, window: int) -> np.ndarray:
    """Mean probabilities over the bytes of each text; zeros for empty ones."""
    data, offsets = text_bytes(texts)
    cut, owner = _cut(data, offsets, window)
    total = np.zeros((len(texts), len(model.languages)))
    weights = model.weights
    hidden = len(weights["out"]) // 2
    for i in range(0, len(cut), _BATCH):
        steps = np.ascontiguousarray(cut[i : i + _BATCH].T).astype(np.intp)
        logits = _logits(weights, "f", steps, weights["out"][:hidden])
        logits += _logits(weights, "b", steps[::-1], weights["out"][hidden:])[::-1]
        logits += weights["out_bias"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (steps != _PAD)[:, None, :] / logits.sum(axis=1, keepdims=True)
        np.add.at(total, owner[i : i + _BATCH], logits.sum(axis=0, dtype=np.float64).T)
    return total / np.maximum(1, np.diff(offsets))[:, None]


def identify_language(
    df: DataFrame, model: LanguageModel, text: str = "text", window: int = WINDOW, lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Every row with the language of its whole text and its mean probability.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything
    if the model knows no language; a model of one language gives that with score 1.
    Ties go to the first language in order.  Repeated rows are labelled alike.  Columns
    named like the added ones are replaced.  An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for rows in batches:
            for part in slices(rows, text, _SLICE_BYTES):
                letters = part.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
                if known.languages:
                    means = _means(known, part.column(part.schema.get_field_index(text)), window)
                    best = np.where(letters, means.argmax(axis=1), len(known.languages))
                    value = np.where(letters, means.max(axis=1), 0.0)
                else:
                    best, value = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                kept = part.select([n for n in part.schema.names if n != "_letters"])
                yield with_results(kept, {lang: pa.array(names[best], pa.string()), score: pa.array(np.minimum(value, 1.0))})

    marked = df.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    added = StructType([StructField(lang, StringType()), StructField(score, DoubleType())])
    return marked.mapInArrow(run, result_schema(df.drop("_letters"), added))
