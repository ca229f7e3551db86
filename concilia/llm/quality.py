"""Quality rules: counted properties of a text, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed byte 4-grams, words and word pairs,
fitted on a bounded sample of labelled rows. Texts are counted and scored in one pass over
Arrow batches; no row is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, bounded_sample, text_or_empty

BITS = 17  #: each kind of n-gram has a table of 2 ** BITS weights
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    """Weights per kind of n-gram, a bias, and Platt's two numbers; ``None`` weights: no model."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, score: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * score + self.offset, -500, 500))))


def _slots(mixed: np.ndarray) -> np.ndarray:
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(distinct.__getitem__, words), np.int64, len(words)), list(distinct)


def _grams(data: bytes, ids: np.ndarray, distinct: list[bytes]) -> list[np.ndarray]:
    """Table slots of the byte 4-grams, the words and the word pairs of a text."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    by_four = raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[ids]
    pairs = hashes[:-1] * np.uint64(31) ^ hashes[1:]
    return [_slots(by_four), _slots(hashes) + (1 << BITS), _slots(pairs) + (2 << BITS)]


def _repeat_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words in windows of three that occur at least twice in the text."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * n_distinct + ids[1:]
    if n_distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, of, counts = np.unique(pairs[:-1] * n_distinct + ids[2:], return_inverse=True, return_counts=True)
    again = counts[of] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def counts_of(text: str, ids: np.ndarray, n_distinct: int) -> tuple[int, ...]:
    """The values of ``_COUNTS``."""
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    return (
        len(ids),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(ids, n_distinct),
    )


def _features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their mean frequency within each kind of n-gram."""
    slots, values = [], []
    for grams in _grams(data, *_word_ids(data.split())):
        found, times = np.unique(grams, return_counts=True)
        slots.append(found)
        values.append(times / max(1, len(grams)))
    return np.concatenate(slots).astype(np.int32), np.concatenate(values).astype(np.float32)


def _score(model: Model, data: bytes, ids: np.ndarray, distinct: list[bytes]) -> float:
    means = [model.weights[grams].mean() for grams in _grams(data, ids, distinct) if len(grams)]
    return float(sum(means)) + model.bias


def training_rows(
    docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str, seed: int
) -> DataFrame:
    """``id, slots, values, label`` of at most ``max_rows`` labelled texts, chosen by seeded
    hash, in order of id in one partition.

    An id with contradicting or null labels is not used. Only the chosen ids, at most
    ``max_rows`` of them, are broadcast.
    """
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
    known = known.where((F.col("label") == F.col("other")) & F.col("label").isin(0, 1) & F.col("id").isNotNull())
    chosen = bounded_sample(known, ["id"], max_rows, seed).select("id", F.col("label").cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                    batch.column("label"),
                ],
                ["id", "slots", "values", "label"],
            )

    # A text without words has no n-grams to learn from.
    joined = texts.join(F.broadcast(chosen), "id").where(F.col("text").rlike(WORDS)).select("id", "text", "label")
    schema = T.StructType([joined.schema["id"], *T.StructType.fromDDL("slots array<int>, values array<float>, label int")])
    # A limit gathers what it lets through in one partition: that of the fit.
    return joined.mapInArrow(each, schema).limit(max_rows).sortWithinPartitions("id")


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rounds: int = 150,
    seed: int = 7,
) -> Model:
    """Fits on four fifths of at most ``max_rows`` labelled rows and calibrates on the rest.

    The bound keeps the sample, some ten kilobytes a row, within one task; the driver gets
    the weights alone. Without rows of both labels there is no model, and the counted rules
    decide alone.
    """
    sample = training_rows(docs, labels, max_rows, id_col, text_col, label_col, seed)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fitted([_Block.of(b) for b in batches if len(b)], rounds)
        weights = None if model.weights is None else model.weights.tobytes()
        numbers = [pa.array([float(n)]) for n in (model.bias, model.slope, model.offset)]
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary()), *numbers], ["weights", "bias", "slope", "offset"])

    found = sample.mapInArrow(fit, "weights binary, bias double, slope double, offset double").where("weights is not null").collect()
    if not found:
        return Model(None)
    return Model(np.frombuffer(bytes(found[0].weights), np.float32), *found[0][1:])


def _fitted(blocks: list[_Block], rounds: int) -> Model:
    label = np.concatenate([b.label for b in blocks]) if blocks else np.zeros(0)
    if len(set(label.tolist())) < 2:
        return Model(None)
    held = np.zeros(len(label), bool)
    for value in (0.0, 1.0):
        held[np.flatnonzero(label == value)[4::5]] = True
    weights, bias = _fit(blocks, label, ~held, rounds)
    scores = np.concatenate([b.scores(weights) for b in blocks]) + bias
    slope, offset = _platt(scores[held], label[held]) if held.any() else (1.0, 0.0)
    return Model(weights, bias, slope, offset)


@dataclass(frozen=True)
class _Block:
    """Some training rows, as views of their Arrow batch: what is computed from them needs
    memory for these only."""

    slots: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Block:
        _, slots, values, label = batch.columns
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (slots, values)]
        starts = slots.offsets.to_numpy()[:-1] - slots.offsets[0].as_py()
        return cls(*flat, starts, label.to_numpy(zero_copy_only=False).astype(np.float64))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.slots] * self.values, self.starts, dtype=np.float64)

    def slope(self, errors: np.ndarray) -> np.ndarray:
        lengths = np.diff(np.append(self.starts, len(self.slots)))
        return np.bincount(self.slots, np.repeat(errors.astype(np.float32), lengths) * self.values, 3 << BITS)


def _fit(blocks: list[_Block], label: np.ndarray, used: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over all rows at once; both labels weigh the same."""
    weight = np.where(label == 1, 0.5 / max(1, (used & (label == 1)).sum()), 0.5 / max(1, (used & (label == 0)).sum())) * used
    cuts = np.cumsum([len(b.label) for b in blocks])[:-1]
    coefficients, bias = np.zeros(3 << BITS, np.float32), 0.0
    squares, bias_squares = np.full(3 << BITS, 1e-10), 1e-10
    for _ in range(rounds):
        scores = np.concatenate([b.scores(coefficients) for b in blocks]) + bias
        errors = weight * (1 / (1 + np.exp(-np.clip(scores, -500, 500))) - label)
        slope = 1e-8 * coefficients.astype(np.float64)
        for block, own in zip(blocks, np.split(errors, cuts)):
            slope += block.slope(own)
        squares += slope**2
        coefficients -= (0.5 * slope / np.sqrt(squares)).astype(np.float32)
        bias_squares += errors.sum() ** 2
        bias -= 0.1 * errors.sum() / np.sqrt(bias_squares)
    return coefficients, float(bias)


def _platt(scores: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make held-out scores probabilities, by Newton steps on smoothed labels."""
    ones = label.sum()
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([scores, np.ones_like(scores)])
    ab = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x @ (p - goal))
        ab -= np.clip(step, -5, 5)
    return float(ab[0]), float(ab[1])


def assess(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_probability: float = 0.3,
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with the five counts, ``base_failed``,
    ``probability`` (that the text is good) and ``kept``.

    A null text has no words and fails; so does one of fewer than ``min_words`` words or
    with more than ``max_repeat_percent`` % of its words in repeated windows of three. The
    others are kept at ``min_probability`` or more. Whole texts are read, whatever their
    length; each row is judged alone, so repeated rows agree. Columns may have any name.
    An empty table yields an empty result.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.weights, model.bias, model.slope, model.offset))  # three tables of 2 ** BITS numbers at most
    rows = docs.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                data = text.encode()
                ids, distinct = _word_ids(data.split())
                counted = counts_of(text, ids, len(distinct))
                failed = counted[0] < min_words or 100 * counted[4] > max_repeat_percent * counted[0]
                known = model.weights is not None and len(ids) > 0
                p = model.probability(_score(model, data, ids, distinct)) if known else None
                out.append((*counted, failed, p, not failed and (p is None or p >= min_probability)))
            columns = zip(*out) if out else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", *_COUNTS, "base_failed", "probability", "kept"])

    counted = ", ".join(f"{c} long" for c in _COUNTS)
    schema = rows.select("row").schema
    for part in f"{counted}, base_failed boolean, probability double, kept boolean".split(", "):
        name, kind = part.split(" ")
        schema = schema.add(name, kind)
    return rows.mapInArrow(each, schema)
