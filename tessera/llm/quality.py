"""Quality classifier: a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

The ratios, the hinge-loss model (dual coordinate descent) and the sigmoid that turns margins into probabilities are
fitted on a bounded sample of labelled rows, in one task; every document is then scored by its whole text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.llm.common import tidy
from tessera.llm.langid import fit_in_a_task, lot, place_in_sample
from tessera.llm.ngrams import SparseRows, present
from tessera.llm.tokens import text_groups

ORDERS = (1, 2, 3)


def log_count_ratios(examples: Iterable[np.ndarray], labels: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << bits), smooth)
    for at, y in zip(examples, labels):
        counts[int(y > 0), at] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(example: Callable[[int], tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, *, c: float = 1.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss problem; ``example`` gives slots and values by number, labels are 1 and -1."""
    w, dual = np.zeros(features), np.zeros(len(labels))
    square = np.array([x @ x for _, x in map(example, range(len(labels)))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(labels)):
            if not square[i]:
                continue
            at, x = example(i)
            gradient = labels[i] * (w[at] @ x) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), c)
            if new != dual[i]:
                w[at] += (new - dual[i]) * labels[i] * x
                largest = max(largest, abs(new - dual[i]))
                dual[i] = new
        if largest < 1e-3 * c:
            break
    return w


def fit_sigmoid(margins: np.ndarray, truth: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    positive, negative = truth.sum(), (1 - truth).sum()
    target = np.where(truth > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-9)
        hessian = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(g * margins).sum() + 1e-6 * a, g.sum()])
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


@dataclass
class QualityModel:
    weights: np.ndarray  # of the ratio-scaled indicators, ratios included
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def margin(self, text: str | None) -> float:
        at = present(text, ORDERS, self.bits)
        scale = np.sqrt((self.ratios[at] ** 2).sum())
        return float(self.weights[at].sum() / scale + self.bias) if scale else self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.offset, -35, 35))))


def fit_quality(labels: list, examples: SparseRows, bits: int, share: dict[int, int], *, c: float = 1.0, seed: int = 7) -> QualityModel:
    """A model from rows of labels and slots; every fourth row, at random, is for the sigmoid alone.

    Of fewer than four rows the sigmoid is fitted on those that the weights are.  ``share`` says how frequent label 0 and
    label 1 are, which the sigmoid takes into account.
    """
    order = np.random.default_rng(seed).permutation(len(labels))
    truth = np.array([float(labels[i] == 1) for i in order])
    none = np.zeros(1 << bits)
    if len(set(truth)) < 2:
        p = (truth.sum() + 1) / (len(truth) + 2)
        return QualityModel(none, none, 0.0, 1.0, float(np.log(p / (1 - p))), bits)
    part = len(truth) // 4
    if len(set(truth[part:])) < 2:  # the one label of all others is in the part kept for the sigmoid
        part = 0
    ratios = log_count_ratios((examples[order[i]][0] for i in range(part, len(truth))), truth[part:], bits)

    def scaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        at = examples[order[i]][0]
        x = ratios[at]
        norm = np.sqrt(x @ x)
        return np.append(at, 1 << bits), np.append(x / norm if norm else x, 1.0)

    w = dual_coordinate_descent(lambda i: scaled(part + i), 2 * truth[part:] - 1, (1 << bits) + 1, c=c, seed=seed)
    model = QualityModel(w[:-1] * ratios, ratios, float(w[-1]), 1.0, 0.0, bits)
    kept = truth[: part or len(truth)]
    margins = np.array([w[s[0]] @ s[1] for s in map(scaled, range(len(kept)))])
    weight = np.array([share[int(y)] / max(1, (kept == y).sum()) for y in kept])
    model.slope, model.offset = fit_sigmoid(margins, kept, weight / weight.mean())
    return model


def train_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 8000, bits: int = 16, c: float = 1.0, seed: int = 7) -> QualityModel:
    """A model from ``doc_id, text`` and ``doc_id, quality``; null labels and ids are left out, a null text is empty.

    ``sample`` bounds the labelled rows that are fitted on, shared equally by the two labels; the sigmoid weighs them
    by how frequent each label is.  Of several labels for one doc_id the lowest counts.  With one label alone, or
    none, every document gets the same score: the share of label 1, or 0.5.
    """
    labelled = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {y: sum(n for q, n in counts.items() if (q == 1) == bool(y)) for y in (0, 1)}
    place = place_in_sample(counts, F.col("label"), (F.col("doc_id"),), sample)
    few = labelled.select("doc_id", "label", place.alias("place")).where("place IS NOT NULL").orderBy("place", "doc_id").limit(sample)  # ids, so the text is not shuffled for them
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = lot(F.col("doc_id"), F.col("text")).cast("double")  # an id that many rows have fills no more than its share
    rows = texts.join(F.broadcast(few.drop("place")), "doc_id").select("label", "text", own.alias("place"))

    def slots(text: str) -> tuple[np.ndarray, np.ndarray]:
        return present(text, ORDERS, bits), np.zeros(0)

    return fit_in_a_task(rows, slots, lambda found, examples: fit_quality(found, examples, bits, share, c=c, seed=seed), sample)


def score_quality(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``name``, 0 to 1; a column of that name is replaced; null text is empty."""
    docs = docs.drop(name)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2 ** bits
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in text_groups(texts):
                made = pa.array([model.score(t) for t in texts[a:b]], pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), made], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType(list(docs.schema.fields)).add(name, DoubleType()))
