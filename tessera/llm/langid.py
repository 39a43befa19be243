"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training rows; the weights are fitted with follow-the-regularised-leader and an
elastic-net penalty, which leaves most of them zero, on a bounded sample, in one task; a temperature fitted on rows that
were kept out of that makes the probabilities honest.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tessera.llm.common import tidy
from tessera.llm.ngrams import SparseRows, counted
from tessera.llm.tokens import text_groups

ORDERS = (1, 2, 3)
UNDETERMINED = "und"


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal for softmax regression with penalties ``l1`` and ``l2``."""

    def __init__(self, classes: int, features: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((classes, features)), np.zeros((classes, features))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        grown = n + g * g
        self.z[:, at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = grown


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        count = counted(text, ORDERS, self.bits)
        at = np.flatnonzero(count)
        x = count[at] * self.idf[at]
        norm = np.sqrt(x @ x)
        return at, x / norm if norm else x

    def probabilities(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return softmax((self.weights[:, at] @ x + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        p = self.probabilities(text)
        return self.languages[int(p.argmax())], float(p.max())


def document_frequencies(texts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many rows of ``text`` each slot occurs, and the number of rows; sums over all rows, made in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += counted(t, ORDERS, bits) > 0
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], names=["slot", "n"])

    found = texts.select("text").mapInArrow(tidy(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # 2 ** bits rows at most
    df, rows = np.zeros(1 << bits), 0
    for r in found:
        if r["slot"] < 0:
            rows = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return df, rows


def lot(*key: Column) -> Column:
    """A whole number below 2 ** 32 that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 32))


def place_in_sample(counts: dict, label: Column, key: tuple[Column, ...], most: int) -> Column:
    """Where a row is in a sample of about ``most``, as many of each label as can be: from 0, up to 1 if it is of the sample, else null.

    Rows are chosen by hash of ``key``, which should tell them apart; null is a value like others.
    """
    each, place = max(1, most // max(1, len(counts))), F.lit(None).cast("double")
    for value, n in counts.items():
        share = lot(*key) / F.lit(float(min(1.0, each / n) * (1 << 32)))
        place = F.when(label == F.lit(value), F.when(share <= 1, share)).otherwise(place)
    return place


def fit_in_a_task(rows: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]], fit: Callable[[list, SparseRows], object], most: int):
    """What ``fit`` makes of the labels and features of the rows of ``label, text, place``, of the ``most`` lowest places at most.

    Features are taken where the rows are.  Slots alone, of which a row has a bounded number however long its text, go
    to one task, in an order that does not depend on where they came from; the model alone goes to the driver.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            at = batch.column(2)
            lists = [pa.array([np.asarray(m[k], kind) for m in made], pa.list_(pa.from_numpy_dtype(kind))) for k, kind in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, at], names=["label", "slots", "amounts", "place"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, found, keys = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                found.append((batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy()))
                keys.append(hashlib.blake2b(found[-1][0].tobytes() + found[-1][1].tobytes(), digest_size=16).digest())
        order = sorted(range(len(labels)), key=lambda i: (keys[i], str(labels[i])))
        del keys
        model = fit([labels[i] for i in order], SparseRows(found[i] for i in order))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    label = rows.schema["label"].dataType.simpleString()
    kinds = f"label {label}, slots array<int>, amounts array<float>, place double"
    gathered = rows.select("label", "text", "place").mapInArrow(tidy(slots), kinds).orderBy("place", "slots").limit(most)  # of each task no more than ``most``
    made = gathered.drop("place").repartition(1).mapInArrow(tidy(train), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], SparseRows([]))


def fit_languages(labels: list, examples: SparseRows, model: LanguageModel, *, epochs: int, seed: int, **ftrl) -> LanguageModel:
    """``model`` with weights, bias and temperature from examples of TF-IDF values; every sixth, at random, is for the last."""
    if not labels:
        return model
    order = np.random.default_rng(seed).permutation(len(labels))
    truth = np.array([model.languages.index(labels[i]) for i in order])
    part = len(truth) // 6
    leader, last = FollowTheLeader(len(model.languages), (1 << model.bits) + 1, **ftrl), np.array([1 << model.bits])
    for _ in range(epochs):
        for i in range(part, len(truth)):
            at, x = examples[order[i]]
            leader.learn(np.concatenate((at, last)), np.append(x, 0.1), int(truth[i]))
    weights = leader.weights()
    model.weights, model.bias = np.ascontiguousarray(weights[:, :-1]), 0.1 * weights[:, -1]
    kept = range(part or len(truth))
    scores = np.array([model.weights[:, at] @ x + model.bias for at, x in (examples[order[i]] for i in kept)])
    loss = lambda t: -np.log(np.maximum(softmax(scores / t)[np.arange(len(kept)), truth[: len(kept)]], 1e-12)).mean()
    grid = np.geomspace(0.02, 5, 120)
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def train_languages(rows: DataFrame, *, sample: int = 6000, bits: int = 15, epochs: int = 2, seed: int = 7, **ftrl) -> LanguageModel:
    """A model from ``doc_id, text, lang`` rows; null texts and languages are left out.

    ``sample`` bounds the rows that weights and temperature are fitted on, shared equally by the languages; document
    frequencies are of all rows.  The languages should be few: each has a row of weights.
    """
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    model = LanguageModel(languages, idf, np.zeros((len(languages), 1 << bits)), np.zeros(len(languages)), 1.0, bits)
    if not counts:
        return model
    place = place_in_sample(counts, F.col("lang"), (F.col("doc_id"), F.col("text")), sample)
    few = rows.select(F.col("lang").alias("label"), "text", place.alias("place")).where("place IS NOT NULL")
    return fit_in_a_task(few, model.features, lambda labels, examples: fit_languages(labels, examples, model, epochs=epochs, seed=seed, **ftrl), sample)


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and, under the two ``names``, language and score; columns of these names are replaced.

    Null text, and text without a letter, is ``und`` with score 0; so is all if nothing was there to learn from.
    """
    docs = docs.drop(*names)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: languages times 2 ** bits
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in text_groups(texts):
                made = [model.predict(t) for t in texts[a:b]]
                columns = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tidy(run), StructType(list(docs.schema.fields)).add(names[0], StringType()).add(names[1], DoubleType()))
