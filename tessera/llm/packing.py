"""Packing documents into fixed-size sequences: few-document length patterns fitted to the length histogram.

Lengths go from 1 to the capacity, so the histogram is of a fixed size however many documents there are, and the whole
plan is made from it: patterns of up to four length classes that fill a sequence are enumerated, their repeat counts are
fitted to the class histogram by non-negative least squares, the counts are rounded, each pattern is filled with lengths
of its classes that come to the capacity exactly, and what remains is packed by decreasing best fit.
A plan says, for a length and a rank among the pieces of that length, which sequence and place it goes to.

Ranks come from running counts inside each written part plus the counts of the parts before it, so no length, however
many documents share it, is brought into one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import tidy, written
from tessera.llm.tokens import array_groups, encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
RANK_BITS = 44


def class_patterns(classes: int, most: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``most`` classes, each 1 to ``classes``, that sum to ``classes``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < most:
            for c in range(min(left, head[-1] if head else left), 0, -1):
                if c * (most - len(head)) < left:
                    break
                extend((*head, c), left - c)

    extend((), classes)
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 of least |a x - b|, by an active set: at most as many positive entries as ``a`` has rows."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        if free.all() or gradient.max() <= tolerance:
            break
        free[int(gradient.argmax())] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (trial[free] > 0).all():
                x = trial
                break
            sinking = free & (trial <= 0)
            step = (x[sinking] / np.maximum(x[sinking] - trial[sinking], 1e-300)).min()
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0.0
    return x


class Lengths:
    """What is left of the histogram, with the largest length that fits a room and is still there."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {length: n for length, n in histogram.items() if n > 0}
        self.sorted = sorted(self.left)

    def largest(self, room: int, used: Counter) -> int | None:
        at = bisect_right(self.sorted, room) - 1
        while at >= 0 and used[self.sorted[at]] >= self.left[self.sorted[at]]:
            at -= 1
        return self.sorted[at] if at >= 0 else None

    def take(self, content: list[int], repeats: int) -> int:
        """How often ``content`` can be taken, at most ``repeats`` times; it is then gone."""
        used = Counter(content)
        repeats = min([repeats, *(self.left[length] // n for length, n in used.items())])
        for length, n in used.items():
            self.left[length] -= n * repeats
            if not self.left[length]:
                del self.left[length]
                self.sorted.remove(length)
        return repeats

    def of_pattern(self, pattern: tuple[int, ...], width: int, capacity: int, tries: int = 4000) -> list[int] | None:
        """Lengths that fill the capacity exactly, one of each class of the pattern but for the last, which is any that fits.

        Longer ones are tried first, and no more than ``tries`` choices.  Very short ones are not the last: they are left for
        the residuals, which they fill.
        """
        chosen: list[int] = []
        used: Counter = Counter()

        def choose(k: int, room: int) -> bool:
            nonlocal tries
            if k == len(pattern) - 1:
                if room < capacity // 16 or self.left.get(room, 0) <= used[room]:
                    return False
                chosen.append(room)
                return True
            at = bisect_right(self.sorted, min(pattern[k] * width, room - 1)) - 1
            while at >= 0 and self.sorted[at] > (pattern[k] - 1) * width and tries > 0:
                length = self.sorted[at]
                at -= 1
                tries -= 1
                if used[length] >= self.left[length]:
                    continue
                chosen.append(length)
                used[length] += 1
                if choose(k + 1, room - length):
                    return True
                chosen.pop()
                used[length] -= 1
            return False

        return chosen if choose(0, capacity) else None

    def fill(self, head: list[int], capacity: int) -> list[int]:
        """``head`` and then, again and again, the best fit for the room left."""
        content, used, room = list(head), Counter(head), capacity - sum(head)
        while room and (length := self.largest(room, used)):
            content.append(length)
            used[length] += 1
            room -= length
        return content


def plan_sequences(histogram: dict[int, int], capacity: int, *, classes: int = 64, most: int = 4) -> list[tuple[list[int], int]]:
    """Contents of sequences and how often each is repeated; every length is used as often as the histogram has it."""
    lengths, plan = Lengths(histogram), []
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    counts = np.zeros(classes)
    for length, n in lengths.left.items():
        counts[-(-length // width) - 1] += n
    patterns = class_patterns(classes, most)
    a = np.zeros((classes, len(patterns)))
    for j, pattern in enumerate(patterns):
        for c in pattern:
            a[c - 1, j] += 1
    scale = 1 / np.sqrt(np.maximum(counts, 1.0))
    fitted = nonnegative_least_squares(a * scale[:, None], counts * scale) if counts.any() else np.zeros(len(patterns))
    # patterns of large documents first, as small ones fit anywhere
    for j in sorted(np.flatnonzero(np.rint(fitted) > 0), key=lambda j: patterns[j], reverse=True):
        repeats = int(np.rint(fitted[j]))
        while repeats > 0 and (content := lengths.of_pattern(patterns[j], width, capacity)):
            n = lengths.take(content, repeats)
            plan.append((content, n))
            repeats -= n
    while lengths.sorted:  # residuals: the largest that is left, then best fits
        content = lengths.fill([lengths.sorted[-1]], capacity)
        plan.append((content, lengths.take(content, 1 << 62)))
    return plan


def plan_slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted slots: from which rank of a length on, into which sequence, at which offset."""
    taken: Counter = Counter()
    keys, ranks, sequences, offsets = [], [], [], []
    sequence = 0
    for content, repeats in plan:
        offset = 0
        for length in content:
            keys.append((length << RANK_BITS) + taken[length])
            ranks.append(taken[length])
            sequences.append(sequence)
            offsets.append(offset)
            taken[length] += repeats
            offset += length
        sequence += repeats
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return {name: np.array(v, dtype=np.int64)[order] for name, v in (("key", keys), ("rank", ranks), ("sequence", sequences), ("offset", offsets))}


def cut_pieces(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document, with its part of the output and its rank there among equal lengths."""
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in array_groups(texts):
                rows = []
                for doc, raw in zip(ids[a:b], tokens.encode_many(texts.slice(a, b - a))):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        piece = raw[at : at + step]
                        n = len(piece) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), PIECES)


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, classes: int = 64, most: int = 4) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: each piece's place in a sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null or empty text is a piece of the end id
    alone; a null doc_id is carried; rows that share a doc_id are packed each on its own.  Only documents longer than
    the capacity are cut.  An empty table gives an empty result.
    """
    pieces = written(cut_pieces(docs, capacity=capacity, tokenizer=tokenizer, end_id=end_id), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = plan_slots(plan_sequences(histogram, capacity, classes=classes, most=most))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.searchsorted(slots["key"], (length << RANK_BITS) + rank, side="right") - 1
            sequence = slots["sequence"][at] + rank - slots["rank"][at]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(slots["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
