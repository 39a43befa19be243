"""One-permutation MinHash fingerprints of word shingles, and a pass over documents beside their successors.

Each shingle is hashed once; the top bits of the hash say which bin it falls in, and the bin takes its smallest hash.
Bins without a shingle copy one that has any, found by a fixed sequence of random bins (optimal densification).  Of
each bin, low bits of the hash mixed with the bin's number are stored, so that copies of one hash agree by chance
independently; that chance is one in ``2 ** bits``, and ``likeness`` corrects for it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, tidy

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleHasher:
    """Hashes of all shingles of a text in one sweep.

    With prefix sums of ``byte * r ** position`` modulo 2 ** 64, the sum over any span times ``r ** -start`` depends on
    the span's bytes alone.
    """

    def __init__(self, words: int = 5, chunk: int = 100_000):
        self.words, self.chunk = words, chunk
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        ones = np.full(n, _MULTIPLIER), np.full(n, inverse)
        for x in ones:
            x[0] = 1
        self.powers, self.inverses = (np.multiply.accumulate(x) for x in ones)

    def _spans(self, parts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b" ".join(parts), np.uint8)
        if len(data) >= len(self.powers):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        spaces = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
        if len(parts) > self.words:
            starts, ends = starts[: len(parts) - self.words + 1], ends[self.words - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        return mix64((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        """One hash for each run of ``words`` words, or one for all words if they are fewer; none without words."""
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(parts) <= self.chunk:
            return self._spans(parts)
        last = len(parts) - self.words + 1
        return np.concatenate([self._spans(parts[i : min(i + self.chunk, last) + self.words - 1]) for i in range(0, last, self.chunk)])


class OnePermutation:
    """Fingerprints of ``bins`` bins of ``bits`` bits."""

    def __init__(self, bins: int = 512, bits: int = 4, words: int = 5):
        assert bins & (bins - 1) == 0 and bits in (1, 2, 4, 8)
        self.bins, self.bits, self.hashes = bins, bits, ShingleHasher(words)
        self.offsets = np.arange(1, bins + 1, dtype=np.uint64) * _MULTIPLIER
        self._tries: list[np.ndarray] = []

    def _bins_to_try(self, block: int, size: int = 128) -> np.ndarray:
        """For each try and bin, which bin to look at."""
        while len(self._tries) <= block:
            first = len(self._tries) * size
            cell = (np.arange(first, first + size, dtype=np.uint64)[:, None] << np.uint64(20)) + np.arange(self.bins, dtype=np.uint64)[None, :]
            self._tries.append((mix64(cell * _MULTIPLIER + np.uint64(1)) >> np.uint64(64 - int(math.log2(self.bins)))).astype(np.int64))
        return self._tries[block]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest of the sorted ``hashes`` in each bin; empty bins copy another's.  There must be one hash."""
        place = (hashes >> np.uint64(64 - int(math.log2(self.bins)))).astype(np.int64)
        first = np.concatenate(([True], place[1:] != place[:-1]))
        place = place[first]
        found = np.zeros(self.bins, np.uint64)
        found[place] = hashes[first]
        full = np.zeros(self.bins, bool)
        full[place] = True
        empty, block = np.flatnonzero(~full), 0
        if len(place) == 1:
            found[:], empty = found[place[0]], empty[:0]
        while len(empty):
            tries = self._bins_to_try(block)[:, empty]
            hit = full[tries]
            done = hit.any(axis=0)
            source = tries[hit.argmax(axis=0), np.arange(len(empty))]
            found[empty[done]] = found[source[done]]
            empty, block = empty[~done], block + 1
        return found

    def values(self, text: str | None) -> np.ndarray | None:
        """The value of each bin; None for a text without words."""
        hashes = np.sort(self.hashes(text))
        if not len(hashes):
            return None
        return (mix64(self.minima(hashes) + self.offsets) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, values: np.ndarray | None) -> str:
        """Hexadecimal digits of the bins' bits; empty for a text without words."""
        if values is None:
            return ""
        per = 8 // self.bits
        shifts = np.arange(per, dtype=np.uint8) * np.uint8(self.bits)
        return np.bitwise_or.reduce(values.reshape(-1, per) << shifts, axis=1).astype(np.uint8).tobytes().hex()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard similarity, 0 to 1; two texts without words are alike."""
        if a is None or b is None:
            return float(a is b)
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (float(np.count_nonzero(a == b)) / self.bins - chance) / (1 - chance)))


def _rank_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by two small searches."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    group = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(group, F.lit(1))), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def with_successors(docs: DataFrame, *, per_partition: int = 4) -> DataFrame:
    """Rows of ``doc_id, text`` in runs of ascending doc_id, each run followed by the row that comes after it.

    Columns ``run``, ``ahead`` (1 for that following row), ``key`` (doc_id, null lowest) and the two given ones; a
    run's rows lie in one partition in order, and the last run is followed by the first row of all.  Text is shuffled
    once; only one row for each run is repeated.
    """
    n = shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    parts = n * per_partition
    found = keyed.agg(F.min("key").alias("low"), F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()
    bounds = sorted({b for b in found["cuts"] or [] if b > found["low"]})
    runs = len(bounds) + 1
    placed = keyed.withColumn("run", _rank_of(F.col("key"), bounds))
    here = F.struct(F.col("run").cast("int").alias("run"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.pmod(F.col("run") - 1, F.lit(runs)).cast("int").alias("run"), F.lit(1).alias("ahead"))
    starts = [found["low"], *bounds] if found["low"] is not None else []
    both = F.when(F.col("key").isin(starts), F.array(here, ahead)).otherwise(F.array(here)) if starts else F.array(here)
    spread = placed.withColumn("at", F.explode(both)).select("at.run", "at.ahead", "key", "doc_id", "text")
    return spread.repartition(n, "run").sortWithinPartitions("run", "ahead", "key", "text")


def fingerprint_edits(docs: DataFrame, *, bins: int = 512, bits: int = 4, words: int = 5) -> DataFrame:
    """Fingerprints of each document and of its text with the second half replaced by the next document's beginning.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Gives ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``.  Null text is empty; a text without words has an empty
    fingerprint, which is like itself alone.  The next document is by ascending doc_id, null first, rows that share a
    doc_id in order of their text, and after the last comes the first.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = OnePermutation(bins, bits, words)
        waiting, current, over = None, None, False  # the document whose successor has not come yet; its run; followed already
        for batch in batches:
            rows = []
            for r, ahead, doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if r != current:
                    waiting, current, over = None, r, False
                if over:
                    continue
                text = text or ""
                values = minhash.values(text)
                if waiting is not None:
                    of, before, old = waiting
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    new = minhash.values(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((of, len(before), digest, minhash.packed(old), minhash.packed(new), minhash.likeness(old, new), minhash.likeness(old, values)))
                over = bool(ahead)
                waiting = (doc, text, values)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).mapInArrow(tidy(run), schema)
