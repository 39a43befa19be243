"""Exact top-k search by inner product: term-at-a-time accumulation over blocks.

Vectors are turned into whole numbers; a component that is zero is no term.  Queries, as sparse rows, are sent to all
tasks, as many at a time as a bounded number of bytes holds; candidates stay where they are read.  Each batch of
candidates becomes postings (row, weight) for each term: every term of a query scatters its weighted postings into a
dense array of scores, one place for each candidate of the batch; a partition selection keeps the best, the batches'
winners are merged in the task and the tasks' by a shuffle.  No array depends on how many candidates there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, tidy

def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, whole``: floor(scale * x) of each component; rows with a null or non-finite part or id are left out."""
    v = F.col(vector_col)
    finite = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floor = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), floor.alias("whole"))


class QueryBlock:
    """Sparse rows of some queries by term, and the best candidates that each has met so far."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], k: int, kind: type):
        self.row, self.query = (np.array([r[j] for r in rows], np.int64) for j in (0, 1))
        self.k, self.kind = k, kind
        sizes = [len(r[2]) for r in rows]
        q, weight = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[2] for r in rows])
        term = np.concatenate([np.arange(n) for n in sizes])
        kept = np.flatnonzero(weight)
        order = kept[np.argsort(term[kept], kind="stable")]
        self.terms = postings(term[order], q[order], weight[order].astype(kind), len(rows))
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64) for _ in rows]
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64) for _ in rows]
        self.least = np.full(len(rows), np.iinfo(np.int64).min)  # what a candidate needs to be among the best

    def meet(self, rows: np.ndarray, ids: np.ndarray, found: dict[int, tuple[np.ndarray | None, np.ndarray]]) -> None:
        """Scatters each term's weighted postings into one dense array of scores for each query, and keeps the best."""
        scores = np.zeros((len(self.query), len(ids)), self.kind)
        room = np.empty_like(scores)
        for term, (q, own) in self.terms.items():
            if term in found:
                at, weight = found[term]
                some = np.multiply(own[:, None], weight, out=room[: len(own), : len(weight)])
                if q is None and at is None:
                    scores += some
                elif at is None:
                    scores[q] += some
                else:
                    scores[np.ix_(np.arange(len(scores)) if q is None else q, at)] += some
        for q in np.flatnonzero(scores.max(axis=1) >= self.least).tolist():
            mine = scores[q]
            taking = np.flatnonzero((mine >= self.least[q]) & (rows != self.row[q]))
            if len(taking) > 4 * self.k:
                least = np.partition(mine[taking], len(taking) - self.k)[len(taking) - self.k]
                taking = taking[mine[taking] >= least]
            if len(taking):
                s, i = np.append(self.scores[q], mine[taking]), np.append(self.ids[q], ids[taking])
                best = np.lexsort((i, -s))[: self.k]
                self.scores[q], self.ids[q] = s[best], i[best]
                if len(best) == self.k:
                    self.least[q] = s[best[-1]]


def postings(term: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """For each term, in whose order the arrays are, the rows that have it and its weights.

    A term that a quarter of the ``n`` rows have gets a weight for all of them, zeros too, and None for the rows: adding
    in place is faster than scattering.
    """
    terms, first = np.unique(term, return_index=True)
    cuts, made = np.append(first, len(term)), {}
    for t, a, b in zip(terms.tolist(), cuts, cuts[1:]):
        if 4 * (b - a) < n:
            made[t] = row[a:b], weight[a:b]
        else:
            every = np.zeros(n, weight.dtype)
            every[row[a:b]] = weight[a:b]
            made[t] = None, every
    return made


def postings_of(whole: pa.ListArray, kind: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    ends = whole.offsets.to_numpy().astype(np.int64)
    values = whole.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sizes, ends = np.diff(ends), ends - ends[0]
    term = np.arange(len(values)) - np.repeat(ends[:-1], sizes)
    kept = np.flatnonzero(values)
    order = kept[np.argsort(term[kept], kind="stable")]
    return postings(term[order], np.repeat(np.arange(len(sizes)), sizes)[order], values[order].astype(kind), len(sizes))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, query_block: int = 32, block: int = 4096, together: int = 1 << 26) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of the highest inner product with each row of ``queries``.

    Both tables have ``vec_id`` and ``whole`` (arrays of whole numbers, missing components count as zero) and may have
    ``row``, which tells rows apart; a candidate of the query's own ``row`` is left out, or of its own vec_id where there
    is no ``row``.  Rank is from 1, ties go to the smaller vec_id; fewer candidates than ``k`` give all.  Every row of
    ``queries`` is a query, also those that share an id, and candidates that share one count each.  Other columns are
    ignored; either table empty gives an empty result.  Sums are exact below 2 ** 63.

    Candidates are read once, where they are, for each ``together`` bytes of queries, and are never shuffled; what is
    shuffled are ``k`` winners for each query and task.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    own = "row" if "row" in vectors.columns and "row" in queries.columns else "vec_id"
    columns = F.col(own).cast("long").alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("whole").cast("array<long>").alias("whole")
    amounts = F.transform("whole", F.abs)
    largest = vectors.agg(F.max(F.array_max(F.transform(F.col("whole").cast("array<long>"), F.abs)))).first()[0] or 0
    sums = F.sum(F.size("whole")).alias("components"), F.max(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)).alias("w")
    asked = scratch.write(queries.select(F.monotonically_increasing_id().alias("q"), *columns), "queries", *sums)
    count, components, heaviest = scratch.rows["queries"]
    kind = np.int32 if (heaviest or 0) * largest < 1 << 31 else np.int64
    parts = max(1, -(-8 * ((components or 0) + 2 * count) // together))
    winners = []
    for part in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(some.toArrow())  # of ``together`` bytes, by the sums above

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value
            lists = table.column(3).combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            ids = [table.column(j).to_numpy() for j in range(3)]
            rows = [(row, i, values[a:b]) for i, (row, a, b) in enumerate(zip(ids[1], ends, ends[1:]))]
            blocks = [QueryBlock(rows[i : i + query_block], k, kind) for i in range(0, len(rows), query_block)]
            for batch in batches:
                for at in range(0, batch.num_rows, block):  # small enough for a block of scores to stay in a core's cache
                    row, vec_id, whole = (c.slice(at, block) for c in batch.columns)
                    found = postings_of(whole, kind)
                    for some in blocks:
                        some.meet(row.to_numpy(), vec_id.to_numpy(), found)
            for some in blocks:
                at = np.repeat(some.query, [len(x) for x in some.ids])
                out = [pa.array(ids[j][at], pa.int64()) for j in (0, 2)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(some.ids)), pa.array(np.concatenate(some.scores).astype(np.int64))], names=["q", "query_id", "vec_id", "score"])

        found = vectors.select(*columns).mapInArrow(tidy(search), "q long, query_id long, vec_id long, score long")
        winners.append(found if parts == 1 else scratch.write(found, "winners"))
    scratch.drop("queries")  # all of them were sent
    place: Column = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    ranked = reduce(DataFrame.union, winners).select("query_id", place.cast("int").alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
