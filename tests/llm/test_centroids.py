import hashlib
import math

import numpy as np
import pytest

from tessera.llm.centroids import LARGEST, cluster_vectors, grid_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster int"


def plain(rows, k, rounds, salt):
    """The rounds one vector after another; ``rows`` are (vec_id, whole)."""
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(w) for _, w in start[:k]]

    def near(w):
        return min((sum((x - y) ** 2 for x, y in zip(w, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        at = [near(w)[1] for _, w in rows]
        for i in range(len(centres)):
            mine = [w for (_, w), a in zip(rows, at) if a == i]
            if mine:
                centres[i] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(v, *reversed(near(w))) for v, w in rows]
    own = {i: sum(d for _, c, d in found if c == i) for i in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(v, c, d, own[c], sum(own.values()), digest[c]) for v, c, d in found]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_equals_the_plain_rounds(spark):
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], 7) for i in range(60)]
    made += [(5, made[5][1], 7), (None, made[0][1], 1), (100, made[9][1], 1), (101, made[9][1], 1)]  # repeated ids, a null id, ties
    odd = [(70, None, 1), (71, [], 1), (72, made[0][1][:5], 1), (73, [1.0] * 5 + [float("nan")], 1), (74, [1.0] * 5 + [float("-inf")], 1), (75, [1.0] * 5 + [None], 1)]
    df = spark.createDataFrame(made + odd, SCHEMA)
    kept = grid_vectors(df, size=6)
    rows = [(r.vec_id, list(r.whole)) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([(v, [math.floor(256 * x) for x in e]) for v, e, _ in made], key=str)
    for k, rounds in ((5, 4), (3, 0), (100, 2)):
        got = [tuple(r) for r in cluster_vectors(kept, k=k, rounds=rounds, size=6).collect()]
        assert order(got) == order(plain(rows, k, rounds, "2:"))


def test_means_go_down_below_zero(spark):
    df = spark.createDataFrame([(1, [-1]), (2, [-2]), (3, [-2])], "vec_id long, whole array<long>")
    got = cluster_vectors(df, k=1, rounds=1, size=1).collect()
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(b"-2").hexdigest()} and got[0].inertia == 1


def test_no_vectors_and_very_long_ones(spark):
    empty = cluster_vectors(grid_vectors(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == [] and [c for c, _ in empty.dtypes] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = grid_vectors(spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 0)], SCHEMA), size=2)
    assert {r.vec_id: list(r.whole) for r in huge.collect()}[1] == [LARGEST, -LARGEST]
    assert {r.vec_id: r.distance for r in cluster_vectors(huge, k=2, size=2).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("name", ["PythonUDF", "MapInArrow", "MapInPandas"])
def test_it_stays_in_the_jvm(spark, name):
    df = spark.createDataFrame([(i, [i, -i]) for i in range(9)], "vec_id long, whole array<long>")
    assert name not in cluster_vectors(df, k=2, size=2)._jdf.queryExecution().toString()
