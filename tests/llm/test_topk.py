import math
import random

from tessera.llm.topk import top_k, whole_vectors


def brute(vectors, queries, k=5):
    out = []
    for q, a in queries.items():
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in vectors if c != q))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_blocks_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0, 0, rng.randrange(-9, 9)]) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, whole array<long>")
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0"), query_block=3).collect()))
    assert got == brute(rows, {i: v for i, v in rows if i % 50 == 0})


def test_fewer_candidates_give_all(spark):
    rows = [(1, [1, 2]), (2, [3]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, whole array<long>")
    assert sorted(map(tuple, top_k(df, df).collect())) == [(1, 1, 2, 3), (1, 2, 3, 0), (2, 1, 1, 3), (2, 2, 3, 0), (3, 1, 1, 0), (3, 2, 2, 0)]
    assert top_k(df.limit(0), df).collect() == [] and top_k(df, df.limit(0)).collect() == []


def test_rows_that_share_an_id(spark):
    """Each row is a query of its own, whose candidates are all rows but itself."""
    rows = [(1, [1], 0), (1, [2], 1), (2, [5], 2), (2, [5], 3), (3, [4], 4)]
    df = spark.createDataFrame(rows, "vec_id long, whole array<long>, row long")
    want = [(1, 1, 2, 5), (1, 2, 2, 5), (1, 3, 3, 4), (1, 4, 1, 2)] + [(1, 1, 2, 10), (1, 2, 2, 10), (1, 3, 3, 8), (1, 4, 1, 2)]
    assert sorted(map(tuple, top_k(df, df.where("vec_id = 1")).collect())) == sorted(want)
    alone = df.drop("row")
    assert sorted(map(tuple, top_k(alone, alone.where("vec_id = 3")).collect())) == [(3, 1, 2, 20), (3, 2, 2, 20), (3, 3, 1, 8), (3, 4, 1, 4)]


def test_queries_in_parts_and_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-(1 << 28), 1 << 28) for _ in range(4)] if i % 3 else [7, 0, 0, 7]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, whole array<long>")
    want = brute(rows, {i: v for i, v in rows if i % 50 == 0})
    for together in (1 << 26, 100):
        assert sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0"), together=together).collect())) == want


def test_what_is_shuffled_follows_the_queries(spark):
    """A candidate's components go to no shuffle: only winners do."""
    df = spark.createDataFrame([(i, [i % 7, 1]) for i in range(1000)], "vec_id long, whole array<long>")
    plan = top_k(df, df.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_only_whole_finite_vectors_take_part(spark):
    rows = [(1, [0.1, -0.1]), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, None), (None, [1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'z' AS whole")
    assert sorted((r.vec_id, r.whole) for r in whole_vectors(df).collect()) == [(1, [25, -26]), (6, [])]
