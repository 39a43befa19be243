import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import annotation, intervals

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SPAN = st.tuples(st.sampled_from("ab"), st.integers(0, 300), st.integers(0, 120)).map(lambda t: (t[0], t[1], t[1] + t[2]))


def joined(spark, features, wins, **options):
    a = spark.createDataFrame([(i, *f) for i, f in enumerate(features)], "f int, chrom string, start0 long, end0 long")
    b = spark.createDataFrame([(i, *w) for i, w in enumerate(wins)], "w int, chrom string, w0 long, w1 long")
    return sorted((r.f, r.w) for r in intervals.interval_join(a, b, **options).collect())


def naive(features, wins, inclusive):
    met = lambda s, w1: s <= w1 if inclusive else s < w1
    return sorted((i, j) for i, (c, s, e) in enumerate(features) for j, (d, w0, w1) in enumerate(wins) if c == d and met(s, w1) and e > w0)


@SLOW
@given(st.lists(SPAN, min_size=1, max_size=25), st.lists(SPAN, min_size=1, max_size=15), st.sampled_from([1, 7, 50, 1000]), st.booleans())
def test_binned_join_equals_the_naive_one(spark, features, wins, width, inclusive):
    assert joined(spark, features, wins, width=width, right_inclusive=inclusive) == naive(features, wins, inclusive)


def test_long_intervals_are_joined_once(spark):
    rng = random.Random(5)
    features = [("a", s, s + rng.choice([3, 40, 5000])) for s in (rng.randrange(9000) for _ in range(60))]
    wins = [("a", s, s + rng.choice([5, 70, 8000])) for s in (rng.randrange(9000) for _ in range(40))]
    assert joined(spark, features, wins, width=10) == naive(features, wins, False)


@pytest.mark.parametrize(("start", "end", "kept"), [(3000, 3100, True), (3001, 3100, False), (900, 1000, False), (900, 1001, True)])
def test_transcript_edges(spark, start, end, kept):
    tx = spark.createDataFrame([("T", "G", "c", start, end, "+", [start], [end])], "name string, name2 string, chrom string, txStart long, txEnd long, strand string, exonStarts array<long>, exonEnds array<long>")
    wins = spark.createDataFrame([("u", "c", 1000, 3000)], "uid string, chrom string, w0 long, w1 long")
    placed = annotation.transcripts_in_windows(tx, wins)
    assert (placed.count() == 1) is kept
    assert (annotation.gene_models(placed).count() == 1) is (kept and start < 3000)


def test_union_merges_touching_intervals(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 25, 30), ("c", 26, 27), ("c", 31, 40)], "chrom string, start0 long, end0 long")
    want = [(0, 20, 2), (25, 30, 2), (31, 40, 1)]
    for made in (intervals.merge_intervals(df, ["chrom"]), intervals.merge_dense_intervals(df, width=7)):
        assert sorted((r.start0, r.end0, r.n) for r in made.collect()) == want
    once = intervals.merge_intervals(df, ["chrom"]).drop("n")
    assert sorted(map(tuple, intervals.merge_intervals(once, ["chrom"]).drop("n").collect())) == sorted(map(tuple, once.collect()))


def test_windows_are_clipped_and_tiles_cover_them(spark):
    df = intervals.windows(spark.createDataFrame([("c", 500, 4_000_100)], "chrom string, start0 long, end0 long"))
    assert df.select("w0", "w1").first() == (0, 4_001_100)
    assert sorted(r.tile for r in intervals.tile_cover(df).collect()) == [0, 1, 2]


def test_windows_that_are_covered_are_those_with_a_pair(spark):
    rng = random.Random(5)
    made = lambda n, most: [(i, "ab"[i % 2], s := rng.randrange(30_000), s + 1 + rng.randrange(most)) for i in range(n)]
    features = spark.createDataFrame([(*r, "xyz"[r[0] % 3]) for r in made(150, 900)], "f int, chrom string, start0 long, end0 long, name string")
    wins = spark.createDataFrame(made(200, 90), "uid int, chrom string, w0 long, w1 long")
    for inclusive in (False, True):
        pairs = intervals.interval_join(features, wins, right_inclusive=inclusive)
        assert sorted(intervals.covered(features, wins, right_inclusive=inclusive).collect()) == sorted(pairs.select("uid").distinct().collect())
        named = intervals.covered(features, wins, ("name",), right_inclusive=inclusive)
        assert sorted(named.collect()) == sorted(pairs.select("uid", "name").distinct().collect())


def test_running_end_by_bins(spark):
    rng = random.Random(6)
    rows = [("ab"[i % 2], s := rng.randrange(5000), s + rng.randrange(1, 3000)) for i in range(300)]
    got = intervals.running_end(spark.createDataFrame(rows, "chrom string, w0 long, w1 long"), "chrom", width=100).collect()
    for r in got:
        assert r.reach == max(w1 for c, w0, w1 in rows if c == r.chrom and (w0, w1) <= (r.w0, r.w1))


def test_dense_union_carries_over_bins(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), s := rng.randrange(4000), s + rng.choice([1, 5, 30, 900])) for _ in range(300)] + [("a", 10, 3999), ("c", 0, 1), ("c", 1, 2)]
    df = spark.createDataFrame(rows, "chrom string, start0 long, end0 long")
    made = intervals.merge_dense_intervals(df, width=64)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, intervals.merge_intervals(df, ["chrom"]).collect()))
    windows = [x for x in made._jdf.queryExecution().analyzed().toString().splitlines() if "windowspecdefinition(chrom" in x]
    assert windows and all("_bin" in x for x in windows)  # by chromosome only over bins, of which there is one row each


@pytest.mark.parametrize("long", [False, True])
def test_short_features_are_dealt_out_once_unless_a_window_is_long(spark, long):
    features = spark.createDataFrame([(i, "a", 10 * i, 10 * i + 3) for i in range(200)], "f int, chrom string, start0 long, end0 long")
    wins = spark.createDataFrame([(1, "a", 0, 90), (2, "a", 500, 520)] + ([(3, "a", 0, 1999)] if long else []), "w int, chrom string, w0 long, w1 long")
    made = intervals.interval_join(features, wins, width=10)
    assert made.count() == 9 + 2 + (200 if long else 0)
    generated = made._jdf.queryExecution()
    made.collect()
    assert "scalar-subquery" in generated.optimizedPlan().toString()
