import random
import statistics

import pytest

from tessera.operators import annotation, quality


@pytest.mark.parametrize("n", [1, 2, 501, 502])
def test_median_is_exact(spark, n):
    rng = random.Random(n)
    rows = [(g, int(rng.choice([-1, 1]) * 2 ** (rng.random() * 40))) for g in ("x", None) for _ in range(n)] + [("y", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    want = {g: statistics.median(v for h, v in rows if h == g) for g in ("x", None)}
    assert {r.g: r.median for r in quality.median(df, "v", ("g",)).collect()} == pytest.approx(want)
    assert quality.median(df.where("g = 'x'"), "v").first().median == pytest.approx(want["x"])
    assert quality.median(df.where("g = 'y'"), "v").collect() == []


def test_median_of_one_hot_value_and_of_large_ones(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 4000000000000000001 END AS v")
    assert quality.median(df, "v").first().median == 4e18
    plan = quality.median(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


def test_unsure_classes_are_interspersed(spark):
    names = ["LTR?", "DNA?", "SINE?", "LINE?", "RC", "LINE", "Simple_repeat", "Unknown", None]
    df = spark.createDataFrame([(n,) for n in names], "rep_class string")
    assert sorted(r.rep_class for r in annotation.of_classes(df).collect()) == ["DNA?", "LINE", "LINE?", "LTR?", "RC", "SINE?"]
    assert annotation.of_classes(df, None).count() == len(names)
