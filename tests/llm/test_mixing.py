import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.mixing import mix_sources, source_targets, word_count

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Water-filling, one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share >= cap * sizes[s]] if share else []
        if not over:
            return fixed | {s: left * weight[s] / share for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 3, "d": 90, None: 40}, {"a": 2, "b": 1, None: 1000}, {"a": 5}, {"a": 0, "b": 9}])
def test_targets_are_reshared_until_none_is_above(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def corpus(spark, n=600):
    rows = [(i, "w " * (1 + i * i % 97), ("b", "a", None, "c")[min(3, i % 11 // 2)]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_each_source_comes_near_its_target(spark):
    df = corpus(spark)
    mixed = mix_sources(df)
    rows = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most"), F.max("size").alias("size")).collect()
    for r in rows:
        assert abs(r.taken - r.target) <= r["size"] and abs(r.taken - r.target) < 0.02 * r.target and r.most <= 3
    again = mix_sources(df.repartition(7))
    assert sorted(map(repr, mixed.drop("text").collect())) == sorted(map(repr, again.drop("text").collect()))


def test_targets_are_met_with_null_and_repeated_ids(spark):
    """A third of the rows has no id, a third one id, and many are the same in text too."""
    rows = [((None, 7, i)[i % 3], "w " * (1 + i % 5), "ab"[i % 7 > 2]) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mix_sources(df)
    assert mixed.count() == len(rows)
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.002 * r.target
    of_kind = lambda m: m.groupBy("doc_id", "source", "text", "copies").count()
    again = mix_sources(df.repartition(7))
    assert sorted(map(repr, of_kind(mixed).collect())) == sorted(map(repr, of_kind(again).collect()))
    # of neither kind of id all rows go the same way
    kinds = mixed.where("doc_id IS NULL OR doc_id = 7").groupBy("doc_id", "source").agg(F.count_distinct("copies").alias("n")).collect()
    assert len(kinds) == 4 and all(r.n == 2 for r in kinds)


def test_certain_copies_and_the_rest(spark):
    rows = mix_sources(corpus(spark)).where("size > 0").collect()
    for r in rows:
        whole = int(r.target // r.source_size)
        assert r.copies in (whole, whole + 1) and r.taken == r.copies * r["size"]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x", "b"), (4, "z z z", "b"), (4, "z z z", "b"), (5, "q " * 50_000, "c")]
    df = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", size int").withColumn("target", F.lit("other"))
    mixed = mix_sources(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = mixed.collect()
    assert len(got) == len(rows) and [r.taken for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert len({r.copies for r in got if r.doc_id == 4}) == 1
    assert mix_sources(df.limit(0)).collect() == []


def test_words_are_runs_without_ascii_white_space(spark):
    df = spark.createDataFrame([("a\tb\x0bc d  e\n",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [4, 0, 0]


@pytest.mark.parametrize("name", ["op7_top_k", "op8_mix_sources"])
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    tidy = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert tidy(got) == tidy(found.fetchall())


def test_plan_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op8_mix_sources"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
