import random

from pyspark.sql import functions as F

from tessera.operators import aliases, documents, numbering


def test_places_are_those_of_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i) for i in range(1000)]
    got = numbering.numbered(spark.createDataFrame(rows, "l string, v long").repartition(5), ["l", "v"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.l, r.v) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1000))
    assert numbering.numbered(spark.range(0), ["id"]).collect() == []


def test_a_list_of_a_third_of_all_rows_is_spread(spark, tmp_path):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 40).cast("string"))).alias("l"), (F.col("id") * 7919 % 30_011).alias("v"))
    made = documents.pages(df, "l", ["v"])
    hot = made.where("l = 'hot'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    numbering.placed(df, ["l"], ["v"], str(tmp_path / "n"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "n")).where("l = 'hot'").select(F.input_file_name()).distinct().count() > 1
    assert {(r.page, r["count"]) for r in hot.groupBy("page").count().collect()} == {(p, 100) for p in range(100)}
    assert hot.where("page = 99").select("shown").distinct().collect()[0].shown == "9901-10000 of 10000"
    first = sorted(r.v for r in df.where("l = 'hot'").collect())[:100]
    assert sorted(r.v for r in hot.where("page = 0").collect()) == first
    assert "windowspecdefinition(l" not in made._jdf.queryExecution().toString()


def test_class_blocks_are_bounded(spark):
    rows = [(f"u{i:05d}", "big" if i % 3 else f"s{i % 7}", "dfam_accession") for i in range(500)] * 2 + [("u1", None, "dfam_accession"), ("u1", "x", "combined_id")]
    df = spark.createDataFrame(rows, "uid string, alias string, alias_type string")
    blocks = aliases.class_blocks(df, most=30).collect()
    assert max(len(b.uids) for b in blocks) == 30 and all((b.first_uid, b.last_uid, b.n_uids) == (b.uids[0], b.uids[-1], len(b.uids)) for b in blocks)
    big = [b for b in blocks if b.value == "big"]
    assert [u for b in sorted(big, key=lambda b: b.block) for u in b.uids] == sorted({u for u, v, _ in rows if v == "big"})
    directory = aliases.class_directory(df)
    assert {r.value: r.n_uids for r in directory.collect()}["big"] == sum(len(b.uids) for b in big)
    plan = aliases.classifier_menu(directory, "s")._jdf.queryExecution().toString()
    assert "collect_" not in plan


def test_pairs_of_one_string_are_shared_by_tasks(spark):
    rows = [(f"u{i}", "hot" if i % 4 else f"s{i % 8}", "combined_id", "r2" if i % 3 else "r1", 1) for i in range(120)] + [("n", None, "combined_id", "r2", 1), ("o", "hot", "hervd_id", "r2", 1)]
    found = aliases.misrouted(spark.createDataFrame(rows, "uid string, alias string, alias_type string, assignment string, is_current int"))
    named = [r for r in rows if r[2] == "combined_id" and r[1]]
    want = sorted((a[1], a[0], b[0], a[3]) for a in named for b in named if a[1] == b[1] and a[0] != b[0] and b[3] == "r2")
    assert sorted(tuple(r) for r in found.collect()) == want
    tasks = found.where("alias = 'hot'").groupBy(F.spark_partition_id()).count().count()
    assert tasks > 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
