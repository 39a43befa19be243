import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents, quality
from tessera.plans.fixtures import view
from tessera.sources import files


@pytest.fixture(scope="module")
def bundle(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bundle"))
    e, c = view(spark, sf_dir, "fx_entity"), view(spark, sf_dir, "fx_coord")
    children = {"coords": documents.nested(c.withColumn("score", F.lit(float("nan"))), "coords", ["assembly", "chrom", "start0", "end0", "score"])}
    docs = documents.assemble(e.select("uid", "grp", "band"), children)
    files.write_bundle(docs, path, 16)
    return path, docs


def test_bundle_reads_back(spark, bundle):
    path, docs = bundle
    again = files.read_bundle(spark, path, docs.schema)
    assert again.where("_corrupt IS NOT NULL").collect() == []
    flat = lambda df: df.select("uid", "grp", "band", F.to_json(F.transform("coords", lambda c: c.dropFields("score"))).alias("c"))
    assert flat(again).exceptAll(flat(docs)).isEmpty() and flat(docs).exceptAll(flat(again)).isEmpty()
    lines = spark.read.text(f"{path}/{files.manifest_of(spark, path)['version']}", recursiveFileLookup=True)
    assert quality.not_strict_json(lines, "value").isEmpty()
    line = json.loads(lines.where(F.contains("value", F.lit("chr"))).first()[0])
    assert line["coords"][0]["score"] is None


def test_lookups_read_their_buckets(spark, bundle):
    path, docs = bundle
    uid = docs.first().uid
    assert files.lookup(spark, path, docs.schema, uid).first().uid == uid
    asked = spark.createDataFrame([(uid,), ("HERVX",), (None,), (uid,)], "uid string")
    made = files.lookups(asked, path, docs.schema)
    assert sorted((r.uid, r.found) for r in made.collect()) == sorted([(uid, True), ("HERVX", False)])
    assert "dynamicpruning" in made._jdf.queryExecution().executedPlan().toString().lower()
    at = made.where("NOT found").first().bucket
    with pytest.raises(KeyError, match=f"HERVX is not in bucket {at}"):
        files.lookup(spark, path, docs.schema, "HERVX")


def test_a_reader_sees_one_version(spark, tmp_path):
    path, docs = str(tmp_path / "b"), lambda n: spark.range(n).selectExpr("concat('u', id) AS uid", f"{n} AS v")
    uids = lambda df: {(r.uid, r.v) for r in df.collect()}
    files.write_bundle(docs(5), path, 4)
    begun = files.read_bundle(spark, path, docs(1).schema)
    files.write_bundle(docs(2), path, 8)
    assert uids(begun) == {(f"u{i}", 5) for i in range(5)} and files.manifest_of(spark, path)["n_buckets"] == 8
    assert uids(files.read_bundle(spark, path, docs(1).schema)) == {("u0", 2), ("u1", 2)}
    files.append_documents(files.in_buckets(docs(9), 4), f"{path}/v-99999999999999999999-half")  # a write that was never finished
    assert uids(files.read_bundle(spark, path, docs(1).schema)) == {("u0", 2), ("u1", 2)}
    files.write_bundle(docs(1), path, 4)
    files.write_bundle(docs(3), path, 4)
    assert len(list((tmp_path / "b").glob("v-*"))) == 3  # the last two and the unfinished one


def test_faults_of_a_written_bundle(spark, tmp_path):
    path, docs = str(tmp_path / "b"), spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "uid string, v int")
    folder = files.write_bundle(docs.where("uid <> 'b'"), path, 4)
    right = {r.uid: r.bucket for r in files.in_buckets(docs, 4).collect()}
    files.append_documents(files.in_buckets(docs.where("uid = 'a'"), 4).withColumn("bucket", (F.col("bucket") + 1) % 4), folder)
    spark.createDataFrame([('{"uid":"c","v":NaN}', 2), ("[]", 3)], "value string, bucket int").write.mode("append").partitionBy("bucket").text(folder)
    refs = spark.createDataFrame([("name", "a"), ("name", "b"), ("name", "b"), ("name", "c"), ("other", "zz")], "kind string, uid string")
    got = {(r.reason, r.kind, r.uid, r.detail) for r in quality.bundle_faults(files.read_bundle(spark, path, docs.schema), refs, 4).collect()}
    assert {g for g in got if g[0] != "corrupt"} == {("placed", None, "a", f"belongs in {right['a']}"), ("repeated", None, "a", "2"), ("missing", "name", "b", "2 names"), ("missing", "other", "zz", "1 names")}
    assert ("corrupt", None, None, '{"uid":"c","v":NaN}') in got


def test_an_empty_table_is_a_fault(spark):
    df = spark.createDataFrame([("x",), (None,)], "assembly string")
    assert {tuple(r) for r in quality.outside(df, ["hg38"], "assembly").collect()} == {("x", "unexpected"), (None, "unexpected")}
    assert [tuple(r) for r in quality.outside(df.where("false"), ["hg38"], "assembly").collect()] == [(None, "empty")]


def test_a_lost_document_is_found_missing(spark, bundle):
    path, docs = bundle
    gone = docs.first().uid
    there = files.read_bundle(spark, path, docs.schema).where(F.col("uid") != gone)
    refs = docs.select("uid", F.lit("combined_id").alias("alias_type"))
    misses = quality.dangling(refs, there, ["uid"])
    assert [tuple(r) for r in quality.examples(misses, "alias_type", "uid").collect()] == [("combined_id", 1, gone)]
    assert not quality.count_check(docs, there).first().ok


def test_children_do_not_multiply_rows(spark):
    e = spark.createDataFrame([("a",), ("b",)], "uid string")
    child = spark.createDataFrame([("a", 2), ("a", 1)], "uid string, v int")
    made = documents.assemble(e, {"x": documents.nested(child, "x", ["v"]), "y": documents.nested(child, "y", ["v"])})
    rows = {r.uid: r for r in made.collect()}
    assert [x.v for x in rows["a"].x] == [1, 2] and rows["b"].x is None and len(rows) == 2
    assert made.select(documents.only_child(F.col("x"))["v"]).where("uid = 'b'").first()[0] is None


def test_columns_that_are_empty_everywhere_go(spark):
    df = spark.createDataFrame([("a", None, "", 0), ("b", None, "", None)], "uid string, x int, y string, z int")
    assert documents.drop_empty_columns(df).columns == ["uid", "z"]
    assert documents.drop_empty_columns(df, keep=("y",)).columns == ["uid", "y", "z"]
    assert documents.project(df, ["z", "none", "uid", "y"], drop=("y",)).columns == ["z", "uid"]


def test_pages_are_clamped(spark):
    df = spark.range(250).withColumnRenamed("id", "v")
    assert [r.v for r in documents.page_of(df, ["v"], 9).collect()] == list(range(200, 250))
    assert documents.page_of(df, ["v"], -1).count() == 100
    listed = documents.pages(df.withColumn("l", F.lit(1)), "l", ["v"])
    assert {(r.page, r.n_pages, r.shown) for r in listed.collect()} == {(0, 3, "1-100 of 250"), (1, 3, "101-200 of 250"), (2, 3, "201-250 of 250")}


def test_preferred_coordinate_falls_back(spark):
    df = spark.createDataFrame([("a", "t2t", "c", 1, 2), ("a", "hg38", "c", 5, 6), ("b", "t2t", "c", 3, 4), ("d", "x", "c", 1, 2)], "uid string, assembly string, chrom string, start0 long, end0 long")
    assert {r.uid: (r.assembly, r.start0) for r in documents.preferred_coordinate(df).collect()} == {"a": ("hg38", 5), "b": ("t2t", 3)}


def test_agreement_counts_entities_without_names_apart(spark):
    want = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", None), ("d", "z")], "uid string, name string")
    have = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "q")], "uid string, name string")
    r = quality.agreement(want, have).first()
    assert (r.n_entities, r.n_unnamed, r.n_all, r.n_some, r.n_none, r.ok) == (3, 1, 1, 1, 1, False)
    assert sorted(map(tuple, quality.drifted(want, have).collect())) == [("a", "y"), ("d", "z")]


def test_catalog_and_materialised_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "hg38", "c", 1, 2)], "locus_uid string, assembly string, chrom string, start bigint, end bigint")
    rows.write.parquet(str(tmp_path / "c"))
    df = files.read_catalog(spark, str(tmp_path / "c"), "locus_coord", ["locus_uid", "assembly", "chrom", "start", "end"], F.col("assembly") == "hg38")
    assert df.columns == ["uid", "assembly", "chrom", "start0", "end0"] and df.count() == 1
    with pytest.raises(ValueError, match="t2t"):
        files.for_assembly(df, "t2t")
    once = files.materialise(df, str(tmp_path / "m"))
    assert files.materialise(df.where("1 = 0"), str(tmp_path / "m")).count() == once.count() == 1
    files.write_gene_models(df, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("assembly = 'hg38'").count() == 1


def test_whole_documents_take_one_shuffle(spark):
    e = spark.createDataFrame([("a", 1), ("b", None)], "uid string, v int")
    x = spark.createDataFrame([("a", 2, "p"), ("a", None, "q"), ("lost", 1, "r")], "uid string, n int, s string")
    y = spark.createDataFrame([("b", 1.5), ("b", 0.5)], "uid string, d double")
    made = documents.whole_documents(e, {"x": x, "y": y, "z": y.where("d > 9")})
    rows = {r.uid: r for r in made.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].v == 1 and rows["b"].v is None
    assert [tuple(r) for r in rows["a"].x] == [(None, "q"), (2, "p")] and rows["a"].y is None and rows["a"].z is None
    assert [r.d for r in rows["b"].y] == [0.5, 1.5] and rows["b"].x is None
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_database_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:ranges;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id AS k", "id % 7 AS v").write.format("jdbc").options(url=url, dbtable="t", **options).save()
    df = files.read_catalog_jdbc(spark, url, "t", key="k", partitions=5, **options)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 100
    some = df.where("v = 3").select("k")
    assert sorted(r.k for r in some.collect()) == list(range(3, 100, 7))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(v), *EqualTo(v,3)]" in plan and "ReadSchema: struct<k:bigint>" in plan
    spark.range(0).selectExpr("id AS k").write.format("jdbc").options(url=url, dbtable="nothing", **options).save()
    assert files.read_catalog_jdbc(spark, url, "nothing", key="k", **options).count() == 0
