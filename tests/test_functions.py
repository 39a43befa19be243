import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def got(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_keys(spark):
    df = column(spark, ["k-108r", "HERV-K 10", "ERV", "é", None])
    assert got(df, text.normalize_key(F.col("x"))) == ["K108R", "HERVK10", "ERV", "", None]
    assert got(df, text.collapse_key(F.col("x"))) == ["K108R", "K10", "", "", None]


def test_packed_tokens(spark):
    df = column(spark, ["K108R, ERVK-6", "a,,a", "x"])
    assert got(df, text.packed_tokens(F.col("x"))) == [["K108R, ERVK-6", "K108R", "ERVK-6"], ["a,,a", "a"], ["x"]]


def test_djb2_follows_its_definition(spark):
    values = ["", "HERVL0000001", "añ中😀", "x" * 300]

    def djb2(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % (1 << 32)
        return h

    df = column(spark, values)
    assert got(df, hashing.djb2(F.col("x"))) == [djb2(v) for v in values]
    assert got(df, hashing.bucket(F.col("x"), 400)) == [djb2(v) % 400 for v in values]


def test_annotation_fields(spark):
    df = column(spark, ["LTR/ERV1", "Simple_repeat", "a/b/c"])
    assert got(df, text.class_of(F.col("x"))) == ["LTR", "Simple_repeat", "a"]
    assert got(df, text.family_of(F.col("x"))) == ["ERV1", "Simple_repeat", "b/c"]
    attributes = column(spark, ['ref_gene_id "R"; gene_id "G";', 'gene_id "";', "gene_id G"])
    assert got(attributes, text.quoted_attribute(F.col("x"), "gene_id")) == ["G", None, None]
    lists = column(spark, ["1,2,3,", "", None, " 4 , 5"])
    assert got(lists, text.integer_list(F.col("x"))) == [[1, 2, 3], [], [], [4, 5]]


@pytest.mark.parametrize(
    ("value", "good"), [('{"a":NaN}', False), ('{"a":Infinity}', False), ('{"a":', False), ('{"a":null}', True), ("[1,2]", True), ("", False), (None, False)]
)
def test_strict_json_check(spark, value, good):
    assert got(column(spark, [value]), text.is_strict_json(F.col("x"))) == [good]


def test_strict_json_text_has_no_nan_and_keeps_nulls(spark):
    df = spark.createDataFrame([((float("nan"), [1.5, float("inf")], None),)], "d struct<a: double, b: array<double>, c: string>")
    made = df.select(text.strict_json(F.col("d"), df.schema["d"].dataType)).first()[0]
    assert json.loads(made, parse_constant=pytest.fail) == {"a": None, "b": [1.5, None], "c": None}


def test_position_is_1_based_and_clamped(spark):
    df = spark.createDataFrame([("chr1", 99, 200)], "c string, s long, e long")
    assert df.select(text.position_1based(F.col("c"), F.col("s"), F.col("e"))).first()[0] == "chr1:100-200"
    assert df.select(text.position_1based(F.col("c"), F.col("s"), F.col("e"), 1000)).first()[0] == "chr1:1-1200"
