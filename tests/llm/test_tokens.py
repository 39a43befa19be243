import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.tokenfile import read_tokens, write_tokens
from tessera.llm.tokens import RunEncoder, text_groups, tokenizer_path

ODD = ["", None, "á ́b", "x\x1cy \x85z", "Σας ΣΑΣ", "<|endoftext|> it's'S 12　　中文①", "가\n\t\r end", "İ ß", "word " * 3000, "x" * 5000, "a b"]


@pytest.fixture(scope="module")
def tool():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def direct(tool, text, end):
    return np.array([*tool.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_runs_give_the_ids_of_whole_texts(tool):
    for limit in (5, 100_000):
        mine = RunEncoder(tokenizer_path(), limit=limit)
        for _ in range(2):
            assert mine.encode_many(ODD) == [direct(tool, t, 0)[:-1].tobytes() for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aZéÉßİıŉſÀ'stred1²½.,!-~×ª\xa0\xad\x85\x1c \t\x0b\u0301", max_size=30)), max_size=5))
def test_any_texts(tool, texts):
    assert RunEncoder(tokenizer_path()).encode_many(texts) == [direct(tool, t, 0)[:-1].tobytes() for t in texts]


def test_every_plain_character(tool):
    texts = [f"a{chr(c)}B{chr(c)}{chr(c)}1{chr(c)} {chr(c)}x" for c in range(1, 0x600)]
    assert RunEncoder(tokenizer_path()).encode_many(texts) == [direct(tool, t, 0)[:-1].tobytes() for t in texts]


def test_groups_cover_all_texts():
    assert list(text_groups(["aa", None, "b" * 9, "c"], chars=3)) == [(0, 3), (3, 4)]
    assert list(text_groups([])) == []


def test_round_trip(spark, tool, tmp_path):
    rows = [(i * 7 % 50, t) for i, t in enumerate(ODD)] + [(None, "n"), (3, "twin"), (3, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    path = f"file://{tmp_path}/t"
    write_tokens(df.selectExpr("*", "1 AS start", "2 AS n_tokens"), path, block_bytes=200)
    start = 0
    got = read_tokens(spark, path, arrays=True).orderBy("start").collect()
    for (doc, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), got, strict=True):
        ids = direct(tool, text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    some = read_tokens(spark, path, [3, 7], arrays=True).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 7]
    assert {(r.start, tuple(r.ids)) for r in some} <= {(r.start, tuple(r.ids)) for r in got}


def test_files_of_another_dictionary_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i} again and again") for i in range(300)], "doc_id long, text string")
    for name, size in (("a", 400), ("b", 800)):
        write_tokens(df, f"file://{tmp_path}/{name}", size=size)
    one, other = (spark.read.parquet(f"file://{tmp_path}/{n}/dictionary").first().dict_hash for n in "ab")
    assert one != other
    (tmp_path / "a/dictionary").rename(tmp_path / "old")
    (tmp_path / "b/dictionary").rename(tmp_path / "a/dictionary")
    with pytest.raises(Exception, match="written with dictionary"):
        read_tokens(spark, f"file://{tmp_path}/a").collect()


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e")
    assert read_tokens(spark, f"file://{tmp_path}/e").collect() == []


def test_query(spark, sf_dir, tool):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op4_token_files(spark, sf_dir).orderBy("doc_id").collect()
    start = 0
    assert [r.doc_id for r in got] == sorted(docs)
    for r in got:
        ids = direct(tool, docs[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
