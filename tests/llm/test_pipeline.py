import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tessera.llm.common import written
from test_nearcopies import plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        out[name] = (before, docs)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "deduplicate", "mix", "pack"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])


def test_filters_keep_clean_documents(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    before, after = stages["language"]
    assert after.count() >= 0.99 * before.count()
    before, after = stages["quality"]
    known = before.join(labels, "doc_id")
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    good = [r.doc_id for r in known.where("quality = 1").collect()]
    bad = [r.doc_id for r in known.where("quality = 0").collect()]
    assert sum(d in kept for d in good) >= 0.99 * len(good) and sum(d in kept for d in bad) <= 0.15 * len(bad)


def test_one_of_each_group_stays(stages):
    """Groups are those of the contract for stages: five-word shingles, Jaccard 0.8 (and not the query's four bits)."""
    before, after = stages["deduplicate"]
    docs = before.orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({docs[r].doc_id for r in plain_groups([d.text for d in docs])})


def test_mix_repeats_whole_rows(stages):
    before, after = stages["mix"]
    rows = {r.doc_id: r for r in before.collect()}
    counts = Counter(r.doc_id for r in after.collect())
    assert set(counts) <= set(rows) and max(counts.values()) <= 3
    assert all(rows[r.doc_id] == r for r in after.collect())
    words = lambda d: len(rows[d].text.split())
    total, taken = sum(map(words, rows)), sum(n * words(d) for d, n in counts.items())
    assert abs(taken - total) < 0.05 * total


def test_pack_places_every_document(stages):
    before, after = stages["pack"]
    want = Counter(r.doc_id for r in before.collect())
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == want
    used = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in used) <= 2048 and len(used) <= 1.02 * sum(r[1] for r in used) / 2048 + 1


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", None, 0), (None, "the words of a text and some more", "en", "a", 5), (2, "", None, "a", 0), (3, "the words of a text and some more", "en", "a", 5), (3, "the words of a text and some more", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert sorted(r.doc_id for r in pipeline.deduplicate(spark, docs, sf_dir).collect()) == [1, 3]


CLASHING = "lang_pred score quality_score size source_size target copies taken rest whole gap last x_rank c_bucket s_source _rank rank bucket row doc file at node key _language _quality_score col".split()


@pytest.mark.parametrize("stage", ["language", "quality", "deduplicate", "mix"])
def test_columns_of_any_name_come_through(spark, sf_dir, stage):
    """Every working name and more, each holding what says which row it belongs to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING))
    take = dict(pipeline.STAGES)[stage]
    made = take(spark, wide, sf_dir)
    assert made.columns == wide.columns
    rows = made.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in take(spark, docs, sf_dir).collect())


def test_null_and_repeated_ids_at_every_stage(spark, sf_dir):
    """No stage tells rows apart by doc_id: what stays is what stays of the same texts under ids of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60)
    odd = docs.selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 7 ELSE doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    texts = lambda df: Counter(r.text for r in df.select("text").collect())
    kept = pipeline.deduplicate(spark, odd, sf_dir)
    assert texts(kept).keys() <= texts(docs).keys() and len(texts(kept)) == len(texts(pipeline.deduplicate(spark, docs, sf_dir)))
    for stage in (pipeline.language, pipeline.quality):
        assert all(n % 2 == 0 for n in texts(stage(spark, docs.union(docs), sf_dir)).values())
    nulls = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars")
    assert pipeline.mix(spark, nulls, sf_dir).where("doc_id IS NOT NULL").count() == 0
    assert Counter(r.doc_id for r in pipeline.sequences(spark, odd, sf_dir).where("piece = 0").collect()) == Counter(r.doc_id for r in odd.collect())


def test_run(spark, sf_dir):
    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 14))


def test_the_rest_stands_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'alias_resolution' in e.queries() and not any(n.startswith('op') for n in e.oracle_sql())"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], timeout=60).returncode == 0
