import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm.nearcopies import may_be_alike, near_copies, shingle_sets
from test_duplicates import jaccard, shingles


def plain_groups(texts):
    """Smallest index that each text reaches over links of Jaccard 0.8 of five-word shingles."""
    sets, parent, having = [shingles(t) for t in texts], list(range(len(texts))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        seen = set().union(*(having.get(g, ()) for g in s)) if s else {j for j in range(i) if not sets[j]}
        for j in seen:
            if jaccard(s, sets[j]) >= 0.8:
                a, b = sorted((root(j), root(i)))
                parent[b] = a
        for g in s:
            having.setdefault(g, []).append(i)
    return [root(i) for i in range(len(texts))]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = str(rng.random())
    return " ".join(words)


def groups_of(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row AS doc_id", "row", "text").repartition(3)
    found = {r.row: r.component for r in near_copies(df, **options).collect()}
    assert len(found) == len(texts)
    first = {}
    return [first.setdefault(found[i], i) for i in range(len(texts))]


@pytest.mark.parametrize("most", [64, 4])
def test_groups_are_those_of_brute_force(spark, most):
    rng = random.Random(most)
    texts = ["", None, " \n", "one", "ONE ", "one two"]
    for n in (12, 60, 300):
        for _ in range(4):
            base = [str(rng.random()) for _ in range(n)]
            texts += [" ".join(base)] + [edited(rng, base, rng.randrange(max(2, n // 20))) for _ in range(12)]
    rng.shuffle(texts)
    want = plain_groups(texts)
    assert len(set(want)) > 20 and groups_of(spark, texts, most=most) == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(100)]
    texts = [edited(rng, base, 1) for _ in range(1000)] + ["x " * 3] * 500
    assert len(set(groups_of(spark, texts))) == 2


def of_a_template(rng, n, copies):
    """Texts that share a template, any two of them with Jaccard 0.75, and copies of some with a little over 0.8."""
    template = [str(rng.random()) for _ in range(126)]
    own = [[str(rng.random()) for _ in range(20)] for _ in range(n)]
    texts = [" ".join(template + o) for o in own]
    return texts + [" ".join(template + o[:6] + [str(rng.random()) for _ in range(14)]) for o in own[:copies]]


@pytest.mark.parametrize(("n", "copies", "most"), [(1200, 120, 256), (300, 60, 8)])
def test_no_copy_is_lost_in_a_crowd_of_one_template(spark, n, copies, most):
    texts = of_a_template(random.Random(n), n, copies)
    assert 0.8 <= jaccard(shingles(texts[0]), shingles(texts[n])) < 0.83 and 0.74 < jaccard(shingles(texts[0]), shingles(texts[1])) < 0.8
    found = groups_of(spark, texts, most=most)
    assert found == [*range(n), *range(copies)]


def test_stage_drops_near_copies_of_likeness_over_four_fifths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = sorted({rows[i].doc_id for i in plain_groups([r.text for r in rows])})
    assert sorted(r.doc_id for r in pipeline.deduplicate(spark, docs, "").select("doc_id").collect()) == want


def test_stage_keeps_what_is_nobodys_copy_without_an_id_or_with_a_shared_one(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, a + " end"), (3, a), (7, d), (9, c), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.deduplicate(spark, docs.repartition(3), "").collect()]
    assert sorted(got, key=repr) == sorted([(3, a), (None, b), (7, c), (7, d), (None, "")], key=repr)
    assert pipeline.deduplicate(spark, docs.limit(0), "").collect() == []


def test_parities_turn_down_no_link(spark):
    rng, texts = random.Random(8), []
    for size in (1, 5, 6, 40, 150, 3000):
        words = [str(rng.random()) for _ in range(size)]
        texts += [" ".join(words), *(edited(rng, words, 1 + size // part) for part in (200, 80, 50, 40, 30, 10))]
        texts += [" ".join(words[: size * 17 // 20]), " ".join(words * 2)]
    df = spark.createDataFrame([*enumerate(texts)], "node long, text string")
    marks = shingle_sets(df).select("node", "mark")
    x, y = marks.toDF("a", "of_a"), marks.toDF("b", "of_b")
    pairs = x.join(y, F.col("a") < F.col("b")).select("a", "b", may_be_alike("of_a", "of_b").alias("may")).collect()
    sets = [shingles(t) for t in texts]
    links = {(r.a, r.b) for r in pairs if jaccard(sets[r.a], sets[r.b]) >= 0.8}
    kept = {(r.a, r.b) for r in pairs if r.may}
    assert len(links) > 20 and links <= kept
    assert len(kept) < len(links) + len(pairs) // 10
