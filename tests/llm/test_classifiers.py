import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.boost import fit_forest
from tessera.llm.langid import LanguageModel, fit_in_a_task, fit_languages, fold_of, FollowTheLeader, identify, place_in_sample, softmax, train_languages
from tessera.llm.ngrams import CHUNK, SparseRows, character_grams, code_points, counted, present
from tessera.llm.quality import ORDERS, dual_coordinate_descent, fit_quality, fit_sigmoid, log_count_ratios, score_quality, train_quality


@pytest.fixture(scope="module")
def tables():
    return "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_as_text(spark):
    df = spark.createDataFrame([(i,) for i in [0, 7, 12345, None]], "doc_id long")
    assert [r[0] for r in df.select(fold_of(F.col("doc_id"), 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 12345)] + [0]


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = "Some words, été 中文 " * 50
    whole, seen = counted(text, (1, 2, 3), 12), present(text, (1, 2, 3), 14)
    monkeypatch.setattr("tessera.llm.ngrams.CHUNK", 100)
    part = counted(text, (1, 2, 3), 12)
    assert (np.flatnonzero(whole) == np.flatnonzero(part)).all() and set(seen) <= set(present(text, (1, 2, 3), 14)) and CHUNK > 100
    assert len(character_grams(code_points("ab"), (1, 2, 3), 12)) == 3 and counted(None, (1, 2), 8).sum() == 0


def test_leader_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    leader = FollowTheLeader(3, 50, l1=0.05)
    for _ in range(1500):
        y = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(10, 50, 4), y))
        leader.learn(at, np.ones(len(at)) / 2, y)
    w = leader.weights()
    assert all(softmax(w[:, [y]] @ np.ones(1)).argmax() == y for y in range(3)) and (w == 0).mean() > 0.1


def test_descent_solves_the_hinge_problem():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = np.sign(x @ [1.0, -2.0, 0.5, 0.0] + 0.3 * rng.normal(size=60))
    w = dual_coordinate_descent(lambda i: (np.arange(4), x[i]), y, 4, c=0.5, epochs=500)
    loss = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in 0.05 * rng.normal(size=(200, 4)))


def test_ratios_and_sigmoid():
    r = log_count_ratios([np.array([0, 1]), np.array([1, 2])], np.array([1.0, 0.0]), 2)
    assert r[0] > 0 > r[2] and abs(r[1]) < 1e-9
    m = np.array([-3.0, -1, 1, 3, -2, 2] * 20)
    a, b = fit_sigmoid(m, (m > 0).astype(float), np.ones(len(m)))
    assert a > 0 and abs(b) < 0.2


def test_trees_separate():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = fit_forest(x, y, trees=20, depth=3)
    fresh = rng.random((500, 3))
    assert ((forest.margins(fresh) > 0) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 2] > 0.3))).mean() > 0.95
    assert len(forest.margins(fresh[:0])) == 0


def some_texts(n, seed):
    """Texts and labels 0 and 1, which half of the words tell."""
    rng = random.Random(seed)
    labels = [rng.randrange(2) for _ in range(n)]
    return [" ".join(rng.choice(("ab", "cd", "ef", "gh") if rng.random() < 0.5 else (("up", "on"), ("no", "so"))[y]) for _ in range(rng.randrange(1, 9))) for y in labels], labels


def test_quality_equals_a_plain_version():
    """Ratios counted in dictionaries, the dual over the matrix of all products, scores by sums over sets."""
    texts, labels = some_texts(60, 4)
    bits, c, seed, share = 12, 1.0, 7, {0: 900, 1: 100}
    model = fit_quality(labels, SparseRows((present(t, ORDERS, bits), np.zeros(0)) for t in texts), bits, share, c=c, seed=seed)

    order = np.random.default_rng(seed).permutation(60).tolist()
    sets = [set(present(texts[i], ORDERS, bits).tolist()) for i in order]
    truth, part = [labels[i] for i in order], 15
    seen = {y: {} for y in (0, 1)}
    for s, y in zip(sets[part:], truth[part:]):
        for f in s:
            seen[y][f] = seen[y].get(f, 0) + 1
    every = {y: sum(seen[y].values()) + (1 << bits) for y in (0, 1)}
    ratio = lambda f: math.log((seen[1].get(f, 0) + 1) / every[1] / ((seen[0].get(f, 0) + 1) / every[0]))
    norm = lambda s: math.sqrt(sum(ratio(f) ** 2 for f in s)) or 1.0
    dot = lambda a, b: sum(ratio(f) ** 2 for f in a & b) / norm(a) / norm(b) + 1
    fitted, sign = sets[part:], [2 * y - 1 for y in truth[part:]]
    q = np.array([[sign[i] * sign[j] * dot(a, b) for j, b in enumerate(fitted)] for i, a in enumerate(fitted)])
    dual, rng = np.zeros(len(fitted)), np.random.default_rng(seed)
    for _ in range(20):
        before = dual.copy()
        for i in rng.permutation(len(fitted)):
            dual[i] = min(max(dual[i] - (q[i] @ dual - 1) / q[i, i], 0.0), c)
        if np.abs(dual - before).max() < 1e-3 * c:
            break
    margin = lambda s: sum(d * y * (dot(s, t) if s else 1.0) for d, y, t in zip(dual, sign, fitted))
    assert np.allclose([model.margin(t) for t in texts], [margin(set(present(t, ORDERS, bits).tolist())) for t in texts], atol=1e-6)

    kept, m = truth[:part], [margin(s) for s in sets[:part]]
    ones = sum(kept)
    goal = [(ones + 1) / (ones + 2) if y else 1 / (part - ones + 2) for y in kept]
    weight = [share[y] / kept.count(y) for y in kept]
    loss = lambda a, b: sum(w * (math.log1p(math.exp(-(a * x + b))) + (1 - t) * (a * x + b)) for x, t, w in zip(m, goal, weight)) / sum(weight)
    least = loss(model.slope, model.offset)
    assert all(least <= loss(model.slope + d, model.offset + e) + 1e-7 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))
    assert all(abs(model.score(t) - 1 / (1 + math.exp(-(model.slope * model.margin(t) + model.offset)))) < 1e-9 for t in texts)


def test_language_equals_a_plain_version(spark):
    """TF-IDF in dictionaries, follow-the-regularised-leader for one weight at a time, temperature by trying all."""
    texts, labels = some_texts(48, 5)
    labels, bits = ["xy"[y] for y in labels], 10
    trained = train_languages(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, lang string"), bits=bits)
    grams = [{int(f): float(count[f]) for f in np.flatnonzero(count)} for count in (counted(t, (1, 2, 3), bits) for t in texts)]
    df = {f: sum(f in g for g in grams) for g in grams for f in g}
    assert np.allclose(trained.idf, [math.log(49 / (1 + df.get(f, 0))) + 1 for f in range(1 << bits)])
    rows = []
    for g, t in zip(grams, texts):
        x = {f: n * (math.log(49 / (1 + df[f])) + 1) for f, n in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        rows.append({f: v / size for f, v in x.items()})
        at, values = trained.features(t)
        assert np.allclose([rows[-1][f] for f in at.tolist()], values)

    empty = LanguageModel(["x", "y"], trained.idf, np.zeros((2, 1 << bits)), np.zeros(2), 1.0, bits)
    model = fit_languages(labels, SparseRows(empty.features(t) for t in texts), empty, epochs=2, seed=7)
    alpha, beta, l1, l2, constant = 0.5, 1.0, 0.02, 0.1, 1 << bits
    z, n = {}, {}

    def weight(k, f):
        a, s = z.get((k, f), 0.0), n.get((k, f), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(s)) / alpha + l2)

    def scores(row):
        return [sum(weight(k, f) * v for f, v in row.items()) for k in (0, 1)]

    order = np.random.default_rng(7).permutation(48).tolist()
    for i in order[8:] * 2:
        row = {**rows[i], constant: 0.1}
        s = scores(row)
        p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
        slopes = {(k, f): (p[k] - (labels[i] == "xy"[k])) * v for k in (0, 1) for f, v in row.items()}
        old = {key: weight(*key) for key in slopes}
        for key, g in slopes.items():
            had = n.get(key, 0.0)
            z[key] = z.get(key, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * old[key]
            n[key] = had + g * g
    assert np.allclose(model.weights, [[weight(k, f) for f in range(1 << bits)] for k in (0, 1)], atol=1e-5)
    assert np.allclose(model.bias, [0.1 * weight(k, constant) for k in (0, 1)], atol=1e-5)
    assert (model.weights == 0).any() and (model.weights != 0).any()

    def share(i, temperature):
        s = [v / temperature for v in scores({**rows[i], constant: 0.1})]
        return [math.exp(v - max(s)) / sum(math.exp(u - max(s)) for u in s) for v in s]

    loss = lambda t: -sum(math.log(max(share(i, t)["xy".index(labels[i])], 1e-12)) for i in order[:8])
    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.02, 5, 60))) + 1e-6
    for i, t in enumerate(texts):
        p = share(i, model.temperature)
        name, score = model.predict(t)
        assert abs(score - max(p)) < 1e-3 and (name == "xy"[p.index(max(p))] or abs(p[0] - 0.5) < 1e-3)


def test_held_out_quality(spark, tables):
    got = queries.op3_quality_scores(spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    good = [r for r in got if r.quality == 1]
    assert np.mean([r.predicted for r in good]) > 0.99


def test_held_out_languages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang")
    held = queries.op10_language(spark, tables).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = lambda df: df.where(fold_of(F.col("doc_id"), 5) != 0)
    flipped = labels.withColumn("quality", F.when(fold_of(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train_quality(docs, kept(labels)), train_quality(docs, kept(flipped))
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "one more of the lines", None), (5, "123 --", "fr"), (None, "a", "en"), (7, "", "en"), (8, "mot " * 200_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "9 AS score")
    model = train_languages(df)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert len(got) == len(rows) and identify(df, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (3, 5, 7))
    assert all(got[i].lang_pred in ("en", "fr") and 0 < got[i].score <= 1 for i in (1, 2, 4, None, 8))
    assert identify(df.limit(0), model).collect() == []
    assert {r.lang_pred for r in identify(df, train_languages(df.limit(0))).collect()} == {"und"}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good plain words here"), (2, "BAD!! BAD!! BAD!!"), (3, None), (None, "x"), (4, "y " * 300_000), (4, "y")], "doc_id long, text string").withColumn("quality_score", F.lit("other"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = score_quality(docs, train_quality(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.quality_score <= 1 for r in got)
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert len({r.quality_score for r in score_quality(docs, train_quality(docs, few)).collect()}) == 1
    assert score_quality(docs.limit(0), train_quality(docs.limit(0), labels)).collect() == []


def test_samples_are_bounded_and_do_not_depend_on_partitions(spark):
    """A third of the rows without an id, a third under one id."""
    rows = [((None, 7, i)[i % 3], f"text {i}", "ab"[i % 10 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    counts = {"a": 2700, "b": 300}
    seen = []

    def fit(labels, examples):
        return sorted(labels), [tuple(at.tolist()) for at, _ in examples]

    def features(text):
        return np.array([int(text.split()[1])], np.int32), np.zeros(0, np.float32)

    for parts in (1, 7):
        place = place_in_sample(counts, F.col("label"), (F.col("doc_id"), F.col("text")), 400)
        chosen = df.repartition(parts).select("doc_id", "label", "text", place.alias("place")).where("place IS NOT NULL")
        ids = [r.doc_id for r in chosen.collect()]
        assert 300 < len(ids) < 500 and 0.2 < sum(i is None for i in ids) / len(ids) < 0.45
        labels, examples = fit_in_a_task(chosen, features, fit, 350)
        assert len(labels) == 350 and 130 < labels.count("b") < 220
        seen.append((labels, sorted(examples)))
    assert seen[0] == seen[1]
    hot = df.withColumn("text", F.lit("the same")).select("label", "text", place_in_sample(counts, F.col("label"), (F.col("doc_id"),), 400).alias("place")).where("place IS NOT NULL")
    assert len(fit_in_a_task(hot, lambda t: (np.zeros(1, np.int32), np.zeros(0, np.float32)), fit, 400)[0]) <= 400
