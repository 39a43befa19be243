import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import queries
from tessera.llm.minhash import OnePermutation, fingerprint_edits
from tessera.llm.simhash import components, lookups, near_duplicates, near_pairs, simhash


def plain_simhash(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word], "") if word else (words, "")
        else:
            word += c
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest index that each fingerprint reaches over links of at most four bits."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_follows_its_definition(spark):
    texts = ["", None, "one", "A b C d", "É é Z z a b c", "a b c d a b c d a b c d", "x\ty\x0bz  w\n" * 40, "q" * 5000]
    assert [simhash(t) % (1 << 64) for t in texts] == [plain_simhash(t) for t in texts]
    native = spark.createDataFrame([("a b c d",)], "t string").selectExpr("xxhash64(t)").first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def crowd(seed, groups=12, each=40, flips=7):
    rng = random.Random(seed)
    made = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            x = base
            for _ in range(rng.randrange(flips)):
                x ^= 1 << rng.randrange(64)
            made.add(x)
    return sorted(made)


@pytest.mark.parametrize(("most", "segments"), [(256, 3), (3, 3), (256, 2), (3, 2)])
def test_components_lose_no_link(spark, most, segments):
    fps = crowd(most)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    found = {r.node: r.component for r in components(near_pairs(nodes, most=most, segments=segments)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == plain_components(fps)


@pytest.mark.parametrize("segments", [3, 2])
def test_values_beside_a_crowded_one(spark, segments):
    """Thousands of fingerprints look up values that few are filed under; no link is lost and no value joins many rows."""
    rng, most = random.Random(9), 8
    value = rng.getrandbits(21) | 0b111
    high = lambda: rng.getrandbits(20) << 44
    fps = {high() | value for _ in range(3000)}
    for bit in (1, 2, 4):
        near = [next(iter(fps)) for _ in range(3)] + rng.sample(sorted(fps), 3)
        fps |= {(f ^ bit) ^ (1 << rng.randrange(44, 64)) for f in near} | {high() | (value ^ bit) for _ in range(3)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    filed, thin, dense = lookups(nodes, most=most, segments=segments)
    under = {r.key: r["count"] for r in filed.groupBy("key").count().collect()}
    met = max(r["count"] * under.get(r.key, 0) for r in thin.groupBy("key").count().collect())
    ball = 23 if segments == 3 else 530
    assert met <= (32 + ball) * most * most and dense.count() >= 3000
    found = {r.node: r.component for r in components(near_pairs(nodes, most=most, segments=segments)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == plain_components(fps)


def test_no_side_of_unknown_size_is_broadcast(spark, monkeypatch):
    """Spark takes packed fingerprints for small before they are exploded; only counted rows may go through the driver."""
    from tessera.llm import simhash as module

    monkeypatch.setattr(module, "FEW", 0, raising=False)
    signed = [f - (1 << 64) if f >> 63 else f for f in crowd(5)]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    docs = spark.createDataFrame([(i, f"a{i} b c d e f") for i in range(40)], "doc_id long, text string")
    _, thin, dense = lookups(nodes, most=3)
    assert dense is not None
    for made in (thin, dense, near_pairs(nodes), near_pairs(nodes, most=3), near_duplicates(docs), near_duplicates(docs, most=3)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components(links.limit(0)).collect() == []


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b c d e"), (7, "A  b c d e"), (7, "other words are here now"), (None, "alone in the whole world"), (8, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS node", "3 AS component_id")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()), key=repr)
    want = sorted(((d, f"{plain_simhash(t):016x}") for d, t in rows), key=repr)
    assert [g[:2] for g in got] == want
    assert {g[2] for g in got if g[1] == "0" * 16} == {3}
    assert sorted((g[0] or 0, g[2]) for g in got if g[1] == f"{plain_simhash('a b c d e'):016x}") == [(0, 7), (7, 7)]
    assert [g[2] for g in got if g[1] == f"{plain_simhash('alone in the whole world'):016x}"] == [None]
    assert near_duplicates(df.limit(0)).collect() == []


def test_simhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    roots = plain_components([plain_simhash(r.text) for r in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_components(spark, sf_dir).collect()}
    assert got == {d.doc_id: (f"{plain_simhash(d.text):016x}", docs[r].doc_id) for d, r in zip(docs, roots)}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_unbiased_and_exact_for_equal_texts():
    m, rng = OnePermutation(), random.Random(3)
    errors = []
    for n in (1, 2, 5, 20, 100, 1000, 5000):
        for keep in (0.0, 0.3, 0.8, 0.95):
            a = [str(rng.random()) for _ in range(n + 4)]
            b = a[: int(len(a) * keep)] + [str(rng.random()) for _ in range(len(a) - int(len(a) * keep))]
            x, y = " ".join(a), " ".join(b)
            errors.append(m.likeness(m.values(x), m.values(y)) - jaccard(shingles(x), shingles(y)))
            assert m.likeness(m.values(x), m.values("  " + x.upper().lower())) == 1.0
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12


def test_long_texts_are_hashed_in_chunks():
    m, small = OnePermutation(), OnePermutation()
    small.hashes.chunk = 7
    text = " ".join(str(i * i) for i in range(1000))
    assert (m.values(text) == small.values(text)).all()


def test_edits(spark):
    rows = [(5, "a b c d e f g"), (None, None), (5, ""), (9, "xé\U0001f600"), (2, "w " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS run").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprint_edits(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))
    assert fingerprint_edits(df.limit(0)).collect() == []
    assert fingerprint_edits(df.where("doc_id = 9")).first().near_next == 1.0


def test_minhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op1_minhash_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    by_text, errors = {}, []
    for i, d in enumerate(docs):
        after = docs[(i + 1) % len(docs)].text
        edited = d.text[: len(d.text) - len(d.text) // 2] + after[: len(d.text) // 2]
        r = got[d.doc_id]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(d.text)
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - jaccard(shingles(d.text), shingles(edited)), r.near_next - jaccard(shingles(d.text), shingles(after))]
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.15
