import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.packing import Lengths, class_patterns, nonnegative_least_squares, pack, plan_sequences
from tessera.llm.tokens import tokenizer_path


def test_patterns_are_all_partitions():
    assert sorted(class_patterns(5, 3)) == [(2, 2, 1), (3, 1, 1), (3, 2), (4, 1), (5,)]


def test_least_squares_keeps_signs():
    rng = np.random.default_rng(1)
    a, b = rng.random((8, 20)), rng.normal(size=8)
    x = nonnegative_least_squares(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient < 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6
    exact = a @ np.where(np.arange(20) % 7 == 0, 2.0, 0.0)
    assert np.abs(a @ nonnegative_least_squares(a, exact) - exact).max() < 1e-6


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 400), min_size=1, max_size=60))
def test_plans_use_every_length_and_no_room_twice(histogram):
    plan = plan_sequences(histogram, 128, classes=16)
    used = Counter()
    for content, n in plan:
        assert n > 0 and sum(content) <= 128
        for length in content:
            used[length] += n
    assert used == Counter(histogram)


def test_plans_come_near_the_least_number():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048)
    n = sum(k for _, k in plan_sequences(dict(Counter(lengths.tolist())), 2048))
    assert n <= 1.005 * np.ceil(lengths.sum() / 2048)


def test_most_sequences_come_from_fitted_counts(monkeypatch):
    """Of sequences with several documents, three in four are filled patterns and not residuals."""
    rng = np.random.default_rng(3)
    lengths = Counter(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048).tolist())
    made = []
    take = Lengths.of_pattern
    monkeypatch.setattr(Lengths, "of_pattern", lambda self, *a: made.append(take(self, *a)) or made[-1])
    plan = plan_sequences(dict(lengths), 2048)
    patterns = {tuple(c) for c in made if c}
    several = [(c, n) for c, n in plan if len(c) > 1]
    assert sum(n for c, n in several if tuple(c) in patterns) > 0.75 * sum(n for _, n in several)


def check(rows, capacity, texts, end=0):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc, text in texts:
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want[(doc, k, at, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_edges(spark):
    texts = [(1, None), (2, ""), (None, "a b c"), (3, "word " * 100), (3, "word " * 100), (4, "x y z")] + [(10 + i, "same text here") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length").repartition(5)
    check(pack(df, capacity=16).collect(), 16, texts)
    assert pack(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op2_pack_sequences(spark, sf_dir).collect()
    assert check(rows, 2048, texts) <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("histogram", [{}, {2048: 5}, {1: 1}])
def test_plain_histograms(histogram):
    assert sum(n for _, n in plan_sequences(histogram, 2048)) == sum(histogram.values())
