import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import aliases, search, stored_search

ROWS = [("L1", "K108R, ERVK-6", "ervmap_alt_name", 1), ("L1", "K-10", "combined_id", 1), ("L2", "ERVK-10", "combined_id", 1)]
TYPES = aliases.IDENTIFIERS


def table(spark, rows):
    return spark.createDataFrame([(u, a, t, "r2", c) for u, a, t, c in rows], "uid string, alias string, alias_type string, assignment string, is_current int")


def hits(spark, rows, queries, **options):
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    return search.search(asked, search.postings(table(spark, rows)), **options)


def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    made = table(spark, rows)
    entities = made.selectExpr("uid", "uid AS combined_id", "'g' AS grp", "'' AS band", "'' AS origin").distinct()
    stored_search.write_index(made, entities, entities.selectExpr("uid", "'hg38' AS assembly", "'c' AS chrom", "1 AS start0", "2 AS end0"), path)
    return path


def nrm(s):
    return re.sub("[^A-Z0-9]", "", s.upper())


def nrmc(s):
    return re.sub("^(HERV|ERV)", "", nrm(s))


def sequential(rows, q, cap, only=None):
    """The rules, one key after another."""
    postings = {}
    for u, a, t, c in rows:
        for s in [a, *(p.strip() for p in a.split(",") if t == "ervmap_alt_name")] if only in (None, t) else []:
            if s and nrm(s):
                where = postings.setdefault(nrm(s), {})
                where[(TYPES.index(t), s, u)] = max(c, where.get((TYPES.index(t), s, u), 0))
    n, c, out, seen = nrm(q), nrmc(q), [], set()

    def take(key, tier):
        for (t, s, u), _ in sorted(postings.get(key, {}).items()):
            if (u, s) not in seen:
                seen.add((u, s))
                out.append((tier, s, u))

    if not n:
        return []
    take(n, 0 if n == q.upper() else 1)
    for key in sorted(postings):
        if len(out) < cap and key.startswith(n) and key != n:
            take(key, 2)
    if len(out) < cap and c:
        folded = {}
        for key in sorted(postings):
            folded.setdefault(nrmc(key), []).append(key)
        for key in folded.get(c, []):
            take(key, 3)
        for ckey in sorted(folded):
            if len(out) < cap and ckey.startswith(c) and ckey != c:
                for key in folded[ckey]:
                    take(key, 4)
    return sorted(out)


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("K108R", {(0, "K108R", "L1"), (2, "K108R, ERVK-6", "L1")}),
        ("k-108r", {(1, "K108R", "L1"), (2, "K108R, ERVK-6", "L1")}),
        ("HERVK108", {(4, "K108R", "L1"), (4, "K108R, ERVK-6", "L1")}),
        ("K-10", {(1, "K-10", "L1"), (2, "K108R", "L1"), (2, "K108R, ERVK-6", "L1"), (3, "ERVK-10", "L2")}),
        ("ERV", {(2, "ERVK-6", "L1"), (2, "ERVK-10", "L2")}),
        ("--", set()),
    ],
)
def test_tiers(spark, q, want):
    assert {(r.tier, r.str, r.uid) for r in hits(spark, ROWS, [q]).collect()} == want


NAME = st.tuples(st.sampled_from(["", "HERV", "ERV"]), st.sampled_from(["K", "K1", "K-1", "K10", "k-10r", "H2", "H"]), st.sampled_from(["", ", K1", ",ERVH2"])).map("".join).filter(bool)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["L1", "L2", "L3"]), NAME, st.sampled_from(TYPES), st.integers(0, 1)), min_size=1, max_size=12), st.sampled_from([1, 2, 3, 200]))
def test_batch_equals_the_sequential_rules(spark, rows, cap):
    queries = ["K", "k-1", "HERVK", "ERV", "H2", "K10R", "herv-h", "!"]
    got = {}
    for r in hits(spark, rows, queries, cap=cap, block=2).collect():
        got.setdefault(r.q, []).append((r.tier, r.str, r.uid))
    for q in queries:
        assert sorted(got.get(q, [])) == sequential(rows, q, cap), q


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_index_equals_the_sequential_rules(spark, tmp_path_factory, seed):
    rng = random.Random(seed)
    made = [p + k + s for p in ("", "HERV", "ERV") for k in ("K", "K1", "K-1", "K10", "k-10r", "H2", "H", "") for s in ("", ", K1", ",ERVH2") if p + k + s]
    rows = [(rng.choice(["L1", "L2", "L3"]), rng.choice(made), rng.choice(TYPES[3:]), rng.randrange(2)) for _ in range(14)]
    path = stored(spark, rows, tmp_path_factory)
    queries = ["K", "k-1", "HERVK", "ERV", "H2", "K10R", "K10RX", "herv-h", "!", "HERVH2X"]
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    for cap, only in ((1, None), (2, None), (200, None), (200, "ervmap_alt_name")):
        got = {}
        for r in stored_search.stored_search(asked, path, cap=cap, only_type=only).collect():
            got.setdefault(r.q, []).append((r.tier, r.str, r.uid))
        for q in queries:
            assert sorted(got.get(q, [])) == sequential(rows, q, cap, only), (q, cap, only)


def test_a_short_query_reads_no_more_keys_than_it_can_use(spark, tmp_path_factory):
    rows = [(f"L{i}", f"A{i:04d}", "combined_id", 1) for i in range(900)] + [("M", "B", "combined_id", 1)]
    path = stored(spark, rows, tmp_path_factory)
    found = stored_search.stored_search(spark.createDataFrame([("a",), ("b",), ("zz",)], "q string"), path, cap=20)
    assert sorted(r.str for r in found.where("q = 'a'").collect()) == [f"A{i:04d}" for i in range(20)]
    assert [r.str for r in found.where("q = 'b'").collect()] == ["B"] and found.where("q = 'zz'").isEmpty()
    plan = found._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "GreaterThanOrEqual(prefix,A)" in plan and "scope" in plan
    nothing = stored_search.stored_search(spark.createDataFrame([("--",), (None,)], "q string"), path)
    assert nothing.collect() == [] and nothing.columns == found.columns


def test_no_join_of_a_batch_sends_a_side_to_all_tasks(spark, tmp_path_factory):
    path = stored(spark, [(f"L{i}", f"A{i:04d}", "combined_id", 1) for i in range(50)], tmp_path_factory)
    names = spark.createDataFrame([(f"L{i}", "x", "g") for i in range(50)], "uid string, combined_id string, grp string")
    found = search.labelled(stored_search.stored_search(spark.createDataFrame([("a",), ("a00",)], "q string"), path), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan


def test_what_an_index_is_made_of_does_not_go_through_the_driver(spark, sf_dir):
    from tessera.operators import documents
    from tessera.plans.fixtures import view

    listed = documents.list_rows(view(spark, sf_dir, "fx_entity"), view(spark, sf_dir, "fx_coord"))
    for made in (view(spark, sf_dir, "fx_alias"), listed):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_part_whose_places_are_known_is_not_computed_to_find_its_ranges(spark, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(stored_search, "RANGE", 100)
    path = stored(spark, [(f"L{i}", f"A{i:04d}", "combined_id", 1) for i in range(950)], tmp_path_factory)
    for name, column in (("postings", "rank"), ("collapsed", "at"), ("prefixes", "first")):
        of = ["of"] if name != "postings" else []
        part = spark.read.parquet(f"{path}/{name}").where("scope = 'all'").selectExpr(*of, column, "_metadata.file_path AS f")
        spans = sorted(tuple(r) for r in part.groupBy(*of, "f").agg(F.min(column).alias("low"), F.max(column).alias("high")).select(*of, "low", "high").collect())
        assert len(spans) >= 9 and all(one[:-2] != two[:-2] or one[-1] < two[-2] for one, two in zip(spans, spans[1:]))


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_prefixes_come_from_neighbours_alone(spark, span):
    rng = random.Random(span)
    made = {(s, "".join(rng.choice("AB") for _ in range(rng.randrange(0, 6)))) for s in ("all", "x") for _ in range(25)}
    rows = [(s, k, i) for i, (s, k) in enumerate(sorted(made))]
    want = {}
    for s, k, i in rows:
        for n in range(1, len(k) + 1):
            want.setdefault((s, k[:n]), []).append(i)
    shortest = {}
    for (s, p), at in sorted(want.items()):
        if len(at) == 1:
            shortest.setdefault(at[0], (s, p))
    kept = sorted((s, p, at[0], len(at)) for (s, p), at in want.items() if len(at) > 1 or shortest[at[0]] == (s, p))
    got = stored_search._prefixes(spark.createDataFrame(rows, "scope string, key string, rank long"), "key", "rank", span)
    assert sorted((r.scope, r.prefix, r.first, r.n) for r in got.collect()) == kept


def test_commas_part_only_packed_names(spark):
    index = search.postings(table(spark, [("L1", "a, b", "combined_id", 1), ("L1", "a, b", "ervmap_alt_name", 1)]))
    assert sorted((r.alias_type, r.str) for r in index.collect()) == [("combined_id", "a, b"), ("ervmap_alt_name", "a"), ("ervmap_alt_name", "a, b"), ("ervmap_alt_name", "b")]


def test_other_spellings_come_with_their_keyspace(spark):
    rows = [("L1", "ab", "combined_id", 1), ("L1", "ab", "hervd_id", 1), ("L1", "abc", "hervd_id", 1), ("L1", "abc", "ervmap_id", 1)]
    (only,) = search.grouped(hits(spark, rows, ["ab"])).collect()
    assert (only.headline, [tuple(x) for x in only.also]) == ("ab", [("abc", "hervd_id")])
    both = spark.createDataFrame([("q", 0, "ab", t, "L1", 1) for t in ("combined_id", "hervd_id")], "q string, tier int, str string, alias_type string, uid string, is_current int")
    assert [tuple(x) for x in search.grouped(both).first().also] == [("ab", "hervd_id")]


def test_groups_share_a_row_for_the_same_entities(spark):
    rows = [("L1", "ab", "combined_id", 1), ("L1", "abc", "hervd_id", 0), ("L2", "abd", "combined_id", 1)]
    found = {r.headline: r for r in search.grouped(hits(spark, rows, ["ab"])).collect()}
    assert set(found) == {"ab", "abd"}
    assert (found["ab"].also, found["ab"].retired, found["ab"].badge, found["ab"].place) == ([("abc", "hervd_id")], True, "", 1)
    assert (found["abd"].badge, found["abd"].n_loci) == ("prefix", 1)


def test_hits_are_shown_in_the_order_of_the_language(spark):
    rows = [("q", 2, s) for s in ("b", "A", "a", "é", "e", "f", "aa")] + [("q", 0, "zzzz")]
    shown = search.ordered_hits(spark.createDataFrame(rows, "q string, tier int, str string"))
    assert [r.str for r in shown.collect()] == ["zzzz", "a", "A", "b", "e", "é", "f", "aa"]


def test_only_one_keyspace(spark):
    rows = [("L1", "ab", "combined_id", 1), ("L1", "ab", "hervd_id", 1)]
    assert [r.alias_type for r in hits(spark, rows, ["ab"]).collect()] == ["combined_id"]
    assert [r.alias_type for r in hits(spark, rows, ["ab"], only_type="hervd_id").collect()] == ["hervd_id"]


def test_ambiguity_is_kept_and_nulls_mean_nothing(spark):
    df = table(spark, [("L2", "x", "combined_id", 0), ("L1", "x", "combined_id", 1), ("L1", None, "combined_id", 1), ("L1", "y", "hervd_id", 1)])
    found = {(r.alias_type, r.alias): (r.uids, r.is_current) for r in aliases.resolve(df).collect()}
    assert found == {("combined_id", "x"): (["L1", "L2"], 1), ("hervd_id", "y"): (["L1"], 1)}
    assert {r.alias_type: (r.n_strings, r.n_ambiguous) for r in aliases.ambiguity(df).collect()} == {"combined_id": (1, 1), "hervd_id": (1, 0)}


def test_every_resolved_string_is_found_by_search(spark):
    df = table(spark, ROWS)
    asked = df.selectExpr("alias AS q").distinct()
    found = {(r.q, r.uid) for r in search.search(asked, search.postings(df)).collect()}
    assert {(r.alias, u) for r in aliases.resolve(df).collect() for u in r.uids} <= found
