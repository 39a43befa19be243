import hashlib
import random
import zlib

import pytest

from tessera.llm.prefixtrie import prefix_trie, sequences, spliced, turn_codes

SCHEMA = "conv_id long, turn long, role string, text string"
TOLD = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def listed(rows):
    """Turns of each conversation as (role, text), null turn first."""
    made = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        made.setdefault(c, []).append((role or "", text or ""))
    return made


def rebuilt(own):
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return made


def plain(built):
    """Every prefix of every conversation by itself."""
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def under(p):
        return [p] + [x for q in kids[p] for x in under(q)]

    out = []
    for p, who in members.items():
        below = under(p)
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r[c] for c in TOLD) for r in prefix_trie(df, **options).collect()), key=repr)


def conversations(seed, n, words):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 != 5:
            rows += [(c, t, rng.choice(["user", "assistant"]), "é" * rng.randrange(words)) for t in range(rng.choice([1, 2, 3, 6, 12]))]
    return rows


@pytest.mark.parametrize(("turns", "words"), [(1, 2), (5, 2), (40, 3), (1 << 18, 2)])
def test_equals_every_prefix_by_itself(spark, turns, words):
    rows = conversations(turns, 90, words)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(sequences(turn_codes(df)), turns=turns) == plain(listed(rows))
    assert found(spliced(turn_codes(df)), turns=turns) == plain(rebuilt(listed(rows)))


def test_copies_beyond_a_block(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3 + (c % 10 == 0))] + [(1000, 0, "user", "turn 0"), (1001, 0, "user", "else")]
    df = sequences(turn_codes(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert found(df, turns=37) == plain(listed(rows))


def test_odd_rows(spark):
    rows = [
        (0, None, None, "first"), (0, 1, "user", None), (0, 0, "", ""), (3, 5, "user", "no head turns left"), (8, 0, "user", "x"), (8, 0, "user", "x"),
        (None, 0, "user", "of no conversation"), (-7, 0, "user", "below"), (50, 0, "a", "b:c"), (51, 0, "a1:", "b:c"), (60, 0, "user", "long " * 50_000), (61, 0, "user", "long " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, key string, node int")
    assert found(sequences(turn_codes(df)), turns=2) == plain(listed(rows))
    kept = [r for r in rows if (r[0] or 0) >= 0]
    assert found(spliced(turn_codes(df.where("conv_id IS NULL OR conv_id >= 0")))) == plain(rebuilt(listed(kept)))


def test_a_family_without_turns_is_in_the_root(spark):
    c = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "all its turns are the head's, which is not there")]
    got = found(spliced(turn_codes(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain({c: []}) and got[0][:6] == (c, 0, None, 1, 0, 1)


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(sequences(turn_codes(df))) == [] and found(spliced(turn_codes(df))) == []
