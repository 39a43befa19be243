"""Tiered search of strings for a batch of queries.

Tiers: 0 the query's key as typed, 1 the same after normalising the query, 2 keys that start with it, 3 keys of the
same collapsed form, 4 keys whose collapsed form starts with the query's.  Prefix matches are equal joins on a block of
leading characters and a check of the rest, so no query meets all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse_key, normalize_key, packed_tokens, without_prefix
from tessera.operators.aliases import IDENTIFIERS, type_order


#: Fixed value: the keyspace whose strings pack several names between commas.
PACKED = "ervmap_alt_name"


def postings(aliases: DataFrame, keyspaces: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """``key, ckey, alias_type, str, uid, is_current`` of each string and, in the keyspace that packs them, each part of one."""
    rows = aliases.where(F.col("alias_type").isin(*keyspaces) & F.col("alias").isNotNull())
    parts = F.when(F.col("alias_type") == PACKED, packed_tokens(F.col("alias"))).otherwise(F.array("alias"))
    tokens = rows.select("alias_type", "uid", "is_current", F.explode(parts).alias("str"))
    keyed = tokens.withColumn("key", normalize_key(F.col("str"))).where(F.col("key") != "")
    once = keyed.groupBy("key", "alias_type", "str", "uid").agg(F.max("is_current").alias("is_current"))
    return once.withColumn("ckey", without_prefix(F.col("key")))


def collapsed_map(index: DataFrame) -> DataFrame:
    return index.select("ckey", "key").distinct()


def index_stats(index: DataFrame) -> DataFrame:
    """Keys, postings, keys of several entities, and collapsed keys."""
    each = index.groupBy("key").agg(F.count("*").alias("n"), (F.min("uid") < F.max("uid")).alias("several"), F.first("ckey").alias("ckey"))
    return each.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_postings"), F.count_if("several").alias("n_multi"), F.countDistinct("ckey").alias("n_collapsed"))


def _prefix_join(queries: DataFrame, keys: DataFrame, q: str, k: str, block: int) -> DataFrame:
    """Pairs in which ``k`` starts with ``q``; both sides are blocked by the first characters that a query has."""
    left = queries.where(F.col(q) != "").withColumn("_width", F.least(F.length(q), F.lit(block))).withColumn("_block", F.expr(f"substr({q}, 1, least(length({q}), {block}))"))
    lengths = F.sequence(F.lit(1), F.least(F.length(k), F.lit(block)))
    right = keys.where(F.col(k) != "").withColumn("_block", F.explode(F.transform(lengths, lambda n: F.substr(F.col(k), F.lit(1), n))))
    return left.join(right, "_block").where(F.startswith(F.col(k), F.col(q))).drop("_block", "_width")


def asked(queries: DataFrame) -> DataFrame:
    """Each distinct ``q`` with ``n``, what it normalises to, and ``c``, what it collapses to; those without letters or digits go."""
    return queries.select("q").where(F.col("q").isNotNull()).distinct().withColumn("n", normalize_key(F.col("q"))).where("n <> ''").withColumn("c", collapse_key(F.col("q")))


def search(queries: DataFrame, index: DataFrame, *, cap: int = 200, block: int = 6, only_type: str | None = None) -> DataFrame:
    """Hits ``q, tier, str, alias_type, uid, is_current`` of each distinct ``q`` in ``postings`` that are computed for it.

    A pair of entity and string counts once, at its first tier.  Tier 2 takes whole keys while the hits before are
    below ``cap``; tiers 3 and 4 come only if the hits so far are below it, tier 3 whole, tier 4 by whole collapsed
    keys.  A query that collapses to nothing has no tiers 3 and 4; one without letters or digits has no hits.
    Where many batches are asked, ``stored_search`` gives the same hits from a written index.
    """
    index = index if only_type is None else index.where(F.col("alias_type") == only_type)
    wanted = asked(queries)
    keys = index.select("key", "ckey").distinct()
    plain = _prefix_join(wanted, keys.select("key", F.col("ckey").alias("k_ckey")), "n", "key", block)
    plain = plain.select("q", "key", F.when(F.col("key") == F.col("n"), F.when(F.col("n") == F.upper("q"), 0).otherwise(1)).otherwise(2).alias("tier"), F.lit("").alias("unit_ckey"))
    folded = _prefix_join(wanted, keys, "c", "ckey", block)
    folded = folded.select("q", "key", F.when(F.col("ckey") == F.col("c"), 3).otherwise(4).alias("tier"), F.col("ckey").alias("unit_ckey"))
    # A short query may start a large part of all keys.  A string has one key, so each key of tier 2 has a hit of its
    # own and the first ``cap`` are enough; of the collapsed keys at most ``cap`` can be all seen before, so twice as
    # many are.  Spark applies both limits before it shuffles.
    by_key = F.row_number().over(Window.partitionBy("q").orderBy("tier", "key"))
    plain = plain.withColumn("_place", by_key).where(F.col("_place") <= cap + 1).drop("_place")
    by_ckey = F.dense_rank().over(Window.partitionBy("q").orderBy("tier", "unit_ckey"))
    folded = folded.withColumn("_place", by_ckey).where(F.col("_place") <= 2 * cap + 1).drop("_place")
    return in_tiers(plain.unionByName(folded).join(index.drop("ckey"), "key"), cap)


def in_tiers(found: DataFrame, cap: int) -> DataFrame:
    """The hits among ``q, tier, unit_ckey, key, str, alias_type, uid, is_current`` that the rules of ``search`` keep.

    All steps are windows of one query, dealt out once; a query has few hits beside those of ambiguous keys.
    """
    first = F.row_number().over(Window.partitionBy("q", "uid", "str").orderBy("tier", "unit_ckey", "key", type_order()))
    once = found.repartition("q").withColumn("_first", first).where("_first = 1").drop("_first")
    once = once.withColumn("unit", F.when(F.col("tier") <= 2, F.col("key")).otherwise(F.col("unit_ckey")))
    # hits of the units before a row's own: those up to it, equal ones included, without its own
    own = F.count(F.lit(1)).over(Window.partitionBy("q", "tier", "unit"))
    through = F.count(F.lit(1)).over(Window.partitionBy("q").orderBy("tier", "unit").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    late_through = F.count_if(F.col("tier") >= 3).over(Window.partitionBy("q").orderBy("tier", "unit").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = once.withColumn("_own", own).withColumn("_before", through - F.col("_own")).withColumn("_late", late_through - F.col("_own"))
    early = (F.col("tier") <= 1) | ((F.col("tier") == 2) & (F.col("_before") < cap))
    kept_early = F.count_if(early).over(Window.partitionBy("q"))  # tier 2 that is left out does not count for tiers 3 and 4
    ranked = ranked.withColumn("_early", kept_early)
    late = (F.col("_early") < cap) & ((F.col("tier") == 3) | ((F.col("tier") == 4) & (F.col("_early") + F.col("_late") < cap)))
    return ranked.where(early | late).select("q", "tier", "str", "alias_type", "uid", "is_current")


def grouped(hits: DataFrame, most: int = 60, spellings: int = 4) -> DataFrame:
    """Result rows: strings of one set of entities are one row, headed by the best; at most ``most`` for each query.

    ``place, q, tier, headline, also, uids, n_loci, retired, badge``: a row is retired if any of its members is not
    current; ``also`` has up to ``spellings`` other strings, each once with its keyspace, among them the headline's own
    string if another keyspace has it too.
    """
    strings = hits.groupBy("q", "str", "alias_type").agg(F.sort_array(F.collect_set("uid")).alias("uids"), F.min("tier").alias("tier"), F.min("is_current").alias("is_current"))
    order = F.struct("tier", F.length("str").alias("n"), "str", type_order().alias("t"), "alias_type")
    rows = strings.groupBy("q", "uids").agg(F.array_sort(F.collect_list(order)).alias("members"), F.min("is_current").alias("is_current"))
    head = F.col("members")[0]
    others = F.slice("members", F.lit(2), F.size("members"))
    spelled = F.transform(others, lambda m: m["str"])
    firsts = F.filter(others, lambda m, i: F.array_position(spelled, m["str"]) == i + 1)
    made = rows.select(
        "q",
        head["tier"].alias("tier"),
        head["str"].alias("headline"),
        F.slice(F.transform(firsts, lambda m: F.struct(m["str"].alias("str"), m["alias_type"].alias("alias_type"))), 1, spellings).alias("also"),
        "uids",
        F.size("uids").alias("n_loci"),
        (F.col("is_current") == 0).alias("retired"),
        F.when(head["tier"] == 2, "prefix").when(head["tier"] >= 3, "prefix-collapsed").otherwise("").alias("badge"),
    )
    place = F.row_number().over(Window.partitionBy("q").orderBy("tier", F.length("headline"), "headline", F.col("uids")[0]))
    return made.withColumn("place", place).where(F.col("place") <= most)


def ordered_hits(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: by tier, length and the order of the language, not of the code points."""
    return hits.orderBy("q", "tier", F.length("str"), F.collate("str", "UNICODE"))


def labelled(rows: DataFrame, entities: DataFrame, columns: tuple[str, ...] = ("combined_id", "grp")) -> DataFrame:
    """Rows of ``uid`` with how the entity is called; unknown entities have nulls.  The entities never go through the driver."""
    return rows.join(entities.select("uid", *columns).hint("merge"), "uid", "left")


def strings_per_type(index: DataFrame) -> DataFrame:
    return index.groupBy("alias_type").agg(F.countDistinct("str").alias("n_strings"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """For each query: hits, distinct entities, hits found by collapsing, distinct strings."""
    return hits.groupBy("q").agg(F.count("*").alias("n_hits"), F.countDistinct("uid").alias("n_loci"), F.count_if(F.col("tier") >= 3).alias("n_collapsed"), F.countDistinct("str").alias("n_strings"))


def contains_text(rows: DataFrame, column: str, query: Column | str) -> DataFrame:
    """Rows whose ``column`` holds the query, whatever the case."""
    return rows.where(F.contains(F.upper(column), F.upper(F.lit(query) if isinstance(query, str) else query)))


def key_prefix(rows: DataFrame, query: str, column: str = "uid") -> DataFrame:
    """Rows whose internal key starts with the query, capitals or not."""
    return rows.where(F.startswith(F.col(column), F.upper(F.lit(query))))
