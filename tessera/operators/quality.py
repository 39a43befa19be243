"""Checks of catalog and bundle; each is exhaustive and gives rows that say what is wrong, or counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import bucket as hashed
from tessera.functions.text import is_strict_json
from tessera.sources.files import materialise, scratch


def not_strict_json(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not one strict JSON value."""
    return rows.where(~is_strict_json(F.col(column)))


def dangling(refs: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """References to nothing: rows of ``refs`` whose ``on`` columns are not in ``known``."""
    return refs.join(known.select(*on).distinct().hint("merge"), on, "left_anti")


def examples(misses: DataFrame, by: str, value: str, most: int = 3) -> DataFrame:
    """How many misses each kind has, and its first few values; no more than those are ever gathered for a kind."""
    counts = misses.groupBy(by).agg(F.count("*").alias("n_misses"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(value))
    few = misses.select(by, value).distinct().withColumn("_place", place).where(F.col("_place") <= most)
    listed = few.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("examples"))
    return counts.join(listed, by, "left").select(by, "n_misses", F.coalesce("examples", F.lit("")).alias("examples"))


def agreement(expected: DataFrame, built: DataFrame, by: tuple[str, ...] = (), floor: float = 90.0) -> DataFrame:
    """How many entities have all, some or none of their expected names among the built ones, and whether enough have all.

    Entities whose expected names are all null are left out of the rates and counted as ``n_unnamed``.
    """
    want = expected.groupBy("uid", *by).agg(F.collect_set("name").alias("want"))
    have = built.groupBy("uid").agg(F.collect_set("name").alias("have"))
    both = want.join(have.hint("merge"), "uid", "left").withColumn("found", F.size(F.array_intersect("want", F.coalesce("have", F.array().cast("array<string>")))))
    named = F.size("want") > 0
    counts = both.groupBy(*by).agg(
        F.count_if(named).alias("n_entities"),
        F.count_if(~named).alias("n_unnamed"),
        F.count_if(named & (F.col("found") == F.size("want"))).alias("n_all"),
        F.count_if(named & (F.col("found") > 0) & (F.col("found") < F.size("want"))).alias("n_some"),
        F.count_if(named & (F.col("found") == 0)).alias("n_none"),
    )
    share = 100.0 * F.col("n_all") / F.nullif("n_entities", F.lit(0))
    return counts.withColumn("all_pct", share).withColumn("ok", F.coalesce(F.col("all_pct") >= floor, F.lit(False)))


def recorded(hits: DataFrame, genome: str, source: str) -> DataFrame:
    """Recorded gene names of one genome and source as ``uid, name``."""
    return hits.where((F.col("genome") == genome) & (F.col("source") == source)).select("uid", F.col("ref_gene_name").alias("name"))


def drifted(expected: DataFrame, built: DataFrame) -> DataFrame:
    """Expected (uid, name) pairs that no built row has."""
    return expected.where(F.col("name").isNotNull()).select("uid", "name").distinct().join(built.select("uid", "name").distinct().hint("merge"), ["uid", "name"], "left_anti")


def bundle_faults(bundle: DataFrame, refs: DataFrame, buckets: int) -> DataFrame:
    """``reason, kind, uid, bucket, detail``: what is wrong with a written bundle, one row for each case.

    ``bundle`` is read back, with the ``bucket`` of the folder a line lies in and ``_corrupt`` lines; ``refs`` are the
    ``kind, uid`` that names resolve to.  Reasons: ``corrupt``, a line that is no document (``detail`` has it); ``placed``, a
    document in another bucket than its uid hashes to; ``repeated``, one that is there more than once; ``missing``, a uid
    that names of ``kind`` resolve to and that is not where a lookup would read it (``detail`` counts the names).
    Every line and every reference is checked.  A line counts once, in one pass over the files.
    """
    lines = bundle.select("uid", "bucket", "_corrupt", hashed(F.col("uid"), buckets).alias("want"))
    none = F.lit(None).cast("string")
    broken = lines.where(F.col("_corrupt").isNotNull() | F.col("uid").isNull())
    corrupt = broken.select(F.lit("corrupt").alias("reason"), none.alias("kind"), none.alias("uid"), "bucket", F.col("_corrupt").alias("detail"))
    each = lines.where(F.col("_corrupt").isNull() & F.col("uid").isNotNull()).groupBy("uid", "want").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("bucket") != F.col("want"), F.col("bucket"))).alias("elsewhere"), F.bool_or(F.col("bucket") == F.col("want")).alias("home")
    )
    placed = each.where("elsewhere IS NOT NULL").select(F.lit("placed"), none, "uid", F.col("elsewhere"), F.concat(F.lit("belongs in "), F.col("want").cast("string")))
    repeated = each.where("n > 1").select(F.lit("repeated"), none, "uid", F.col("want"), F.col("n").cast("string"))
    names = refs.groupBy("kind", "uid").agg(F.count(F.lit(1)).alias("names"))
    lost = names.join(each.where("home").select("uid").hint("merge"), "uid", "left_anti")
    missing = lost.select(F.lit("missing"), "kind", "uid", hashed(F.col("uid"), buckets), F.concat(F.col("names").cast("string"), F.lit(" names")))
    return corrupt.union(placed).union(repeated).union(missing)


def coverage_by_assembly(entities: DataFrame, coords: DataFrame, repeats: DataFrame, first: str = "hg38", second: str = "t2t") -> DataFrame:
    """Entities with the first assembly, with the second alone, with neither; with repeats, and with repeats on an assembly they have no coordinate on.

    ``repeats`` has the ``uid, assembly`` of each repeat of an entity.
    """
    marks = coords.select("uid", "assembly", F.lit(False).alias("r")).unionByName(repeats.select("uid", "assembly", F.lit(True).alias("r")))
    pairs = marks.groupBy("uid", "assembly").agg(F.bool_or("r").alias("r"), F.bool_or(~F.col("r")).alias("c"))
    seen = pairs.groupBy("uid").agg(
        F.bool_or(F.col("c") & (F.col("assembly") == first)).alias("a"), F.bool_or(F.col("c") & (F.col("assembly") == second)).alias("b"), F.bool_or("r").alias("r"), F.bool_or(F.col("r") & ~F.col("c")).alias("lost")
    )
    flags = entities.select("uid").join(seen, "uid", "left").select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("a", "b", "r", "lost")])
    return flags.agg(
        F.count("*").alias("n_entities"), F.count_if("a").alias("n_first"), F.count_if(~F.col("a") & F.col("b")).alias("n_second_only"), F.count_if(~F.col("a") & ~F.col("b")).alias("n_neither"),
        F.count_if("r").alias("n_with_repeats"), F.count_if("lost").alias("n_repeats_without_coordinate"),
    )


def child_coverage(entities: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """For each child table: rows, entities with any, and their share."""
    counts = None
    for name, child in children.items():
        one = child.groupBy("uid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_entities")).select(F.lit(name).alias("child"), "n_rows", "n_entities")
        counts = one if counts is None else counts.unionByName(one)
    total = entities.agg(F.count("*")).scalar()
    return counts.select("child", "n_rows", "n_entities", (F.col("n_entities") / total).alias("share"))


def outside(rows: DataFrame, allowed: list[str], column: str) -> DataFrame:
    """Distinct values of a column that are not allowed, with ``reason``; a table without rows is a fault of its own."""
    values = rows.select(column).distinct().where(~F.col(column).isin(*allowed) | F.col(column).isNull()).withColumn("reason", F.lit("unexpected"))
    empty = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast(rows.schema[column].dataType).alias(column), F.lit("empty").alias("reason"))
    return values.unionByName(empty)


def uneven_exons(tx: DataFrame) -> DataFrame:
    """Transcripts whose exon starts and ends differ in number, or are missing."""
    return tx.where(F.coalesce(F.size("exonStarts") != F.size("exonEnds"), F.lit(True)) | (F.size("exonStarts") < 1))


def count_check(one: DataFrame, other: DataFrame) -> DataFrame:
    """Row counts of two tables and whether they are equal."""
    counts = one.agg(F.count("*").alias("n_one")).select("n_one", other.agg(F.count("*")).scalar().alias("n_other"))
    return counts.withColumn("ok", F.col("n_one") == F.col("n_other"))


def median(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, median``: the exact median of a whole-number column, the mean of the two middle values if there are two.

    First counts of ranges, of which each power of two has up to 1,024; then counts of the values of the one or two
    ranges in the middle.  No buffer ever holds a group's values.  Nulls are left out; without values there is no row.
    """
    value = F.col(column).cast("long")
    low = F.when(F.abs(value) < 1024, value).otherwise(F.expr(f"CAST({column} AS LONG) - pmod(CAST({column} AS LONG), shiftleft(1L, CAST(floor(log2(abs(CAST({column} AS DOUBLE)))) AS INT) - 10))"))
    held = rows.where(value.isNotNull()).select(*by, value.alias("_v"), low.alias("_range"))
    order = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    middle = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    first, last = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = middle.where((F.col("_before") <= last) & (F.col("_before") + F.col("_n") > first)).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_r"), "_before", "_all")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    values = held.join(middle, same).groupBy(*by, "_range", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"))
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    at = values.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hit = lambda place: F.max(F.when((F.col("_at") <= place) & (F.col("_at") + F.col("_n") > place), F.col("_v")))
    return at.groupBy(*by).agg(((hit(first) + hit(last)) / F.lit(2.0)).alias("median")).where("median IS NOT NULL")


def crosscheck(rows: DataFrame, others: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Of ``rows``: how many ``others`` has exactly (``key``), how many overlap one of the same name, and median shifts of the rest.

    ``pairs`` are overlapping rows of the same name with ``shift``, the difference of their starts.  Each row gets a mark
    for the one and the smallest shift for the other, and one pass over the marks counts all.
    """
    there = others.select(*key).distinct().withColumn("_exact", F.lit(True))
    nearest = pairs.groupBy("row_id").agg(F.min("shift").alias("_shift"))
    marked = rows.join(there, key, "left").join(nearest, "row_id", "left").select(F.coalesce("_exact", F.lit(False)).alias("exact"), F.col("_shift").alias("shift"))
    marked = materialise(marked, scratch(rows.sparkSession, "marks"))
    moved = ~F.col("exact") & F.col("shift").isNotNull()
    counts = marked.agg(F.count("*").alias("n_rows"), F.count_if("exact").alias("n_exact"), F.count("shift").alias("n_near"), F.count_if(moved).alias("n_shifted"))
    return counts.withColumn("median_shift", median(marked.where(moved), "shift").scalar())
