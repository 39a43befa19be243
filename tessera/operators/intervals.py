"""Half-open intervals: windows, overlap joins, unions, tiles and clipping.

Columns are ``chrom, start0, end0`` (0-based, half-open); a padded window has ``w0, w1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals over this many bins long are joined on bins ``COARSE`` times as wide.
LONG, COARSE = 64, 256


def windows(df: DataFrame, pad: int = 1000, start: str = "start0", end: str = "end0") -> DataFrame:
    """Adds ``w0`` and ``w1``: the interval padded, not below 0."""
    return df.withColumn("w0", F.greatest(F.col(start) - pad, F.lit(0))).withColumn("w1", F.col(end) + pad)


def overlaps(start: Column, end: Column, w0: Column, w1: Column, right_inclusive: bool = False) -> Column:
    return (start <= w1 if right_inclusive else start < w1) & (end > w0)


def overlap_length(start: Column, end: Column, w0: Column, w1: Column) -> Column:
    return F.least(end, w1) - F.greatest(start, w0)


def clip(p: Column, w0: Column, w1: Column) -> Column:
    return F.least(F.greatest(p, w0), w1)


def _floor(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def interval_join(
    features: DataFrame,
    wins: DataFrame,
    *,
    width: int = 4096,
    key: str = "chrom",
    start: str = "start0",
    end: str = "end0",
    w0: str = "w0",
    w1: str = "w1",
    right_inclusive: bool = False,
) -> DataFrame:
    """Each overlapping pair of a feature and a window once.

    Both sides are cut into bins of ``width`` and joined on (key, grid, bin), so one crowded key is spread over its bins.
    Intervals of over ``LONG`` bins would be repeated too often: pairs in which one is so long meet on grids of bins
    ``COARSE`` times as wide, one grid for long windows beside short features and one for long features.  Which grids a
    row is on is decided row by row, so one join serves all.  Short features, the larger side as a rule, are on the
    second grid only if there is a long window at all, which a look at the windows tells the job before it joins.
    Apart from ``key`` the two sides may not share column names.  The join is a merge: windows are exploded, and what Spark
    takes for small is their packed file, so it would send all of them through the driver.
    """
    limit, wide = LONG * width, COARSE * width
    last = F.greatest(F.col(end) - 1, F.col(start))
    reach = F.greatest(F.col(w1) if right_inclusive else F.col(w1) - 1, F.col(w0))
    long_feature, long_window = F.col(end) - F.col(start) > limit, F.col(w1) - F.col(w0) > limit

    def bins(grid: int, low: Column, high: Column, size: int) -> Column:
        return F.transform(F.sequence(_floor(low, size), _floor(high, size)), lambda b: F.struct(F.lit(grid).alias("grid"), b.alias("bin")))

    some_long = F.coalesce(wins.agg(F.bool_or(long_window)).scalar(), F.lit(False))
    fine = bins(0, F.col(start), last, width)
    of_feature = F.when(long_feature, bins(2, F.col(start), last, wide)).when(some_long, F.concat(fine, bins(1, F.col(start), last, wide))).otherwise(fine)
    of_window = F.concat(F.when(long_window, bins(1, F.col(w0), reach, wide)).otherwise(bins(0, F.col(w0), reach, width)), bins(2, F.col(w0), reach, wide))
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    a = features.where(whole).withColumn("_at", F.explode(of_feature)).withColumns({"_grid": F.col("_at.grid"), "_bin": F.col("_at.bin")}).drop("_at")
    b = wins.withColumn("_at", F.explode(of_window)).withColumns({"_grid": F.col("_at.grid"), "_bin": F.col("_at.bin")}).drop("_at")
    size = F.when(F.col("_grid") == 0, width).otherwise(wide)
    met = a.join(b.hint("merge"), [key, "_grid", "_bin"]).where(overlaps(F.col(start), F.col(end), F.col(w0), F.col(w1), right_inclusive))
    first = F.floor(F.greatest(F.col(start), F.col(w0)) / size).cast("long") == F.col("_bin")
    return met.where(first).drop("_grid", "_bin")  # a pair counts in the first bin it shares


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start0", end: str = "end0") -> DataFrame:
    """The union of the intervals of each key: overlapping and touching ones become one; ``n`` says of how many."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)
    islands = df.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def merge_dense_intervals(df: DataFrame, key: str = "chrom", *, width: int = 1 << 20, start: str = "start0", end: str = "end0") -> DataFrame:
    """As ``merge_intervals`` for keys of very many rows, which are spread over bins of their starts.

    Inside a bin intervals are merged by themselves.  Over bins, of which there is one row each, run the largest end and
    the start of the union's interval that was opened last.  What begins within the end that the bins before reach is
    part of the interval opened last there; anything else opens one.
    """
    binned = merge_intervals(df.withColumn("_bin", _floor(F.col(start), width)), [key, "_bin"], start, end).withColumnRenamed("n", "_n")
    ahead = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = binned.groupBy(key, "_bin").agg(F.max(end).alias("_most"), F.max(start).alias("_last"))
    reached = ends.withColumn("_before", F.max("_most").over(ahead))
    # the last of a bin opens an interval unless it, too, begins within what is reached
    opened = F.when(F.col("_before").isNull() | (F.col("_last") > F.col("_before")), F.col("_last"))
    carried = reached.withColumn("_opened", opened).select(key, "_bin", "_before", F.max("_opened").over(ahead).alias("_open"))
    placed = binned.join(carried.hint("merge"), [key, "_bin"])
    inside = F.col("_before").isNotNull() & (F.col(start) <= F.col("_before"))
    islands = placed.withColumn("_island", F.when(inside, F.col("_open")).otherwise(F.col(start)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_island")


def running_end(df: DataFrame, key: str, w0: str = "w0", w1: str = "w1", *, width: int = 1 << 20) -> DataFrame:
    """Adds ``reach``: the largest end up to here, by start.

    The maximum runs inside bins of ``width`` of the start; what the bins before reach is a running maximum over bins, of
    which there is one row each, so a crowded key is never sorted in one task.
    """
    binned = df.withColumn("_bin", _floor(F.col(w0), width))
    most = binned.groupBy(key, "_bin").agg(F.max(w1).alias("_most"))
    before = F.max("_most").over(Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = most.select(key, "_bin", before.alias("_before"))
    inside = F.max(w1).over(Window.partitionBy(key, "_bin").orderBy(w0, w1).rowsBetween(Window.unboundedPreceding, 0))
    return binned.withColumn("_inside", inside).join(carried.hint("merge"), [key, "_bin"]).withColumn("reach", F.greatest("_inside", "_before")).drop("_bin", "_inside", "_before")


def covered(features: DataFrame, wins: DataFrame, by: tuple[str, ...] = (), *, start: str = "start0", end: str = "end0", right_inclusive: bool = False) -> DataFrame:
    """The distinct ``uid`` (and ``by``) of windows that any feature (of the same ``by``) overlaps, without making the pairs.

    Features are merged into islands first, which meet the same windows: a window that meets an island meets the
    feature that holds the first position of it inside the window.
    """
    grouped = features.select(*(F.col(c).alias(f"_{c}") for c in by), "chrom", F.col(start).alias("start0"), F.col(end).alias("end0"))
    named = grouped.withColumn("_place", F.struct("chrom", *(f"_{c}" for c in by)))
    islands = merge_dense_intervals(named.select("_place", "start0", "end0"), "_place").select("_place.*", "start0", "end0")
    met = interval_join(islands, wins.select("uid", "chrom", "w0", "w1"), right_inclusive=right_inclusive)
    return met.select("uid", *(F.col(f"_{c}").alias(c) for c in by)).distinct()


def tile_cover(wins: DataFrame, tile: int = 2_000_000) -> DataFrame:
    """The distinct ``chrom, tile`` that windows touch, both edge tiles included."""
    return wins.select("chrom", F.explode(F.sequence(_floor(F.col("w0"), tile), _floor(F.col("w1"), tile))).alias("tile")).distinct()


def multiplicity(pairs: DataFrame, columns: list[str], uid: str = "uid") -> DataFrame:
    """For each feature (its ``columns``), ``n_loci``: how many entities' windows it lies in."""
    return pairs.groupBy(*columns).agg(F.countDistinct(uid).alias("n_loci"))
