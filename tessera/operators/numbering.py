"""Row numbers over a whole order, however large a list of it is.

Rows are dealt out by ranges of the order and sorted inside each; a row's number is its place there plus the rows of
the ranges before, of which there is one count each.  No window ever has a list to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import scratch

#: Bits of the place inside a range, as in Spark's increasing ids.
_PLACE = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place", path: str | None = None) -> DataFrame:
    """``rows`` with their place in ``order`` (from 0), which should tell all rows apart.

    The sorted rows are written once, to ``path`` or a folder of the session, so that all who read them see the same ranges.
    """
    path = path or scratch(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    held = rows.sparkSession.read.parquet(path).withColumns({"_range": F.shiftright("_id", _PLACE), "_at": F.col("_id").bitwiseAND(F.lit((1 << _PLACE) - 1))}).drop("_id")
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # one row for each task that wrote
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def placed(rows: DataFrame, lists: list[str], order: list[str], path: str | None = None) -> DataFrame:
    """``rows`` with ``_place``, their place in their list (from 0), and ``_size``, how long the list is; null is a list."""
    whole = numbered(rows, [*lists, *order], "_all", path)
    spans = whole.groupBy(*[F.col(c).alias(f"_of_{c}") for c in lists]).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("_size"))
    same = None
    for c in lists:
        one = F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        same = one if same is None else same & one
    return whole.join(spans, same).withColumn("_place", F.col("_all") - F.col("_first")).drop("_all", "_first", *[f"_of_{c}" for c in lists])
