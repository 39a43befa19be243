"""String hashes that can be computed the same way outside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def djb2(s: Column) -> Column:
    """h = h * 33 + code point, from 5381, modulo 2 ** 32."""
    points = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(points, F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("long")))


def bucket(s: Column, buckets: int) -> Column:
    return F.pmod(djb2(s), F.lit(buckets)).cast("int")
