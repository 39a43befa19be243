"""Nested documents, one for each entity, and what is shown of lists of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import bucket
from tessera.functions.text import position_1based
from tessera.operators.numbering import placed


def project(df: DataFrame, columns: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """The listed columns that exist, without the dropped ones."""
    return df.select(*[c for c in columns if c in df.columns and c not in drop])


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns that are null or empty in every row; one pass counts them all."""
    filled = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if c in keep or filled[c]])


def nested(child: DataFrame, name: str, columns: list[str], key: str = "uid") -> DataFrame:
    """A child table as one row for each entity, its rows an array in order of their fields."""
    return child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def assemble(entities: DataFrame, children: dict[str, DataFrame], lookups: tuple[tuple[DataFrame, str], ...] = (), key: str = "uid") -> DataFrame:
    """Entities with their lookups and children.

    Every child is nested before it is joined, so rows never multiply, and all joins are on one key, so one shuffle
    serves them; they are merges, as a child grows with the entities.  A missing child is null.
    """
    made = entities
    for table, on in lookups:
        made = made.join(table, on, "left")
    for child in children.values():
        made = made.join(child.hint("merge"), key, "left")
    return made


def whole_documents(entities: DataFrame, children: dict[str, DataFrame], key: str = "uid") -> DataFrame:
    """Entities with all their children nested, each an array of its rows in order of their columns, null without any.

    Entities and children are one table of tagged rows, grouped once by ``key``: one shuffle, whatever the number of
    children, and rows never multiply.  Rows of a child whose entity is not there go.
    """
    own = [c for c in entities.columns if c != key]
    tables = {"_self": entities.select(key, *own), **children}
    kinds = {name: F.struct(*[c for c in df.columns if c != key]) for name, df in tables.items()}
    types = {name: df.select(kinds[name].alias("s")).schema["s"].dataType for name, df in tables.items()}
    made = None
    for name, df in tables.items():
        tagged = df.select(key, *[(kinds[name] if n == name else F.lit(None).cast(types[n])).alias(n) for n in tables])
        made = tagged if made is None else made.union(tagged)
    lists = [F.array_sort(F.collect_list(name)).alias(name) for name in children]
    grouped = made.groupBy(key).agg(F.first("_self", ignorenulls=True).alias("_self"), *lists).where("_self IS NOT NULL")
    return grouped.select(key, *[F.col("_self")[c].alias(c) for c in own], *[F.when(F.size(name) > 0, F.col(name)).alias(name) for name in children])


def best_hits(hits: DataFrame, flag: str = "is_best_by_sw_score") -> DataFrame:
    """Hits that are marked the best of their entity."""
    return hits.where(F.col(flag) == 1)


def mark_best(hits: DataFrame, score: str, ties: list[str], flag: str = "is_best_by_sw_score") -> DataFrame:
    """Marks the hit of the highest score of each entity, the first by ``ties`` among equals."""
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col(score).desc(), *ties))
    return hits.withColumn(flag, F.when(place == 1, 1).otherwise(0))


def only_child(rows: Column) -> Column:
    """The first of a list of 0 or 1 rows, or null."""
    return F.get(rows, F.lit(0))


def preferred_coordinate(coords: DataFrame, order: tuple[str, ...] = ("hg38", "t2t")) -> DataFrame:
    """One coordinate for each entity: of the first assembly that has one, by chromosome and start."""
    rank = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("assembly"))
    known = coords.where(F.col("assembly").isin(*order))
    best = F.min(F.struct(rank.alias("rank"), "chrom", "start0", "end0", "assembly")).alias("b")
    return known.groupBy("uid").agg(best).select("uid", "b.assembly", "b.chrom", "b.start0", "b.end0")


def list_rows(entities: DataFrame, coords: DataFrame, assembly: str = "hg38") -> DataFrame:
    """One narrow row for each entity, with its first coordinate on the assembly or null; none goes through the driver."""
    first = coords.where(F.col("assembly") == assembly).groupBy("uid").agg(F.min(F.struct("chrom", "start0", "end0")).alias("c"))
    shown = entities.join(first.hint("merge"), "uid", "left")
    return shown.select("uid", "combined_id", "grp", "band", "origin", "c.chrom", "c.start0", "c.end0", position_1based(F.col("c.chrom"), F.col("c.start0"), F.col("c.end0")).alias("position"))


def pages(rows: DataFrame, lists: str, order: list[str], size: int = 100) -> DataFrame:
    """Adds ``page`` (from 0), ``n_pages`` and ``shown`` ("lo-hi of n") to the rows of each list.

    Rows are numbered over all lists at once, so that a list of any length is spread over tasks.
    """
    ready = placed(rows, [lists], order)
    page = F.floor(F.col("_place") / size).cast("long")
    low, high = page * size + 1, F.least((page + 1) * size, F.col("_size"))
    shown = F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" of "), F.col("_size").cast("string"))
    return ready.select(*rows.columns, page.alias("page"), F.greatest(F.ceil(F.col("_size") / size), F.lit(1)).cast("long").alias("n_pages"), shown.alias("shown"))


def page_of(rows: DataFrame, order: list[str], page: int, size: int = 100) -> DataFrame:
    """One page of a whole table, clamped to those there are."""
    n_pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset(min(max(page, 0), n_pages - 1) * size).limit(size)


def bucket_sizes(documents: DataFrame, buckets: int, payload: Column) -> DataFrame:
    """Rows and bytes of each bucket of documents."""
    placed = documents.select(bucket(F.col("uid"), buckets).alias("bucket"), F.octet_length(payload).alias("_bytes"))
    return placed.groupBy("bucket").agg(F.count("*").alias("n_documents"), F.sum("_bytes").alias("n_bytes"))


def bundle_totals(sizes: DataFrame) -> DataFrame:
    """Buckets, documents, and mean and largest bytes of a bucket."""
    return sizes.agg(F.count("*").alias("n_buckets"), F.sum("n_documents").alias("n_documents"), F.sum("n_bytes").alias("n_bytes"), F.avg("n_bytes").alias("mean_bytes"), F.max("n_bytes").alias("max_bytes"))


def tracks(lanes: dict[str, DataFrame]) -> DataFrame:
    """Lanes of features ``uid, label, start0, end0, w0, w1`` as one table, clipped and placed in the window, 0 to 1."""
    made = None
    for name, lane in lanes.items():
        rows = lane.where((F.col("end0") > F.col("w0")) & (F.col("start0") < F.col("w1"))).select("uid", F.lit(name).alias("lane"), "label", "start0", "end0", "w0", "w1")
        made = rows if made is None else made.unionByName(rows)
    clip = lambda p: F.least(F.greatest(F.col(p), F.col("w0")), F.col("w1"))
    span = (F.col("w1") - F.col("w0")).cast("double")
    return made.select("uid", "lane", "label", clip("start0").alias("clip_start"), clip("end0").alias("clip_end"), ((clip("start0") - F.col("w0")) / span).alias("x0"), ((clip("end0") - F.col("w0")) / span).alias("x1"))


