"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target number of words.  ``target / source_size`` is the expected number of copies of each of
its documents: its whole part is allocated with certainty, and the rest is an inclusion probability.  Documents are
ranked by the odds of a random number divided by the odds of their inclusion, and the first ones are taken until the
words left to allocate are used up, which makes the sample's size fixed in words.

Only one row per source and one row per source and rank bucket is ever brought together: the rank at which a source
is cut is found by sums over buckets of the rank, then by a running sum inside the one bucket where the cut falls, so
a source that holds a third of all rows is never sorted in one task.

The random number is that of a row: of its id, and of its place among the rows of its source with that id, if there are
several.  Those places come from row numbers over ranges, so an id, or null, may hold a third of all rows as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, Scratch, small
from tessera.operators.numbering import numbered

#: Into how many parts the rows of a source or id are dealt where they meet what is known of it, if such are very many.
SALTS = 32
#: Columns of the result beside those of the documents.
ADDED = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(doc_id: Column, nth: Column, seed: int) -> Column:
    """A number in (0, 1) of the seed, the id and the row's place among those of the id, from 0, so reruns agree."""
    again = F.when(nth > 0, F.concat(F.lit(":"), nth.cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"), again))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``(source, size)`` to one row per source with ``source_size`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total size; a target stops at
    ``cap`` times its source's size, and the excess goes to the others by weight until none is above.  The capped
    sources are a prefix in order of size per weight, so one running sum finds them without a loop.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights)) + 1)
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    staged = (
        by_source.withColumn("weight", weight)
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("size_left", F.sum("source_size").over(everything).cast("double") - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.greatest(F.col("size_left"), F.lit(0.0)) / F.col("weight_left"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.lit(float(cap)) * F.col("source_size"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.row_number().over(ratio).alias("place"), "level"))).over(everything)["level"])
    )
    target = F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("level") * F.col("weight"))
    return staged.select("source", "source_size", target.alias("target"))


def meet(rows: DataFrame, known: DataFrame, keys: dict[str, str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the one row that ``known`` has of their ``keys``, null being a key like others.

    ``known`` is sent to all tasks if it has ``few`` rows; else the rows of a hot key are dealt out over ``SALTS`` by their
    place ``at`` in their file.
    """
    same = reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()))
    if few:
        return rows.join(F.broadcast(known), same, how).drop(*keys.values())
    each = known.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    return dealt.join(each, same & (F.col("salt") == F.col("of")), how).drop(*keys.values(), "salt", "of")


def places_of_repeated(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``file, at, nth`` of the rows whose source has their doc_id more than once, but the first of each (``nth`` 0).

    ``rows`` has ``source, doc_id, text_hash, size, file, at``.  Rows of one id are numbered by text and size; such as
    are the same in these are interchangeable.
    """
    repeated = rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = scratch.write(repeated.select(F.col("source").alias("r_source"), F.col("doc_id").alias("r_doc")), "repeated")
    few, keys = scratch.count("repeated") <= BROADCAST_ROWS, {"source": "r_source", "doc_id": "r_doc"}
    path = f"{scratch.root}/numbered"
    scratch.tables["numbered"] = [path]
    whole = numbered(meet(rows, repeated, keys, few), ["source", "doc_id", "text_hash", "size", "file", "at"], "place", path)
    firsts = whole.groupBy(F.col("source").alias("r_source"), F.col("doc_id").alias("r_doc")).agg(F.min("place").alias("first"))
    placed = meet(whole, firsts, keys, few).select("file", "at", (F.col("place") - F.col("first")).alias("nth"))
    return scratch.write(placed.where("nth > 0"), "nth")


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 42,
    buckets: int = 4096,
    size_col: str | None = None,
    nested: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` and ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``, or in place of the text a column ``size_col`` of ready counts;
    columns of the new names are replaced, all others pass through whatever they are called.  With ``nested`` the columns
    of ``docs`` come as they are in a struct of that name instead.  Sizes and shares are written to the shared folder
    once, as each of the passes below needs them and none needs the text.
    ``taken`` is ``copies * size``.  Null or empty texts have size 0; a source of size 0 has target 0 and no copies.
    Rows with the same doc_id in one source, or with none, are taken each on its own, so that a source of such rows comes
    near its target too; of rows that are the same in text, any may be the one.  Rows are told apart by their place in
    the files that ``docs`` is read from; if it is not read straight from files, it is written first.
    An empty table gives an empty result.

    The target is the source's, so all documents of a source have the same inclusion odds, and dividing by them changes
    no order within it: there the Pareto ranks are a random order with a cut.  Odds differ between sources alone.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    row = F.struct(*docs.columns).alias("row")
    try:
        kept = docs.select(row, "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        kept = scratch.write(docs.select(row), "docs").select("row", "_metadata.file_path", "_metadata.row_index")
    of = lambda c: F.col("row")[c]
    made = F.coalesce(of(size_col), F.lit(0)).cast("long") if size_col else word_count(of("text"))
    text_hash = F.lit(0).cast("long") if size_col else F.xxhash64(of("text"))
    place = F.xxhash64("file_path").alias("file"), F.col("row_index").alias("at")
    sized = kept.select("row", of("doc_id").alias("doc_id"), of("source").alias("source"), made.alias("size"), *place)
    narrow = scratch.write(sized.select("doc_id", "source", "size", "file", "at", text_hash.alias("text_hash")), "sizes")
    nth = places_of_repeated(narrow, scratch)

    def numbered_rows(rows: DataFrame) -> DataFrame:
        if not scratch.count("nth"):
            return rows.withColumn("nth", F.lit(0).cast("long"))
        return rows.join(small(nth, scratch.count("nth")), ["file", "at"], "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long")))

    if scratch.count("nth"):
        narrow = scratch.write(numbered_rows(narrow), "sizes")
        scratch.drop_older("sizes")
    else:
        narrow = numbered_rows(narrow)
    targets = scratch.write(source_targets(narrow, weights, cap), "targets")
    few = scratch.count("targets") <= BROADCAST_ROWS
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = targets.select(F.col("source").alias("s_source"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))

    def of_source(rows: DataFrame, known: DataFrame, column: str, how: str = "inner") -> DataFrame:
        return meet(rows, known, {"source": column}, few, how)

    def ranked(df: DataFrame) -> DataFrame:
        u, p = random_unit(F.col("doc_id"), F.col("nth"), seed), F.col("rest") / F.nullif(F.col("source_size"), F.lit(0))
        rank = F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))
        return of_source(df, shares, "s_source").withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (F.col("rank") + 1) * buckets))

    # where each source is cut: first by buckets of the rank, then inside one bucket
    open_rows = ranked(narrow).where(F.col("rank").isNotNull() & (F.col("size") > 0))
    by_bucket = open_rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("rest").alias("rest"))
    running = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
    cut_bucket = (
        by_bucket.withColumn("upto", running)
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before"))).alias("cut"))
        .select(F.col("source").alias("c_source"), F.col("cut.bucket").alias("c_bucket"), "cut.before")
    )
    met = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket"))
    in_cut = open_rows.join(F.broadcast(cut_bucket) if few else cut_bucket, met)
    through = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "nth"))
    cuts = (
        in_cut.withColumn("through", through)
        .groupBy("source")
        .agg(
            F.first("c_bucket").alias("c_bucket"),
            F.max(F.when(F.col("through") <= F.col("rest"), F.struct("rank", "doc_id", "nth"))).alias("last"),
            (F.first("rest") - F.coalesce(F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))), F.first("before"))).alias("gap"),
        )
        .withColumnRenamed("source", "t_source")
    )
    cuts = scratch.write(cuts, "cuts")

    def selected() -> Column:
        inside = (F.col("bucket") == F.col("c_bucket")) & (F.struct("rank", "doc_id", "nth") <= F.col("last"))
        return F.col("rank").isNotNull() & (F.col("c_bucket").isNull() | (F.col("bucket") < F.col("c_bucket")) | F.coalesce(inside, F.lit(False)))

    # one more document of each source closes the gap that whole documents leave
    closing = (
        of_source(open_rows, cuts, "t_source")
        .where(~selected() & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "doc_id", "nth")).alias("c"))
        .select(F.col("source").alias("x_source"), F.col("c.rank").alias("x_rank"), F.col("c.doc_id").alias("x_doc"), F.col("c.nth").alias("x_nth"))
    )
    decisions = scratch.write(cuts.join(closing, F.col("t_source").eqNullSafe(F.col("x_source")), "left").drop("x_source"), "decisions")
    scratch.keep("docs", "nth", "targets", "decisions")
    decided = of_source(ranked(numbered_rows(sized)), decisions, "t_source", "left")
    closes = F.coalesce((F.col("rank") == F.col("x_rank")) & F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.col("nth") == F.col("x_nth")), F.lit(False))
    copies = (F.col("whole") + F.when(selected() | closes, 1).otherwise(0)).cast("long")
    own = [F.col("row").alias(nested)] if nested else [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return decided.select(*own, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
