"""Annotation text to typed rows: exon lines to transcripts, repeat lines to repeat calls, with rejects kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import class_of, family_of, quoted_attribute, strand_of
from tessera.operators.intervals import interval_join, merge_intervals, overlap_length

REPEAT_FIELDS = 15


def _gtf_fields(lines: DataFrame, features: tuple[str, ...]) -> DataFrame:
    once = lines.select(F.explode(F.array(F.struct("line", F.split("line", "\t").alias("f")))).alias("x"))  # so that a line is split once
    fields = once.select("x.line", "x.f").where(F.col("line").isNotNull() & ~F.startswith(F.col("line"), F.lit("#")))
    wanted = fields.where((F.size("f") >= 9) & F.get("f", F.lit(2)).isin(*features))
    at = lambda i: F.get("f", F.lit(i))
    read = F.struct(
        "line",
        at(0).alias("chrom"),
        F.expr("try_cast(trim(f[3]) AS BIGINT)").alias("s1"),
        F.expr("try_cast(trim(f[4]) AS BIGINT)").alias("e1"),
        at(6).alias("strand"),
        quoted_attribute(at(8), "transcript_id").alias("name"),
        quoted_attribute(at(8), "gene_name").alias("gene_name"),
        quoted_attribute(at(8), "gene_id").alias("gene_id"),
    )
    return wanted.select(F.explode(F.array(read)).alias("y")).select("y.*")  # so that filters on what is read do not read it again


def _gtf_fault() -> Column:
    return F.when(F.col("s1").isNull() | F.col("e1").isNull(), "coordinates").when(F.col("name").isNull(), "transcript_id")


def exons(lines: DataFrame, features: tuple[str, ...] = ("exon",)) -> DataFrame:
    """``name, name2, chrom, start0, end0, strand`` of each good line of ``line``; 1-based inclusive becomes half-open.

    Lines that are comments, have under nine fields or are of another feature are not exons; see ``exon_rejects`` for
    those that are but cannot be read.
    """
    good = _gtf_fields(lines, features).where(_gtf_fault().isNull())
    return good.select("name", F.coalesce("gene_name", "gene_id", "name").alias("name2"), "chrom", (F.col("s1") - 1).alias("start0"), F.col("e1").alias("end0"), "strand")


def exon_rejects(lines: DataFrame, features: tuple[str, ...] = ("exon",)) -> DataFrame:
    """``line, fault`` of wanted lines without whole coordinates or without a transcript."""
    return _gtf_fields(lines, features).withColumn("fault", _gtf_fault()).where(F.col("fault").isNotNull()).select("line", "fault")


def transcripts(exon_rows: DataFrame) -> DataFrame:
    """One row for each transcript and chromosome, exons in order: name, name2, chrom, txStart, txEnd, strand, exonStarts, exonEnds."""
    listed = F.array_sort(F.collect_list(F.struct("start0", "end0")))
    first = F.min(F.struct("start0", "end0", "name2", "strand"))
    made = exon_rows.groupBy("name", "chrom").agg(listed.alias("x"), F.min("start0").alias("txStart"), F.max("end0").alias("txEnd"), first.alias("h"))
    return made.select("name", F.col("h.name2").alias("name2"), "chrom", "txStart", "txEnd", F.col("h.strand").alias("strand"), F.col("x.start0").alias("exonStarts"), F.col("x.end0").alias("exonEnds"))


def transcript_bounds(exon_rows: DataFrame) -> DataFrame:
    """``name, name2, chrom, txStart, txEnd`` as ``transcripts`` has them, without lists of exons, which cost more than all the rest."""
    first = F.min(F.struct("start0", "end0", "name2"))
    made = exon_rows.groupBy("name", "chrom").agg(F.min("start0").alias("txStart"), F.max("end0").alias("txEnd"), first.alias("h"))
    return made.select("name", F.col("h.name2").alias("name2"), "chrom", "txStart", "txEnd")


def split_transcripts(exon_rows: DataFrame) -> DataFrame:
    """Transcript ids that occur on several chromosomes."""
    return exon_rows.groupBy("name").agg(F.countDistinct("chrom").alias("n_chroms")).where(F.col("n_chroms") > 1)


def with_exons(tx: DataFrame) -> DataFrame:
    return tx.where(F.size("exonStarts") > 0)


def first_transcripts(tx: DataFrame) -> DataFrame:
    """One row for each (name, chrom, txStart), as tiles that overlap deliver a transcript more than once."""
    return tx.groupBy("name", "chrom", "txStart").agg(F.min(F.struct(*[c for c in tx.columns if c not in ("name", "chrom", "txStart")])).alias("h")).select("name", "chrom", "txStart", "h.*").select(*tx.columns)


def _repeat_fields(lines: DataFrame) -> DataFrame:
    once = lines.select(F.explode(F.array(F.struct("line", F.split(F.trim("line"), r"\s+").alias("f")))).alias("x"))  # so that a line is split once
    return once.select("x.line", "x.f").where(F.col("line").isNotNull())


def repeats(lines: DataFrame) -> DataFrame:
    """Typed rows of lines of exactly 15 fields: chrom, start0, end0, strand, rep_name, rep_class, rep_family, sw_score, pct_div."""
    at = lambda i: F.get("f", F.lit(i))
    rows = _repeat_fields(lines).where(F.size("f") == REPEAT_FIELDS)
    return rows.select(
        at(4).alias("chrom"),
        (at(5).try_cast("long") - 1).alias("start0"),
        at(6).try_cast("long").alias("end0"),
        strand_of(at(8)).alias("strand"),
        at(9).alias("rep_name"),
        class_of(at(10)).alias("rep_class"),
        family_of(at(10)).alias("rep_family"),
        at(0).try_cast("long").alias("sw_score"),
        at(1).try_cast("double").alias("pct_div"),
    )


def malformed_repeats(lines: DataFrame) -> DataFrame:
    """Lines that start with a number but have another count of fields; headers are no faults."""
    return _repeat_fields(lines).where((F.size("f") != REPEAT_FIELDS) & F.col("f")[0].rlike("^[0-9]+$")).select("line")


def repeats_in_windows(rows: DataFrame, wins: DataFrame, *, width: int = 4096) -> DataFrame:
    """One row for each repeat and window it overlaps, with ``overlap_bp``; windows are ``uid, chrom, w0, w1``."""
    joined = interval_join(rows, wins.select("uid", "chrom", "w0", "w1"), width=width)
    overlap = overlap_length(F.col("start0"), F.col("end0"), F.col("w0"), F.col("w1"))
    return joined.withColumn("overlap_bp", overlap).drop("w0", "w1")


#: The classes of interspersed repeats, sure and unsure.
INTERSPERSED = ("LINE", "SINE", "LTR", "LTR?", "DNA", "DNA?", "Retroposon", "RC", "SINE?", "LINE?")


def of_classes(rows: DataFrame, classes: tuple[str, ...] | None = INTERSPERSED) -> DataFrame:
    """Interspersed repeats, or all of them without ``classes``."""
    return rows if classes is None else rows.where(F.col("rep_class").isin(*classes))


def tagged(rows: DataFrame, assembly: str, source: str | None = None) -> DataFrame:
    """Rows with the assembly they belong to, and where they came from."""
    rows = rows.withColumn("assembly", F.lit(assembly))
    return rows if source is None else rows.withColumn("source", F.lit(source))


def ingest_stats(lines: DataFrame, wins: DataFrame) -> DataFrame:
    """One row: data lines, malformed lines, lines and chromosomes without windows, repeats in windows, pairs."""
    rows = repeats(lines).withColumn("_id", F.monotonically_increasing_id())
    counts = _repeat_fields(lines).agg(
        F.count_if(F.size("f") == REPEAT_FIELDS).alias("data_lines"),
        F.count_if((F.size("f") != REPEAT_FIELDS) & F.col("f")[0].rlike("^[0-9]+$")).alias("malformed"),
    )
    lost = rows.join(wins.select("chrom").distinct(), "chrom", "left_anti").agg(F.countDistinct("chrom").alias("unplaced_chroms"), F.count("*").alias("unplaced_lines"))
    met = repeats_in_windows(rows, wins).groupBy("_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("repeats_in_window"), F.coalesce(F.sum("n"), F.lit(0)).alias("locus_repeat_pairs"))
    beside = counts.select("*", lost.select(F.struct("*")).scalar().alias("l"), met.select(F.struct("*")).scalar().alias("m"))
    return beside.select("data_lines", "malformed", "l.*", "m.*")


def class_frequencies(rows: DataFrame, most: int = 12) -> DataFrame:
    return rows.groupBy("rep_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rep_class").limit(most)


def transcripts_in_windows(tx: DataFrame, wins: DataFrame, *, width: int = 4096, distinct: bool = False) -> DataFrame:
    """One row for each transcript and window of the same chromosome; one that starts at the window's end still counts.

    Bounds alone go through the interval join; exons are attached to what it leaves.  Transcripts that are ``distinct``, so
    that name and chromosome tell them apart, as ``transcripts`` makes them, need no look for copies.
    """
    key = ["name", "chrom", "txStart"]
    once = wins.select("uid", "chrom", "w0", "w1").dropDuplicates(["uid", "chrom", "w0", "w1"])
    if distinct:
        bounds = interval_join(tx.select(*key, "txEnd"), once, width=width, start="txStart", end="txEnd", right_inclusive=True)
        return bounds.select("uid", *key, "w0", "w1").join(tx.hint("merge"), key).select("uid", *tx.columns, "w0", "w1")
    bounds = interval_join(tx.select(*key, "txEnd").distinct(), once, width=width, start="txStart", end="txEnd", right_inclusive=True)
    placed = bounds.dropDuplicates(["uid", *key]).select("uid", *key, "w0", "w1")
    return placed.join(first_transcripts(tx), key).select("uid", *tx.columns, "w0", "w1")


def gene_models(placed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Isoforms of one gene label and entity as one row; only exons inside the window count, strictly.

    ``uid, gene, n_isoforms, start0, end0, strand, exons`` (the union of the isoforms' exons in the window, touching ones
    merged, by start), ``n_exons`` of it, and ``intron_only`` if no exon lies in the window.  All steps are of one entity and
    gene, so rows are dealt out by these alone, to ``partitions`` tasks if that is given: who knows how many rows there
    are so keeps the memory of a task the same at any size.
    """
    inside = F.filter(F.arrays_zip("exonStarts", "exonEnds"), lambda x: (x["exonEnds"] > F.col("w0")) & (x["exonStarts"] < F.col("w1")))
    shown = placed.where((F.col("txStart") < F.col("w1")) & (F.col("txEnd") > F.col("w0"))).withColumn("inside", inside)
    head = F.min(F.struct("txStart", "txEnd", "name", "strand"))
    labelled = shown.withColumn("gene", F.coalesce("name2", "name")).repartition(*([partitions] if partitions else []), "uid", "gene")
    made = labelled.groupBy("uid", "gene").agg(F.count("*").alias("n_isoforms"), F.min("txStart").alias("start0"), F.max("txEnd").alias("end0"), head["strand"].alias("strand"))
    exon_rows = labelled.select("uid", "gene", F.explode("inside").alias("x")).select("uid", "gene", F.col("x.exonStarts").alias("start0"), F.col("x.exonEnds").alias("end0"))
    union = merge_intervals(exon_rows, ["uid", "gene"])
    listed = union.groupBy("uid", "gene").agg(F.array_sort(F.collect_list(F.struct("start0", "end0"))).alias("exons"))
    models = made.join(listed, ["uid", "gene"], "left")
    models = models.withColumn("exons", F.coalesce("exons", F.array().cast("array<struct<start0: bigint, end0: bigint>>"))).withColumn("n_exons", F.size("exons").cast("long"))
    return models.withColumn("intron_only", F.col("n_exons") == 0)
