"""Names to entities, with ambiguity kept: resolution tables, classifiers, panels and audits of keyspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.numbering import placed
from tessera.operators.quality import median

#: Keyspaces that identify an entity, in order of preference, and keyspaces that classify it.
IDENTIFIERS = ("combined_id", "versioned_id", "telescope_id", "hervd_id", "ervmap_id", "ervmap_alt_name")
CLASSIFIERS = ("dfam_int_model", "dfam_accession", "repbase_name")


def type_order() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in IDENTIFIERS]), F.col("alias_type"))


def resolve(aliases: DataFrame, keyspaces: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """``alias_type, alias, uids, is_current``: every entity a string may mean; null strings mean none."""
    named = aliases.where(F.col("alias_type").isin(*keyspaces) & F.col("alias").isNotNull())
    return named.groupBy("alias_type", "alias").agg(F.sort_array(F.collect_set("uid")).alias("uids"), F.max("is_current").alias("is_current"))


def ambiguity(aliases: DataFrame, keyspaces: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """Strings of each keyspace and how many of them mean more than one entity."""
    named = aliases.where(F.col("alias_type").isin(*keyspaces) & F.col("alias").isNotNull())
    each = named.groupBy("alias_type", "alias").agg((F.min("uid") < F.max("uid")).alias("several"))
    return each.groupBy("alias_type").agg(F.count("*").alias("n_strings"), F.count_if("several").alias("n_ambiguous"))


def class_members(aliases: DataFrame, keyspaces: tuple[str, ...] = CLASSIFIERS) -> DataFrame:
    """``alias_type, value, uid``: each entity of each class once."""
    named = aliases.where(F.col("alias_type").isin(*keyspaces) & F.col("alias").isNotNull())
    return named.select("alias_type", F.col("alias").alias("value"), "uid").distinct()


def class_blocks(aliases: DataFrame, keyspaces: tuple[str, ...] = CLASSIFIERS, most: int = 1000) -> DataFrame:
    """``alias_type, value, block, first_uid, last_uid, n_uids, uids``: the entities of each class in order, in blocks.

    A block has ``most`` uids, the last of a class may have fewer, so no row and no group grows with a class.
    """
    ready = placed(class_members(aliases, keyspaces), ["alias_type", "value"], ["uid"])
    blocks = ready.groupBy("alias_type", "value", F.floor(F.col("_place") / most).cast("int").alias("block"))
    listed = blocks.agg(F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"), F.count(F.lit(1)).alias("n_uids"), F.sort_array(F.collect_list("uid")).alias("uids"))
    return listed.select("alias_type", "value", "block", "first_uid", "last_uid", "n_uids", "uids")


def class_directory(aliases: DataFrame, keyspaces: tuple[str, ...] = CLASSIFIERS) -> DataFrame:
    """``alias_type, value, n_uids``: how many entities each class has, without listing them."""
    return class_members(aliases, keyspaces).groupBy("alias_type", "value").agg(F.count(F.lit(1)).alias("n_uids"))


def classifier_sizes(aliases: DataFrame, keyspaces: tuple[str, ...] = CLASSIFIERS) -> DataFrame:
    """Number of classes of each keyspace and the median of their sizes, cut to a whole number."""
    each = class_directory(aliases, keyspaces)
    middle = median(each, "n_uids", ("alias_type",)).select("alias_type", F.floor("median").cast("long").alias("median_size"))
    return each.groupBy("alias_type").agg(F.count("*").alias("n_values")).join(middle, "alias_type")


def classifier_menu(directory: DataFrame, query: str = "", most: int = 60) -> DataFrame:
    """The first values of each keyspace of a ``class_directory`` that hold the query (all, if it is empty), by length, then by spelling."""
    found = directory.where(F.contains(F.upper("value"), F.upper(F.lit(query)))) if query else directory
    place = F.row_number().over(Window.partitionBy("alias_type").orderBy(F.length("value"), "value"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("alias_type", "value", "n_uids", "place")


def alias_panel(aliases: DataFrame) -> DataFrame:
    """For each entity and keyspace its strings, each with its assignment once, in order."""
    first = F.row_number().over(Window.partitionBy("uid", "alias_type", "alias", "assignment").orderBy(F.col("is_current").desc()))
    once = aliases.withColumn("_first", first).where("_first = 1")
    listed = F.array_sort(F.collect_list(F.struct("alias", "assignment", "is_current")))
    return once.groupBy("uid", "alias_type").agg(listed.alias("names"))


def keyspace_collisions(aliases: DataFrame, one: str, other: str) -> DataFrame:
    """Strings that two keyspaces share, and whether they are bare numbers."""
    of = lambda t: aliases.where((F.col("alias_type") == t) & F.col("alias").isNotNull()).select("alias")
    return of(one).intersect(of(other)).withColumn("numeric", F.col("alias").rlike("^[0-9]+$"))


#: Tasks that share the pairs of one string.
SHARES = 8


def misrouted(aliases: DataFrame, key: str = "combined_id", assignment: str = "r2") -> DataFrame:
    """Rows that a join on the string alone would also send to another entity than a join on string and assignment.

    There are far more pairs than rows, so tasks are not merged by the size of what they read, no side goes through the
    driver, and the rows of a string are dealt out to several tasks.
    """
    rows = aliases.where(F.col("alias_type") == key).select("uid", "alias", "assignment")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = rows.where(F.col("assignment") == assignment).select("alias", F.col("uid").alias("right_uid"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    left = rows.withColumn("_share", F.pmod(F.hash("uid"), F.lit(SHARES))).repartition(tasks, "alias", "_share")
    met = left.join(right.repartition(tasks, "alias", "_share").hint("merge"), ["alias", "_share"])
    return met.where(F.col("uid") != F.col("right_uid")).select("alias", "uid", "right_uid", "assignment")


def prefix_mismatch(entities: DataFrame) -> DataFrame:
    """By group: entities, and how many have a key whose leading capitals differ from the group."""
    differs = F.regexp_extract("uid", "^[A-Z]+", 0) != F.col("grp")
    return entities.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(differs).alias("n_mismatch"))


def collapse_merges(postings: DataFrame) -> DataFrame:
    """Collapsed keys that bring together keys which mean different sets of entities."""
    sets = postings.groupBy("ckey", "key").agg(F.array_join(F.sort_array(F.collect_set("uid")), ",").alias("uids"))
    found = sets.groupBy("ckey").agg(F.count("*").alias("n_keys"), F.countDistinct("uids").alias("n_sets"))
    return found.where((F.col("n_keys") > 1) & (F.col("n_sets") > 1))
