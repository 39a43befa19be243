"""The search index as written tables, and batches of searches that read them.

Keys are numbered in their order, so the keys that start with a query are a range of numbers.  Where it begins, and how
many keys it has, stands in a table of prefixes: those that several keys share and, of each key, the shortest that it
has alone.  A query looks its own prefixes up there, takes the longest, and asks for no more numbers than its cap lets
it use, however many keys begin so.  No query is compared with keys that it does not want, and no block of keys is hot.

Everything is kept for all keyspaces together (scope ``all``) and for each alone, in ``scope=`` folders.  Tables are
sorted by what they are looked up by, so the first characters of a batch skip row groups by their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import aliases as names
from tessera.operators.documents import list_rows
from tessera.operators.numbering import numbered
from tessera.operators.search import asked, in_tiers, postings
from tessera.sources.files import drop, materialise, scratch

#: First characters by which row groups are skipped; keys are capitals and digits, so a batch has at most 36 + 36 ** 2.
HEAD = 2
#: The scope of all keyspaces together.
ALL = "all"
#: Keys that are compared with their neighbours in one task.
SPAN = 1 << 16
#: Places of the order that one task writes.
RANGE = 1 << 16


def _common(one: Column, other: Column) -> Column:
    """How many first characters two different texts share; null if one is null."""
    return F.array_position(F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1


def _prefixes(keys: DataFrame, key: str, place: str, span: int = SPAN) -> DataFrame:
    """``scope, prefix, first, n``: of prefixes that several keys share, and of the shortest that a key has alone, the range of places.

    A key is compared with the one before and the one after alone.  What it shares with one of them only are prefixes
    whose range begins or ends here, and one character more than with either is the shortest it has alone; so a prefix
    makes two rows at most, however many keys have it.  Neighbours are met in spans of ``span`` places; a key at the edge
    of one is in the span beside it, too.
    """
    at, order = F.col(place), Window.partitionBy("_span").orderBy(place)
    spread = keys.where(F.col(key) != "").select("scope", key, place, F.explode(F.sequence(F.floor((at - 1) / span), F.floor((at + 1) / span))).alias("_span"))
    told = spread.withColumn("_back", F.when(F.lag("scope").over(order) == F.col("scope"), _common(F.lag(key).over(order), F.col(key))))
    told = told.select("scope", key, place, "_span", F.coalesce("_back", F.lit(0)).alias("_back")).withColumn("_ahead", F.coalesce(F.lead("_back").over(order), F.lit(0)))
    told = told.where(F.col("_span") == F.floor(at / span))
    lengths = F.sequence(F.least("_back", "_ahead") + 1, F.least(F.length(key), F.greatest("_back", "_ahead") + 1))
    ends = told.select("scope", at.alias("at"), F.explode(F.transform(lengths, lambda n: F.substr(F.col(key), F.lit(1), n.cast("int")))).alias("prefix"))
    return ends.groupBy("scope", "prefix").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("n"))


def index_parts(aliases: DataFrame, entities: DataFrame, coords: DataFrame, assembly: str, work: str) -> dict[str, tuple[DataFrame, list[str], tuple[int, Column] | None]]:
    """The parts of a search index, each with the columns it is sorted by; ``work`` is a folder for what is numbered.

    Where places number the order of a part, how many ranges of them there are and which one a row is in come third.

    classifier
        the entities of each class, in blocks
    postings
        ``scope, rank, key, alias_type, str, uid, is_current``: what each key means; ``rank`` numbers the keys
    collapsed
        ``scope, of, at, unit, rank``: the keys of each collapsed key (``of`` = ckey), and of each key itself (key); ``at`` numbers the units
    prefixes
        of keys and of collapsed keys, where their ranges are
    listmeta
        what lists show of each entity
    meta
        one row of counts and keyspaces
    """
    post = materialise(postings(aliases), f"{work}/postings")  # which four of the parts and the counts begin from
    scoped = post.withColumn("scope", F.explode(F.array(F.lit(ALL), "alias_type")))
    keys = numbered(scoped.select("scope", "key", "ckey").distinct(), ["scope", "key"], "rank", f"{work}/keys")
    folded = numbered(keys.select("scope", "ckey").distinct(), ["scope", "ckey"], "crank", f"{work}/folded")
    both = _prefixes(keys, "key", "rank").withColumn("of", F.lit("key")).unionByName(_prefixes(folded, "ckey", "crank").withColumn("of", F.lit("ckey")))
    units = keys.join(folded.hint("merge"), ["scope", "ckey"]).select("scope", F.lit("ckey").alias("of"), F.col("crank").alias("at"), F.col("ckey").alias("unit"), "rank")
    units = units.unionByName(keys.select("scope", F.lit("key").alias("of"), F.col("rank").alias("at"), F.col("key").alias("unit"), "rank"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    whole = keys.where(F.col("scope") == ALL)
    meta = entities.agg(F.count(F.lit(1)).alias("n_loci")).select(
        "n_loci", count(whole).alias("n_keys"), count(folded.where(F.col("scope") == ALL)).alias("n_collapsed"), count(post).alias("n_postings"),
        F.array(*[F.lit(t) for t in names.IDENTIFIERS]).alias("ident_types"), F.array(*[F.lit(t) for t in names.CLASSIFIERS]).alias("class_types"),
    )
    n, n_folded = (aliases.sparkSession.read.parquet(f"{work}/{part}").count() // RANGE + 1 for part in ("keys", "folded"))
    among = lambda at: F.floor(F.col(at) / RANGE) + F.when(F.col("of") == "ckey", n).otherwise(0)
    return {
        "classifier": (names.class_blocks(aliases), ["alias_type", "value", "block"], None),
        "postings": (scoped.join(keys.drop("ckey").hint("merge"), ["scope", "key"]).select("scope", "rank", "key", "alias_type", "str", "uid", "is_current"), ["scope", "rank"], (n, F.floor(F.col("rank") / RANGE))),
        "collapsed": (units, ["scope", "of", "at", "rank"], (n + n_folded, among("at"))),
        "prefixes": (both, ["scope", "of", "prefix"], (n + n_folded, among("first"))),  # in the order of prefixes their first keys are in order, too
        "listmeta": (list_rows(entities, coords, assembly), ["uid"], None),
        "meta": (meta, [], None),
    }


def write_index(aliases: DataFrame, entities: DataFrame, coords: DataFrame, path: str, assembly: str = "hg38") -> None:
    """Writes all parts of a search index to ``path``, each sorted over its files.

    A part is dealt out by ranges of its order.  Spark would compute it once more to find such ranges, so where places
    number the order they are ranges of places.
    """
    spark = entities.sparkSession
    work = scratch(spark, "index")
    for name, (part, order, ranges) in index_parts(aliases, entities, coords, assembly, work).items():
        dealt = part.repartitionById(ranges[0], ranges[1].cast("int")) if ranges else part.repartitionByRange(*order) if order else part.coalesce(1)
        ready = dealt.sortWithinPartitions(*order) if order else dealt
        writer = ready.write.partitionBy("scope") if "scope" in part.columns else ready.write
        writer.mode("overwrite").parquet(f"{path}/{name}")
    drop(spark, work)


SCHEMAS = {
    "classifier": "alias_type string, value string, block int, first_uid string, last_uid string, n_uids long, uids array<string>",
    "postings": "rank long, key string, alias_type string, str string, uid string, is_current int, scope string",
    "collapsed": "of string, at long, unit string, rank long, scope string",
    "prefixes": "of string, prefix string, first long, n long, scope string",
}


def read_part(spark: SparkSession, path: str, name: str, scope: str | None = None) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    part = reader.parquet(f"{path}/{name}")
    return part if scope is None else part.where(F.col("scope") == scope).drop("scope")


def _begins(column: str, heads: list[str]) -> Column:
    """Whether a sorted column can have to do with texts of these ``heads``: by its bounds, which skip row groups, then by its first characters."""
    first = F.substr(F.col(column), F.lit(1), F.lit(1)).isin(*{h for h in heads if len(h) < HEAD})
    both = F.substr(F.col(column), F.lit(1), F.lit(HEAD)).isin(*{h[:n] for h in heads for n in (1, HEAD)})
    return F.col(column).between(min(h[:1] for h in heads), max(h + "~" for h in heads)) & (first | both)


def stored_search(queries: DataFrame, path: str, *, cap: int = 200, only_type: str | None = None) -> DataFrame:
    """The hits of ``search`` for each distinct ``q``, from the index in ``path``.

    A query of any length reads at most ``cap`` + 1 keys and 2 ``cap`` + 1 collapsed keys beside the prefixes of itself.
    All joins are merges: what Spark takes for small enough to send to all tasks are packed files and rows before they are
    exploded, which grow with the batch and would go through the driver.
    """
    spark, scope = queries.sparkSession, only_type or ALL
    wanted = materialise(asked(queries), scratch(spark, "asked"))
    sought = F.array(F.struct(F.lit("key").alias("of"), F.col("n").alias("text")), F.struct(F.lit("ckey").alias("of"), F.col("c").alias("text")))
    probes = wanted.select("q", F.inline(sought)).where("text <> ''")
    heads = [r.h for r in probes.select(F.substr("text", F.lit(1), F.lit(HEAD)).alias("h")).distinct().collect()]
    if not heads:
        return in_tiers(spark.createDataFrame([], "q string, tier int, unit_ckey string, key string, str string, alias_type string, uid string, is_current int"), cap)
    own = probes.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda n: F.substr(F.col("text"), F.lit(1), n))).alias("prefix"))
    table = read_part(spark, path, "prefixes", scope).where(_begins("prefix", heads))
    longest = own.join(table.hint("merge"), ["of", "prefix"]).groupBy("of", "q", "text").agg(F.max(F.struct(F.length("prefix").alias("l"), "first", "n")).alias("m"))
    # a longer query than its longest prefix here: one key may begin so, of several none does
    real = longest.where((F.col("m.l") == F.length("text")) | (F.col("m.n") == 1))
    room = F.when(F.col("of") == "key", cap + 1).otherwise(2 * cap + 1)
    places = real.select("of", "q", "text", F.explode(F.sequence(F.col("m.first"), F.col("m.first") + F.least(F.col("m.n"), room) - 1)).alias("at"))
    units = read_part(spark, path, "collapsed", scope).where(_begins("unit", heads))
    met = places.join(units.hint("merge"), ["of", "at"]).where(F.startswith("unit", "text"))
    same, folded = F.col("unit") == F.col("text"), F.col("of") == "ckey"
    tier = F.when(folded, F.when(same, 3).otherwise(4)).otherwise(F.when(same, F.when(F.col("text") == F.upper("q"), 0).otherwise(1)).otherwise(2))
    found = met.select("q", tier.alias("tier"), F.when(folded, F.col("unit")).otherwise("").alias("unit_ckey"), "rank")
    return in_tiers(found.join(read_part(spark, path, "postings", scope).hint("merge"), "rank"), cap)
