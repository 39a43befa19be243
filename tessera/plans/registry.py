"""Named queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import hashing, text
from tessera.operators import aliases, annotation, documents, intervals, quality, search, stored_search
from tessera.plans.fixtures import view, with_views
from tessera.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, *views: str):
    """Registers a function of the named views under its name, with its SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        ORACLE[f.__name__] = with_views(list(views), sql)
        return f

    return register


IDENT = "('" + "','".join(aliases.IDENTIFIERS) + "')"
CLASS = "('" + "','".join(aliases.CLASSIFIERS) + "')"
WIN = "win AS (SELECT uid, assembly, chrom, greatest(start0 - 1000, 0) AS w0, end0 + 1000 AS w1 FROM fx_coord WHERE assembly = 'hg38')"
NRM = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
NRMC = "regexp_replace(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), '^(HERV|ERV)', '')"
TYPE_ORDER = "list_position(['" + "','".join(aliases.IDENTIFIERS) + "'], alias_type)"
POSTINGS = f"""tok AS (
  SELECT alias_type, uid, is_current, unnest(CASE WHEN alias_type = 'ervmap_alt_name' THEN list_distinct(list_concat([alias], list_transform(string_split(alias, ','), lambda t: trim(t)))) ELSE [alias] END) AS str
  FROM fx_alias WHERE alias IS NOT NULL AND alias_type IN {IDENT}
), post AS (
  SELECT {NRM.format('str')} AS key, {NRMC.format('str')} AS ckey, alias_type, str, uid, max(is_current) AS is_current
  FROM tok WHERE str <> '' AND {NRM.format('str')} <> '' GROUP BY ALL
)"""


def hg38_windows(coords: DataFrame) -> DataFrame:
    return intervals.windows(coords.where("assembly = 'hg38'")).select("uid", "assembly", "chrom", "w0", "w1")


# ---- names


@query(f"SELECT alias_type, alias, string_agg(DISTINCT uid, ',' ORDER BY uid) AS uids, count(DISTINCT uid) AS n_uids, max(is_current) AS is_current FROM fx_alias WHERE alias IS NOT NULL AND alias_type IN {IDENT} GROUP BY ALL", "fx_alias")
def alias_resolution(a):
    return aliases.resolve(a).select("alias_type", "alias", F.array_join("uids", ",").alias("uids"), F.size("uids").cast("long").alias("n_uids"), "is_current")


@query(f"SELECT alias_type, count(*) AS n_strings, count(*) FILTER (WHERE n > 1) AS n_ambiguous FROM (SELECT alias_type, alias, count(DISTINCT uid) AS n FROM fx_alias WHERE alias_type IN {IDENT} GROUP BY ALL) GROUP BY ALL", "fx_alias")
def alias_ambiguity(a):
    return aliases.ambiguity(a)


CLASS_ROWS = f"SELECT *, row_number() OVER (PARTITION BY alias_type, value ORDER BY uid) AS rn FROM (SELECT DISTINCT alias_type, alias AS value, uid FROM fx_alias WHERE alias IS NOT NULL AND alias_type IN {CLASS})"
CLASS_BLOCKS = f"SELECT alias_type, value, CAST((rn - 1) // 1000 AS INTEGER) AS block, min(uid) AS first_uid, max(uid) AS last_uid, count(*) AS n_uids, string_agg(uid, ',' ORDER BY uid) AS uids FROM ({CLASS_ROWS}) GROUP BY alias_type, value, (rn - 1) // 1000"


@query(CLASS_BLOCKS, "fx_alias")
def classifier_lists(a):
    return aliases.class_blocks(a).withColumn("uids", F.array_join("uids", ","))


@query("SELECT 'lang' AS alias_type, lang AS value, count(DISTINCT doc_id) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source, count(DISTINCT doc_id) FROM documents WHERE source IS NOT NULL GROUP BY ALL", "documents")
def document_classifiers(d):
    rows = d.select(F.col("doc_id").alias("uid"), F.lit(1).alias("is_current"), F.explode(F.array(F.struct(F.lit("lang").alias("alias_type"), F.col("lang").alias("alias")), F.struct(F.lit("source").alias("alias_type"), F.col("source").alias("alias")))).alias("a"))
    return rows.select("a.*", "uid").where("alias IS NOT NULL").groupBy("alias_type", F.col("alias").alias("value")).agg(F.countDistinct("uid").alias("n"))


@query(f"SELECT alias_type, count(*) AS n_values, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_size FROM (SELECT alias_type, alias, count(DISTINCT uid) AS n FROM fx_alias WHERE alias_type IN {CLASS} GROUP BY ALL) GROUP BY ALL", "fx_alias")
def classifier_median(a):
    return aliases.classifier_sizes(a)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias_type ORDER BY length(value), value) AS place FROM (SELECT alias_type, alias AS value, count(DISTINCT uid) AS n_uids FROM fx_alias WHERE alias_type IN {CLASS} AND contains(upper(alias), 'B') GROUP BY ALL)) WHERE place <= 60", "fx_alias")
def classifier_menu(a):
    return aliases.classifier_menu(aliases.class_directory(a), "b").withColumn("place", F.col("place").cast("long"))


@query("SELECT uid, alias_type, string_agg(alias || '/' || assignment || '/' || CAST(is_current AS VARCHAR), ';' ORDER BY alias, assignment) AS names, count(*) AS n FROM (SELECT uid, alias_type, alias, assignment, max(is_current) AS is_current FROM fx_alias GROUP BY ALL) GROUP BY ALL", "fx_alias")
def alias_panel(a):
    names = F.transform("names", lambda n: F.concat_ws("/", n["alias"], n["assignment"], n["is_current"].cast("string")))
    return aliases.alias_panel(a).select("uid", "alias_type", F.array_join(names, ";").alias("names"), F.size("names").cast("long").alias("n"))


@query("SELECT alias, regexp_matches(alias, '^[0-9]+$') AS \"numeric\" FROM (SELECT alias FROM fx_alias WHERE alias_type = 'hervd_id' INTERSECT SELECT alias FROM fx_alias WHERE alias_type = 'ervmap_id')", "fx_alias")
def keyspace_collisions(a):
    return aliases.keyspace_collisions(a, "hervd_id", "ervmap_id")


@query("SELECT a.alias, a.uid, b.uid AS right_uid, a.assignment FROM fx_alias a JOIN fx_alias b ON a.alias = b.alias AND a.alias_type = 'combined_id' AND b.alias_type = 'combined_id' AND b.assignment = 'r2' AND a.uid <> b.uid", "fx_alias")
def naive_join_misroutes(a):
    return aliases.misrouted(a)


@query("SELECT grp, count(*) AS n, count(*) FILTER (WHERE regexp_extract(uid, '^[A-Z]+') <> grp) AS n_mismatch FROM fx_entity GROUP BY ALL", "fx_entity")
def prefix_group_mismatch(e):
    return aliases.prefix_mismatch(e)


# ---- search


@query(f"WITH {POSTINGS} SELECT key, ckey, alias_type, str, uid, is_current FROM post", "fx_alias")
def fuzzy_postings(a):
    return search.postings(a)


@query(f"WITH {POSTINGS} SELECT DISTINCT ckey, key FROM post", "fx_alias")
def collapsed_map(a):
    return search.collapsed_map(search.postings(a))


@query(f"WITH {POSTINGS} SELECT count(DISTINCT key) AS n_keys, count(*) AS n_postings, (SELECT count(*) FROM (SELECT key FROM post GROUP BY key HAVING count(DISTINCT uid) > 1)) AS n_multi, count(DISTINCT ckey) AS n_collapsed FROM post", "fx_alias")
def index_stats(a):
    return search.index_stats(search.postings(a))


@query(f"WITH {POSTINGS}, s AS (SELECT ckey, key, string_agg(DISTINCT uid, ',' ORDER BY uid) AS uids FROM post GROUP BY ALL) SELECT ckey, count(*) AS n_keys, count(DISTINCT uids) AS n_sets FROM s GROUP BY ckey HAVING count(*) > 1 AND count(DISTINCT uids) > 1", "fx_alias")
def collapse_merge_audit(a):
    return aliases.collapse_merges(search.postings(a))


@query(f"WITH {POSTINGS} SELECT p.ckey, p.key FROM (SELECT DISTINCT ckey, key FROM post) p WHERE p.key NOT IN (SELECT {NRM.format('alias')} FROM fx_alias WHERE alias IS NOT NULL)", "fx_alias")
def collapsed_dangling(a):
    known = a.where("alias IS NOT NULL").select(text.normalize_key(F.col("alias")).alias("key"))
    return quality.dangling(search.collapsed_map(search.postings(a)), known, ["key"]).select("ckey", "key")


#: A batch of queries: every telescope id as it is spelled, every group, and names with the other prefix.
BATCH = "asked AS (SELECT DISTINCT q FROM (SELECT alias AS q FROM fx_alias WHERE alias_type IN ('telescope_id', 'dfam_int_model') UNION ALL SELECT 'HERV' || string_split(alias, ',')[1] FROM fx_alias WHERE alias_type = 'ervmap_alt_name'))"
HITS = f"""{POSTINGS}, {BATCH}, qn AS (
  SELECT q, {NRM.format('q')} AS n, {NRMC.format('q')} AS c FROM asked WHERE {NRM.format('q')} <> ''
), keys AS (SELECT DISTINCT key, ckey FROM post), cand AS (
  SELECT q, key, CASE WHEN key = n THEN CASE WHEN n = upper(q) THEN 0 ELSE 1 END ELSE 2 END AS tier, '' AS unit_ckey FROM qn JOIN keys ON starts_with(key, n)
  UNION ALL SELECT q, key, CASE WHEN ckey = c THEN 3 ELSE 4 END, ckey FROM qn JOIN keys ON c <> '' AND starts_with(ckey, c)
), ded AS (
  SELECT q, tier, CASE WHEN tier <= 2 THEN cand.key ELSE unit_ckey END AS unit, str, alias_type, uid, is_current,
    row_number() OVER (PARTITION BY q, uid, str ORDER BY tier, unit_ckey, cand.key, {TYPE_ORDER}) AS rn
  FROM cand JOIN post ON post.key = cand.key
), unit AS (SELECT q, tier, unit, count(*) AS hits FROM ded WHERE rn = 1 GROUP BY ALL), run AS (
  SELECT *, coalesce(sum(hits) OVER (PARTITION BY q ORDER BY tier, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM unit
), early AS (SELECT * FROM run WHERE tier <= 1 OR (tier = 2 AND before < 200)), kept AS (
  SELECT q, tier, unit FROM early
  UNION ALL SELECT r.q, r.tier, r.unit FROM run r LEFT JOIN (SELECT q, sum(hits) AS h FROM early GROUP BY q) e ON e.q = r.q
  WHERE r.tier >= 3 AND coalesce(e.h, 0) < 200 AND (r.tier = 3 OR r.before < 200)
), hits AS (SELECT d.q, d.tier, d.str, d.alias_type, d.uid, d.is_current FROM ded d JOIN kept k ON k.q = d.q AND k.tier = d.tier AND k.unit = d.unit WHERE d.rn = 1)"""


def _asked(a: DataFrame) -> DataFrame:
    spelled = a.where(F.col("alias_type").isin("telescope_id", "dfam_int_model")).select(F.col("alias").alias("q"))
    other = a.where("alias_type = 'ervmap_alt_name'").select(F.concat(F.lit("HERV"), F.split("alias", ",")[0]).alias("q"))
    return spelled.union(other)


#: What this session has written once for all queries, by its kind and the files it was made of.
_WRITTEN: dict[tuple[str, ...], str] = {}


def _once(name: str, source: DataFrame, write: Callable[[str], None], whole: str) -> str:
    """The folder that ``write`` fills from the files of ``source``; if this session has filled it, it is used again.

    ``whole`` is the part of it that is there only when it is complete.
    """
    spark = source.sparkSession
    at = _kept_as(name, source)
    if at not in _WRITTEN or not files.exists(spark, f"{_WRITTEN[at]}/{whole}"):
        path = files.scratch(spark, name)
        write(path)
        _WRITTEN[at] = path
    return _WRITTEN[at]


def _kept_as(name: str, source: DataFrame) -> tuple[str, ...]:
    return (name, source.sparkSession.sparkContext.applicationId, *sorted(source.inputFiles()))


def _index(a: DataFrame, e: DataFrame, c: DataFrame) -> str:
    """The written search index of these tables."""
    return _once("search", a, lambda path: stored_search.write_index(a, e, c, path), "meta/_SUCCESS")


@query(f"WITH {HITS} SELECT q, tier, str, alias_type, uid, is_current FROM hits", "fx_alias", "fx_entity", "fx_coord")
def search_batch_hits(a, e, c):
    return stored_search.stored_search(_asked(a), _index(a, e, c))


@query(
    f"""WITH {HITS}, strs AS (
  SELECT q, str, alias_type, string_agg(DISTINCT uid, ',' ORDER BY uid) AS uids, min(uid) AS first_uid, count(DISTINCT uid) AS n_loci, min(tier) AS tier, min(is_current) AS is_current FROM hits GROUP BY q, str, alias_type
), mem AS (
  SELECT *, {TYPE_ORDER} AS t, row_number() OVER (PARTITION BY q, uids ORDER BY tier, length(str), str, {TYPE_ORDER}) AS pos FROM strs
), alt AS (
  SELECT q, uids, str, alias_type, row_number() OVER (PARTITION BY q, uids ORDER BY pos) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY q, uids, str ORDER BY pos) AS same FROM mem WHERE pos > 1) WHERE same = 1
), also AS (SELECT q, uids, string_agg(str || '/' || alias_type, ';' ORDER BY nth) AS also FROM alt WHERE nth <= 4 GROUP BY q, uids
), rws AS (
  SELECT q, uids, min(first_uid) AS first_uid, max(n_loci) AS n_loci, min(is_current) = 0 AS retired, list({{'tier': tier, 'n': length(str), 'str': str, 't': {TYPE_ORDER}}} ORDER BY tier, length(str), str, {TYPE_ORDER}) AS members FROM strs GROUP BY q, uids
), pl AS (
  SELECT q, uids, n_loci, retired, members[1].tier AS tier, members[1].str AS headline,
    row_number() OVER (PARTITION BY q ORDER BY members[1].tier, length(members[1].str), members[1].str, first_uid) AS place FROM rws
) SELECT q, place, tier, headline, coalesce(also.also, '') AS also, uids, n_loci, retired, CASE WHEN tier = 2 THEN 'prefix' WHEN tier >= 3 THEN 'prefix-collapsed' ELSE '' END AS badge FROM pl LEFT JOIN also USING (q, uids) WHERE place <= 60""",
    "fx_alias", "fx_entity", "fx_coord",
)
def search_batch_grouped(a, e, c):
    rows = search.grouped(stored_search.stored_search(_asked(a), _index(a, e, c)))
    also = F.array_join(F.transform("also", lambda x: F.concat_ws("/", x["str"], x["alias_type"])), ";").alias("also")
    return rows.select("q", F.col("place").cast("long").alias("place"), "tier", "headline", also, F.array_join("uids", ",").alias("uids"), F.col("n_loci").cast("long").alias("n_loci"), "retired", "badge")


@query(f"WITH {HITS.replace('FROM fx_alias WHERE alias IS NOT NULL AND alias_type IN ' + IDENT, 'FROM fx_alias WHERE alias_type = ' + chr(39) + 'ervmap_alt_name' + chr(39))} SELECT q, tier, str, alias_type, uid, is_current FROM hits", "fx_alias", "fx_entity", "fx_coord")
def search_one_keyspace(a, e, c):
    return stored_search.stored_search(_asked(a), _index(a, e, c), only_type="ervmap_alt_name")


@query(f"WITH {HITS} SELECT h.q, h.tier, h.str, h.uid, e.combined_id, e.grp FROM hits h LEFT JOIN fx_entity e USING (uid)", "fx_alias", "fx_entity", "fx_coord")
def search_labelled(a, e, c):
    found = search.labelled(stored_search.stored_search(_asked(a), _index(a, e, c)), e)
    return search.ordered_hits(found).select("q", "tier", "str", "uid", "combined_id", "grp")


@query(f"WITH {POSTINGS} SELECT alias_type, count(DISTINCT str) AS n_strings FROM post GROUP BY alias_type", "fx_alias")
def strings_per_type(a):
    return search.strings_per_type(search.postings(a))


@query(f"WITH {HITS} SELECT q, count(*) AS n_hits, count(DISTINCT uid) AS n_loci, count(*) FILTER (WHERE tier >= 3) AS n_collapsed, count(DISTINCT str) AS n_strings FROM hits GROUP BY q", "fx_alias", "fx_entity", "fx_coord")
def search_hit_summary(a, e, c):
    return search.hit_summary(stored_search.stored_search(_asked(a), _index(a, e, c)))


@query("SELECT uid, combined_id FROM fx_entity WHERE contains(upper(combined_id), upper('an'))", "fx_entity")
def substring_filter(e):
    return search.contains_text(e, "combined_id", "an").select("uid", "combined_id")


@query("SELECT uid, grp FROM fx_entity WHERE starts_with(uid, upper('hervl00001'))", "fx_entity")
def key_prefix_filter(e):
    return search.key_prefix(e, "hervl00001").select("uid", "grp")


# ---- hashes and documents


@query("SELECT url, h AS hash, CAST(h % 400 AS INTEGER) AS bucket FROM (SELECT url, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 33 + c) & 4294967295) AS h FROM pages)", "pages")
def djb2_bucket(p):
    return p.select("url", hashing.djb2(F.col("url")).alias("hash"), hashing.bucket(F.col("url"), 400).alias("bucket"))


DJB2_UID = "CAST(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(uid, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 33 + c) & 4294967295) % 400 AS INTEGER)"


@query(f"SELECT {DJB2_UID} AS bucket, count(*) AS n_documents, CAST(sum(strlen(versioned_id)) AS BIGINT) AS n_bytes FROM fx_entity GROUP BY 1", "fx_entity")
def bucket_stats(e):
    return documents.bucket_sizes(e, 400, F.col("versioned_id"))


@query(f"SELECT count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_documents, CAST(sum(b) AS BIGINT) AS n_bytes, avg(b) AS mean_bytes, max(b) AS max_bytes FROM (SELECT {DJB2_UID} AS bucket, count(*) AS n, CAST(sum(strlen(versioned_id)) AS BIGINT) AS b FROM fx_entity GROUP BY 1)", "fx_entity")
def bundle_totals(e):
    return documents.bundle_totals(documents.bucket_sizes(e, 400, F.col("versioned_id")))


@query(
    """SELECT e.uid, e.grp, a.n_aliases, a.aliases, c.coords, g.genes FROM fx_entity e
LEFT JOIN (SELECT uid, count(*) AS n_aliases, string_agg(alias_type || '=' || alias || '/' || assignment, ';' ORDER BY alias_type, alias, assignment) AS aliases FROM fx_alias GROUP BY uid) a USING (uid)
LEFT JOIN (SELECT uid, string_agg(assembly || ':' || chrom || ':' || CAST(start0 AS VARCHAR) || '-' || CAST(end0 AS VARCHAR), ';' ORDER BY assembly) AS coords FROM fx_coord GROUP BY uid) c USING (uid)
LEFT JOIN (SELECT uid, string_agg(genome || '=' || coalesce(ref_gene_name, ''), ';' ORDER BY genome) AS genes FROM fx_hit_gene GROUP BY uid) g USING (uid)""",
    "fx_entity", "fx_alias", "fx_coord", "fx_hit_gene",
)
def locus_document(e, a, c, g):
    children = {
        "aliases": documents.nested(a, "aliases", ["alias_type", "alias", "assignment", "is_current"]),
        "coords": documents.nested(c, "coords", ["assembly", "chrom", "start0", "end0"]),
        "genes": documents.nested(g, "genes", ["genome", "source", "ref_gene_name"]),
    }
    made = documents.assemble(e.select("uid", "grp"), children)
    flat = lambda name, f: F.array_join(F.transform(name, f), ";").alias(name)
    return made.select(
        "uid",
        "grp",
        F.size("aliases").cast("long").alias("n_aliases"),
        flat("aliases", lambda x: F.concat(x["alias_type"], F.lit("="), x["alias"], F.lit("/"), x["assignment"])),
        flat("coords", lambda x: F.concat(x["assembly"], F.lit(":"), x["chrom"], F.lit(":"), x["start0"].cast("string"), F.lit("-"), x["end0"].cast("string"))),
        flat("genes", lambda x: F.concat(x["genome"], F.lit("="), F.coalesce(x["ref_gene_name"], F.lit("")))),
    )


@query("SELECT c.c_custkey, n.n_name, r.r_name, coalesce(o.n_orders, 0) AS n_orders FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey", "customer", "nation", "region", "orders")
def lookup_chain(c, n, r, o):
    counts = {"orders": o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))}
    keyed = c.withColumn("n_nationkey", F.col("c_nationkey"))
    made = documents.assemble(keyed, counts, ((n, "n_nationkey"), (r.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")), key="c_custkey")
    return made.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT uid, assembly, chrom, start0, end0 FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE assembly WHEN 'hg38' THEN 1 ELSE 2 END, chrom, start0, end0) AS rn FROM fx_coord) WHERE rn = 1", "fx_coord")
def preferred_coordinate(c):
    return documents.preferred_coordinate(c)


LISTED = "rows_ AS (SELECT e.uid, e.combined_id, e.grp, c.chrom, c.start0, c.end0, c.chrom || ':' || CAST(greatest(c.start0 + 1, 1) AS VARCHAR) || '-' || CAST(c.end0 AS VARCHAR) AS position FROM fx_entity e LEFT JOIN (SELECT * FROM fx_coord WHERE assembly = 'hg38') c ON c.uid = e.uid)"


@query(
    f"WITH {LISTED} SELECT uid, grp, position, CAST((rn - 1) // 100 AS BIGINT) AS page, CAST(greatest(ceil(n / 100.0), 1) AS BIGINT) AS n_pages, CAST((rn - 1) // 100 * 100 + 1 AS VARCHAR) || '-' || CAST(least(((rn - 1) // 100 + 1) * 100, n) AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY combined_id, uid) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM rows_)",
    "fx_entity", "fx_coord",
)
def list_page(e, c):
    return documents.pages(documents.list_rows(e, c), "grp", ["combined_id", "uid"]).select("uid", "grp", "position", "page", "n_pages", "shown")


@query(f"WITH {LISTED} SELECT a.alias_type, a.alias AS value, r.uid, r.position FROM fx_alias a JOIN rows_ r ON r.uid = a.uid WHERE a.alias_type IN {CLASS}", "fx_alias", "fx_entity", "fx_coord")
def classifier_rows(a, e, c):
    return aliases.class_members(a).join(documents.list_rows(e, c), "uid").select("alias_type", "value", "uid", "position")


@query("SELECT uid, chrom || ':' || CAST(start0 + 1 AS VARCHAR) || '-' || CAST(end0 AS VARCHAR) AS position, chrom || ':' || CAST(greatest(start0 - 999, 1) AS VARCHAR) || '-' || CAST(end0 + 1000 AS VARCHAR) AS padded FROM fx_coord WHERE assembly = 'hg38'", "fx_coord")
def display_position(c):
    at = lambda pad: text.position_1based(F.col("chrom"), F.col("start0"), F.col("end0"), pad)
    return c.where("assembly = 'hg38'").select("uid", at(0).alias("position"), at(1000).alias("padded"))


# ---- intervals


@query(f"WITH {WIN} SELECT w.uid, r.chrom, r.start0, r.end0, r.strand, r.rep_name, least(r.end0, w.w1) - greatest(r.start0, w.w0) AS overlap_bp FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0", "fx_repeat", "fx_coord")
def interval_overlap(r, c):
    return annotation.repeats_in_windows(r, hg38_windows(c)).select("uid", "chrom", "start0", "end0", "strand", "rep_name", "overlap_bp")


@query("WITH s AS (SELECT *, CASE WHEN start0 > max(end0) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS o FROM fx_repeat), i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT chrom, min(start0) AS start0, max(end0) AS end0, count(*) AS n FROM i GROUP BY chrom, g", "fx_repeat")
def interval_union(r):
    return intervals.merge_dense_intervals(r)


@query("SELECT uid, chrom, w0, w1, max(w1) OVER (PARTITION BY chrom ORDER BY w0, w1 ROWS UNBOUNDED PRECEDING) AS reach FROM (SELECT uid, chrom, greatest(start0 - 1000, 0) AS w0, end0 + 1000 AS w1 FROM fx_coord WHERE assembly = 'hg38')", "fx_coord")
def interval_running_end(c):
    return intervals.running_end(hg38_windows(c), "chrom").select("uid", "chrom", "w0", "w1", "reach")


@query(f"WITH {WIN}, p AS (SELECT w.uid, r.* FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0) SELECT chrom, start0, end0, rep_name, count(DISTINCT uid) AS n_loci FROM p GROUP BY ALL", "fx_repeat", "fx_coord")
def repeat_multiplicity(r, c):
    return intervals.multiplicity(annotation.repeats_in_windows(r, hg38_windows(c)), ["chrom", "start0", "end0", "rep_name"])


@query("SELECT chrom, count(DISTINCT (start0, end0)) AS n_distinct, count(*) AS n_rows FROM fx_repeat GROUP BY chrom", "fx_repeat")
def distinct_repeats(r):
    return r.groupBy("chrom").agg(F.countDistinct("start0", "end0").alias("n_distinct"), F.count("*").alias("n_rows"))


@query("SELECT DISTINCT chrom, unnest(range(w0 // 2000000, w1 // 2000000 + 1)) AS tile FROM (SELECT chrom, greatest(start0 - 1000, 0) AS w0, end0 + 1000 AS w1 FROM fx_coord WHERE assembly = 'hg38')", "fx_coord")
def tile_cover(c):
    return intervals.tile_cover(hg38_windows(c))


@query("SELECT a.event_id AS event_id, b.event_id AS other_id FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) a JOIN (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s < b.s + 3600 AND a.s + 60 > b.s", "events")
def event_overlap(e):
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    left = e.select("event_id", "user_id", s.alias("start0"), (s + 60).alias("end0"))
    right = e.select(F.col("event_id").alias("other_id"), "user_id", s.alias("w0"), (s + 3600).alias("w1"))
    return intervals.interval_join(left, right, width=3600, key="user_id").where("event_id <> other_id").select("event_id", "other_id")


@query(f"WITH {WIN} SELECT r.uid, 'repeat' AS lane, r.rep_name AS label, least(greatest(r.start0, w0), w1) AS clip_start, least(greatest(r.end0, w0), w1) AS clip_end, (least(greatest(r.start0, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) AS x0, (least(greatest(r.end0, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) AS x1 FROM (SELECT w.uid, w.w0, w.w1, r.* FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0 WHERE r.rep_class_family IN ('LTR/ERV1', 'LINE/L1')) r UNION ALL SELECT w.uid, 'locus', 'hg38', c.start0, c.end0, (c.start0 - w0) / CAST(w1 - w0 AS DOUBLE), (c.end0 - w0) / CAST(w1 - w0 AS DOUBLE) FROM fx_coord c JOIN win w ON w.uid = c.uid AND c.assembly = 'hg38'", "fx_repeat", "fx_coord")
def track_features(r, c):
    wins = hg38_windows(c)
    interspersed = r.where(F.col("rep_class_family").isin("LTR/ERV1", "LINE/L1"))
    lane = intervals.interval_join(interspersed, wins).withColumn("label", F.col("rep_name"))
    locus = c.where("assembly = 'hg38'").select("uid", "start0", "end0", F.lit("hg38").alias("label")).join(wins.drop("chrom"), "uid")
    return documents.tracks({"repeat": lane, "locus": locus})


# ---- annotation

GTF = """g AS (SELECT line, string_split(line, chr(9)) AS f FROM fx_gtf_line), x AS (
  SELECT line, f[1] AS chrom, TRY_CAST(f[4] AS BIGINT) - 1 AS start0, TRY_CAST(f[5] AS BIGINT) AS end0, f[7] AS strand,
    nullif(regexp_extract(f[9], '(?:^|[; ])transcript_id "([^"]*)"', 1), '') AS name,
    coalesce(nullif(regexp_extract(f[9], '(?:^|[; ])gene_name "([^"]*)"', 1), ''), nullif(regexp_extract(f[9], '(?:^|[; ])gene_id "([^"]*)"', 1), ''), nullif(regexp_extract(f[9], '(?:^|[; ])transcript_id "([^"]*)"', 1), '')) AS name2
  FROM g WHERE len(f) >= 9 AND f[3] = 'exon'
), e AS (SELECT * FROM x WHERE start0 IS NOT NULL AND end0 IS NOT NULL AND name IS NOT NULL), tx AS (
  SELECT name, chrom, arg_min(name2, (start0, end0, name2)) AS name2, min(start0) AS txStart, max(end0) AS txEnd, arg_min(strand, (start0, end0, name2)) AS strand,
    list(start0 ORDER BY start0, end0) AS exonStarts, list(end0 ORDER BY start0, end0) AS exonEnds FROM e GROUP BY name, chrom
)"""
TXW = "txw AS (SELECT t.*, w.uid, w.w0, w.w1 FROM tx t JOIN win w ON w.chrom = t.chrom AND t.txStart <= w.w1 AND t.txEnd > w.w0)"


@query(f"WITH {GTF} SELECT name, name2, chrom, txStart AS tx_start, txEnd AS tx_end, strand, array_to_string(exonStarts, ',') AS starts, array_to_string(exonEnds, ',') AS ends FROM tx", "fx_gtf_line")
def gtf_transcripts(g):
    tx = annotation.with_exons(annotation.transcripts(annotation.exons(g)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return tx.select("name", "name2", "chrom", F.col("txStart").alias("tx_start"), F.col("txEnd").alias("tx_end"), "strand", joined("exonStarts").alias("starts"), joined("exonEnds").alias("ends"))


@query(f"WITH {GTF} SELECT line, CASE WHEN start0 IS NULL OR end0 IS NULL THEN 'coordinates' ELSE 'transcript_id' END AS fault FROM x WHERE start0 IS NULL OR end0 IS NULL OR name IS NULL", "fx_gtf_line")
def gtf_rejects(g):
    return annotation.exon_rejects(g)


@query(f"WITH {GTF} SELECT name, count(DISTINCT chrom) AS n_chroms FROM e GROUP BY name HAVING count(DISTINCT chrom) > 1", "fx_gtf_line")
def split_transcripts(g):
    return annotation.split_transcripts(annotation.exons(g))


@query(f"WITH {GTF}, {WIN}, {TXW} SELECT uid, name, name2, chrom, txStart AS tx_start, txEnd AS tx_end FROM txw", "fx_gtf_line", "fx_coord")
def interval_overlap_right_inclusive(g, c):
    placed = annotation.transcripts_in_windows(_transcripts(g), hg38_windows(c), distinct=True)
    return placed.select("uid", "name", "name2", "chrom", F.col("txStart").alias("tx_start"), F.col("txEnd").alias("tx_end"))


GENES = """s AS (SELECT *, coalesce(name2, name) AS gene FROM txw WHERE txStart < w1), x2 AS (
  SELECT DISTINCT uid, gene, p[1] AS a, p[2] AS b FROM (SELECT uid, gene, w0, w1, unnest(list_zip(exonStarts, exonEnds)) AS p FROM s) WHERE p[2] > w0 AND p[1] < w1
), o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY uid, gene ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS opens FROM x2
), i AS (SELECT *, sum(opens) OVER (PARTITION BY uid, gene ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o
), m AS (SELECT uid, gene, island, min(a) AS a, max(b) AS b FROM i GROUP BY ALL
), u AS (SELECT uid, gene, count(*) AS n_exons, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY a) AS exons FROM m GROUP BY ALL
), gm AS (SELECT uid, gene, count(*) AS n_isoforms, min(txStart) AS start0, max(txEnd) AS end0, arg_min(strand, (txStart, txEnd, name, strand)) AS strand FROM s GROUP BY ALL)"""


def _transcripts(g: DataFrame) -> DataFrame:
    """The transcripts of all lines, parsed once and kept as a table for the queries that need them."""
    tx = annotation.transcripts(annotation.exons(g))
    return g.sparkSession.read.schema(tx.schema).parquet(_once("transcripts", g, lambda path: tx.write.parquet(path), "_SUCCESS"))


def _bounds(g: DataFrame) -> DataFrame:
    """Names and bounds of the transcripts, kept as well; whole transcripts serve where this session has them."""
    tx = annotation.transcript_bounds(annotation.exons(g))
    if _kept_as("transcripts", g) in _WRITTEN:
        return _transcripts(g).select(*tx.columns)
    return g.sparkSession.read.schema(tx.schema).parquet(_once("bounds", g, lambda path: tx.write.parquet(path), "_SUCCESS"))


#: Placed transcripts that one task makes gene models of.
PLACED = 200_000


def _models(g: DataFrame, c: DataFrame) -> DataFrame:
    placed = files.materialise(annotation.transcripts_in_windows(_transcripts(g), hg38_windows(c), distinct=True), files.scratch(g.sparkSession, "placed"))
    return annotation.gene_models(placed, max(g.sparkSession.sparkContext.defaultParallelism, placed.count() // PLACED + 1))


def _spans(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["start0"].cast("string"), F.lit("-"), x["end0"].cast("string"))), ",")


@query(f"WITH {GTF}, {WIN}, {TXW}, {GENES} SELECT uid, gene, n_isoforms, start0, end0, strand, coalesce(n_exons, 0) AS n_exons, coalesce(exons, '') AS exons, n_exons IS NULL AS intron_only FROM gm LEFT JOIN u USING (uid, gene)", "fx_gtf_line", "fx_coord")
def gene_collapse(g, c):
    return _models(g, c).withColumn("exons", _spans("exons"))


@query(f"WITH {GTF}, {WIN}, {TXW}, {GENES} SELECT gm.uid, 'gene' AS lane, CASE WHEN n_isoforms > 1 THEN gene || ' (' || CAST(n_isoforms AS VARCHAR) || ' tx)' ELSE gene END AS label, least(greatest(gm.start0, w0), w1) AS clip_start, least(greatest(gm.end0, w0), w1) AS clip_end, (least(greatest(gm.start0, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) AS x0, (least(greatest(gm.end0, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) AS x1 FROM gm JOIN win USING (uid) UNION ALL SELECT m.uid, 'exon', gene, least(greatest(a, w0), w1), least(greatest(b, w0), w1), (least(greatest(a, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE), (least(greatest(b, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) FROM m JOIN win USING (uid)", "fx_gtf_line", "fx_coord")
def gene_lanes(g, c):
    models = files.materialise(_models(g, c), files.scratch(g.sparkSession, "models"))
    models = models.join(hg38_windows(c).select("uid", "w0", "w1").hint("merge"), "uid")
    label = F.when(F.col("n_isoforms") > 1, F.concat("gene", F.lit(" ("), F.col("n_isoforms").cast("string"), F.lit(" tx)"))).otherwise(F.col("gene"))
    exons = models.select("uid", "w0", "w1", F.col("gene").alias("label"), F.inline("exons"))
    return documents.tracks({"gene": models.withColumn("label", label), "exon": exons})


@query(f"WITH {WIN} SELECT w.uid, l.lane, l.label, least(greatest(l.a, w0), w1) AS clip_start, least(greatest(l.b, w0), w1) AS clip_end, (least(greatest(l.a, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) AS x0, (least(greatest(l.b, w0), w1) - w0) / CAST(w1 - w0 AS DOUBLE) AS x1 FROM win w JOIN (SELECT uid, 'segment' AS lane, rep_name AS label, a, b FROM fx_segment UNION ALL SELECT uid, 'orf', coalesce(orf_class, 'ORF'), a, b FROM fx_orf UNION ALL SELECT uid, 'domain', coalesce(gene, domain_desc), a, b FROM fx_domain) l ON l.uid = w.uid AND l.b > w0 AND l.a < w1", "fx_coord", "fx_segment", "fx_orf", "fx_domain")
def child_lanes(c, s, o, d):
    wins = hg38_windows(c).select("uid", "w0", "w1")
    lane = lambda rows, label: rows.select("uid", label.alias("label"), F.col("a").alias("start0"), F.col("b").alias("end0")).join(wins, "uid").where(intervals.overlaps(F.col("start0"), F.col("end0"), F.col("w0"), F.col("w1")))
    return documents.tracks({"segment": lane(s, F.col("rep_name")), "orf": lane(o, F.coalesce("orf_class", F.lit("ORF"))), "domain": lane(d, F.coalesce("gene", "domain_desc"))})


#: Children of a whole document: the view, the columns in order, and which of its rows.
CHILDREN = {
    "aliases": ("fx_alias", ("alias", "alias_type", "assignment", "is_current"), "true"),
    "coord": ("fx_coord", ("assembly", "chrom", "start0", "end0"), "true"),
    "structure": ("fx_structure", ("structure", "category"), "true"),
    "segments": ("fx_segment", ("rep_name", "a", "b"), "true"),
    "geve": ("fx_orf", ("orf_class", "a", "b"), "true"),
    "domains": ("fx_domain", ("gene", "domain_desc", "a", "b"), "true"),
    "hervarium_int": ("fx_internal", ("element", "a", "b"), "true"),
    "genes": ("fx_hit_gene", ("genome", "source", "ref_gene_name"), "true"),
    "crossgenome": ("fx_crossgenome", ("pct_identity", "xg_class"), "true"),
    "dfam_best": ("fx_dfam", ("consensus_name", "sw_score"), "is_best_by_sw_score = 1"),
    "repeats": ("fx_locus_repeat", ("assembly", "start0", "end0", "rep_name"), "true"),
}


def _text(column: str) -> str:
    return f"coalesce(CAST(CAST({column} AS BIGINT) AS VARCHAR), '')" if column == "pct_identity" else f"coalesce(CAST({column} AS VARCHAR), '')"


WHOLE = "SELECT e.uid, e.combined_id, e.grp, e.band, " + ", ".join(f"c_{n}.{n}, coalesce(c_{n}.n, 0) AS n_{n}" for n in CHILDREN) + " FROM fx_entity e " + " ".join(
    f"LEFT JOIN (SELECT uid, count(*) AS n, string_agg(concat({', chr(124), '.join(_text(c) for c in columns)}), ';' ORDER BY {', '.join(c + ' NULLS FIRST' for c in columns)}) AS {n} FROM {v} WHERE {which} GROUP BY uid) c_{n} ON c_{n}.uid = e.uid" for n, (v, columns, which) in CHILDREN.items()
)


@query(WHOLE, "fx_entity", *[v for v, _, _ in CHILDREN.values()])
def full_document(e, *tables):
    rows = {n: df.where(which).select("uid", *columns) for (n, (_, columns, which)), df in zip(CHILDREN.items(), tables)}
    rows["dfam_best"] = documents.best_hits(tables[list(CHILDREN).index("dfam_best")]).select("uid", "consensus_name", "sw_score")
    made = documents.whole_documents(e.select("uid", "combined_id", "grp", "band"), rows)
    shown = lambda x, c: F.coalesce((x[c].cast("long") if c == "pct_identity" else x[c]).cast("string"), F.lit(""))
    line = lambda columns: lambda x: F.concat(*[y for c in columns for y in (F.lit("|"), shown(x, c))][1:])
    told = []
    for n, (_, columns, _) in CHILDREN.items():
        told.append(F.array_join(F.transform(n, line(columns)), ";").alias(n))
        told.append(F.coalesce(F.size(F.when(F.col(n).isNotNull(), F.col(n))), F.lit(0)).cast("long").alias(f"n_{n}"))
    return made.select("uid", "combined_id", "grp", "band", *told)


@query(f"WITH {GTF}, {WIN}, {TXW} SELECT t.uid, t.name FROM txw t WHERE t.txStart < t.w1 AND t.uid IN (SELECT uid FROM fx_hit_gene)", "fx_gtf_line", "fx_coord", "fx_hit_gene")
def transcript_lookup(g, c, h):
    wins = hg38_windows(c).join(h.select("uid").distinct(), "uid", "left_semi")
    placed = annotation.transcripts_in_windows(_transcripts(g), wins, distinct=True)
    again = hg38_windows(c).select("uid", F.col("w1").alias("edge"))
    return placed.join(again, "uid").where("txStart < edge").select("uid", "name")


@query(f"WITH {WIN} SELECT assembly, count(*) AS n_windows, CAST(sum(w1 - w0) AS BIGINT) AS window_bp FROM win WHERE uid IN (SELECT uid FROM fx_hit_gene) GROUP BY assembly", "fx_coord", "fx_hit_gene")
def gene_windows(c, h):
    wins = hg38_windows(c).join(h.select("uid").distinct(), "uid", "left_semi")
    return wins.groupBy("assembly").agg(F.count("*").alias("n_windows"), F.sum(F.col("w1") - F.col("w0")).alias("window_bp"))


def _met(g: DataFrame, c: DataFrame) -> DataFrame:
    """``uid`` of windows with any transcript."""
    tx = _bounds(g).select("chrom", "txStart", "txEnd")
    return intervals.covered(tx, hg38_windows(c), start="txStart", end="txEnd", right_inclusive=True)


@query(f"WITH {GTF} SELECT count(DISTINCT name) AS n_transcripts, count(DISTINCT chrom) AS n_chroms, CAST(sum(len(exonStarts)) AS BIGINT) AS n_exons FROM tx", "fx_gtf_line")
def transcript_totals(g):
    tx = annotation.transcripts(annotation.exons(g))
    return tx.agg(F.countDistinct("name").alias("n_transcripts"), F.countDistinct("chrom").alias("n_chroms"), F.sum(F.size("exonStarts")).alias("n_exons"))


@query(f"WITH {GTF}, {WIN}, {TXW} SELECT 'hg38' AS assembly, count(DISTINCT uid) AS n_loci, count(DISTINCT uid) / CAST((SELECT count(*) FROM win) AS DOUBLE) AS share FROM txw", "fx_gtf_line", "fx_coord")
def transcript_coverage(g, c):
    wins = hg38_windows(c)
    placed = _met(g, c).agg(F.count("*").alias("n_loci"))
    return placed.select(F.lit("hg38").alias("assembly"), "n_loci", (F.col("n_loci") / wins.agg(F.count("*")).scalar()).alias("share"))


RMSK = """ln AS (SELECT line, regexp_split_to_array(trim(line), '\\s+') AS f FROM fx_rmsk_line), rp AS (
  SELECT f[5] AS chrom, CAST(f[6] AS BIGINT) - 1 AS start0, CAST(f[7] AS BIGINT) AS end0, CASE WHEN f[9] = 'C' THEN '-' ELSE '+' END AS strand, f[10] AS rep_name,
    string_split(f[11], '/')[1] AS rep_class, coalesce(string_split(f[11], '/')[2], string_split(f[11], '/')[1]) AS rep_family, CAST(f[1] AS BIGINT) AS sw_score, CAST(f[2] AS DOUBLE) AS pct_div
  FROM ln WHERE len(f) = 15
)"""


@query(f"WITH {RMSK} SELECT * FROM rp", "fx_rmsk_line")
def rmsk_parse(m):
    return annotation.repeats(m)


@query(f"WITH {RMSK} SELECT line FROM ln WHERE len(f) <> 15 AND regexp_matches(f[1], '^[0-9]+$')", "fx_rmsk_line")
def rmsk_malformed(m):
    return annotation.malformed_repeats(m)


@query(
    f"WITH {RMSK}, {WIN}, n AS (SELECT *, row_number() OVER () AS id FROM rp), p AS (SELECT id FROM n JOIN win w ON w.chrom = n.chrom AND n.start0 < w.w1 AND n.end0 > w.w0) SELECT (SELECT count(*) FROM rp) AS data_lines, (SELECT count(*) FROM ln WHERE len(f) <> 15 AND regexp_matches(f[1], '^[0-9]+$')) AS malformed, (SELECT count(DISTINCT chrom) FROM rp WHERE chrom NOT IN (SELECT chrom FROM win)) AS unplaced_chroms, (SELECT count(*) FROM rp WHERE chrom NOT IN (SELECT chrom FROM win)) AS unplaced_lines, (SELECT count(DISTINCT id) FROM p) AS repeats_in_window, (SELECT count(*) FROM p) AS locus_repeat_pairs",
    "fx_rmsk_line", "fx_coord",
)
def rmsk_stats(m, c):
    return annotation.ingest_stats(m, hg38_windows(c))


@query(f"WITH {RMSK} SELECT rep_class, count(*) AS n FROM rp GROUP BY rep_class ORDER BY n DESC, rep_class LIMIT 12", "fx_rmsk_line")
def class_top12(m):
    return annotation.class_frequencies(annotation.repeats(m))


@query(f"WITH {WIN}, p AS (SELECT w.uid, w.assembly, r.* FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0) SELECT uid, count(*) AS n, string_agg(CAST(start0 AS VARCHAR) || ':' || rep_name, ',' ORDER BY start0, end0, rep_name) AS repeats FROM p GROUP BY uid", "fx_repeat", "fx_coord")
def locus_repeats(r, c):
    pairs = annotation.repeats_in_windows(r, hg38_windows(c))
    listed = documents.nested(pairs, "repeats", ["start0", "end0", "rep_name"])
    return listed.select("uid", F.size("repeats").cast("long").alias("n"), F.array_join(F.transform("repeats", lambda x: F.concat(x["start0"].cast("string"), F.lit(":"), x["rep_name"])), ",").alias("repeats"))


@query(f"WITH {WIN}, p AS (SELECT w.uid, r.*, row_number() OVER (PARTITION BY w.uid ORDER BY sw_score DESC, r.start0, r.end0, rep_name, strand) AS rn FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0) SELECT uid, rep_name, sw_score FROM p WHERE rn = 1", "fx_repeat", "fx_coord")
def best_repeat_hits(r, c):
    pairs = annotation.repeats_in_windows(r, hg38_windows(c))
    return documents.best_hits(documents.mark_best(pairs, "sw_score", ["start0", "end0", "rep_name", "strand"])).select("uid", "rep_name", "sw_score")


@query(f"WITH {RMSK} SELECT 'hg38' AS assembly, 'rmsk' AS source, rep_family, count(*) AS n FROM rp WHERE rep_class IN ('" + "', '".join(annotation.INTERSPERSED) + "') GROUP BY rep_family", "fx_rmsk_line")
def interspersed_families(m):
    rows = annotation.tagged(annotation.of_classes(annotation.repeats(m)), "hg38", "rmsk")
    return rows.groupBy("assembly", "source", "rep_family").agg(F.count("*").alias("n"))


# ---- checks


AGREE = f"WITH {GTF}, {WIN}, {TXW}, want AS (SELECT uid, source, list(DISTINCT ref_gene_name) FILTER (ref_gene_name IS NOT NULL) AS want FROM fx_hit_gene GROUP BY ALL), have AS (SELECT uid, list(DISTINCT name2) AS have FROM txw GROUP BY uid), b AS (SELECT w.*, coalesce(len(want), 0) AS n, len(list_intersect(coalesce(want, []), coalesce(have, []))) AS found FROM want w LEFT JOIN have USING (uid))"


def _built(g: DataFrame, c: DataFrame, expected: DataFrame) -> DataFrame:
    """The distinct names that the ``expected`` entities have transcripts of, without a pair for each transcript."""
    tx = _bounds(g).select(F.col("name2").alias("name"), "chrom", "txStart", "txEnd")
    wins = hg38_windows(c).join(expected.select("uid").hint("merge"), "uid", "left_semi")
    return intervals.covered(tx, wins, ("name",), start="txStart", end="txEnd", right_inclusive=True)


@query(f"{AGREE} SELECT count(*) FILTER (n > 0) AS n_entities, count(*) FILTER (n > 0 AND found = n) AS n_all FROM b WHERE source = 'gencode'", "fx_gtf_line", "fx_coord", "fx_hit_gene")
def agreement_of_one_source(g, c, h):
    expected = quality.recorded(h, "hg38", "gencode")
    return quality.agreement(expected, _built(g, c, expected)).select("n_entities", "n_all")


@query(f"{AGREE} SELECT source, count(*) FILTER (n > 0) AS n_entities, count(*) FILTER (n = 0) AS n_unnamed, count(*) FILTER (n > 0 AND found = n) AS n_all, count(*) FILTER (found > 0 AND found < n) AS n_some, count(*) FILTER (n > 0 AND found = 0) AS n_none, 100.0::DOUBLE * count(*) FILTER (n > 0 AND found = n) / nullif(count(*) FILTER (n > 0), 0) AS all_pct, coalesce(100.0::DOUBLE * count(*) FILTER (n > 0 AND found = n) / nullif(count(*) FILTER (n > 0), 0) >= 90, false) AS ok FROM b GROUP BY source", "fx_gtf_line", "fx_coord", "fx_hit_gene")
def agreement_rates(g, c, h):
    return quality.agreement(h.select("uid", "source", F.col("ref_gene_name").alias("name")), _built(g, c, h), by=("source",))


@query(f"WITH {GTF}, {WIN}, {TXW} SELECT DISTINCT uid, ref_gene_name AS name FROM fx_hit_gene WHERE ref_gene_name IS NOT NULL AND (uid, ref_gene_name) NOT IN (SELECT uid, name2 FROM txw)", "fx_gtf_line", "fx_coord", "fx_hit_gene")
def symbol_drift(g, c, h):
    return quality.drifted(h.select("uid", F.col("ref_gene_name").alias("name")), _built(g, c, h))


@query(f"WITH {GTF}, {WIN}, {TXW} SELECT DISTINCT uid FROM fx_hit_gene WHERE uid NOT IN (SELECT uid FROM txw)", "fx_gtf_line", "fx_coord", "fx_hit_gene")
def unexplained_overlaps(g, c, h):
    return quality.dangling(h.select("uid").distinct(), _met(g, c), ["uid"])


@query(f"WITH {GTF}, {WIN}, {TXW}, lost AS (SELECT uid FROM win WHERE uid IN (SELECT uid FROM fx_hit_gene) AND uid NOT IN (SELECT uid FROM fx_hit_gene WHERE genome = 'hg38')) SELECT count(*) AS n_lost, count(*) FILTER (uid IN (SELECT uid FROM txw)) AS n_lost_with_transcript FROM lost", "fx_gtf_line", "fx_coord", "fx_hit_gene")
def window_filter_loss(g, c, h):
    wins = hg38_windows(c).select("uid")
    loose = wins.join(h.select("uid").distinct(), "uid", "left_semi")
    lost = loose.subtract(wins.join(h.where("genome = 'hg38'").select("uid").distinct(), "uid", "left_semi"))
    built = _met(g, c).withColumn("has", F.lit(1))
    return lost.join(built, "uid", "left").agg(F.count("*").alias("n_lost"), F.count("has").alias("n_lost_with_transcript"))


@query(f"WITH {WIN}, rp AS (SELECT DISTINCT w.uid FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0) SELECT (SELECT count(*) FROM fx_entity) AS n_entities, (SELECT count(DISTINCT uid) FROM fx_coord WHERE assembly = 'hg38') AS n_first, (SELECT count(*) FROM (SELECT uid FROM fx_coord WHERE assembly = 't2t' EXCEPT SELECT uid FROM fx_coord WHERE assembly = 'hg38')) AS n_second_only, (SELECT count(*) FROM fx_entity WHERE uid NOT IN (SELECT uid FROM fx_coord)) AS n_neither, (SELECT count(DISTINCT uid) FROM rp) AS n_with_repeats, (SELECT count(DISTINCT uid) FROM rp WHERE uid NOT IN (SELECT uid FROM fx_coord WHERE assembly = 't2t')) AS n_repeats_without_coordinate", "fx_entity", "fx_coord", "fx_repeat")
def coverage_by_assembly(e, c, r):
    """Repeats of the first assembly's windows, said to be of the second, so that some entities have no coordinate for them."""
    repeats = annotation.repeats_in_windows(r, hg38_windows(c)).select("uid", F.lit("t2t").alias("assembly"))
    return quality.coverage_by_assembly(e, c, repeats)


@query("SELECT event_id, props FROM fx_json WHERE props IS NULL OR NOT json_valid(props) OR contains(props, 'NaN')", "fx_json")
def strict_json_violations(e):
    return quality.not_strict_json(e, "props").select("event_id", "props")


@query("SELECT l_orderkey, l_linenumber, '{\"share\":' || CASE WHEN l_discount = 0 THEN 'null' ELSE 'true' END || ',\"flag\":\"' || l_returnflag || '\"}' AS doc FROM lineitem", "lineitem")
def strict_json_text(li):
    share = (F.lit(1.0) / F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.lit(1.0))).alias("share")
    zero = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(share)
    made = li.select("l_orderkey", "l_linenumber", text.finite(zero).isNotNull().alias("known"), "l_returnflag")
    doc = F.struct(F.when(F.col("known"), F.lit(True)).alias("share"), F.col("l_returnflag").alias("flag"))
    with_doc = made.withColumn("d", doc)
    return with_doc.select("l_orderkey", "l_linenumber", text.strict_json(F.col("d"), with_doc.schema["d"].dataType).alias("doc"))


@query(f"WITH {WIN} SELECT (SELECT count(*) FROM fx_repeat) AS n_rows, count(*) FILTER (EXISTS (SELECT 1 FROM fx_repeat r WHERE r.chrom = c.chrom AND r.start0 = c.start0 AND r.end0 = c.end0)) AS n_exact FROM fx_coord c WHERE assembly = 'hg38'", "fx_repeat", "fx_coord")
def coordinate_crosscheck(r, c):
    exact = c.where("assembly = 'hg38'").join(r.select("chrom", "start0", "end0").distinct(), ["chrom", "start0", "end0"], "left_semi")
    return r.agg(F.count("*").alias("n_rows")).select("n_rows", exact.agg(F.count("*")).scalar().alias("n_exact"))


SEGMENTS = "seg AS (SELECT chrom, start0, end0, rep_name, row_number() OVER (ORDER BY chrom, start0, end0, rep_name) AS row_id FROM (SELECT DISTINCT chrom, start0, end0, rep_name FROM fx_repeat WHERE strand = '+')), oth AS (SELECT DISTINCT chrom, start0, end0, rep_name FROM fx_repeat WHERE strand = '-')"


@query(f"WITH {SEGMENTS}, pr AS (SELECT s.row_id, abs(s.start0 - o.start0) AS shift FROM seg s JOIN oth o ON s.chrom = o.chrom AND s.rep_name = o.rep_name AND s.start0 < o.end0 AND s.end0 > o.start0), ex AS (SELECT row_id FROM seg SEMI JOIN oth USING (chrom, start0, end0, rep_name)), rest AS (SELECT row_id, min(shift) AS shift FROM pr WHERE row_id NOT IN (SELECT row_id FROM ex) GROUP BY row_id) SELECT (SELECT count(*) FROM seg) AS n_rows, (SELECT count(*) FROM ex) AS n_exact, (SELECT count(DISTINCT row_id) FROM pr) AS n_near, (SELECT count(*) FROM rest) AS n_shifted, (SELECT quantile_cont(shift, 0.5) FROM rest) AS median_shift", "fx_repeat")
def segment_crosscheck(r):
    key = ["chrom", "start0", "end0", "rep_name"]
    rows = r.where("strand = '+'").select(*key).distinct().withColumn("row_id", F.xxhash64(*key))
    others = r.where("strand = '-'").select(*key).distinct()
    named = lambda df: df.withColumn("place", F.concat_ws("|", "chrom", "rep_name"))
    right = named(others).select("place", F.col("start0").alias("w0"), F.col("end0").alias("w1"))
    pairs = intervals.interval_join(named(rows), right, key="place").select("row_id", F.abs(F.col("start0") - F.col("w0")).alias("shift"))
    return quality.crosscheck(rows, others, pairs, key)


@query("SELECT 'alias' AS child, count(*) AS n_rows, count(DISTINCT uid) AS n_entities, count(DISTINCT uid) / (SELECT CAST(count(*) AS DOUBLE) FROM fx_entity) AS share FROM fx_alias UNION ALL SELECT 'coord', count(*), count(DISTINCT uid), count(DISTINCT uid) / (SELECT CAST(count(*) AS DOUBLE) FROM fx_entity) FROM fx_coord UNION ALL SELECT 'gene', count(*), count(DISTINCT uid), count(DISTINCT uid) / (SELECT CAST(count(*) AS DOUBLE) FROM fx_entity) FROM fx_hit_gene", "fx_entity", "fx_alias", "fx_coord", "fx_hit_gene")
def child_coverage(e, a, c, h):
    return quality.child_coverage(e, {"alias": a, "coord": c, "gene": h})


@query("WITH only_t2t AS (SELECT DISTINCT uid FROM fx_coord WHERE assembly = 't2t' AND uid NOT IN (SELECT uid FROM fx_coord WHERE assembly = 'hg38')) SELECT e.origin, count(*) AS n_entities, count(*) FILTER (e.uid IN (SELECT uid FROM fx_hit_gene)) AS n_with_gene FROM fx_entity e JOIN only_t2t USING (uid) GROUP BY e.origin", "fx_entity", "fx_coord", "fx_hit_gene")
def subset_coverage(e, c, h):
    only = c.where("assembly = 't2t'").select("uid").distinct().join(c.where("assembly = 'hg38'"), "uid", "left_anti")
    has = h.select("uid").distinct().withColumn("has", F.lit(1))
    return e.join(only, "uid", "left_semi").join(has, "uid", "left").groupBy("origin").agg(F.count("*").alias("n_entities"), F.count("has").alias("n_with_gene"))


@query("SELECT genome, source, count(*) AS n FROM fx_hit_gene GROUP BY ALL", "fx_hit_gene")
def genome_source_counts(h):
    return h.groupBy("genome", "source").agg(F.count("*").alias("n"))


@query(f"WITH {WIN}, p AS (SELECT DISTINCT w.uid, 'hg38' AS assembly FROM fx_repeat r JOIN win w ON w.chrom = r.chrom AND r.start0 < w.w1 AND r.end0 > w.w0) SELECT p.uid, p.assembly FROM p WHERE (p.uid, p.assembly) NOT IN (SELECT uid, assembly FROM fx_coord WHERE assembly = 't2t')", "fx_repeat", "fx_coord")
def repeats_without_coordinate(r, c):
    pairs = annotation.repeats_in_windows(r, hg38_windows(c)).select("uid", F.lit("hg38").alias("assembly")).distinct()
    return quality.dangling(pairs, c.where("assembly = 't2t'"), ["uid", "assembly"]).select("uid", "assembly")


LISTED_EXONS = "len(list_filter(string_split(coalesce({}, ''), ','), lambda x: trim(x) <> ''))"


@query(f"SELECT name, chrom FROM fx_packed_tx WHERE {LISTED_EXONS.format('starts')} <> {LISTED_EXONS.format('ends')} OR {LISTED_EXONS.format('starts')} < 1", "fx_packed_tx")
def exon_length_mismatch(x):
    tx = x.select("name", "chrom", text.integer_list(F.col("starts")).alias("exonStarts"), text.integer_list(F.col("ends")).alias("exonEnds"))
    return quality.uneven_exons(tx).select("name", "chrom")


@query("SELECT (SELECT count(*) FROM fx_entity) AS n_one, (SELECT count(DISTINCT uid) FROM fx_alias) AS n_other, (SELECT count(*) FROM fx_entity) = (SELECT count(DISTINCT uid) FROM fx_alias) AS ok", "fx_entity", "fx_alias")
def locus_count_check(e, a):
    return quality.count_check(e, a.select("uid").distinct())


@query("SELECT DISTINCT assembly, 'unexpected' AS reason FROM fx_coord WHERE assembly NOT IN ('hg38')", "fx_coord")
def unexpected_assemblies(c):
    return quality.outside(c, ["hg38"], "assembly")


@query("SELECT NULL::VARCHAR AS assembly, 'empty' AS reason WHERE NOT EXISTS (SELECT 1 FROM fx_coord WHERE assembly = 'hg19')", "fx_coord")
def empty_assembly(c):
    return quality.outside(c.where("assembly = 'hg19'"), ["hg19"], "assembly")


# ---- small operators on whole tables


@query("SELECT uid, grp, band FROM fx_entity", "fx_entity")
def projected_columns(e):
    return documents.project(e, ["uid", "grp", "band", "no_such_column", "origin"], drop=("origin",))


@query("SELECT uid, chrom, start0, end0 FROM fx_coord WHERE assembly = 't2t'", "fx_coord")
def coordinates_of_assembly(c):
    return files.for_assembly(c, "t2t").select("uid", "chrom", "start0", "end0")


@query("SELECT uid, grp FROM fx_entity", "fx_entity")
def without_empty_columns(e):
    return documents.drop_empty_columns(e.select("uid", "grp", F.lit("").alias("blank"), F.lit(None).cast("string").alias("nothing")), keep=("uid",))


@query("SELECT e.uid, x.pct_identity, x.xg_class FROM fx_entity e LEFT JOIN fx_crossgenome x USING (uid)", "fx_entity", "fx_crossgenome")
def only_children(e, x):
    made = documents.assemble(e.select("uid"), {"x": documents.nested(x, "x", ["pct_identity", "xg_class"])})
    return made.select("uid", documents.only_child(F.col("x")).alias("x")).select("uid", "x.pct_identity", "x.xg_class")


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey + l_suppkey AS BIGINT) AS total, 2 AS n FROM lineitem", "lineitem")
def integer_lists(li):
    packed = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(", "), F.col("l_suppkey").cast("string"), F.lit(","))
    found = li.select("l_orderkey", "l_linenumber", text.integer_list(packed).alias("x"))
    return found.select("l_orderkey", "l_linenumber", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size("x").alias("n"))


@query("SELECT l_orderkey, l_linenumber, '{\"shares\":[' || CASE WHEN l_linenumber % 3 = 0 THEN 'null' WHEN l_linenumber % 3 = 1 THEN '0.5' ELSE 'null' END || '],\"of\":{\"flag\":\"' || l_returnflag || '\"}}' AS doc FROM lineitem", "lineitem")
def nested_strict_json(li):
    value = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 3 == 1, F.lit(0.5)).otherwise(F.lit(float("-inf")))
    made = li.select("l_orderkey", "l_linenumber", F.struct(F.array(value).alias("shares"), F.struct(F.col("l_returnflag").alias("flag")).alias("of")).alias("d"))
    return made.select("l_orderkey", "l_linenumber", text.strict_json(F.col("d"), made.schema["d"].dataType).alias("doc"))


# ---- what is written and read back, in the folder that the session names


@query("SELECT k, uid, grp FROM fx_entity WHERE grp = 'Brand#22' OR k > (SELECT max(k) - 100 FROM fx_entity)", "fx_entity")
def database_scan(e):
    """Entities written to a database that lives in this process, of Spark's own jars, and read in ranges of a key."""
    spark = e.sparkSession
    url, table = f"jdbc:derby:memory:tessera{uuid.uuid4().hex};create=true", "entity"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    kinds = "uid VARCHAR(40), grp VARCHAR(40)"  # else they were large objects, which are not compared
    e.select("k", "uid", "grp").write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=kinds, **options).save()
    read = files.read_catalog_jdbc(spark, url, table, key="k", partitions=4, **options)
    late = e.agg(F.max("k")).first()[0] - 100
    return read.where((F.col("grp") == "Brand#22") | (F.col("k") > late)).select("k", "uid", "grp")


@query("SELECT uid, grp, origin FROM fx_entity WHERE band IS NOT NULL", "fx_entity")
def catalog_scan(e):
    path = files.scratch(e.sparkSession, "catalog")
    names = {"uid": "locus_uid", "grp": "group"}
    e.withColumnsRenamed(names).select("locus_uid", "combined_id", "versioned_id", "group", "band", "origin").write.parquet(path)
    return files.read_catalog(e.sparkSession, path, "locus", columns=["locus_uid", "group", "origin", "band"], where=F.col("band").isNotNull()).select("uid", "grp", "origin")


@query("SELECT line FROM fx_rmsk_line", "fx_rmsk_line")
def text_scan(m):
    path = files.scratch(m.sparkSession, "lines")
    m.select("line").write.option("compression", "gzip").text(path)
    return files.read_lines(m.sparkSession, path, partitions=8).select("line")


@query(f"WITH {GTF} SELECT name, chrom, txStart AS tx_start, txEnd AS tx_end, CAST(len(exonStarts) AS INTEGER) AS n_exons FROM tx", "fx_gtf_line")
def tile_scan(g):
    """Tiles of transcripts, each also delivered by the tile after its own, as overlapping tiles do; one of each is kept."""
    path = files.scratch(g.sparkSession, "tiles")
    tx = annotation.transcripts(annotation.exons(g))
    packed = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(",")).alias(c)
    record = F.struct("name", "name2", "chrom", "txStart", "txEnd", "strand", packed("exonStarts"), packed("exonEnds"))
    own = F.floor(F.col("txStart") / 200_000).cast("long")
    tiles = tx.select("chrom", record.alias("r"), F.explode(F.array(own, own + 1)).alias("tile"))
    listed = tiles.groupBy("chrom", "tile").agg(F.to_json(F.collect_list("r")).alias("value"))
    files.write_texts(listed, path, ["chrom", "tile"])
    once = annotation.first_transcripts(files.read_tiles(g.sparkSession, path))
    return annotation.with_exons(once).select("name", "chrom", F.col("txStart").alias("tx_start"), F.col("txEnd").alias("tx_end"), F.size("exonStarts").alias("n_exons"))


@query("SELECT uid, count(*) AS n FROM fx_alias GROUP BY uid", "fx_alias")
def materialised_reuse(a):
    path = files.scratch(a.sparkSession, "reuse")
    made = a.groupBy("uid").agg(F.count("*").alias("n"))
    files.materialise(made, path)
    return files.materialise(made.where("uid IS NULL"), path)  # what is there is read, so this is not computed


def _documents(e: DataFrame, c: DataFrame) -> DataFrame:
    return documents.assemble(e.select("uid", "grp", "origin"), {"coords": documents.nested(c, "coords", ["assembly", "chrom", "start0", "end0"])})


def _bundle(e: DataFrame, c: DataFrame) -> tuple[str, T.StructType]:
    """A bundle of all entities, written over a small one of others, and its schema."""
    path = files.scratch(e.sparkSession, "bundle")
    docs = _documents(e, c)
    stale = e.where("k % 1000 = 1").select(F.concat(F.lit("OLD"), "uid").alias("uid"), "grp", "origin", F.array().cast(docs.schema["coords"].dataType).alias("coords"))
    for documents_ in (stale, docs):
        files.write_bundle(documents_, path)
    return path, docs.schema


@query(f"SELECT uid, {DJB2_UID} AS bucket, grp, origin, n_coords FROM fx_entity LEFT JOIN (SELECT uid, CAST(count(*) AS INTEGER) AS n_coords FROM fx_coord GROUP BY uid) USING (uid)", "fx_entity", "fx_coord")
def bundle_round_trip(e, c):
    path, schema = _bundle(e, c)
    read = files.read_bundle(e.sparkSession, path, schema).where("_corrupt IS NULL")
    return read.select("uid", "bucket", "grp", "origin", F.when(F.col("coords").isNotNull(), F.size("coords")).alias("n_coords"))


@query("SELECT uid, grp FROM fx_entity", "fx_entity", "fx_coord")
def bundle_read_during_rewrite(e, c):
    """A reader that has begun before a rewrite: it gets the whole old bundle and nothing of the new one."""
    path, docs = files.scratch(e.sparkSession, "bundle"), _documents(e, c)
    files.write_bundle(docs, path)
    begun = files.read_bundle(e.sparkSession, path, docs.schema)
    files.write_bundle(docs.where("grp < 'Brand#3'").withColumn("grp", F.lit("new")), path)
    return begun.select("uid", "grp")


@query(f"SELECT q.uid, q.bucket, e.uid IS NOT NULL AS found, e.grp, e.origin FROM (SELECT uid, {DJB2_UID} AS bucket FROM (SELECT uid FROM fx_coord WHERE chrom = 'chr3' UNION SELECT 'NOT' || uid FROM fx_coord WHERE chrom = 'chr2')) q LEFT JOIN fx_entity e ON e.uid = q.uid", "fx_entity", "fx_coord")
def bundle_lookup(e, c):
    """All entities of one chromosome, and as many that are not there."""
    path, schema = _bundle(e, c)
    uids = c.where("chrom = 'chr3'").select("uid").union(c.where("chrom = 'chr2'").select(F.concat(F.lit("NOT"), "uid").alias("uid")))
    return files.lookups(uids, path, schema).select("uid", "bucket", "found", "grp", "origin")


@query("SELECT CAST(400 AS BIGINT) AS n_buckets, 'djb2_mod' AS hash, count(*) AS n_documents FROM fx_entity", "fx_entity", "fx_coord")
def bundle_manifest(e, c):
    path, _ = _bundle(e, c)
    return e.sparkSession.read.schema("n_buckets long, hash string, n_documents long").json(f"{path}/manifest.json")


def _damaged(e: DataFrame, c: DataFrame) -> tuple[str, T.StructType]:
    """A bundle in which some documents are missing, some lie in the next bucket, and some buckets have a line cut short."""
    path, docs, kind = files.scratch(e.sparkSession, "damaged"), _documents(e, c), F.col("k") % 500
    pick = lambda n: docs.join(e.where(kind == n).select("uid"), "uid", "left_semi")
    folder = files.write_bundle(docs.join(e.where(kind.isin(7, 8)).select("uid"), "uid", "left_anti"), path)
    files.append_documents(files.in_buckets(pick(7), 400).withColumn("bucket", (F.col("bucket") + 1) % 400), folder)
    cut = pick(9).select(F.concat(F.lit('{"uid":"'), "uid", F.lit('","grp":')).alias("value"), hashing.bucket(F.col("uid"), 400).alias("bucket"))
    cut.write.mode("append").partitionBy("bucket").text(folder)
    return path, docs.schema


def _resolved(a: DataFrame, e: DataFrame, c: DataFrame) -> DataFrame:
    """``kind, uid`` of every name of the written index: its classes and its postings."""
    spark, path = a.sparkSession, _index(a, e, c)
    classes = stored_search.read_part(spark, path, "classifier").select(F.col("alias_type").alias("kind"), F.explode("uids").alias("uid"))
    return classes.union(stored_search.read_part(spark, path, "postings", stored_search.ALL).select("alias_type", "uid"))


FAULTS = f"""{POSTINGS}, refs AS (
  SELECT alias_type AS kind, uid FROM (SELECT DISTINCT alias_type, alias, uid FROM fx_alias WHERE alias IS NOT NULL AND alias_type IN {CLASS}) UNION ALL SELECT alias_type, uid FROM post
), en AS (SELECT uid, k % 500 AS m, {DJB2_UID} AS b FROM fx_entity), faults AS (
  SELECT 'corrupt' AS reason, NULL AS kind, NULL AS uid, b AS bucket, '{{"uid":"' || uid || '","grp":' AS detail FROM en WHERE m = 9
  UNION ALL SELECT 'placed', NULL, uid, (b + 1) % 400, 'belongs in ' || CAST(b AS VARCHAR) FROM en WHERE m = 7
  UNION ALL SELECT 'missing', r.kind, r.uid, min(b), CAST(count(*) AS VARCHAR) || ' names' FROM refs r JOIN en ON en.uid = r.uid WHERE m IN (7, 8) GROUP BY r.kind, r.uid
)"""


@query(f"WITH {FAULTS} SELECT reason, kind, uid, bucket, detail FROM faults", "fx_alias", "fx_entity", "fx_coord")
def bundle_faults(a, e, c):
    path, schema = _damaged(e, c)
    return quality.bundle_faults(files.read_bundle(a.sparkSession, path, schema), _resolved(a, e, c), int(files.manifest_of(a.sparkSession, path)["n_buckets"]))


@query(f"WITH {FAULTS} SELECT kind, count(*) AS n_misses, array_to_string(list_slice(list(DISTINCT uid ORDER BY uid), 1, 3), ',') AS examples FROM faults WHERE reason = 'missing' GROUP BY kind", "fx_alias", "fx_entity", "fx_coord")
def resolution_misses(a, e, c):
    path, schema = _damaged(e, c)
    found = quality.bundle_faults(files.read_bundle(a.sparkSession, path, schema), _resolved(a, e, c), int(files.manifest_of(a.sparkSession, path)["n_buckets"]))
    return quality.examples(found.where("reason = 'missing'"), "kind", "uid")


@query(f"WITH {POSTINGS}, k AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rank FROM (SELECT DISTINCT key FROM post)) SELECT key, rank, alias_type, str, uid, is_current FROM post JOIN k USING (key)", "fx_alias", "fx_entity", "fx_coord")
def search_index_round_trip(a, e, c):
    return stored_search.read_part(a.sparkSession, _index(a, e, c), "postings", stored_search.ALL)


@query(f"WITH {POSTINGS}, k AS (SELECT key, ckey, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rank, CAST(dense_rank() OVER (ORDER BY ckey) - 1 AS BIGINT) AS crank FROM (SELECT DISTINCT key, ckey FROM post)) SELECT 'ckey' AS of, crank AS at, ckey AS unit, rank FROM k UNION ALL SELECT 'key', rank, key, rank FROM k", "fx_alias", "fx_entity", "fx_coord")
def search_index_collapsed(a, e, c):
    return stored_search.read_part(a.sparkSession, _index(a, e, c), "collapsed", stored_search.ALL)


@query(CLASS_BLOCKS, "fx_alias", "fx_entity", "fx_coord")
def search_index_classifier(a, e, c):
    return stored_search.read_part(a.sparkSession, _index(a, e, c), "classifier").withColumn("uids", F.array_join("uids", ","))


@query(f"WITH {LISTED.replace('e.grp, c.chrom', 'e.grp, e.band, e.origin, c.chrom')} SELECT uid, combined_id, grp, band, origin, chrom, start0, end0, position FROM rows_", "fx_alias", "fx_entity", "fx_coord")
def search_index_listmeta(a, e, c):
    return stored_search.read_part(a.sparkSession, _index(a, e, c), "listmeta")


@query(f"WITH {POSTINGS} SELECT (SELECT count(*) FROM fx_entity) AS n_loci, count(DISTINCT key) AS n_keys, count(DISTINCT ckey) AS n_collapsed, count(*) AS n_postings, '{','.join(aliases.IDENTIFIERS)}' AS ident_types, '{','.join(aliases.CLASSIFIERS)}' AS class_types FROM post", "fx_alias", "fx_entity", "fx_coord")
def search_index_meta(a, e, c):
    return stored_search.read_part(a.sparkSession, _index(a, e, c), "meta").withColumns({t: F.array_join(t, ",") for t in ("ident_types", "class_types")})


@query(f"WITH {GTF}, {WIN}, {TXW}, {GENES} SELECT uid, gene, 'hg38' AS assembly, start0, end0 FROM gm", "fx_gtf_line", "fx_coord")
def gene_model_round_trip(g, c):
    path = files.scratch(g.sparkSession, "models")
    files.write_gene_models(annotation.tagged(_models(g, c), "hg38"), path)
    return g.sparkSession.read.parquet(path).where("assembly = 'hg38'").select("uid", "gene", "assembly", "start0", "end0")
