"""Queries over the given tables, one for each training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, scratch_path, written


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import fingerprint_edits

    return fingerprint_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import fold_of
    from tessera.llm.quality import score_quality, train_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0)
    scored = score_quality(docs, train_quality(docs, labels))
    held_out = fold_of(F.col("doc_id"), 5) == 0
    score = F.col("quality_score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokenfile import read_tokens, write_tokens

    path = scratch_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_tokens(spark, path)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import format_conversations, read_conversations

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = written(format_conversations(turns.unionByName(added)), "windows")
    return read_conversations(windows)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import top_k, whole_vectors

    vectors = whole_vectors(read_table(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id())
    vectors = written(vectors, "vectors")  # numbered once
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources, word_count

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(written(docs, "docs"), size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.extract import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import fold_of, identify, train_languages

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.centroids import cluster_vectors, grid_vectors

    return cluster_vectors(grid_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _centroid_sql(k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2:") -> str:
    """The rounds one after another, each a table of assignments and one of centroids."""
    near = """SELECT i, vec_id, whole, CAST(cluster AS INTEGER) AS cluster, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, cluster) AS place FROM (
    SELECT v.i, v.vec_id, v.whole, c.cluster, CAST(list_sum(list_transform(list_zip(v.whole, c.centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v CROSS JOIN c{r} c
  )) WHERE place = 1"""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(place - 1 AS INTEGER) AS cluster, whole AS centre FROM (SELECT whole, row_number() OVER (ORDER BY sha256('{salt}' || CAST(vec_id AS VARCHAR)), whole) AS place FROM v) WHERE place <= {k}
)"""]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS centre FROM (
    SELECT cluster, j, CAST(sum(whole[j]) AS BIGINT) AS total, count(*) AS n FROM a{r} CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS j) GROUP BY cluster, j
  ) GROUP BY cluster
), c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.centre, c.centre) AS centre FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)""")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    return ", ".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.centre, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefixtrie import prefix_trie, spliced, turn_codes

    return prefix_trie(spliced(turn_codes(read_table(spark, sf_dir, "conversations"))))


#: CRC-32 of a decimal number's characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import merge_captures, read_archives, write_archives

    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = merge_captures(read_archives(spark, path))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_fingerprints,
        op2_pack_sequences,
        op3_quality_scores,
        op4_token_files,
        op5_simhash_components,
        op6_chat_windows,
        op7_top_k,
        op8_mix_sources,
        op9_main_text,
        op10_language,
        op11_cluster_vectors,
        op12_prefix_trie,
        op13_warc_captures,
    )
}

SQL: dict[str, str] = {
    "op13_warc_captures": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, strlen(html) AS bytes, h, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, g * 5 + 1, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY h, bytes) AS kept FROM d)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to FROM m
""",
    "op12_prefix_trie": f"""
WITH own AS MATERIALIZED (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS MATERIALIZED (
  SELECT o.conv_id, CASE WHEN d.turns IS NULL THEN list_slice(o.turns, h + 1, len(o.turns)) ELSE list_concat(list_slice(d.turns, 1, h), list_slice(o.turns, h + 1, len(o.turns))) END AS turns
  FROM (SELECT *, CAST({_CRC} % 9 AS INTEGER) AS h FROM own) o LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 5
), named AS MATERIALIZED (
  SELECT conv_id, turns, list_transform(range(0, len(turns) + 1), lambda d: sha256(CAST(list_transform(list_slice(turns, 1, d), lambda t: CAST(strlen(t.role) AS VARCHAR) || ':' || t.role || CAST(strlen(t.text) AS VARCHAR) || ':' || t.text) AS VARCHAR))) AS names FROM built
), pre AS MATERIALIZED (
  SELECT conv_id, d AS depth, names[d + 1] AS node, CASE WHEN d > 0 THEN names[d] END AS parent, d = len(turns) AS ends, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM named)
), node AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM pre GROUP BY node, depth
), kids AS MATERIALIZED (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent
), above AS MATERIALIZED (
  SELECT n.names[a + 1] AS top, (k.n_children IS NULL) AS leaf, (m.n_convs - 1) * m.bytes AS saved
  FROM (SELECT node, depth, conv_id AS rep, n_convs, bytes, unnest(range(0, depth + 1)) AS a FROM node) m JOIN named n ON n.conv_id = m.rep LEFT JOIN kids k ON k.node = m.node
), sums AS MATERIALIZED (SELECT top AS node, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY top)
SELECT CAST(n.conv_id AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM node n LEFT JOIN node p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node
""",
    "op11_cluster_vectors": _centroid_sql(),
    "op7_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.whole, c.whole), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op8_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS place FROM w
), l AS (
  SELECT *, greatest(sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 0::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o
), c AS (
  SELECT *, level * weight >= 3.0::DOUBLE * source_size AS capped FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size
    ELSE max(level) FILTER (NOT capped) OVER () * weight END AS target FROM c
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), x AS (
  SELECT *, target - whole * source_size AS rest FROM r
), u AS (
  SELECT d.doc_id, d.source, d.size, x.source_size, x.target, x.whole, x.rest, x.rest / x.source_size AS p,
    (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':42'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
), q AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS k FROM u
), g AS (
  SELECT *, CASE WHEN k IS NOT NULL THEN sum(size) OVER (PARTITION BY source, k IS NULL ORDER BY k, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS through FROM q
), f AS (
  SELECT *, k IS NOT NULL AND through <= rest AS inside FROM g
), h AS (
  SELECT *, rest - coalesce(max(through) FILTER (inside) OVER (PARTITION BY source), 0) AS gap FROM f
), z AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN k IS NOT NULL AND NOT inside AND size > 0 AND abs(size - gap) < gap THEN abs(size - gap) END NULLS LAST, k, doc_id) = 1
    AND k IS NOT NULL AND NOT inside AND size > 0 AND abs(size - gap) < gap AS closes FROM h
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN inside OR closes THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM z
""".replace("\\\\", "\\"),
}
