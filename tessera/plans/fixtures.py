"""Catalog-shaped views over the given tables; one SQL text serves Spark and the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_entity": """
SELECT concat('HERVL', lpad(CAST(p_partkey AS STRING), 7, '0')) AS uid, p_partkey AS k,
       concat(p_name, CASE WHEN p_partkey % 83 = 0 THEN ', ' ELSE '_' END, CAST(p_partkey % 97 AS STRING)) AS combined_id,
       concat(p_name, '_', CAST(p_partkey AS STRING), '.v2') AS versioned_id,
       p_brand AS grp, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE concat(CAST(p_size AS STRING), 'q') END AS band,
       CASE WHEN p_partkey % 501 = 0 THEN NULL ELSE p_type END AS origin
FROM {part}""",
    "fx_alias": """
SELECT uid, combined_id AS alias, 'combined_id' AS alias_type, 'r2' AS assignment, 1 AS is_current FROM {fx_entity}
UNION ALL SELECT e.uid, p.combined_id, 'combined_id', 'r1', 0 FROM {fx_entity} e JOIN {fx_entity} p ON p.k = e.k - 1 WHERE e.k % 4 = 0
UNION ALL SELECT uid, versioned_id, 'versioned_id', 'r2', 1 FROM {fx_entity}
UNION ALL SELECT uid, concat('TS-', CAST(k AS STRING)), 'telescope_id', 'r2', 1 FROM {fx_entity} WHERE k % 3 = 0
UNION ALL SELECT uid, CAST(k AS STRING), 'hervd_id', 'r2', 1 FROM {fx_entity} WHERE k % 2 = 0
UNION ALL SELECT uid, CAST(k % 500 AS STRING), 'ervmap_id', 'r2', 1 FROM {fx_entity} WHERE k % 7 = 0
UNION ALL SELECT uid, concat('K', CAST(k AS STRING), 'R, ERVK-', CAST(k + 1 AS STRING)), 'ervmap_alt_name', 'r2', 1 FROM {fx_entity} WHERE k % 10 = 0
UNION ALL SELECT uid, concat('HERV-Z', CAST(k AS STRING)), 'ervmap_alt_name', 'r2', 1 FROM {fx_entity} WHERE k % 41 = 0
UNION ALL SELECT uid, concat('Z', CAST(k - 1 AS STRING)), 'ervmap_alt_name', 'r2', 1 FROM {fx_entity} WHERE k % 41 = 1
UNION ALL SELECT uid, grp, 'dfam_int_model', 'r2', 1 FROM {fx_entity}
UNION ALL SELECT uid, concat('DF', CAST(k % 252 AS STRING)), 'dfam_accession', 'r2', 1 FROM {fx_entity}
UNION ALL SELECT uid, origin, 'repbase_name', 'r2', 1 FROM {fx_entity} WHERE origin IS NOT NULL""",
    "fx_coord": """
SELECT uid, 'hg38' AS assembly, concat('chr', CAST(k % 5 AS STRING)) AS chrom, k * 700 AS start0, k * 700 + 100 + (k % 50) * 20 AS end0 FROM {fx_entity} WHERE k % 13 <> 0
UNION ALL SELECT uid, 't2t', concat('chr', CAST(k % 5 AS STRING)), k * 700 + 50, k * 700 + 150 + (k % 50) * 20 FROM {fx_entity} WHERE k % 3 <> 0""",
    "fx_repeat": """
SELECT concat('chr', CAST(l_partkey % 5 AS STRING)) AS chrom,
       greatest(l_partkey * 700 + l_orderkey % 4000 - 2000, 0) AS start0,
       greatest(l_partkey * 700 + l_orderkey % 4000 - 2000, 0) + CAST(floor(l_quantity) AS BIGINT) * 10 AS end0,
       CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END AS strand,
       concat('rep', CAST(l_suppkey AS STRING)) AS rep_name,
       CASE WHEN l_partkey % 37 = 0 THEN 'DNA?/hAT' WHEN l_partkey % 41 = 0 THEN 'RC/Helitron' WHEN l_returnflag = 'A' THEN 'LTR/ERV1' WHEN l_returnflag = 'N' THEN 'LINE/L1' ELSE 'Simple_repeat' END AS rep_class_family,
       CAST(floor(l_extendedprice) AS BIGINT) AS sw_score, l_discount * 100 AS pct_div
FROM {lineitem}""",
    "fx_gtf_line": """
SELECT concat_ws(chr(9), CASE WHEN l_orderkey % 211 = 0 AND l_linenumber = 3 THEN 'chrX' ELSE concat('chr', CAST(l_orderkey % 5 AS STRING)) END, 'src',
       CASE WHEN l_linenumber = 7 THEN 'transcript' ELSE 'exon' END,
       CAST(l_orderkey * 23 + l_linenumber * 150 + l_partkey % 100 + 1 AS STRING),
       CAST(l_orderkey * 23 + l_linenumber * 150 + l_partkey % 100 + CAST(floor(l_quantity) AS BIGINT) AS STRING), '.',
       CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END, '.',
       concat('gene_id "G', CAST(l_orderkey % 1000 AS STRING), '";',
              CASE WHEN l_orderkey % 19 = 0 THEN '' ELSE concat(' transcript_id "T', CAST(l_orderkey AS STRING), '";') END,
              CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE concat(' gene_name "GENE', CAST(l_orderkey % 1000 AS STRING), '";') END)) AS line
FROM {lineitem}""",
    "fx_json": """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '{"share": NaN}' WHEN event_id % 89 = 0 THEN 'no value' ELSE props END AS props
FROM {events}""",
    "fx_rmsk_line": """
SELECT concat_ws('  ', CAST(sw_score AS STRING), '10.5', '0.0', '0.0', chrom, CAST(start0 + 1 AS STRING), CAST(end0 AS STRING), '(0)',
       CASE WHEN strand = '-' THEN 'C' ELSE '+' END, rep_name, rep_class_family, '1', '100', '(0)', '7',
       CASE WHEN sw_score % 23 = 0 THEN '*' END) AS line
FROM {fx_repeat}""",
    "fx_segment": """
SELECT uid, concat('seg', CAST(k % 40 AS STRING)) AS rep_name, k * 700 + j * 60 - 1500 AS a, k * 700 + j * 60 - 1500 + 50 AS b
FROM (SELECT *, 0 AS j FROM {fx_entity} UNION ALL SELECT *, 30 FROM {fx_entity} UNION ALL SELECT *, 55 FROM {fx_entity}) WHERE k % 5 <> 0""",
    "fx_orf": """
SELECT uid, CASE WHEN k % 4 = 0 THEN NULL ELSE concat('class', CAST(k % 3 AS STRING)) END AS orf_class, k * 700 + 10 AS a, k * 700 + 400 AS b FROM {fx_entity} WHERE k % 6 = 0""",
    "fx_domain": """
SELECT uid, CASE WHEN k % 2 = 0 THEN 'pol' END AS gene, 'a domain' AS domain_desc, k * 700 - 900 AS a, k * 700 - 700 AS b FROM {fx_entity} WHERE k % 3 = 0""",
    "fx_crossgenome": """
SELECT uid, CAST(80 + k % 20 AS DOUBLE) AS pct_identity, concat('x', CAST(k % 4 AS STRING)) AS xg_class FROM {fx_entity} WHERE k % 3 <> 1""",
    "fx_dfam": """
SELECT uid, concat('DF', CAST(k % 7 AS STRING)) AS consensus_name, k % 100 + 1 AS sw_score, CASE WHEN k % 4 <> 0 OR k % 100 + 1 >= 50 + k % 31 * 3 THEN 1 ELSE 0 END AS is_best_by_sw_score FROM {fx_entity} WHERE k % 2 = 0
UNION ALL SELECT uid, 'DFother', 50 + k % 31 * 3, CASE WHEN k % 100 + 1 < 50 + k % 31 * 3 THEN 1 ELSE 0 END FROM {fx_entity} WHERE k % 4 = 0 AND k % 100 + 1 <> 50 + k % 31 * 3""",
    "fx_packed_tx": """
SELECT concat('T', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS name, concat('chr', CAST(l_orderkey % 5 AS STRING)) AS chrom,
       CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_partkey % 103 = 0 THEN ',' ELSE concat(CAST(l_partkey AS STRING), ',', CAST(l_partkey + 50 AS STRING), ',') END AS starts,
       CASE WHEN l_orderkey % 10 = 3 THEN concat(CAST(l_partkey + 20 AS STRING), ',') WHEN l_partkey % 103 = 0 THEN '' ELSE concat(CAST(l_partkey + 20 AS STRING), ', ', CAST(l_partkey + 70 AS STRING), ',') END AS ends
FROM {lineitem}""",
    "fx_structure": """
SELECT uid, CASE WHEN k % 3 = 0 THEN 'LTR-int-LTR' ELSE 'int' END AS structure, CASE WHEN k % 7 = 0 THEN NULL ELSE concat('cat', CAST(k % 5 AS STRING)) END AS category FROM {fx_entity} WHERE k % 8 <> 0""",
    "fx_internal": """
SELECT uid, concat('int', CAST(k % 6 AS STRING)) AS element, k * 700 + 20 AS a, k * 700 + 90 AS b FROM {fx_entity} WHERE k % 5 = 1
UNION ALL SELECT uid, 'intZ', k * 700 - 10, k * 700 + 5 FROM {fx_entity} WHERE k % 10 = 1""",
    "fx_locus_repeat": """
SELECT uid, 'hg38' AS assembly, k * 700 + 30 AS start0, k * 700 + 60 AS end0, concat('rep', CAST(k % 9 AS STRING)) AS rep_name FROM {fx_entity} WHERE k % 4 <> 3
UNION ALL SELECT uid, 't2t', k * 700 - 40, k * 700 + 10, 'repT' FROM {fx_entity} WHERE k % 6 = 0
UNION ALL SELECT concat('NOT', uid), 't2t', k, k + 1, 'lost' FROM {fx_entity} WHERE k % 50 = 0""",
    "fx_hit_gene": """
SELECT uid, CASE WHEN k % 3 = 0 THEN 'hg38' ELSE 't2t' END AS genome, CASE WHEN k % 3 = 0 THEN 'gencode' ELSE 'refseq' END AS source,
       CASE WHEN k % 29 = 0 THEN NULL ELSE concat('GENE', CAST(k % 1000 AS STRING)) END AS ref_gene_name
FROM {fx_entity} WHERE k % 2 = 0""",
}


#: Views that are joined with themselves.  They are computed from packed files that Spark takes for small, so a side of the
#: join would go through the driver; it is a merge.
MERGED = {"fx_alias": ("fx_entity",)}
#: Given tables that views are made of.
TABLES = ("part", "lineitem", "events")


def _plain(text: str) -> str:
    for v in (*TABLES, *VIEWS):
        text = text.replace("{" + v + "}", v)
    return text


def _uses(name: str) -> list[str]:
    return [v for v in (*TABLES, *VIEWS) if "{" + v + "}" in VIEWS[name]]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of ``sf_dir``; nothing is registered."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace('{"share": NaN}', '{{"share": NaN}}')  # braces that name no table
    used = {u: view(spark, sf_dir, u) for u in _uses(name)}
    return spark.sql(text, **{u: df.hint("merge") if u in MERGED.get(name, ()) else df for u, df in used.items()})


def with_views(names: list[str], sql: str) -> str:
    """``sql`` after common table expressions for the views it needs."""
    order: list[str] = []

    def need(name: str) -> None:
        for u in _uses(name) if name in VIEWS else []:
            need(u)
        if name in VIEWS and name not in order:
            order.append(name)

    for n in names:
        need(n)
    heads = [f"{n} AS ({_plain(VIEWS[n])})" for n in order]
    return "WITH " + ",\n".join(heads) + ("\n" + sql if not sql.lstrip().startswith("WITH ") else ",\n" + sql.lstrip()[5:]) if heads else sql
