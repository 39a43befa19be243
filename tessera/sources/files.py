"""Readers and writers: catalog tables, annotation text, tile payloads, bundles in hashed buckets."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import bucket
from tessera.functions.text import finite_deep, integer_list
from tessera.sources.schemas import SCHEMAS, TILE_RECORD


def read_catalog(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A catalog table by its schema; columns and filters reach the scan.  Coordinates become ``start0, end0``, the key ``uid``."""
    df = spark.read.schema(SCHEMAS[table]).parquet(path) if table in SCHEMAS else spark.read.parquet(path)
    df = df if columns is None else df.select(*columns)
    df = df if where is None else df.where(where)
    return df.withColumnsRenamed({"locus_uid": "uid", "start": "start0", "end": "end0", "group": "grp"})


def read_catalog_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """The same from a database, through whatever driver the session has.

    With a whole-number ``key`` the table is read in ``partitions`` ranges of it at once, between the least and the
    largest, which the database is asked for; rows of a null key come with the first.  Columns and filters that are
    applied to the result reach the database.
    """
    source = lambda: spark.read.format("jdbc").options(url=url, **options)
    ranges = {}
    if key is not None:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        low, high = source().option("query", f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}").load().first()
        if low is not None and low < high:
            ranges = {"partitionColumn": key, "lowerBound": low, "upperBound": high + 1, "numPartitions": partitions}
    df = source().options(dbtable=table, **ranges).load()
    return df.withColumnsRenamed({"locus_uid": "uid", "start": "start0", "end": "end0", "group": "grp"})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only a session that runs in this one process may leave it unset; it then gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_texts(rows: DataFrame, path: str, by: list[str]) -> None:
    """``value`` of each row as a file of its own, in folders of the ``by`` columns, which tell rows apart.

    There are as many files as rows, so each task puts its own in place; else the driver would, one after another.
    """
    rows.select("value", *by).repartition(*by).write.partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def for_assembly(coords: DataFrame, assembly: str) -> DataFrame:
    """Rows of one assembly; an error if there are none."""
    rows = coords.where(F.col("assembly") == assembly)
    if rows.isEmpty():
        raise ValueError(f"no coordinates of assembly {assembly!r}")
    return rows


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``line, source`` of text files, plain or gz.  A gz file is one task to read, so its lines are dealt out after."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source"))
    return lines.repartition(partitions) if partitions else lines


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of tile payloads, each a list of records or a map from chromosome to such a list.

    Every file is one JSON text; fields that are absent are null, others are ignored.
    """
    texts = spark.read.text(path, wholetext=True).select("value")
    as_list = F.from_json("value", f"array<struct<{_fields(TILE_RECORD)}>>")
    as_map = F.from_json("value", f"map<string,array<struct<{_fields(TILE_RECORD)}>>>")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    rows = texts.select(F.explode(F.when(is_list, as_list).otherwise(F.flatten(F.map_values(as_map)))).alias("r")).select("r.*")
    return rows.withColumn("exonStarts", integer_list(F.col("exonStarts"))).withColumn("exonEnds", integer_list(F.col("exonEnds")))


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in ddl.split(", ")))


def materialise(df: DataFrame, path: str, *, reuse: bool = True) -> DataFrame:
    """Reads ``path`` if it holds a finished table, or writes ``df`` there and reads it."""
    spark = df.sparkSession
    if not (reuse and exists(spark, f"{path}/_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Fixed value: the name of the hash that manifests give.
HASH = "djb2_mod"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _switch(spark: SparkSession, path: str, manifest: dict) -> None:
    """Puts the manifest in place of the one before by one rename, so that a reader finds the old one or the new one."""
    jvm = spark._jvm
    fresh, fs = _fs(spark, f"{path}/manifest-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    at = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), at, over)


def manifest_of(spark: SparkSession, path: str) -> dict:
    """``n_buckets``, ``hash``, ``n_documents`` and ``version`` of the bundle that is in force."""
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
    return json.loads(text)


def in_buckets(documents: DataFrame, buckets: int) -> DataFrame:
    """Documents as they are written: without NaN and infinities, which become null, and with their bucket."""
    clean = documents.select(*[finite_deep(F.col(f.name), f.dataType).alias(f.name) for f in documents.schema.fields])
    return clean.withColumn("bucket", bucket(F.col("uid"), buckets))


def append_documents(placed: DataFrame, folder: str) -> None:
    """Documents with a ``bucket`` as gzip JSON lines, nulls written, in ``bucket=`` folders."""
    placed.repartition("bucket").write.mode("append").partitionBy("bucket").option("compression", "gzip").option("ignoreNullFields", "false").json(folder)


def write_bundle(documents: DataFrame, path: str, buckets: int = 400, keep: int = 1) -> str:
    """Documents as strict JSON lines in ``bucket=`` folders by the hash of their uid; gives the folder they are in.

    They go to a folder of their own, a version, and are in force once the manifest names it.  A reader that began
    before goes on with the version it found: ``keep`` versions before this one stay, older ones are deleted.
    """
    spark = documents.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    seen = Observation()
    append_documents(in_buckets(documents, buckets).observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/{version}")
    _switch(spark, path, {"n_buckets": buckets, "hash": HASH, "n_documents": seen.get["n"], "version": version})
    root, fs = _fs(spark, path)
    before = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    for old in before[: max(0, before.index(version) - keep)]:
        drop(spark, f"{path}/{old}")
    return f"{path}/{version}"


def read_bundle(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All documents of the version in force; a line that cannot be read is kept in ``_corrupt``, its ``bucket`` is the folder's."""
    with_bucket = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType()), T.StructField("bucket", T.IntegerType())])
    reader = spark.read.schema(with_bucket).option("columnNameOfCorruptRecord", "_corrupt").option("allowNonNumericNumbers", "false")
    return reader.json(f"{path}/{manifest_of(spark, path)['version']}")


def lookups(uids: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """``uid, bucket, found`` and the document of each distinct ``uid``; one that is not there names the bucket it is not in.

    The uids' buckets prune the folders that are read, while the job runs; how many buckets there are, the manifest says.
    """
    spark = uids.sparkSession
    n = int(manifest_of(spark, path)["n_buckets"])
    wanted = uids.select("uid").where(F.col("uid").isNotNull()).distinct().withColumn("bucket", bucket(F.col("uid"), n))
    wanted = wanted.where(F.col("bucket") < n)  # which always holds; Spark prunes only by a side that has a filter
    there = read_bundle(spark, path, schema).where(F.col("uid").isNotNull()).drop("_corrupt").withColumn("found", F.lit(True))
    met = wanted.join(there, ["uid", "bucket"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return met.select("uid", "bucket", "found", *[f.name for f in schema.fields if f.name != "uid"])


def lookup(spark: SparkSession, path: str, schema: T.StructType, uid: str) -> DataFrame:
    """One document, from its bucket alone; an error that names the bucket if it is not there."""
    row = lookups(spark.createDataFrame([(uid,)], "uid string"), path, schema)
    found = row.where("found")
    if found.isEmpty():
        raise KeyError(f"{uid} is not in bucket {row.first().bucket}")
    return found.drop("found", "bucket")


def write_gene_models(models: DataFrame, path: str) -> None:
    """Gene models in ``assembly=`` folders."""
    models.write.mode("overwrite").partitionBy("assembly").parquet(path)


