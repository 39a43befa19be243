"""Token-id files: one zstandard dictionary for all documents, one frame for each document, and an offset index.

A file set is a folder of three Parquet tables, so that any store Spark can reach holds it:

``dictionary``  ``dict_hash, content``: the dictionary, trained on serialized id arrays of a bounded sample.
``blocks``      one row for each block of consecutive documents in ascending id order: ``part, block, dict_hash,
                first_doc, last_doc, n_docs, doc_ids, starts, counts, frame_ends, payload``; ``payload`` holds the
                frames of the documents one after another, ``frame_ends`` where each ends, ``starts`` the ids that come
                before each document within its part.
``parts``       ``part, base``: ids that come before each part.

A document's ids are one slice of one payload, decompressed alone; ``first_doc`` and ``last_doc`` let the Parquet
reader skip all other blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, tidy
from tessera.llm.tokens import array_groups, encoder, tokenizer_path

BLOCKS = (
    "part int, block int, dict_hash string, first_doc long, last_doc long, n_docs int, doc_ids array<long>, "
    "starts array<long>, counts array<long>, frame_ends array<long>, payload binary"
)


def train_dictionary(docs: DataFrame, path: str, *, size: int = 65_536, sample: int = 1024, longest_chars: int = 4096) -> bytes:
    """A zstandard dictionary from the id arrays of whole documents of up to ``longest_chars`` among about ``sample``.

    The sample is a documented bound: the documents whose ids and texts hash lowest.  It is encoded in one task.  The dictionary only affects how well short documents compress, never what is read back.  Too little text
    for training gives no dictionary (empty).
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        arrays = [a for batch in batches for a in encoder(path).encode_many(batch.column(0))]
        try:
            made = zstandard.train_dictionary(size, [a for a in arrays if len(a) >= 8]).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["content"])

    share = min(1.0, sample / max(1, docs.select("doc_id").count()))
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))  # of a low hash there are about ``sample``, and no others are sent
    few = docs.where((lot < int(share * (1 << 32)) + 1) & F.length("text").between(1, longest_chars)).select(lot.alias("lot"), "text")
    found = few.orderBy("lot", "text").limit(sample).select("text").repartition(1).sortWithinPartitions("text").mapInArrow(tidy(train), "content binary").collect()
    return max((bytes(r["content"]) for r in found), key=len, default=b"")


def dictionary_hash(content: bytes) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(content, seed=0)


def write_tokens(
    docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, block_bytes: int = 1_000_000, level: int = 1, **training
) -> None:
    """Encode ``doc_id, text`` of ``docs`` and write a file set to ``path`` in ascending doc_id order.

    Null text is empty, so a document of ``end_id`` alone.  A null doc_id sorts first; rows that share a doc_id are all
    kept, in order of their text.  An empty table gives empty tables.  The text is shuffled once, by ranges of doc_id;
    each task writes its blocks as it reads, so memory holds one block and one group of texts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    content = train_dictionary(docs, tokenizer, **training)
    spark.createDataFrame([(dictionary_hash(content), content)], "dict_hash string, content binary").write.parquet(f"{path}/dictionary")
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(content) if content else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=known).compress
        tokens, part, block, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, starts, counts, frames, held = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            row = (part, block, dictionary_hash(content), ids[0], ids[-1], len(ids), ids, starts, counts, np.cumsum([len(f) for f in frames]).tolist(), b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        names = [f.split()[0] for f in BLOCKS.split(", ")]
        many = pa.list_(pa.int64())
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), many, many, many, many, pa.binary()]
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in array_groups(texts):
                for doc, raw in zip(docs_[a:b], tokens.encode_many(texts.slice(a, b - a))):
                    frame = compress(raw + end)
                    ids.append(doc), starts.append(start), counts.append(len(raw) // 4 + 1), frames.append(frame)
                    start += len(raw) // 4 + 1
                    held += len(frame)
                    if held >= block_bytes:
                        yield close()
                        ids, starts, counts, frames, held, block = [], [], [], [], 0, block + 1
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(encode), BLOCKS).write.parquet(f"{path}/blocks")
    # one row a part: what comes before each is a sum over the parts, of which there are as many as tasks
    parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base, rows = 0, []
    for r in sorted(parts.collect()):
        rows.append((r["part"], base))
        base += r["n"]
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, *, arrays: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, and its ``ids`` if ``arrays``, all read from the files.

    ``doc_ids`` reads those documents only: other blocks are skipped and other frames of a block stay compressed.
    A file that was compressed with another dictionary is refused.
    """
    held = spark.read.parquet(f"{path}/dictionary").collect()
    content = bytes(held[0]["content"]) if held else b""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is not None:
        wanted = F.lit(False)
        for d in doc_ids:
            wanted = wanted | ((F.col("first_doc").isNull() | (F.col("first_doc") <= d)) & (F.col("last_doc") >= d))
        blocks = blocks.where(wanted)
    only = None if doc_ids is None else frozenset(doc_ids)
    located = blocks.join(F.broadcast(spark.read.schema("part int, base long").parquet(f"{path}/parts")), "part")
    columns = ["base", "dict_hash", "doc_ids", "starts", "counts", "frame_ends", "payload"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(content) if content else None
        decompress = zstandard.ZstdDecompressor(dict_data=known).decompress
        expected = dictionary_hash(content)
        for batch in batches:
            for i in range(batch.num_rows):
                base, dict_hash, docs_, starts, counts, ends, payload = (batch.column(k)[i].as_py() for k in range(len(columns)))
                if dict_hash != expected:
                    raise ValueError(f"written with dictionary {dict_hash}, not {expected}")
                out: list[tuple] = []
                begin = 0
                for doc, start, n, end in zip(docs_, starts, counts, ends):
                    if only is None or doc in only:
                        raw = decompress(payload[begin:end])
                        if len(raw) != 4 * n:
                            raise ValueError(f"document {doc} has {len(raw) // 4} ids, not {n}")
                        out.append((doc, base + start, len(raw) // 4, zlib.crc32(raw), raw))
                    begin = end
                got = list(zip(*out)) or [[]] * 5
                fields = [pa.array(got[k], pa.int64()) for k in range(4)]
                if arrays:
                    fields.append(pa.array([np.frombuffer(r, "<u4").astype(np.int64) for r in got[4]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(fields, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * arrays)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * arrays
    return located.select(*columns).mapInArrow(tidy(decode), schema)
