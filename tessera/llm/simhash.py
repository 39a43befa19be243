"""SimHash near-duplicates: multi-index hashing over fingerprint segments, then connected components.

Documents of equal fingerprints are one node.  Two fingerprints that differ in at most four of 64 bits agree up to one
bit in one of the first two of three segments, or agree in the third.  So each fingerprint is filed under its three
segments and looked up under each segment as it is and, in the first two, with one bit cleared (of two segments that
differ in one bit, the one that has the bit finds the other).  What a lookup fetches is verified over all 64 bits.
Three segments of 21 bits suit up to some hundred million different fingerprints; with more, two segments of 32 bits,
which are looked up within two bits and one bit, keep what a lookup fetches short.  Both find the same links, and the
number of fingerprints decides.

A segment value that very many fingerprints share would make all their pairs, and one beside it, which they all look
up, as many rows.  Fingerprints that meet in such values go another way, which is exact as well and makes a fixed number
of rows for each: fingerprints within four bits have a value within two bits of both, so each is listed under all values
within two bits of it, and those listed under one value are linked to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small, tidy
from tessera.llm.tokens import text_groups

#: By the number of segments, the first bit, the width and the radius of lookups of each: of four differing bits, one
#: segment has no more than its radius.
SEGMENTS = {3: ((0, 21, 1), (21, 21, 1), (42, 22, 0)), 2: ((0, 32, 2), (32, 32, 1))}
DISTANCE = 4
#: Up to so many different fingerprints a segment of 21 bits is shared by 128 of them on average.
THREE_SEGMENTS = 1 << 28
#: Up to so many counted values are sent to all tasks.  All other joins here are merges: fingerprints are packed and then
#: exploded, or filed under many values, so what Spark takes for small would go through the driver many times as large.
FEW = 100_000


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number: bits that are set in over half of the shingles' XXH64."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], dtype=">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4) -> DataFrame:
    """``doc_id, fp`` for each row of ``doc_id, text``; null text is empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                made = pa.array([simhash(t, words) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), made], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _filed(fp: Column, segments: int) -> Column:
    """The values of all segments, told apart by a number above them."""
    parts = [F.shiftrightunsigned(fp, first).bitwiseAND(_long((1 << width) - 1)) for first, width, _ in SEGMENTS[segments]]
    return F.array(*[_long(k << 40) + part for k, part in enumerate(parts)])


def _ball(value: Column, width: int, radius: int) -> Column:
    """What is looked up beside a segment's value itself; null among it where a bit is not set."""
    if radius == 2:
        masks = [1 << i for i in range(width)] + [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
        return F.transform(F.array(*map(_long, masks)), value.bitwiseXOR)
    if radius == 1:
        return F.array(*[F.when(value.bitwiseAND(_long(1 << i)) != 0, value.bitwiseXOR(_long(1 << i))) for i in range(width)])
    return F.array().cast("array<long>")


def _looked(fp: Column, segments: int) -> Column:
    """The values to look up: each segment's ball of its radius."""
    filed = _filed(fp, segments)
    return F.array_compact(F.concat(filed, *[_ball(filed[k], width, radius) for k, (_, width, radius) in enumerate(SEGMENTS[segments])]))


def _beside(key: Column, segments: int) -> Column:
    """What fingerprints that are filed under ``key`` look up beside it."""
    found = F.array().cast("array<long>")
    for k, (_, width, radius) in enumerate(SEGMENTS[segments]):
        found = F.when(F.shiftright(key, 40) == k, _ball(key, width, radius)).otherwise(found)
    return F.array_compact(found)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def lookups(nodes: DataFrame, *, most: int = 256, segments: int = 3) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``node, fp, key`` of what is filed, ``l_node, l_fp, key`` of what is to be looked up in it, and ``node, fp`` of those
    that must be linked in another way, if there are any.

    A value is crowded if over ``most`` fingerprints are filed under it: no lookup goes there.  A value is besieged if
    fingerprints of crowded values, over ``32 * most`` of them, look it up: their lookups do not go there either, while
    those from other values, of which each has ``most`` at most, do.  So the rows that one value joins are bounded
    whatever share of the fingerprints has it or stands beside it.
    """
    filed = nodes.select("node", "fp", F.explode(_filed(F.col("fp"), segments)).alias("key"))
    looked = nodes.select(F.col("node").alias("l_node"), F.col("fp").alias("l_fp"), F.explode(_looked(F.col("fp"), segments)).alias("key"))
    scratch = Scratch(nodes.sparkSession, "lookups")
    crowded = scratch.write(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
    if not scratch.count("crowded"):
        return filed, looked, None
    values = _few(crowded.select("key"), scratch.count("crowded"))
    thin = looked.join(values, "key", "left_anti")
    dense = looked.join(values, "key").select(F.col("l_node").alias("node"), F.col("l_fp").alias("fp"))
    sent = crowded.select(F.col("key").alias("own"), "n", F.explode(_beside(F.col("key"), segments)).alias("key"))
    besieged = sent.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 32 * most).select("key")
    besieged = scratch.write(sent.join(besieged.hint("merge"), "key").join(values, "key", "left_anti").select("own", "key"), "besieged")
    if scratch.count("besieged"):
        own = F.element_at(_filed(F.col("l_fp"), segments), (F.shiftright("key", 40) + 1).cast("int"))
        thin = thin.withColumn("own", own).join(_few(besieged, scratch.count("besieged")), ["own", "key"], "left_anti").drop("own")
        beside = _few(besieged.select("key").distinct(), scratch.count("besieged"))
        dense = dense.union(filed.join(beside, "key", "left_semi").select("node", "fp"))
    return filed, thin, dense.distinct()


def near_pairs(nodes: DataFrame, *, most: int = 256, segments: int = 3) -> DataFrame:
    """``a, b``: links between ``node``s whose ``fp`` differ in at most four bits.

    ``nodes`` has distinct ``fp`` and a ``node`` id each.  Pairs that only crowded or besieged segment values would bring
    together (see ``lookups``) come as chains through common midpoints, so not every close pair is listed but all are
    connected.
    """
    filed, thin, dense = lookups(nodes, most=most, segments=segments)
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("l_fp"))) <= DISTANCE
    pairs = thin.join(filed.hint("merge"), "key").where((F.col("node") != F.col("l_node")) & close)
    pairs = pairs.select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b"))
    if dense is None:
        return pairs.distinct()
    # all values within two bits: positions i < j, where 64 stands for no bit
    bit = lambda c: F.when(F.col(c) < 64, F.expr(f"shiftleft(1L, {c})")).otherwise(F.lit(0).cast("long"))
    firsts = dense.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    seconds = firsts.select("node", "fp", "i", F.explode(F.when(F.col("i") < 64, F.sequence(F.col("i") + 1, F.lit(64))).otherwise(F.array(F.lit(64)))).alias("j"))
    listed = seconds.select("node", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("middle"))
    least = listed.groupBy("middle").agg(F.min("node").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    chained = listed.join(least.hint("merge"), "middle").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    return pairs.union(chained).distinct()


def components(links: DataFrame, *, rounds: int = 60, per_file: int = 500_000) -> DataFrame:
    """``node, component``: the smallest node that each linked node of ``a, b`` can reach.

    Large-star and small-star rounds; each round's links are written to the shared folder and the round before them is
    deleted.  It ends when a round changes nothing, so that every link goes from a node to the smallest of its
    component.  A round's count and checksum are taken while it is written, and no round has more links than the first.
    """
    scratch = Scratch(links.sparkSession, "components")
    check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    first = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = scratch.write(first, "links", check)
    found = lambda: links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        state = scratch.rows["links"]
        if not state[0]:
            return found()
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(smallest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(smallest.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = small_star.union(smallest.select("u", F.col("m").alias("v"))).distinct().coalesce(1 + state[0] // per_file)
        links = scratch.write(made, "links", check)
        scratch.drop_older("links")
        if scratch.rows["links"] == state:
            return found()
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, *, words: int = 4, most: int = 256, segments: int | None = None, hot: int = 100_000) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest doc_id that links of at most four bits reach.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null text counts as empty; texts without words
    have fingerprint zero and are linked like any other.  Rows that share a doc_id each have their fingerprint and
    are linked by it alone.  Rows of null doc_id link others; a component of null ids only has a null component_id.
    An empty table gives an empty result.

    ``segments`` is three up to ``THREE_SEGMENTS`` different fingerprints, two beyond, if it is not given.  The rows of
    fingerprints that over ``hot`` rows share stay where they are: what such a fingerprint needs to know is one row,
    and there are at most as many as rows divided by ``hot``.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, words=words), "marked")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    keyed = scratch.write(nodes.select("fp", "least", "n", F.col("fp").alias("node")), "nodes", F.count_if(F.col("n") > hot).alias("hot"))
    if segments is None:
        segments = 3 if scratch.count("nodes") <= THREE_SEGMENTS else 2
    found = components(near_pairs(keyed.select("node", "fp"), most=most, segments=segments))
    labelled = keyed.join(found.hint("merge"), "node", "left").select("fp", "least", "n", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(least.hint("merge"), "component").select("fp", "n", "component_id")
    if scratch.rows["nodes"][1]:
        by_fp = scratch.write(by_fp, "by_fp")
        often = small(by_fp.where(F.col("n") > hot).select("fp", "component_id"), scratch.rows["nodes"][1])
        joined = marked.join(often, "fp").unionByName(marked.join(often, "fp", "left_anti").join(by_fp.drop("n").hint("merge"), "fp"))
    else:
        joined = marked.join(by_fp.drop("n").hint("merge"), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
