"""Near-duplicates by the likeness of texts: documents whose sets of five-word shingles have Jaccard 0.8 or more.

Candidates come from the SimHash tables of ``simhash.near_pairs`` and, as fingerprints of such texts differ in about ten
of 64 bits, too many for small Hamming balls, from bands of one-permutation MinHash as well: 36 bands of seven minima
each, of which two texts of Jaccard 0.8 share none with a chance of one in 5,000, and of 0.85 one in a million.  Every
candidate is checked on the shingles themselves, and what is left are links for components.  Texts of equal shingles
are one node.

Sets are large, so few pairs of them are brought together.  First each node is compared with the smallest node that it
shares a band with, and with its SimHash candidates.  Nodes that share a band and are in different components by then
are compared with two nodes of the band's largest component.  A group of near copies, however large, is one component
after that for the most part, and its other pairs are never made.  Those that are so still meet all nodes of the other
components, first by their parities: 1,024 bits, each the parity of the number of shingles that fall on it.  Sets
differ in at least as many shingles as their parities in bits, and two sets of Jaccard 0.8 in a ninth of both sizes at
most, so what parities turn down cannot be a link; only the sets of other pairs are fetched.

A band that over ``most`` nodes share may hold several components still.  If those beside its largest one have over
``most`` nodes, its nodes are filed under pairs of bands first, then fours and so on, which links what is most alike
without making all pairs of a group.  What is in different components of such a band after that is compared by parities
like the rest, so that whatever shares a band and is not linked otherwise is compared, however crowded the band is.

Those comparisons are dealt out: nodes of a band lie in classes of like size, each cut into parts of about ``most``, and a
node goes to the parts of its own class and of the two beside it, as others cannot be alike.  So no part is large,
whatever share of all nodes a band holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small, tidy
from tessera.llm.minhash import OnePermutation, ShingleHasher, mix64
from tessera.llm.simhash import THREE_SEGMENTS, components, near_pairs
from tessera.llm.tokens import text_groups

WORDS = 5
LIKENESS = 0.8
#: At Jaccard 0.8 a pair shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS.
BINS, BANDS, ROWS = 256, 36, 7
#: Parities are so many numbers of 64 bits.
PARITIES = 16
#: Sizes of texts that are alike differ by a quarter at most, so they are in one class of this ratio or in two side by side.
CLASS_RATIO = 1.26
MARK = f"struct<n:int,{','.join(f'p{i}:long' for i in range(PARITIES))}>"


def bands(minima: np.ndarray) -> np.ndarray:
    """One number for each band of the bins' minima."""
    found = np.arange(BANDS, dtype=np.uint64)
    for row in minima[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        found = mix64(found * np.uint64(0x9E3779B97F4A7C15) + row)
    return found


def majority(hashes: np.ndarray) -> int:
    """The SimHash of the hashes, signed: bits that are set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(np.int64)[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of the bits, whether an odd number of the hashes falls on it."""
    bits = 64 * PARITIES
    odd = np.bincount((mix64(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marks(sets: list[np.ndarray]) -> pa.Array:
    """The size and the parities of each set."""
    words = np.stack([parities(s) for s in sets]).T
    columns = [pa.array([len(s) for s in sets], pa.int32()), *map(pa.array, words)]
    return pa.StructArray.from_arrays(columns, names=["n", *(f"p{i}" for i in range(PARITIES))])


def may_be_alike(a: str, b: str, likeness: float = LIKENESS) -> Column:
    """False where the sets that ``a`` and ``b`` are the marks of cannot have that Jaccard likeness."""
    differing = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITIES)), F.lit(0))
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(x, y) >= likeness * F.greatest(x, y) - 1e-9
    return sizes & (differing <= (x + y) * ((1 - likeness) / (1 + likeness)) + 1e-9)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """``docs`` with what ``make`` gives for its last column, the texts, in that column's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minhash, names = ShingleHasher(WORDS), OnePermutation(BINS, words=WORDS), [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in text_groups(texts):
                sets = [np.unique(hasher(t)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *make(sets, minhash)], names=names)

    return docs.mapInArrow(tidy(run), schema)


def sketches(keyed: DataFrame) -> DataFrame:
    """``row, file, at, doc_id, text_hash, same, fp, bands`` of each row; ``same`` tells sets apart."""

    def make(sets: list[np.ndarray], minhash: OnePermutation) -> list[pa.Array]:
        same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets])
        fps = pa.array([majority(s) for s in sets], pa.int64())
        return [same, fps, _lists([bands(minhash.minima(s)) if len(s) else s for s in sets])]

    text = F.col("text").cast("string")
    columns = F.monotonically_increasing_id().alias("row"), "file", "at", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    return _mapped(keyed.select(*columns), make, "row long, file long, at long, doc_id long, text_hash long, same binary, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles, mark`` for ``node, text``."""
    made = lambda sets, _: [_lists(sets), _marks(sets)]
    return _mapped(texts.select("node", F.col("text").cast("string")), made, f"node long, shingles array<long>, mark {MARK}")


def alike(pairs: DataFrame, sets: DataFrame, *, likeness: float = LIKENESS) -> DataFrame:
    """The pairs ``a, b`` whose ``shingles`` have at least that Jaccard likeness."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    enough = common >= likeness * (F.size("of_a") + F.size("of_b") - common) - 1e-9
    fits = F.least(F.size("of_a"), F.size("of_b")) >= likeness * F.greatest(F.size("of_a"), F.size("of_b")) - 1e-9
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(fits & enough).select("a", "b")


def _keys(width: int) -> Column:
    """Numbers for ``width`` bands at a time: each band with others at three distances."""
    twice, every = F.concat("bands", "bands"), F.sequence(F.lit(1), F.lit(BANDS))
    at = lambda step: F.transform(every, lambda i: F.xxhash64(*[F.element_at(twice, (i + step * k - 1) % BANDS + 1) for k in range(width)], F.lit(step)))
    return F.concat(*map(at, (1, 5, 11)))


def members(filed: DataFrame) -> DataFrame:
    """Rows ``node, key`` whose key has several nodes, with their number ``n`` and the ``least`` of them."""
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    return filed.join(shared.hint("merge"), "key").select("node", "key", "n", "least")


def toward(placed: DataFrame) -> DataFrame:
    """``a, b``: the nodes beside the largest component ``c`` of each ``key``, each with two nodes of that component.

    Which two is by a hash of node and key, so a node meets other ones under each of its keys.
    """
    lot = F.struct(F.xxhash64("node", "key").alias("lot"), "node")
    by = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"), F.min(lot)["node"].alias("first"), F.max(lot)["node"].alias("last"))
    largest = by.groupBy("key").agg(F.max(F.struct("size", "c", "first", "last")).alias("m")).select("key", "m.*").withColumnRenamed("c", "main")
    met = placed.join(largest.hint("merge"), "key").where(F.col("c") != F.col("main")).select("node", F.explode(F.array("first", "last")).alias("x"))
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))


def standing(placed: DataFrame) -> DataFrame:
    """``placed``, ``node, key, c``, with the key's largest component ``main`` and how many nodes are ``beside`` it."""
    by = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    largest = by.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "c")).alias("m"))
    return placed.join(largest.select("key", F.col("m.c").alias("main"), (F.col("all") - F.col("m.size")).alias("beside")).hint("merge"), "key")


def across(rest: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """``a, b``: nodes of one ``key`` and different components that ``marks``, ``node, mark``, let be alike.

    ``rest`` is what ``standing`` gives.  Each node beside the largest component asks all parts of the classes that it
    can be alike to; a part has about ``most`` nodes.
    """
    size_class = F.floor(F.log(F.greatest("mark.n", F.lit(1))) / F.log(F.lit(CLASS_RATIO))).cast("int")
    marked = rest.join(marks.hint("merge"), "node").withColumn("k", size_class)
    parts = marked.groupBy("key", "k").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n"))
    parts = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("parts"))  # a few dozen classes at most
    dealt = marked.join(parts.hint("merge"), "key")
    held = dealt.select("key", "k", F.pmod(F.xxhash64("node"), F.col("parts")[F.col("k")]).cast("int").alias("part"), "node", "c", "mark", (F.col("c") == F.col("main")).alias("inner"))
    near = F.filter(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1), lambda k: F.map_contains_key("parts", k))
    asks = dealt.where(F.col("c") != F.col("main")).select("key", F.explode(near).alias("k"), "parts", F.col("node").alias("x"), F.col("c").alias("x_c"), F.col("mark").alias("x_mark"))
    asks = asks.select("key", "k", F.explode(F.sequence(F.lit(0), F.col("parts")[F.col("k")] - 1)).alias("part"), "x", "x_c", "x_mark")
    once = (F.col("c") != F.col("x_c")) & (F.col("inner") | (F.col("x") < F.col("node")))
    met = asks.join(held.hint("merge"), ["key", "k", "part"]).where(once & may_be_alike("mark", "x_mark"))
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))


def grouped(keyed: DataFrame, scratch: Scratch, *, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """For rows ``file, at, doc_id, text``, which ``file`` and ``at`` tell apart: their sketches, with a number ``row``, and
    for each set of shingles (``same``) its ``component`` and the ``best`` of its rows.

    Best is the smallest (doc_id with null last, hash of the text, row).  doc_id may be null or repeated and links
    nothing.  Texts without words are copies of each other.
    """
    marked = scratch.write(sketches(keyed), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "row")
    nodes = scratch.write(
        marked.groupBy("same").agg(F.min("row").alias("node"), F.min(order).alias("best"), F.first("file").alias("file"), F.first("at").alias("at"), F.first("fp").alias("fp"), F.first("bands").alias("bands")),
        "nodes",
    )
    banded = nodes.where(F.size("bands") > 0)
    shared = scratch.write(members(banded.select("node", F.explode("bands").alias("key"))), "shared")
    nearest = shared.groupBy("node").agg(F.min("least").alias("a")).where(F.col("a") < F.col("node")).select("a", F.col("node").alias("b"))
    segments = 3 if scratch.count("nodes") <= THREE_SEGMENTS else 2
    pairs = scratch.write(nearest.union(near_pairs(banded.select("node", "fp"), segments=segments)).distinct(), "pairs")
    wanted = shared.select("node").union(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = scratch.write(nodes.select("node", "file", "at").join(wanted.hint("merge"), "node", "left_semi"), "wanted")
    texts = keyed.join(small(wanted, scratch.count("wanted")), ["file", "at"]).select("node", "text")
    sets = scratch.write(shingle_sets(texts), "sets")
    scratch.drop("wanted")
    links = scratch.write(alike(pairs, sets), "links")
    found = components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows ``node, key`` of keys whose nodes are in different components, with the component ``c``."""
        own = rows.join(found, "node", "left").select("node", "key", F.coalesce("component", "node").alias("c"))
        mixed = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        return own.join(mixed.hint("merge"), "key")

    compared = pairs

    def compare(more: DataFrame) -> None:
        nonlocal links, compared, found
        pairs = scratch.write(more.distinct().join(compared.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        if scratch.count("pairs"):
            links = links.union(scratch.write(alike(pairs, sets), "links"))
            compared = compared.union(pairs)
            if scratch.count("links"):
                found = components(links)

    width, filed, first_crowded = 1, shared.select("node", "key"), None
    while True:
        placed = scratch.write(labelled(filed), "placed")
        if not scratch.count("placed"):
            break
        compare(toward(placed))
        placed = scratch.write(labelled(placed.select("node", "key")), "placed")
        stands = scratch.write(standing(placed), "stands")
        compare(across(stands.where(F.col("beside") <= most), sets.select("node", "mark"), most))
        crowded = scratch.write(stands.where(F.col("beside") > most).select("node", "key"), "crowded")
        if width == 1 and scratch.count("crowded"):
            first_crowded = crowded
        width *= 2
        if not scratch.count("crowded") or width > BANDS:
            break
        filed = members(banded.join(crowded.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.explode(F.array_distinct(_keys(width))).alias("key"))).select("node", "key")
    if first_crowded is not None:
        placed = scratch.write(labelled(first_crowded), "placed")
        if scratch.count("placed"):
            compare(across(scratch.write(standing(placed), "stands"), sets.select("node", "mark"), most))
    return marked, nodes.join(found, "node", "left").select("same", "best", F.coalesce("component", "node").alias("component"))


def near_copies(docs: DataFrame, *, most: int = 256) -> DataFrame:
    """``doc_id, row, text_hash, component``: for each ``doc_id, row, text`` a number that rows linked by near copies share.

    ``row`` is a whole number that tells rows apart and must not change when ``docs`` is read again; doc_id may be null
    or repeated and links nothing.  Texts without words are copies of each other.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    keyed = docs.select(F.lit(0).cast("long").alias("file"), F.col("row").cast("long").alias("at"), "doc_id", "text")
    marked, sets = grouped(keyed, scratch, most=most)
    return marked.join(sets, "same").select("doc_id", F.col("at").alias("row"), "text_hash", "component")


def one_of_each_group(docs: DataFrame, *, most: int = 256) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs`` as they are, whatever they are called.

    ``docs`` needs ``doc_id`` and ``text``.  Of a group the row of the smallest doc_id stays, null last, then that of the
    smallest hash of the text; of rows that are the same in both, any one.  Null text is empty, and texts without words are one group.
    A row of null or repeated doc_id is dropped only if its text is a near copy of one that stays.  An empty table gives
    an empty result.  Rows are told apart by their place in the files that ``docs`` is read from; if it is not read
    straight from files, it is written first.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    try:
        whole = docs.select(F.struct(*docs.columns).alias("doc"), "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        whole = scratch.write(docs.select(F.struct(*docs.columns).alias("doc")), "docs").select("doc", "_metadata.file_path", "_metadata.row_index")
    keyed = whole.select("doc", F.xxhash64("file_path").alias("file"), F.col("row_index").alias("at"))
    rows, sets = grouped(keyed.select("file", "at", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), scratch, most=most)
    kept = sets.groupBy("component").agg(F.min("best").alias("best")).select("best.row")
    dropped = scratch.write(rows.join(kept.hint("merge"), "row", "left_anti").select("file", "at"), "dropped")
    scratch.keep("docs", "dropped")
    return keyed.join(small(dropped, scratch.count("dropped")), ["file", "at"], "left_anti").select("doc.*")
