"""WARC archives of pages, and an index of their captures by an external merge.

Archives are written and read through Spark's text files with the record separator as line end, so they lie in any store
Spark reaches and a lost task is simply run again.  Of equal payloads one is kept; the others become revisits.

The index comes from locally sorted runs: a task sorts a bounded number of captures by URL key and time, cuts the run
at the bounds of key ranges and sends each piece on as one row.  A range's pieces, each in order already, are merged
by a tree of losers.  Ranges follow one another, so the whole is in order; their bounds are captures, not URLs, so one
URL with very many captures is cut like any other.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, shuffle_partitions, small, tidy

#: Fixed values of the format.
BREAK = "\r\n"
GAP = "\r\n\r\n"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(text: Column) -> Column:
    """SHA-1 of a text's UTF-8 bytes in upper-case base 32."""
    hexed = F.sha1(text)
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substr(hexed, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(fives, ""), BASE32_HEX, BASE32)


def payloads(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, bytes, captured`` of pages; null html is empty.

    Pages have no date of their own: the capture is page_id seconds after 1970, modulo 2 ** 31, and 0 for a null one.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    made = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    seconds = F.pmod(F.coalesce("page_id", F.lit(0).cast("long")), F.lit(1 << 31))
    captured = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return made.select("*", sha1_base32(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"), captured.alias("captured"))


def kept_payloads(rows: DataFrame, at_least: int = 0) -> DataFrame:
    """``digest, bytes, kept``: of payloads of ``at_least`` bytes that several records share, the largest page_id."""
    shared = rows.where(F.col("bytes") >= at_least).groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    return shared.where((F.col("n") > 1) & F.col("kept").isNotNull()).drop("n")


def record(row_kept: str = "kept") -> Column:
    """A row of ``payloads`` as a record, without the gap that ends it; a revisit if a larger page_id has the payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    uri = F.col("url")
    for sign, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        uri = F.replace(uri, F.lit(sign), F.lit(code))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col(row_kept).isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col(row_kept)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(GAP))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(VERSION + BREAK),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.col("captured")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", name(row_kept)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
    )
    return F.concat(head, F.lit(BREAK), http, F.when(again, "").otherwise(F.col("html")))


def write_archives(pages: DataFrame, path: str, *, at_least: int = 0, records_a_file: int = 50_000) -> None:
    """WARC files, gzip, of all ``page_id, url, html``, written to ``path``.

    Of records of one payload of ``at_least`` bytes or more, that of the largest page_id is a response and the others
    are revisits of it, without the payload; if several rows have that page_id, each is a response, and so is every row
    of a payload whose page_ids are all null; a null page_id beside others is a revisit.  Payloads are equal if their
    SHA-1 and length are.  White space in a URL is escaped.  Pages are read once for digests and once to be written;
    they are shuffled only if more payloads are shared than can be sent to all tasks.  Other columns are ignored.
    """
    rows = payloads(pages)
    scratch = Scratch(pages.sparkSession, "payloads")
    kept = scratch.write(kept_payloads(rows, at_least), "kept")
    marked = rows.join(small(kept, scratch.count("kept")), ["digest", "bytes"], "left")
    marked.select(record().alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)
    scratch.drop("kept")


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _capture(head: bytes, block: bytes) -> tuple:
    """page_id, url, captured, type, refers_to, bytes and digest of the full payload; an error if the payload is damaged."""
    fields = dict(line.split(": ", 1) for line in head.decode().split(BREAK)[1:])
    at = block.index(GAP.encode()) + len(GAP)
    http = dict(line.split(": ", 1) for line in block[: at - len(GAP)].decode().split(BREAK)[1:])
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response":
        payload = memoryview(block)[at:]
        if len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its digest says")
    refers = _number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Date"], kind, refers, size, digest


class Records:
    """Records of one archive from the parts that its gaps cut it into; a payload may hold gaps of its own."""

    def __init__(self):
        self.held, self.head, self.need, self.offset = bytearray(), None, 0, 0

    def feed(self, part: bytes) -> Iterator[tuple[int, tuple]]:
        """Offsets and captures of the records that ``part``, and the gap behind it, bring to their end."""
        self.held += part
        self.held += GAP.encode()
        while True:
            if self.head is None:
                end = self.held.find(GAP.encode())
                if end <= 0:
                    return
                self.head = bytes(self.held[:end])
                length = next(x for x in self.head.decode().split(BREAK) if x.startswith("Content-Length: "))
                self.need = end + len(GAP) + int(length.removeprefix("Content-Length: "))
            if len(self.held) < self.need + len(GAP):
                return
            yield self.offset, _capture(self.head, bytes(self.held[len(self.head) + len(GAP) : self.need]))
            self.offset += self.need + len(GAP)
            del self.held[: self.need + len(GAP)]
            self.head = None

    def close(self) -> None:
        if self.head is not None or bytes(self.held).strip():
            raise ValueError("an archive ends within a record")


def url_key(url: str | None) -> str:
    """A URL in sorting order: the host's parts from the last to the first, then the path and the sorted query."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    port = "" if port in (None, 80, 443) else f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}{port}){parts.path or '/'}{query}"


_CAPTURE = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64())]
    + [("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
)
_CAPTURE_DDL = "url_key string, captured string, page_id long, payload_digest string, archive string, offset long, url string, record_type string, refers_to long, payload_bytes long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in ``path``: what its headers say, its archive and its place there.

    An archive is read by one task, record after record; a task holds one record at a time.  The payload of a response
    must have the digest and length that its headers give; a revisit has those of the payload it refers to.
    """
    parts = spark.read.option("lineSep", GAP).text(path).select(F.col("_metadata.file_name").alias("archive"), "value")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, archive, made = None, None, []
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != archive:
                    if records:
                        records.close()
                    records, archive = Records(), name
                for offset, (page_id, url, captured, kind, refers, size, digest) in records.feed(part.as_buffer()):
                    made.append((url_key(url), captured, page_id, digest, archive, offset, url, kind, refers, size))
            if len(made) >= 10_000:
                yield _rows(made)
                made = []
        if records:
            records.close()
        yield _rows(made)

    return parts.mapInArrow(tidy(parse), _CAPTURE_DDL)


def _rows(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], f.type) for j, f in enumerate(_CAPTURE)], schema=_CAPTURE)


class LoserTree:
    """Merges sorted runs: every inner node keeps who lost there, so the next smallest costs one path to the top."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, k = runs, len(runs)
        self.at, self.heads = [0] * k, [r[0] if r else None for r in runs]
        self.losers, up = [0] * max(k, 1), [*[0] * k, *range(k)]
        for node in range(k - 1, 0, -1):
            a, b = up[2 * node], up[2 * node + 1]
            up[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = up[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return self.heads[a] <= self.heads[b]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and place in it of each item in order."""
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            node = (w + k) // 2
            while node:
                if not self._first(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def sort_keys(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    """What captures are ordered by: URL key, time, page_id with null first, digest, and where they lie."""
    columns = [table.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "payload_digest", "archive", "offset")]
    return [(key, when, page is not None, page or 0, *rest) for key, when, page, *rest in zip(*columns)]


def _runs(bounds, rows: int):
    """Sorted runs of ``rows`` captures, each cut at the ranges' bounds; a piece is one row of arrays."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        keys = sort_keys(table)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, table = [keys[i] for i in order], table.take(pa.array(order)).combine_chunks()
        at = [0, *(bisect_left(keys, b) for b in bounds.value), len(keys)]
        full = [r for r in range(len(at) - 1) if at[r] < at[r + 1]]
        offsets = pa.array([at[r] for r in full] + [len(keys)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, table.column(f.name).combine_chunks().cast(f.type)) for f in _CAPTURE]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *lists], names=["range", *_CAPTURE.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield from cut(held)
                held, n = [], 0
        if held:
            yield from cut(held)

    return tidy(run)


def _merged(pieces: pa.Table) -> pa.Table:
    lists = {f.name: pieces.column(f.name).combine_chunks() for f in _CAPTURE}
    sizes = lists["url_key"].value_lengths().to_numpy()
    flat = pa.table([lists[f.name].flatten() for f in _CAPTURE], names=_CAPTURE.names)
    keys, starts = sort_keys(flat), np.cumsum(sizes) - sizes
    order = [starts[run] + at for run, at in LoserTree([keys[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())])]
    merged = flat.take(pa.array(order, pa.int64()))
    ranges = pa.array(np.full(len(order), pieces.column("range")[0].as_py(), np.int32))
    return pa.table([ranges, pa.array(np.arange(len(order))), *merged.columns], names=["range", "place", *_CAPTURE.names])


def merge_captures(captures: DataFrame, *, run: int = 1 << 17, a_range: int = 1 << 20, sample: int = 16) -> DataFrame:
    """The captures with ``range`` and ``place``, by which they are in order of URL key, time and page_id, null first.

    A range has about ``a_range`` captures, which one task merges; its bounds are quantiles of about ``sample`` captures
    for each range, chosen by hash, which is all that the driver sees.  Repeated captures are told apart by where they
    lie.  No captures give no rows.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "captures")
    held = scratch.write(captures, "captures")
    n = scratch.count("captures")
    ranges = max(-(-n // a_range), min(shuffle_partitions(spark), n >> 12), 1)
    some = held.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(max(1, n // (sample * ranges)))) == 0) if ranges > 1 else held.limit(0)
    seen = sorted(sort_keys(some.toArrow()))
    bounds = spark.sparkContext.broadcast([seen[len(seen) * r // ranges] for r in range(1, ranges)] if seen else [])
    pieces = held.mapInArrow(_runs(bounds, run), "range int, " + ", ".join(f"{c} array<{t}>" for c, t in (x.split() for x in _CAPTURE_DDL.split(", "))))
    return pieces.groupBy("range").applyInArrow(_merged, f"range int, place long, {_CAPTURE_DDL}")
