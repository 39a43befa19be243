import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://www.Example.com/a?y=2&x=1", "<p>same</p>"),
    (2, "http://example.com/a", "<p>same</p>"),
    (7, None, "<p>same</p>"),
    (None, "http://example.com/b c\r\nX: y", "<p>same</p>"),
    (3, "http://[broken", None),
    (4, "", ""),
    (5, "https://example.org:8080/é", "gap\r\n\r\nwithin\r\n\r\n"),
    (6, "http://example.org", "ends with half a gap\r\n"),
    (8, "http://example.org", "\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (9, "http://example.org", "퟿é\u0000 🙂\r\r\n\n\r\n"),
    (10, "http://example.net", "long " * 200_000),
    (11, "http://example.net", "twice"),
    (11, "http://example.net", "twice"),
    (None, "http://example.net/n", "of no page"),
    (None, "http://example.net/n", "of no page"),
]


def plain(rows, at_least=0):
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        most = max((p for p in same if p is not None), default=None)
        again = len(same) > 1 and most is not None and len(data) >= at_least and (page is None or page < most)
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", most if again else None))
    return sorted(want, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("at_least", [0, 8])
def test_archives_read_back(spark, tmp_path, at_least):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], f"{SCHEMA}, digest string, kept int").repartition(3)
    warc.write_archives(df, str(tmp_path / "a"), at_least=at_least, records_a_file=4)
    got = warc.read_archives(spark, str(tmp_path / "a"))
    assert told(got) == told(warc.merge_captures(got)) == plain(ROWS, at_least)


def test_files_are_warc(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA).coalesce(1), str(tmp_path / "a"))
    (one,) = Path(tmp_path / "a").glob("part-*.gz")
    text = gzip.decompress(one.read_bytes()).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.endswith("\r\n\r\n") and text.count("<p>same</p>") == 1
    head, block = text.split("\r\n\r\n", 1)
    length = int(dict(x.split(": ", 1) for x in head.split("\r\n")[1:])["Content-Length"])
    assert block.encode()[length:].startswith(b"\r\n\r\nWARC/1.1")
    found = warc.read_archives(spark, str(tmp_path / "a")).where("record_type = 'response'").first()
    assert text.encode()[found.offset :].startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>")


def test_captures_come_in_order(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(3)}", f"{rng.randrange(5)}", rng.choice([None, *range(9)]), "d", "a", i, "u", "response", None, 0) for i in range(3000)]
    rows += [("hot", "0", 1, "d", "a", i, "u", "response", None, 0) for i in range(3000, 5000)]
    df = spark.createDataFrame(rows, warc._CAPTURE_DDL).repartition(5)
    got = warc.merge_captures(df, run=170, a_range=400).orderBy("range", "place").collect()
    assert [tuple(r)[2:] for r in got] == sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3:6]))
    sizes = [sum(r.range == i for r in got) for i in range(got[-1].range + 1)]
    assert len(sizes) == 13 and max(sizes) < 1000  # the key with two fifths of all captures is cut too


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20),) for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
    order = list(warc.LoserTree(runs))
    assert [runs[r][i] for r, i in order] == sorted(x for r in runs for x in r) and len(set(order)) == len(order)


def test_damage_is_an_error(spark, tmp_path):
    for name, text in (("cut", "WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"), ("changed", None)):
        (tmp_path / name).mkdir()
        if text is None:
            warc.write_archives(spark.createDataFrame(ROWS[:1], SCHEMA), str(tmp_path / "good"))
            text = gzip.decompress(next((tmp_path / "good").glob("part-*.gz")).read_bytes()).decode().replace("same", "lame")
        (tmp_path / name / "x").write_bytes(text.encode())
        with pytest.raises(Exception, match="within a record|not what its digest says"):
            warc.read_archives(spark, str(tmp_path / name)).collect()


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.merge_captures(warc.read_archives(spark, str(tmp_path / "a"))).collect() == []


def test_keys_and_digests(spark):
    assert warc.url_key("http://www.Example.com/a?y=2&x=1") == "com,example)/a?x=1&y=2"
    assert [warc.url_key(u) for u in (None, "http://[x", "https://a.b:8080")] == [")/", "http://[x", "b,a:8080)/"]
    got = spark.createDataFrame([(x,) for x in ("", "abc", "é")], "t string").select("t", warc.sha1_base32(F.col("t")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)
