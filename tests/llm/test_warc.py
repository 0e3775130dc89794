import glob
import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rows = [(i, f"https://host{i % 7}.example/{i}?q=ä", f"<p>page {i % 90} " + "wort Wörter 世界 \r\n\r\n WARC/1.1\r\n\r\n" * (i % 90)) for i in range(300)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "http://a\r\nWARC-Type: x", "x" * 99), (1003, "u", "x" * 99), (1004, "u", "y" * 100), (1005, "u", "y" * 100), (None, "u", "y" * 100)]
    rows += [(1006, "u", "\r\n" * 200_000), (1007, "u", "z" * 3_000_000), (1008, "u", "é" * 50), (1009, "v", "é" * 50)]
    rows += [(2000, "b", "again " * 30), (2000, "a", "again " * 30), (2000, "a", "again " * 30), (2000, None, "again " * 30), (2001, "a", "again " * 30)]
    return rows + [(None, None, "unkeyed " * 20)] * 3


def wanted(rows):
    """key, bytes, digest, type, refers_to of each row, with the first of each payload by key, then by url, a response."""
    out, seen = [], {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = len(body) >= warc.LEAST and digest in seen
        out.append((key, len(body), digest, "revisit" if again else "response", seen[digest] if again else None))
        seen.setdefault(digest, key)
    return Counter(out)


def test_round_trip(spark):
    rows = pages()
    got = warc.roundtrip(spark.createDataFrame(rows, SCHEMA).repartition(6)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(tuple(r) for r in got) == wanted(rows)


def test_shuffled(spark):
    """Where too many payloads repeat for a broadcast, the result is the same."""
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    plain = lambda most: Counter((r._key, r._digest, r._first if r._revisit else None, r._revisit) for r in warc.deduplicated(df, "page_id", "url", "html", most=most).select("_key", "_digest", "_first", "_revisit").collect())
    assert plain(0) == plain(warc.BROADCAST)
    assert sum(n for (*_, again), n in plain(0).items() if again) == sum(n for r, n in wanted(rows).items() if r[3] == "revisit")


def test_files(spark, tmp_path):
    """Streams are one member; archives one for each record, at the places that the sidecar names, and hold the same bytes."""
    rows = pages()
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/streams")
    done = warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/archives").collect()
    assert sum(r.records for r in done) == len(rows) and not any(r.error for r in done)
    for r in done:
        with open(r.source.removeprefix("file:"), "rb") as f:
            whole = f.read()
        first = zlib.decompressobj(31)
        stream = first.decompress(whole)
        assert first.eof and not first.unused_data
        with open(r.archive, "rb") as f:
            archive = f.read()
        assert gzip.decompress(archive) == stream
        at = 0
        for e in sorted(warc.index(spark, f"{tmp_path}/archives").filter(F.col("archive") == r.archive).collect()):
            assert e.offset == at
            record = zlib.decompressobj(31)
            text = record.decompress(archive[at : at + e.length])
            assert record.eof and not record.unused_data
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + e.type.encode()) and text.endswith(b"\r\n\r\n")
            at += e.length
        assert at == len(archive)
    payloads = warc.read(warc.index(spark, f"{tmp_path}/archives")).filter("type = 'response'")
    assert {hashlib.sha256(r.payload).hexdigest() for r in payloads.collect()} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
    assert not glob.glob(f"{tmp_path}/archives/.*-*")


def record(kind, block, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{len(block)}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Other writers' records, members and padding; archives that break off keep what came before."""
    good = record("warcinfo", b"software: none") + record("metadata", b"", "X-Folded: a\r\n  b\r\n") + record("resource", b"\r\n\r\n" * 9)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.warc.gz").write_bytes(gzip.compress(good))
    (tmp_path / "in/members.warc.gz").write_bytes(gzip.compress(good[:70]) + gzip.compress(good[70:]) + gzip.compress(b"") + b"\0" * 30)
    (tmp_path / "in/plain.warc").write_bytes(good)
    (tmp_path / "in/empty.warc.gz").write_bytes(b"")
    (tmp_path / "in/cut.warc.gz").write_bytes(gzip.compress(good + record("resource", bytes(range(256)) * 40))[:-40])
    (tmp_path / "in/short.warc.gz").write_bytes(gzip.compress(good[:-30]))
    (tmp_path / "in/junk.warc.gz").write_bytes(gzip.compress(good + b"<html>\r\n\r\n"))
    done = {r.source.rpartition("/")[2].split(".")[0]: r for r in warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out").collect()}
    assert {k: r.records for k, r in done.items()} == {"one": 3, "members": 3, "plain": 3, "cut": 3, "short": 2, "junk": 3}
    assert {k for k, r in done.items() if r.error} == {"cut", "short", "junk"}
    for k in ("one", "members", "plain", "cut", "junk"):
        assert gzip.decompress((tmp_path / f"out/{k}.warc.gz").read_bytes()) == good
    found = warc.read(warc.index(spark, f"{tmp_path}/out")).filter("type = 'resource'").collect()
    assert len(found) == 5 and all(r.payload == b"\r\n\r\n" * 9 for r in found)
    again = warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out").filter("error is null").count()  # a repeated run leaves the same files
    assert again == 3 and warc.index(spark, f"{tmp_path}/out").count() == 17


def test_changed_payload_raises(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.warc.gz").write_bytes(gzip.compress(record("resource", b"other", "WARC-Payload-Digest: sha256:00\r\n")))
    warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    with pytest.raises(Exception, match="not the one that its digest names"):
        warc.read(warc.index(spark, f"{tmp_path}/out")).count()


def test_stream_in_pieces():
    """Whatever the sizes of reads, the bytes are the same."""

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    data = bytes(range(256)) * 9
    stream = warc.Stream(Slow(gzip.compress(data) + b"\0\0" + gzip.compress(data)))
    out = b""
    while part := stream.take(100):
        out += part
    assert out == data * 2


def test_many_equal_pages(spark):
    df = spark.range(20_000).selectExpr("id div 2 as page_id", "'u' as url", "repeat('same ', 40) as html")
    got = warc.roundtrip(df).groupBy("record_type").agg(F.count("*").alias("n"), F.max("refers_to").alias("m")).collect()
    assert {(r.record_type, r.n, r.m) for r in got} == {("response", 1, None), ("revisit", 19_999, 0)}


def test_edges(spark, same):
    rows = pages()
    names = ("_key", "_url", "_body", "_digest", "type", "id", "refers_to", "_n", "_first")
    clashing = spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    same(warc.roundtrip(clashing), warc.roundtrip(spark.createDataFrame(rows, SCHEMA)))
    assert warc.roundtrip(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([("a/ä <>", "u", "h"), ("%41", "u", "h" * 200), ("%42 ", None, "h" * 200)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.roundtrip(named).collect()} == {("a/ä <>", None), ("%41", None), ("%42 ", "%41")}
