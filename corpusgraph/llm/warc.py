"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar index.

Spark's text writer compresses a whole file as one gzip stream, as many tools
leave archives: nothing in it can be reached but by inflating all before it.
The normaliser inflates each such stream once, from front to back, writes
every record as a gzip member of its own, and beside each archive a sidecar
of JSON lines with every record's offset and length.  Records are then read
by seeking, and tasks divide an archive between them at any record.

Archives are opened with pyarrow.fs, which reaches local and mounted folders,
HDFS and object stores.  A task writes under a name of its own and renames it
at the end; the bytes depend on the input alone, so that a repeated or a
speculative task leaves the same files.  No task holds more than one record.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_dir, stash

#: Smaller payloads are never revisits.
LEAST = 100
PIECE = 1 << 20
#: Bytes of a record's header beyond which an archive counts as damaged.
HEADER = 1 << 20
#: Bytes of keys and urls of repeated payloads that are broadcast.
BROADCAST = 1 << 23
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "offset long, length long, type string, id string, uri string, refers_to string, digest string"


@lru_cache(maxsize=8)
def _store(scheme: str, host: str) -> pafs.FileSystem:
    if scheme in ("", "file"):
        return pafs.LocalFileSystem()
    named = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return pafs.FileSystem.from_uri(f"{named}://{host}/")[0]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    parts = urlsplit(uri, allow_fragments=False) if re.match(r"[a-zA-Z][\w+.-]*:", uri) else None
    if not parts or parts.scheme == "file":
        return _store("", ""), uri if not parts else uri[len(parts.scheme) + 1 + 2 * uri[len(parts.scheme) + 1 :].startswith("//") :]
    inside = parts.path if parts.scheme in ("hdfs", "viewfs") else f"{parts.netloc}{parts.path}"
    return _store(parts.scheme, parts.netloc), inside


def renamed(store: pafs.FileSystem, old: str, new: str) -> None:
    """Move a file to a name that an earlier attempt may have left, with the same bytes."""
    try:
        store.move(old, new)
    except OSError:
        store.delete_file(new)
        store.move(old, new)


class Stream:
    """Bytes of a gzip stream, one of several members, or of a plain file, read from front to back."""

    def __init__(self, raw):
        self.raw, self.held, self.at, self.over = raw, bytearray(), 0, False
        self.feed = raw.read(PIECE)
        self.gzip = self.feed[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        """Hold more bytes; False at the end.  A stream that breaks off raises EOFError."""
        if not self.feed:
            self.feed = self.raw.read(PIECE)
        if not self.gzip:
            self.held += self.feed
            got, self.feed = bool(self.feed), b""
            return got
        while True:
            if self.inflate.eof:  # padding by zeros may follow a member
                self.feed = (self.inflate.unused_data + self.feed).lstrip(b"\0") or self.raw.read(PIECE)
                self.inflate = zlib.decompressobj(31)
                self.over = True
                continue
            if not self.feed:
                self.feed = self.raw.read(PIECE)
            if not self.feed:
                if not self.over:
                    raise EOFError("the gzip stream breaks off")
                return False
            if self.over:
                self.feed = self.feed.lstrip(b"\0")
                if not self.feed:
                    continue
            self.over = False
            out = self.inflate.decompress(self.feed, PIECE)
            self.feed = self.inflate.unconsumed_tail
            if out:
                self.held += out
                return True

    def take(self, n: int) -> bytes:
        """The next bytes, at most ``n`` and at least one; none at the end."""
        if not self.held and not self._more():
            return b""
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out

    def header(self) -> bytes:
        """Up to and with the next empty line, behind any line ends; none at the end."""
        seen = 0
        while True:
            bare = len(self.held) - len(self.held.lstrip(b"\r\n"))
            if bare and not seen:
                del self.held[:bare]
                self.at += bare
            found = self.held.find(END, max(0, seen - 3))
            if found >= 0:
                return self.take(found + 4)
            if len(self.held) > HEADER:
                raise ValueError("no end of a header")
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise EOFError("a header breaks off")
                return b""


def fields(header: bytes) -> dict[str, str]:
    """Named fields of a header by lower-case name; folded lines are joined, and the first of equal names counts."""
    lines = re.sub(r"\r\n[ \t]+", " ", header.decode("utf-8", "replace")).split("\r\n")[1:]
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def members(stream: Stream, level: int = 6) -> Iterator[tuple[dict[str, str], list[bytes]]]:
    """Every record's fields, and the record as a gzip member in pieces."""
    while header := stream.header():
        if not header.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {stream.at - len(header)}")
        named = fields(header)
        left = int(named["content-length"])
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        pieces = [pack.compress(header)]
        while left:
            part = stream.take(min(left, PIECE))
            if not part:
                raise EOFError("a record breaks off")
            left -= len(part)
            pieces.append(pack.compress(part))
        pieces += [pack.compress(END), pack.flush()]
        yield named, [p for p in pieces if p]


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Every ``*.gz`` or ``*.warc`` file under ``source`` as ``target``/name.warc.gz and its sidecar name.warc.gz.idx.

    A row for each archive: source, archive, records, bytes (inflated), error.
    An archive that breaks off, or is no WARC from some place on, keeps the
    records before it and has the reason as ``error``; Spark lists no file
    without bytes.  Records of every type pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(target)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                inside, name = opened(path)
                stem = re.sub(r"(\.txt|\.warc)?(\.gz)?$", "", os.path.basename(name))
                archive, own = f"{stem}.warc.gz", f".{stem}-{uuid.uuid4().hex}"
                count, at, error, size = 0, 0, None, 0
                with inside.open_input_stream(name, compression=None) as raw, store.open_output_stream(f"{folder}/{own}", compression=None) as out, store.open_output_stream(f"{folder}/{own}.idx", compression=None) as index:
                    try:
                        stream = Stream(raw)
                        for named, pieces in members(stream, level):
                            length = sum(map(len, pieces))
                            for p in pieces:
                                out.write(p)
                            entry = {"offset": at, "length": length, "type": named.get("warc-type"), "id": named.get("warc-record-id"), "uri": named.get("warc-target-uri"), "refers_to": named.get("warc-refers-to"), "digest": named.get("warc-payload-digest")}
                            index.write(json.dumps(entry).encode() + b"\n")
                            at, count, size = at + length, count + 1, stream.at
                    except (EOFError, ValueError, KeyError, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"
                for end in ("", ".idx"):
                    renamed(store, f"{folder}/{own}{end}", f"{folder}/{archive}{end}")
                yield pa.RecordBatch.from_pydict({"source": [path], "archive": [f"{target}/{archive}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64()), "error": pa.array([error], pa.string())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(source).select("path")
    return stash(files.mapInArrow(run, "source string, archive string, records long, bytes long, error string"), "archives")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars under a folder: archive, offset, length, type, id, uri, refers_to, digest of every record."""
    entries = spark.read.schema(ENTRY).option("pathGlobFilter", "*.idx").json(folder)
    beside = F.concat(F.lit(f"{folder}/"), F.regexp_replace("_metadata.file_name", r"\.idx$", ""))
    return entries.select(beside.alias("archive"), *entries.columns)


def _payload(store: pafs.FileSystem, held: dict, path: str, offset: int, length: int, keep: bool) -> tuple[int, str, bytes | None]:
    """Size, SHA-256 and, if ``keep``, bytes of what stands behind the HTTP header of the record at ``offset``; a record without one is payload all through."""
    if held.get("path") != path:
        if "file" in held:
            held["file"].close()
        held["path"], held["file"] = path, store.open_input_file(path)

    class Part:
        def __init__(self):
            held["file"].seek(offset)
            self.left = length

        def read(self, n):
            out = held["file"].read(min(n, self.left))
            self.left -= len(out)
            return out

    stream = Stream(Part())
    named = fields(stream.header())
    left, sha, size, kept = int(named["content-length"]), hashlib.sha256(), 0, []
    told = -1
    if named.get("content-type", "").startswith("application/http") and left:
        before = stream.at
        told = int(fields(stream.header()).get("content-length", -1))
        left -= stream.at - before
    while left:
        part = stream.take(min(left, PIECE))
        if not part:
            raise EOFError(f"{path}: the record at {offset} breaks off")
        left -= len(part)
        size += len(part)
        sha.update(part)
        if keep:
            kept.append(part)
    if named.get("warc-type") == "revisit":
        return told, named.get("warc-payload-digest", "").removeprefix("sha256:"), None
    if named.get("warc-payload-digest", "sha256:" + sha.hexdigest()) != "sha256:" + sha.hexdigest():
        raise ValueError(f"{path}: the payload of the record at {offset} is not the one that its digest names")
    return size, sha.hexdigest(), b"".join(kept) if keep else None


def read(entries: DataFrame, content: bool = True) -> DataFrame:
    """Every record of an index: type, id, uri, refers_to, payload_bytes, payload_digest and, with ``content``, payload.

    Size and digest are those of the bytes that stand there; for a revisit,
    whose payload is elsewhere, they are those that its headers tell.  A
    payload that differs from its record's digest raises.
    """
    columns = ["type", "id", "uri", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            step = 64 if content else 4096
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                found = []
                for archive, offset, length in zip(*[part.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                    store, path = opened(archive)
                    found.append(_payload(store, held, path, offset, length, content))
                made = {c: part.column(c) for c in columns} | {"payload_bytes": pa.array([f[0] for f in found], pa.int64()), "payload_digest": pa.array([f[1] for f in found], pa.string())}
                yield pa.RecordBatch.from_pydict(made | ({"payload": pa.array([f[2] for f in found], pa.binary())} if content else {}))

    return entries.select("archive", "offset", "length", *columns).mapInArrow(run, "type string, id string, uri string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * content)


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def key_of(urn: Column, kind: str) -> Column:
    """The key that a record was written with; an empty one is null."""
    name = F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)
    return F.url_decode(F.when(name != "", name)).cast(kind)


def deduplicated(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST, most: int = BROADCAST) -> DataFrame:
    """_key, _url, _body, _bytes, _digest, _first: the key whose equal payload a row revisits; ``_revisit`` says whether it does.

    A null payload is empty, a null key comes last.  Of rows equal in key and
    payload the one of the least url stays a response, null last, and of equal
    rows one.  Such rows are counted before they are shuffled.  The payloads
    that occur again are looked up by a broadcast where their keys and urls
    have at most ``most`` bytes, so that no payload moves, and by a shuffle
    beyond, where AQE splits a payload that very many pages have.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body"))
    rows = rows.withColumns({"_bytes": F.octet_length("_body").cast("long"), "_digest": F.unhex(F.sha2(F.col("_body").cast("binary"), 256))})
    rank = F.struct(F.col("_key").isNull(), "_key", F.col("_url").isNull(), "_url", "_n")
    heads = rows.filter(F.col("_bytes") >= least).groupBy("_digest", "_key", "_url").agg(F.count("*").alias("_n"))
    heads = heads.groupBy("_digest").agg(F.min(rank).alias("_head"), F.sum("_n").alias("_all")).filter("_all > 1")
    heads = stash(heads.select(F.col("_digest").alias("_d"), F.col("_head._key").alias("_first"), F.col("_head._url").alias("_at"), F.col("_head._n").alias("_same")), "repeated")
    size = F.lit(64) + F.octet_length(F.coalesce(F.col("_at"), F.lit(""))) + F.octet_length(F.coalesce(F.col("_first").cast("string"), F.lit("")))
    told = heads.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.max("_same"), F.lit(0)).alias("same")).first()
    joined = rows.join(heads.hint("broadcast" if told.bytes <= most else "merge"), F.col("_digest") == F.col("_d"), "left")
    head = F.col("_d").isNotNull() & F.col("_key").eqNullSafe(F.col("_first")) & F.col("_url").eqNullSafe(F.col("_at"))
    names = ["_key", "_url", "_body", "_bytes", "_digest", "_first"]
    twins = F.coalesce(head & (F.col("_same") > 1), F.lit(False))
    single = joined.filter(~twins).select(*names, (F.col("_d").isNotNull() & ~head).alias("_revisit"))
    if told.same <= 1:
        return single
    several = joined.filter(twins).groupBy(*names).agg(F.count("*").alias("_n"))
    several = several.select(*names, F.explode(F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda i: i > 1)).alias("_revisit"))
    return single.unionByName(several)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = DATE) -> None:
    """The pages as WARC records, each file of ``folder`` one gzip stream."""
    rows = deduplicated(pages, key, url, payload, least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("_body")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("_revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("_key"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("_digest")))),
        F.when(F.col("_revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("_first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def roundtrip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the pages, normalises the archives and reads them back: key, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of ``pages``.  A null payload is empty, a null key
    stays one, repeated rows are records each; an empty table gives no rows,
    and other columns are not looked at.  The archives stay in the scratch
    folder.
    """
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, f"{folder}/streams", key, url, payload, least)
    done = normalise(spark, f"{folder}/streams", f"{folder}/archives")
    bad = done.filter("error is not null").first()
    if bad:
        raise ValueError(f"{bad.source}: {bad.error}")
    kind = pages.schema[key].dataType.simpleString()
    found = read(index(spark, f"{folder}/archives"), content=False)
    return found.select(key_of(F.col("id"), kind).alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), key_of(F.col("refers_to"), kind).alias("refers_to"))
