"""WARC archives of pages, and a two-level capture index over them.

Pages are written where they are read, so payloads with a text of their own aren't
shuffled. The index is: capture lines sorted by reversed-host key in gzip blocks, and a
sparse directory with the first and last key of each block. A look-up searches the
directory by bisection, reads the blocks found by range, searches their lines by
bisection, and reads records by range.

Files are written through ``pyarrow.fs`` below a shared folder, under names of their own
for each attempt of a task; tables that Spark commits name the files that count, so
what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm.common import MARKS, stage
from kerbflow.session import shared_folder

CAPTURE = "url_key string, page_id long, file string, offset long, length long"
DIRECTORY = "block_file string, offset long, length long, first_key string, last_key string, lines long"
RECORD = ("page_id long, record_type string, payload_bytes long, payload_digest string, "
          "refers_to long, url string, payload binary")


@dataclass(frozen=True)
class Archive:
    """Where an archive is, and its sizes: payloads of ``least_revisit`` bytes or more are
    stored once; a file is closed after ``file_bytes``; the directory has about
    ``most_blocks`` entries at most, whatever the number of captures, so that each task
    can hold it (keys are cut to ``key_chars`` there)."""

    path: str
    least_revisit: int = 100
    file_bytes: int = 1 << 30
    block_lines: int = 1000
    most_blocks: int = 50_000
    key_chars: int = 200
    #: Records that lie within so many bytes of a file are read by one task, in order.
    chunk_bytes: int = 16 << 20


def url_key(url: Column) -> Column:
    """Reversed host, ``)`` and the rest of the address: ``org,example,www)/a?b=1``.

    The scheme, user, port, a leading ``www.`` and the fragment go; the host is in lower
    case. A null address is empty; what has no host keeps its text behind the ``)``.
    """
    text = F.coalesce(url, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, "#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    has_host = bare.startswith("//")
    place = F.regexp_extract(bare, "^//([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[0-9]*$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    rest = F.when(has_host, F.regexp_replace(bare, "^//[^/?]*", "")).otherwise(bare)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.concat_ws(",", F.reverse(F.split(F.when(has_host, host).otherwise(""), r"\."))),
                    F.lit(")"), rest)


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def decided(pages: DataFrame, least: int) -> DataFrame:
    """Pages with digest, record type and the page a revisit refers to.

    Rows whose digest occurs once stay where they are. Of equal payloads the row with
    the smallest page_id (null last), then the smallest address, is the response; rows
    equal in these too are counted, and one of them is the response.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.octet_length(_payload()).cast("long").alias("payload_bytes"),
        F.sha2(_payload(), 256).alias("payload_digest"),
    )
    who = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    groups = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", who.alias("who")).agg(F.count("*").alias("n"))
        .groupBy("payload_digest").agg(F.min(F.struct("who", "n")).alias("first"), F.sum("n").alias("all"))
        .filter(F.col("all") > 1)
    )
    groups = stage(groups.select(
        "payload_digest", F.col("first.who.page_id").alias("first_id"),
        F.col("first.who.url").alias("first_url"), F.col("first.n").alias("n_first")), "payload-groups")
    mark = F.pmod(F.xxhash64("payload_digest"), F.lit(MARKS))
    marked = rows.withColumn("mark_", F.when(F.col("payload_bytes") >= least, mark))
    marks = F.broadcast(groups.select(mark.alias("mark_")).distinct())  # at most MARKS numbers
    alone = marked.join(marks, "mark_", "left_anti")
    joined = marked.join(marks, "mark_", "left_semi").join(groups, "payload_digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    fields = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    single = F.col("n_first").isNull() | (is_first & (F.col("n_first") == 1))
    same = joined.filter(is_first & (F.col("n_first") > 1)).groupBy(*fields).agg(F.count("*").alias("n"))
    same = same.select(*fields, F.col("page_id").alias("first_id"),
                       F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    response, none = F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    revisit, to = F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to")
    late = joined.filter(F.col("n_first").isNotNull() & ~is_first)
    return (
        alone.select(*fields, response, none)
        .unionByName(joined.filter(single).select(*fields, response, none))
        .unionByName(same.filter("copy = 1").select(*fields, response, none))
        .unionByName(late.unionByName(same.filter("copy > 1"), allowMissingColumns=True)
                     .withColumn("html", F.lit("")).select(*fields, revisit, to))
    )


# Records


def _line(value: str) -> str:
    """An address as one header value: blanks and control characters by percent."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, html, n_bytes, digest, kind, refers_to, capture_id: str) -> bytes:
    """A WARC/1.1 record. A revisit has the header block alone; length and digest of the
    full payload, and the pages' numbers, are fields of both kinds."""
    payload = html.encode("utf-8") if kind == "response" else b""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {n_bytes}\r\n\r\n").encode()
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{capture_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url or 'urn:none')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}",
    ]
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        fields.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            fields.append(f"Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(fields).encode("utf-8") + b"\r\n\r\n" + head + payload + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The facts of one record, those of a response from its payload; a damaged record is
    an error."""
    top, _, body = data.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    length = int(fields["Content-Length"])
    if version != "WARC/1.1" or body[length:] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    payload = body[:length].partition(b"\r\n\r\n")[2]
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else said
    if digest != said or (response and len(payload) != int(fields["Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("Page-ID"), "record_type": fields["WARC-Type"],
        "payload_bytes": len(payload) if response else int(fields["Payload-Length"]),
        "payload_digest": digest, "refers_to": number("Refers-To-Page-ID"),
        "url": fields["WARC-Target-URI"], "payload": payload if response else None,
    }


# Files


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)


class _Files:
    """Appends to files of one task attempt, a new one after ``limit`` bytes."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.fs, self.folder = _filesystem(folder)
        self.suffix, self.limit, self.out = suffix, limit, None
        self.fs.create_dir(self.folder, recursive=True)

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at + len(data) > self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        place = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Range reads, the last file kept open."""

    def __init__(self, folder: str):
        self.fs, self.folder = _filesystem(folder)
        self.name = self.file = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.folder}/{name}")
        self.file.seek(offset)
        return self.file.read(length)


def write_records(pages: DataFrame, archive: Archive) -> DataFrame:
    """One gzip member for each row of ``decided`` pages; the captures written."""
    folder, limit = f"{archive.path}/warc", archive.file_bytes
    rows = pages.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type",
                        "refers_to", url_key(F.col("url")).alias("url_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz", limit)
        for batch in batches:
            found = []
            for k in range(batch.num_rows):  # one text at a time
                *facts, key = (c[k].as_py() for c in batch.columns)
                data = gzip.compress(record(*facts, str(uuid.uuid4())), 6, mtime=0)
                found.append((key, facts[0], *files.append(data), len(data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                if found else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())],
                names=["url_key", "page_id", "file", "offset", "length"])
        files.close()

    return stage(rows.mapInArrow(run, CAPTURE), "captures")


# Index


def _capture_line(key: str, page_id, file: str, offset: int, length: int) -> bytes:
    return f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}\n".encode("utf-8")


def write_index(captures: DataFrame, archive: Archive) -> DataFrame:
    """Sorted capture lines in gzip blocks, and their directory (one row for each block).

    Ranges of (key, page, file, offset) make the partitions, so a key with any share of
    the captures is split over tasks and blocks.
    """
    folder, chars = f"{archive.path}/index", archive.key_chars
    size = max(archive.block_lines, -(-captures.count() // archive.most_blocks))
    order = ["url_key", "page_id", "file", "offset"]
    clean = F.regexp_replace("url_key", r"[\t\n\r]", "%09").alias("url_key")
    rows = captures.select(clean, "page_id", "file", "offset", "length")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], str, str]]:
        lines, first, last = [], "", ""
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(lines) == size:
                    yield lines, first, last
                    lines = []
                if not lines:
                    first = row[0]
                lines.append(_capture_line(*row))
                last = row[0]
        if lines:
            yield lines, first, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".cdx.gz", 1 << 30)
        for lines, first, last in blocks(batches):
            data = gzip.compress(b"".join(lines), 6, mtime=0)
            name, place = files.append(data)
            yield pa.RecordBatch.from_pylist([{
                "block_file": name, "offset": place, "length": len(data), "first_key": first[:chars],
                "last_key": last[:chars], "lines": len(lines),
            }], schema=pa.schema([
                ("block_file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int64())]))
        files.close()

    directory = rows.mapInArrow(run, DIRECTORY)
    directory.write.parquet(f"{archive.path}/directory")
    return read_directory(captures.sparkSession, archive)


def read_directory(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{archive.path}/directory")


def _key_lines(data: bytes, keys: list[str]) -> Iterator[tuple]:
    """Captures of ``keys`` in a block, by bisection of its sorted lines."""
    lines = zlib.decompress(data, 31).decode("utf-8").split("\n")[:-1]
    of = [x.split("\t", 1)[0].encode("utf-8") for x in lines]
    for key in keys:
        wanted = key.encode("utf-8")
        for line in lines[bisect_left(of, wanted) : bisect_right(of, wanted)]:
            key, page, file, offset, length = line.split("\t")
            yield key, int(page) if page else None, file, int(offset), int(length)


def _tasks(spark: SparkSession) -> int:
    """Tasks that read what small rows point to; a stated number is not merged by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(keys: DataFrame, archive: Archive) -> DataFrame:
    """All captures of the distinct ``url_key`` values of ``keys``.

    Each task bisects the directory (``archive.most_blocks`` and a few for each task of
    the index; keys cut short, so a block more may be looked at) and names the blocks of
    each key; every block wanted is then read once, by the task that its range falls to.
    """
    spark = keys.sparkSession
    rows = read_directory(spark, archive).toArrow().to_pylist()  # see Archive.most_blocks
    rows = sorted(rows, key=lambda r: (r["first_key"].encode(), r["last_key"].encode()))
    firsts, lasts = ([r[c].encode() for r in rows] for c in ("first_key", "last_key"))
    held = spark.sparkContext.broadcast((firsts, lasts))
    places = spark.sparkContext.broadcast([(r["block_file"], r["offset"], r["length"]) for r in rows])
    chars, folder = archive.key_chars, f"{archive.path}/index"
    wanted = keys.select(F.regexp_replace("url_key", r"[\t\n\r]", "%09").alias("url_key")).distinct()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = held.value
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                cut = key[:chars].encode("utf-8")
                found.extend((key, b) for b in range(bisect_left(last, cut), bisect_right(first, cut)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())],
                names=["url_key", "block"])

    asked = wanted.mapInArrow(find, "url_key string, block long").repartitionByRange(
        _tasks(spark), "block", "url_key").sortWithinPartitions("block", "url_key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, (names) = _Ranges(folder), ("url_key", "page_id", "file", "offset", "length")
        pairs = ((k, b) for batch in batches for k, b in zip(*(c.to_pylist() for c in batch.columns)))
        for block, some in groupby(pairs, key=lambda x: x[1]):
            data = ranges.read(*places.value[block])
            found = list(zip(*_key_lines(data, [k for k, _ in some]))) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=list(names))

    return asked.mapInArrow(read, CAPTURE)


def read_records(captures: DataFrame, archive: Archive, *columns: str) -> DataFrame:
    """The records of ``captures``, ``columns`` of RECORD (default: all).

    Captures near each other in a file go to one task, which reads them in file order.
    """
    folder, kept = f"{archive.path}/warc", list(columns) or [c.split()[0] for c in RECORD.split(", ")]
    types = dict(c.split() for c in RECORD.split(", "))
    kind = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, kind[types[c]]) for c in kept])
    chunk = F.floor(F.col("offset") / archive.chunk_bytes).alias("chunk")
    rows = captures.select("file", "offset", "length", chunk).repartition(
        _tasks(captures.sparkSession), "file", "chunk").sortWithinPartitions(
        "file", "offset").select("file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for batch in batches:
            found, held = [], 0
            for place in zip(*(c.to_pylist() for c in batch.columns)):
                facts = parsed(zlib.decompress(ranges.read(*place), 31))
                held += len(facts["payload"] or b"") if "payload" in kept else 64
                found.append(facts)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept))


def archive_pages(pages: DataFrame, archive: Archive) -> DataFrame:
    """Writes a record for each page (page_id, url, html) and the index over them; the
    captures written.

    Of equal payloads of ``archive.least_revisit`` bytes or more one is a response and
    the others revisit it. A null html is empty; a null page_id comes last and stays
    null; a null address has the key ``)/``; repeated rows are captures of their own, one
    of them the response; other columns are not read; no rows give an empty index.
    """
    captures = write_records(decided(pages, archive.least_revisit), archive)
    write_index(captures, archive)
    return captures


def round_trip(pages: DataFrame, archive: Archive | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as
    read back: the addresses of the pages are looked up in the index, and the records
    of their captures read and checked (digest and length from the payload)."""
    archive = archive or Archive(shared_folder(pages.sparkSession, "warc"))
    archive_pages(pages, archive)
    keys = pages.select(url_key(F.col("url").cast("string")).alias("url_key"))
    return read_records(look_up(keys, archive), archive, "page_id", "payload_bytes",
                        "payload_digest", "record_type", "refers_to")
