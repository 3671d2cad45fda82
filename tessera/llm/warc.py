"""Operator 11, WARC archives as seekable Zstandard bundles.

A bundle is a file of WARC 1.1 records: records are grouped into independent Zstandard frames
of about a megabyte, and a seek table with the sizes and a checksum of every frame closes the
file as a skippable frame, in the layout of the public seekable format. Any Zstandard program
unpacks a bundle whole; ``find`` unpacks only the frames that hold wanted records. An index
(Parquet, written by Spark) maps each record identifier to bundle, frame, and the offset and
length within the unpacked frame.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the least page_id is a
response, the others are revisits: headers only, that refer to the response. Payloads are hashed
once, when rows are staged in the shared folder; the least row of each digest comes from an
aggregation of narrow rows, so a payload that a third of all pages share is combined before the
shuffle, and the join back is a broadcast up to ``BROADCAST_DIGESTS`` digests, a shuffle beyond
that, where Spark splits a hot digest.

A task names its bundles by a random number of its own, and the index, which Spark commits,
lists only those of tasks that ended well: what a lost or repeated task left behind is never
read. Bundles are read frame by frame, so neither side holds more than a frame, or a record if
that is longer. Frames and payload digests are checked while reading.

Nulls: a null payload counts as empty and, being short, is a response. A null id is written
without an id and comes after all others; a null URL becomes about:blank. Repeated rows: of rows
with the same id and payload one is the response and the others revisit it, so refers_to may be
the row's own id. Ids may have any plain type. Payloads may be empty or of any length below two
gigabytes. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, partitions, run_dir, table, written

#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: Unpacked bytes of a frame and packed bytes of a bundle; one record may be longer.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Frames that a task of a reader takes at most, on average.
TASK_FRAMES = 256
#: Rows of repeated digests up to which they are broadcast (at most about 200 bytes each).
BROADCAST_DIGESTS = 200_000
#: WARC-Date of all records; pages carry no time of their own.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Fixed values of the Zstandard frame format and its seekable extension.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_INDEX = "record_id string, page_id string, bundle string, frame int, at long, length long"
_RECORDS = "record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, refers_to string"


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class BundleWriter:
    """Records into frames of one file, the seek table at its end."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.frames: list[tuple[int, int, int]] = []  # packed bytes, unpacked bytes, checksum
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The number of the frame and the offset in it at which the record stands."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = zstandard.ZstdCompressor(level=3).compress(raw)
            self.sink.write(packed)
            self.written += len(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Frames of one file by number, found through its seek table."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        size = 12 if flags & CHECKSUMS else 8
        entries = self._at(end - 9 - frames * size, frames * size)
        self.frames = [struct.unpack_from("<II", entries, i * size) for i in range(frames)]
        self.checks = [struct.unpack_from("<I", entries, i * size + 8)[0] if size == 12 else None for i in range(frames)]
        self.starts = [0]
        for packed, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, number: int) -> bytes:
        packed, size = self.frames[number]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[number], packed), max_output_size=size)
        if len(raw) != size or self.checks[number] not in (None, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF):
            raise ValueError(f"frame {number} is damaged")
        return raw


def record(kind: str, record_id: str, block: bytes, content_type: str, **headers: str | None) -> bytes:
    """A WARC record; underscores in names of headers stand for hyphens, None leaves one out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def records(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of unpacked bytes."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        lines = raw[at : end - 4].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no whole record at {at}")
        yield at, stop + 4 - at, headers, raw[end:stop]
        at = stop + 4


def _address(url: str | None) -> str:
    """The URL without blanks and control characters, which would end its header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url) if url else "about:blank"


def _page_record(row: dict, archive: uuid.UUID, own_id: str) -> tuple[str, bytes]:
    """The identifier and bytes of a page's record. Of responses long enough to be revisited the identifier is named by the digest."""
    named = str(uuid.uuid5(archive, row["digest"]).urn)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    page = {"WARC_Target_URI": _address(row["url"]), "WARC_Payload_Digest": f"sha256:{row['digest']}", "WARC_Page_ID": None if row["page_id"] is None else urllib.parse.quote(row["page_id"])}
    if row["revisit"]:
        to = {"WARC_Profile": PROFILE, "WARC_Refers_To": f"<{named}>", "WARC_Refers_To_Page_ID": None if row["first_id"] is None else urllib.parse.quote(row["first_id"])}
        return own_id, record("revisit", own_id, head, "application/http;msgtype=response", **page, **to)
    found = named if row["size"] >= REVISIT_BYTES else own_id
    return found, record("response", found, head + row["payload"], "application/http;msgtype=response", **page)


def _parsed(headers: dict[str, str], block: bytes) -> tuple[dict, bytes | None]:
    """The fields of a page's record, and the payload of a response, whose length and digest are checked."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    known = headers["WARC-Type"] == "response"
    if known and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not what its digest says")
    ids = [None if x is None else urllib.parse.unquote(x) for x in (headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID"))]
    refers = headers.get("WARC-Refers-To")
    values = (headers["WARC-Record-ID"][1:-1], ids[0], headers["WARC-Target-URI"], headers["WARC-Type"], size, digest, refers and refers[1:-1], ids[1])
    return dict(zip(_names(_RECORDS), values, strict=True)), payload if known else None


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _types(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _staged(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``(row, page_id, url, payload, size, digest)`` of every page, settled, so that row means the same row to every reader."""
    payload = F.coalesce(column(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(column(id_col).alias("page_id"), column(url_col).cast("string").alias("url"), payload.alias("payload"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest")), "warc-rows")


def _with_first(staged: DataFrame) -> DataFrame:
    """Staged rows with ``first_row`` and ``first_id``: the response of their payload, where others revisit it."""
    least = F.struct(F.isnull("page_id").alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    often = staged.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(least).alias("first"), F.count("*").alias("n")).filter("n > 1")
    often = written(often.select("digest", F.col("first.row").alias("first_row"), F.col("first.id").alias("first_id")), "warc-first")
    if often.count() <= BROADCAST_DIGESTS:
        often = F.broadcast(often)
    return staged.join(often, "digest", "left")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """A record for each page: bundles in ``path/bundles``, the index of records in ``path/index``."""
    spark = pages.sparkSession
    folder, archive = f"{path}/bundles", uuid.uuid4()
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    revisit: Column = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    rows = _with_first(_staged(pages, id_col, url_col, payload_col)).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "size", "digest", revisit.alias("revisit"),
        F.col("first_id").cast("string").alias("first_id"), F.when(~revisit, F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        task, number, count = uuid.uuid4().hex, 0, 0
        bundle, name, places = None, "", []

        def index() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_names(_INDEX), p, strict=True)) for p in places], schema=_types(_INDEX))

        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: c[at].as_py() for k, c in zip(batch.schema.names, batch.columns, strict=True)}
                if bundle is None:
                    name = f"{task}-{number:05d}.warc.zst"
                    bundle = BundleWriter(files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                    info = uuid.uuid5(archive, name).urn
                    bundle.add(record("warcinfo", info, b"format: WARC File Format 1.1\r\n", "application/warc-fields", WARC_Filename=name))
                    bundle.flush()
                found, data = _page_record(row, archive, uuid.uuid5(archive, f"{name} {count}").urn)
                places.append((found, row["page_id"], name, *bundle.add(data), len(data)))
                count += 1
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle, number = None, number + 1
            if places:
                yield index()
                places = []
        if bundle is not None:
            bundle.close()

    rows.mapInArrow(run, _INDEX).write.parquet(f"{path}/index")


def _frames(spark: SparkSession, path: str, frames: DataFrame, wanted: bool, payloads: bool) -> DataFrame:
    """Records of the frames ``(bundle, frame[, places])``; wanted: only those at the places, found without a walk over the frame."""
    folder, schema = f"{path}/bundles", _RECORDS + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        name, bundle = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name = row["bundle"]
                    bundle = BundleReader(files.open_input_file(f"{root}/{name}"))
                raw = bundle.frame(row["frame"])
                parts = (next(records(raw[p["at"] : p["at"] + p["length"]])) for p in row["places"]) if wanted else records(raw)
                found = [_parsed(headers, block) for _, _, headers, block in parts]
                yield pa.RecordBatch.from_pylist([f | {"payload": p} if payloads else f for f, p in found], schema=_types(schema))

    tasks = max(partitions(frames), frames.count() // TASK_FRAMES)
    dealt = frames.repartition(tasks, F.xxhash64("bundle", "frame")).sortWithinPartitions("bundle", "frame")  # a key of its own, for Spark drops a second exchange by the same one
    return dealt.mapInArrow(run, schema)


def index(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, page_id, bundle, frame, at, length)`` of every record of a page."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every page's record, frame by frame: ``(record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to_id, refers_to, payload)``.

    payload_bytes and payload_digest are those of the full payload; payload is null for revisits.
    """
    return _frames(spark, path, index(spark, path).select("bundle", "frame").distinct(), False, payloads)


def find(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in wanted, as ``read`` gives them; only their frames are unpacked."""
    places = index(spark, path).join(wanted.select("record_id").distinct(), "record_id")
    frames = places.groupBy("bundle", "frame").agg(F.collect_list(F.struct("at", "length")).alias("places"))  # at most the records of a frame
    return _frames(spark, path, frames, True, True)


def digest(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write pages to a new folder of the shared one and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    spark = pages.sparkSession
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, id_col, **options)
    kind = pages.select(column(id_col)).schema[0].dataType
    return read(spark, path, payloads=False).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "pages"))


SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM payloads),
firsts AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS least FROM hashed),
kinds AS (SELECT *, n > 1 AND payload_bytes >= {REVISIT_BYTES} AS again FROM firsts)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to
FROM kinds
"""
