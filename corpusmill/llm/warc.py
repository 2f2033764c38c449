"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes`` that are compressed independently; a bundle ends with a seek
table in a skippable frame (each frame's compressed and decompressed size and checksum, then a footer), so that it is an
ordinary ``.warc.zst`` to any reader and one frame can be read alone. An index, sorted by record identifier, maps each
record to its bundle, its frame, and its offset and length inside that frame.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is stored as a response
and the others as revisits, which name it, its address and its digest but hold no payload.

On Spark: payloads are compared by SHA-256 in an aggregation, and only payloads that occur more than once are joined
back, broadcast if they are few. Tasks then write their rows as they come, without an exchange, holding one frame; a
bundle gets a name of its own for each attempt, and only bundles that the committed index names are ever read, so a lost
executor or a second attempt leaves at most a file that nobody reads. Reading deals out frames, not bundles.

Folders are URIs that pyarrow's file systems open (a local or mounted path, hdfs, s3, gs).

Defined cases: a null html is the empty payload, and empty payloads are equal payloads too; a null page id is smaller than
any other; rows with the largest id of a payload are all responses, and rows that are equal in id, address and
payload share one identifier; a page without address gets one made of its id; an empty table gives an archive without
bundles; columns other than the three are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import shared_path, stored
from corpusmill.operators.scale import broadcast_if_small

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: The seekable format's magic numbers and the flag of a table with checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = "record_id string, page_id long, record_type string, bundle string, frame long, frame_at long, frame_size long, offset long, length long"
RECORDS = "record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path in it."""
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """An identifier that follows from what the record holds, so that a task that runs again gives the same."""
    named = f"{'' if page_id is None else page_id}\n{url or ''}\n{digest}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(named.encode()).digest()[:16], version=4)}>"


def target_uri(page_id: int | None, url: str | None) -> str:
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else f"urn:page:{'' if page_id is None else page_id}"


def warc_record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: dict | None, date: str) -> tuple[str, str, bytes]:
    """Identifier, type and bytes of a page's record; ``first`` is the page (page_id, url) that it revisits."""
    digest = base32_sha1(payload)
    name, own = record_id(page_id, url, digest), [] if page_id is None else [("X-Page-Id", str(page_id))]
    fields = [("WARC-Date", date), ("WARC-Target-URI", target_uri(page_id, url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), *own]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if first is None:
        return name, "response", warc_record("response", name, fields, http + payload)
    fields += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(first["page_id"], first["url"], digest)),
        ("WARC-Refers-To-Target-URI", target_uri(first["page_id"], first["url"])),
        ("X-Refers-To-Page-Id", str(first["page_id"])),
    ]
    return name, "revisit", warc_record("revisit", name, fields, http)


class BundleWriter:
    """Writes records into frames and, at the end, the seek table."""

    def __init__(self, folder: str, name: str, frame_bytes: int, level: int):
        fs, at = file_system(folder)
        self.name, self.frame_bytes = name, frame_bytes
        self.out = fs.open_output_stream(f"{at}/{name}", compression=None)
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.sizes: list[tuple[int, int, int]] = []
        self.records: list[bytes] = []
        self.held = self.written = 0

    def place(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of a record, which is added. A frame takes records until it has ``frame_bytes``."""
        if self.held >= self.frame_bytes:
            self.end_frame()
        at = len(self.sizes), self.held
        self.records.append(record)
        self.held += len(record)
        return at

    def end_frame(self) -> None:
        if not self.records:
            return
        data = b"".join(self.records)
        frame = self.press.compress(data)
        self.out.write(frame)
        self.sizes.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(frame)
        self.records, self.held = [], 0

    def close(self) -> list[tuple[int, int]]:
        """Ends the bundle; where each frame begins and its compressed size."""
        self.end_frame()
        entries = b"".join(struct.pack("<III", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        at, places = 0, []
        for size, _, _ in self.sizes:
            places.append((at, size))
            at += size
        return places


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int, int]]:
    """Start, compressed size, decompressed size and checksum of each frame, from the end of a bundle."""
    end = file.size()
    frames, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table with checksums at the end")
    size = 12 * frames
    table = file.read_at(8 + size, end - 9 - size - 8)
    if struct.unpack("<II", table[:8]) != (SKIPPABLE, size + 9):
        raise ValueError("the seek table has no skippable frame around it")
    at, out = 0, []
    for packed, plain, check in struct.iter_unpack("<III", table[8:]):
        out.append((at, packed, plain, check))
        at += packed
    return out


def read_frame(file: pa.NativeFile, frame: tuple[int, int, int, int]) -> bytes:
    at, packed, plain, check = frame
    data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at))
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("a frame differs from its seek table")
    return data


def parsed(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in ``data``."""
    end = len(data) if end is None else end
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("no record begins here")
        fields = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        at = begin + int(fields["Content-Length"])
        yield fields, data[begin:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end here")
        at += 4


def record_row(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of ``RECORDS``; None for what describes the bundle itself."""
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    payload = None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return (fields["WARC-Record-ID"], number("X-Page-Id"), fields["WARC-Target-URI"], kind, payload, size, digest,
            fields.get("WARC-Refers-To"), number("X-Refers-To-Page-Id"))


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id``, ``url``, ``payload``, and ``first``: the page that holds an equal payload if it is another one."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    often = rows.where("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("last")).where("n > 1")
    often = stored(often.select("same", "last"), "warc-copies")
    rows = rows.join(broadcast_if_small(often), "same", "left")
    return rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last.page_id")), F.col("last")).alias("first"))


def write_archive(
    pages: DataFrame, path: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write ``pages`` (page_id, url, html) as bundles and their index to the folder ``path``, which all executors share."""
    spark, bundles = pages.sparkSession, f"{path}/bundles"
    fs, at = file_system(bundles)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, rows, number = None, [], 0

        def opened() -> BundleWriter:
            name = f"part-{task.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc.zst"
            new = BundleWriter(bundles, name, frame_bytes, level)
            about = f"software: corpusmill\r\nformat: WARC File Format 1.1\r\nfirst-row: {task.partitionId()}-{number}\r\n".encode()
            new.place(warc_record("warcinfo", record_id(None, name, base32_sha1(about)), [("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about))
            return new

        def closed() -> Iterator[pa.RecordBatch]:
            places = writer.close()
            for some in range(0, len(rows), 10_000):
                columns = list(zip(*rows[some : some + 10_000]))
                frames = columns[3]
                arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array([writer.name] * len(frames), pa.string())]
                arrays += [pa.array(c, pa.int64()) for c in (frames, [places[f][0] for f in frames], [places[f][1] for f in frames], columns[4], columns[5])]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "first"))
                writer = writer or opened()
                name, kind, record = page_record(page_id, url, payload, first, date)
                frame, offset = writer.place(record)
                rows.append((name, page_id, kind, frame, offset, len(record)))
                if writer.written >= bundle_bytes:
                    yield from closed()
                    writer, rows, number = None, [], number + 1
        if writer:
            yield from closed()

    index = with_first(pages, min_bytes).mapInArrow(run, INDEX)
    index = stored(index, "warc-index")  # the bundles are written here, once
    index.repartitionByRange("record_id").sortWithinPartitions("record_id").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _records(frames: DataFrame, path: str, ranges: bool) -> DataFrame:
    """Records of ``frames`` (bundle, frame and, with ``ranges``, the places of the wanted ones)."""
    bundles = f"{path}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(bundles)
        name, file, table = None, None, []
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("bundle")[i].as_py() != name:
                    name = batch.column("bundle")[i].as_py()
                    file = fs.open_input_file(f"{at}/{name}")
                    table = seek_table(file)
                data = read_frame(file, table[batch.column("frame")[i].as_py()])
                places = [(p["offset"], p["offset"] + p["length"]) for p in batch.column("places")[i].as_py()] if ranges else [(0, None)]
                rows = [r for a, b in places for r in (record_row(*x) for x in parsed(data, a, b)) if r]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return frames.mapInArrow(run, RECORDS)


def dealt(frames: DataFrame, task_bytes: int = 8 << 20) -> DataFrame:
    """``frames`` in tasks of about ``task_bytes`` of compressed bytes. A frame's row is small whatever its frame holds, so
    the number of tasks cannot be left to the size of the rows."""
    frames = stored(frames, "warc-frames")
    tasks = -(-(frames.agg(F.sum("frame_size")).first()[0] or 1) // task_bytes)
    return frames.repartition(int(tasks), "bundle", F.floor(F.col("frame") / 4)).sortWithinPartitions("bundle", "frame")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record, frame by frame, each response checked against its digest (``RECORDS``)."""
    return _records(dealt(read_index(spark, path).select("bundle", "frame", "frame_size").distinct()), path, False)


def read_records(path: str, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` (record_id), read from their frames alone."""
    ids = wanted.select("record_id").distinct()
    places = read_index(wanted.sparkSession, path).join(broadcast_if_small(ids), "record_id")
    frames = places.groupBy("bundle", "frame", "frame_size").agg(F.collect_set(F.struct("offset", "length")).alias("places"))  # those of one frame
    return _records(dealt(frames), path, True)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``url`` and ``html`` of every record; a revisit gets the payload of its response."""
    rows = read_archive(spark, path)
    payloads = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("held")).dropDuplicates(["refers_to_id"])
    revisits = rows.where("record_type = 'revisit'").join(payloads, "refers_to_id").select("page_id", "url", F.col("held").cast("string").alias("html"))
    return rows.where("record_type = 'response'").select("page_id", "url", F.col("payload").cast("string").alias("html")).unionByName(revisits)


def archived_digest(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder, read it back, and describe each page from its record."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM p
"""
