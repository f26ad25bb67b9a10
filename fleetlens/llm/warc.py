"""WARC archives of pages, each record a Zstandard frame that shares a dictionary built from the archive's own records.

An archive begins with a skippable frame that holds the dictionary; every record follows as a frame of its own. Pages whose payload
was archived under another page become revisit records without payload. Tasks write archives of bounded size next to each other in
one folder: first under a temporary name, then moved. Only archives that a finished task reported are part of the result, so that
repeated or lost tasks leave nothing behind that is read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

#: Payloads of fewer bytes are archived each time.
LEAST_REVISIT = 1000
#: Uncompressed records of one archive, records from which a dictionary is built, and the dictionary's size, in bytes.
ARCHIVE, SAMPLE, DICTIONARY = 32 << 20, 2 << 20, 64 << 10
LEVEL = 3
#: Fixed value: the magic number of the frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D

MANIFEST = "archive string, records long, bytes long"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the largest page_id of equal payloads where that is another one.

    A null html is an empty payload. Payloads below the least size never refer. Rows that share the largest page_id are all
    archived whole; a null page_id refers to a page with an id if there is one.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    # Ids meet by digest without their payloads; a payload then meets its id, so that a page under very many urls is spread out.
    large = rows.where(F.length("payload") >= least).select("page_id", "digest")
    again = large.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    refers = large.join(again, "digest").where("page_id is null or page_id <> keep").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("keep").alias("refers_to")).distinct()
    return rows.join(refers, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def _field(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. Page-ID, Refers-To-Page-ID and Payload-Length are extension fields."""
    name = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date, "WARC-Payload-Digest": name, "Payload-Length": str(len(payload)), "Content-Type": "application/http;msgtype=response"}
    if url is not None:
        fields["WARC-Target-URI"] = _field(url)
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    block = http + payload
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(refers_to, digest), "Refers-To-Page-ID": str(refers_to)}
        block = http
    fields["Content-Length"] = str(len(block))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; of records too few or too small to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY]


def archive_bytes(records: list[bytes], sample: list[bytes]) -> bytes:
    shared = dictionary(sample)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(shared)), shared, *(pack.compress(r) for r in records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    source = io.BufferedReader(unpack.stream_reader(io.BytesIO(memoryview(data)[8 + size :]), read_across_frames=True), 1 << 16)
    while line := source.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("no record where one should begin")
        fields = {}
        while (line := source.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = source.read(int(fields["Content-Length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("no end where a record should end")
        yield fields, block


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            taken, room = [], SAMPLE
            for r in held:
                if room <= 0:
                    break
                taken.append(r[:room])
                room -= len(r)
            data = archive_bytes(held, taken)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(data)
            store.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                held.append(record(*(x.as_py() for x in row), date))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes rows (as from with_revisits) to archives in the folder, which all executors must reach; returns their manifest."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    # A folder without a scheme is one of the cluster's default file system, not of each executor's own disk.
    home = path.getFileSystem(spark._jsc.hadoopConfiguration())
    home.mkdirs(path)
    uri = home.makeQualified(path).toUri().toString()
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return stored(rows.mapInArrow(_writer(uri, date), MANIFEST), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            rows, size = [], 0
            for f, block in records_of(content.as_py()):
                digest = base64.b32decode(f["WARC-Payload-Digest"].partition(":")[2]).hex()
                payload = block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{archive}: a payload does not have its digest")
                rows.append((number(f.get("Page-ID")), f.get("WARC-Target-URI"), payload, int(f["Payload-Length"]), digest, f["WARC-Type"], number(f.get("Refers-To-Page-ID")), archive))
                size += len(payload or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """A row for each record of the archives in the folder, or of those that the manifest names; payload is null for revisits.

    Every payload is checked against its digest. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").where(F.col("archive").endswith(".warc.zst"))
    if manifest is not None:
        files = files.join(manifest.select("archive"), "archive", "left_semi")
    return files.select("archive", "content").mapInArrow(_reader, READ)
