"""WARC archives: writing whole-file gzip streams, rewriting them record by record with an offset index, reading by offset."""

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_bytes, scratch, stored

#: payload bytes after which a task begins another archive; bytes read at once; compression level
FILE_BYTES, READ_BYTES, LEVEL = 64 << 20, 1 << 20, 4
#: payloads from this size on are stored once
REVISIT_BYTES = 100
_PAGE = "urn:page:"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    """(file system, path) of a URI or an absolute path of the shared folder, as an executor opens it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record: a response, or a revisit that has the headers of the response but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_SAME}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def inflated(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, piece by piece."""
    engine = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(data, 4 * size)
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
            if out:
                yield out
    while not engine.eof:
        if not (out := engine.decompress(b"", 4 * size)):
            raise ValueError("the gzip stream ends early")
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, one in memory at a time."""
    held = bytearray()

    def have(n: int) -> bool:
        for piece in pieces:
            held.extend(piece)
            if len(held) >= n:
                break
        return len(held) >= n

    while held or have(1):
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not have(len(held) + 1):
                raise ValueError("a record has no end of header")
        fields, _ = parsed(bytes(held[:at + 4]))
        end = at + 4 + int(fields["content-length"]) + 4
        if len(held) < end and not have(end):
            raise ValueError("a record ends early")
        yield bytes(held[:end])
        del held[:end]


def _packed(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def write(pages: DataFrame, folder: str, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of one gzip stream each and return their manifest (path, records); input columns are page_id, url,
    payload, digest, size, refers_to. A task's files have names of their own: what a lost attempt leaves behind is in no
    manifest."""
    def run(batches):
        out = engine = None
        count = held = 0
        made: list[tuple[str, int]] = []

        def close():
            out.write(engine.flush())
            out.close()
            made.append((path, count))

        for batch in by_bytes(batches, 2):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, count, held = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    files, name = _open(path)
                    files.create_dir(name.rpartition("/")[0])
                    out, engine = files.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(engine.compress(record(*row)))
                count += 1
                held += len(row[2])
                if held >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())],
                                         names=["path", "records"])

    columns = pages.select(F.col("page_id").cast("long"), "url", F.encode("payload", "UTF-8"), "digest", "size", "refers_to")
    return columns.mapInArrow(run, "path string, records long")


def normalise(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite each archive with a member per record and return (path, index, records, bytes).

    A file is inflated once, as a stream; each record is written as a gzip member of its own, and its offset, length,
    type and identifier go to a sidecar file (JSON lines). Memory is that of one record.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                files, name = _open(source)
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                target, to = _open(path)
                target.create_dir(to.rpartition("/")[0])
                at = count = 0
                with files.open_input_stream(name, compression=None) as stream, target.open_output_stream(to, compression=None) as out, \
                        target.open_output_stream(to + ".idx", compression=None) as index:
                    for data in records(inflated(stream)):
                        fields, _ = parsed(data)
                        member = _packed(data, level)
                        out.write(member)
                        index.write((json.dumps({"offset": at, "length": len(member), "type": fields["warc-type"],
                                                 "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri")}) + "\n").encode())
                        at += len(member)
                        count += 1
                rows.append((path, path + ".idx", count, at))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()])],
                names=["path", "index", "records", "bytes"])

    return _spread(manifest).mapInArrow(run, "path string, index string, records long, bytes long")


def _spread(files: DataFrame) -> DataFrame:
    """A file per partition, up to a number of partitions."""
    return files.repartition(max(1, min(files.count(), 10_000)))


def read(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, path, offset) of indexed archives.

    Every record is read by its offset in the sidecar. A response's digest is that of its payload, and must be the one
    in its header; a revisit has both figures from its headers, and no payload.
    """
    def page(text):
        text = (text or "").strip("<>")[len(_PAGE):]
        return int(text) if text else None

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()),
                        ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = _open(path)
                sidecar, side = _open(index)
                rows, held = [], 0
                with files.open_input_file(name) as data, sidecar.open_input_stream(side, compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        fields, block = parsed(zlib.decompress(data.read(entry["length"]), 31))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        size = len(payload)
                        if fields["warc-type"] == "revisit":
                            size, payload = int(head.rpartition(b"Content-Length:")[2]), None
                        elif hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {fields['warc-record-id']} in {path}")
                        rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), payload, size, digest, fields["warc-type"],
                                     page(fields.get("warc-refers-to")), path, entry["offset"]))
                        held += size
                        if held > 4 * READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _spread(archives).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                                             "record_type string, refers_to long, path string, offset long")


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(READ_BYTES):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload, digest, size and refers_to: the smallest page_id with an equal payload of ``least`` bytes or
    more, NULL for that page itself.

    Only digests that occur more than once are joined back, so the table that a hot payload meets has one row for it.
    That table is stored first: Spark knows its size and moves the payloads only if it is too large to broadcast.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("payload"),
                        F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    heads = stored(rows.where(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "heads")
    return rows.join(heads, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def archived(pages: DataFrame) -> DataFrame:
    """Write pages as archives, normalise them, and read the records back; see :func:`read` for the columns.

    The payload of a record is the html in UTF-8; NULL is empty. Of equal payloads of at least 100 bytes the one with the
    smallest page_id is the response, the others are revisits of it; smaller ones are all responses. A page without an
    id is a revisit if a page with an id has its payload, else a response. Rows that repeat an id are records of their
    own: with an equal payload both are responses if the id is the smallest. A NULL url has no target URI; control
    characters and blanks in a url are percent-encoded. An empty table gives no archive and no rows. Other columns are not
    read. The folder is the shared one of the session, opened by executors through pyarrow's file systems.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = stored(write(decided(pages), f"{folder}/whole"), "manifest")
    return read(stored(normalise(manifest, f"{folder}/records"), "archives"))
