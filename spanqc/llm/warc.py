"""WARC archives, written and read as a chunked record table.

A payload travels as rows of record and chunk number, so that no Python process holds
a whole one: the writer gets chunks, compresses each record as a gzip member of its
own and goes on with its digest from chunk to chunk; the reader parses the archives as
a stream and gives chunk rows that carry the number of bytes and the SHA-1 so far.
Files are written in the shared folder, and a manifest, which Spark commits,
names those of the tasks that succeeded; a file of a lost task is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructType

from ..sources.shared import filesystem
from .common import batches_of, stored, text_bytes

#: Bytes of a chunk.
CHUNK = 64 * 1024
#: Chunks that a Python process is given at a time.
AT_ONCE = 256
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: Bytes after which a task starts another file, and of a file's stretch of whole records that one task reads.
FILE_BYTES, STRETCH_BYTES = 1_000_000_000, 64_000_000
#: The profile of a record that stands for an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
END = b"\r\n\r\n"


def on_a_line(page: str | None) -> str | None:
    """An id as the value of a header line: what isn't a plain character is percent-encoded."""
    return None if page is None else quote(page, safe="", errors="surrogatepass")


def off_a_line(value: str | None) -> str | None:
    return None if value is None else unquote(value, errors="surrogatepass")


def record_name(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}:{digest}')}>"


def safe_uri(url: str | None, page: str | None) -> str:
    """A URL without characters that end a header line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{on_a_line(page)}"


def heads(page: str | None, url: str | None, digest: str, size: int, kind: str, original: str | None, date: str) -> bytes:
    """The header of a record and of the HTTP message in it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_name(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {safe_uri(url, page)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        lines.append(f"Page-ID: {on_a_line(page)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(original, digest)}", f"Refers-To-Page-ID: {on_a_line(original)}", f"Payload-Length: {size}"]
    block = len(http.encode()) + (size if kind == "response" else 0)
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n" + http).encode("utf-8", "surrogatepass")


def payload_chunks(frame: DataFrame, id_column: str, url_column: str, payload_column: str, least: int) -> DataFrame:
    """The chunked record table of the rows to write, in order within a row."""
    payload = F.coalesce(text_bytes(payload_column), F.lit(b""))
    rows = frame.select(F.col(id_column).alias("page"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("original"), F.count(F.lit(1)).alias("n"))
    # Only where repeated payloads are many are the rows with payloads shuffled for the join.
    shared = stored(shared.where(F.col("n") > 1).select(F.col("digest").alias("d"), F.col("size").alias("s"), "original"), "repeated-payloads")
    joined = rows.join(shared, (rows.digest == shared["d"]) & (rows["size"] == shared["s"]), "left")
    revisit = F.col("original").isNotNull() & ~F.col("page").eqNullSafe(F.col("original"))
    last = F.when(revisit, F.lit(0)).otherwise(F.floor((F.col("size") - 1) / CHUNK)).cast("int")
    chunks = joined.select(
        F.col("page").cast("string").alias("page"), "url", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("original")).cast("string").alias("original"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("chunk"),
    )
    return chunks.select("page", "url", "digest", "size", "kind", "original", "chunk", F.substring("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("data"))


#: A row for each stretch of whole records of a file.
MANIFEST = StructType().add("file", StringType()).add("offset", LongType()).add("first", LongType()).add("records", LongType()).add("bytes", LongType())


class Writer:
    """Archive files of one task."""

    def __init__(self, folder: str, date: str) -> None:
        self.folder, self.date = folder, date
        self.done: list[tuple[str, int, int, int, int]] = []  # file, where a stretch begins, its first record's number, records, bytes
        self.file = None

    def chunk(self, page: str | None, url: str | None, digest: str, size: int, kind: str, original: str | None, number: int, data: bytes) -> None:
        if number == 0:
            self.end_record()
            if self.file is None or self.bytes > FILE_BYTES:
                self.end_file()
                store, path = filesystem(f"{self.folder}/records-{uuid.uuid4().hex}.warc.gz")
                self.path, self.file, self.bytes, self.records = f"{self.folder}/{path.rpartition('/')[2]}", store.open_output_stream(path, compression=None), 0, 0
                self.begun, self.first = 0, 0
            self.packer, self.sha, self.wanted = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), (kind, digest)
            self.put(self.packer.compress(heads(page, url, digest, size, kind, original, self.date)))
            self.open = True
        self.sha.update(data)
        self.put(self.packer.compress(data))

    def put(self, packed: bytes) -> None:
        self.file.write(packed)
        self.bytes += len(packed)

    open = False

    def end_record(self) -> None:
        if self.open:
            if self.wanted[0] == "response" and self.sha.hexdigest() != self.wanted[1]:
                raise ValueError("a record's chunks came out of order")
            self.put(self.packer.compress(END) + self.packer.flush())
            self.records += 1
            self.open = False
            if self.bytes - self.begun >= STRETCH_BYTES:
                self.end_stretch()

    def end_stretch(self) -> None:
        if self.records > self.first:
            self.done.append((self.path, self.begun, self.first, self.records - self.first, self.bytes - self.begun))
            self.begun, self.first = self.bytes, self.records

    def end_file(self) -> None:
        if self.file is not None:
            self.file.close()
            self.end_stretch()
            self.file = None


def write_archives(frame: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for every row, and ``manifest`` in the same folder.

    Of rows with equal payloads of at least ``least`` bytes that with the largest id is the
    response and the others revisit it; rows that repeat that id are responses
    too. Ids may hold any characters. A null payload is empty; a null id is never the largest, and where all are null,
    all are responses. An empty table gives an empty manifest.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, date)
        for batch in batches:
            small = [batch.column(k).to_pylist() for k in range(7)]
            for k, data in enumerate(batch.column(7)):
                out.chunk(*(column[k] for column in small), data.as_buffer())
        out.end_record()
        out.end_file()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in out.done], pa.string()), *(pa.array([d[i] for d in out.done], pa.int64()) for i in (1, 2, 3, 4))], MANIFEST.names)

    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    chunks = payload_chunks(frame, id_column, url_column, payload_column, least)
    with batches_of(frame.sparkSession, AT_ONCE):
        chunks.mapInArrow(written, MANIFEST).write.parquet(f"{folder}/manifest")


class Stretch:
    """Some bytes of a file, from its position on."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file, self.left = file, size

    def read(self, most: int) -> bytes:
        found = self.file.read(min(most, self.left))
        self.left -= len(found)
        return found


class Inflated:
    """The plain bytes of a file of gzip members, a bounded number at a time."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.buffer = file, b""
        self.member, self.packed = zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(CHUNK)
                if not self.packed:
                    return False
            new = self.member.decompress(self.packed, CHUNK)
            self.packed = self.member.unconsumed_tail
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, zlib.decompressobj(31)
            if new:
                self.buffer += new
                return True

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before a mark, which is taken too; None at the end."""
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                return None
        found, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        """Some bytes, at most so many; none only at the end."""
        if not self.buffer and not self.more():
            return b""
        found, self.buffer = self.buffer[:most], self.buffer[most:]
        return found


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """The fields of each record and its payload in pieces, which are to be used up before the next."""
    plain = Inflated(file)
    while (head := plain.upto(END)) is not None:
        first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record doesn't begin where the one before ended")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            left -= len(plain.upto(END) or b"") + len(END)

        def pieces(left: int = left) -> Iterator[bytes]:
            while left:
                piece = plain.take(min(left, CHUNK))
                if not piece:
                    raise ValueError("an archive ends within a record")
                left -= len(piece)
                yield piece

        own = pieces()
        yield fields, own
        for _ in own:  # what the caller left
            pass
        if plain.upto(END):
            raise ValueError("a record doesn't end where it should")


CHUNKS = (
    StructType().add("file", StringType()).add("record", LongType()).add("page", StringType()).add("record_type", StringType()).add("refers_to", StringType()).add("chunk", IntegerType())
    .add("data", BinaryType()).add("bytes_so_far", LongType()).add("sha1_so_far", StringType()).add("last", BooleanType())
)


def read_archives(spark: SparkSession, folder: str, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that a manifest names.

    A row for each chunk of each record: ``file``, ``record`` (its number in the file), ``page``,
    ``record_type``, ``refers_to``, ``chunk`` (number), ``data`` (null unless asked for),
    ``bytes_so_far``, ``sha1_so_far`` and ``last``. An empty payload has one chunk. A
    revisit has one chunk without data, with the length and digest of the full payload.
    """
    def rows(path: str, offset: int, first: int, size: int) -> Iterator[tuple]:
        store, name = filesystem(path)
        with store.open_input_file(name) as file:
            file.seek(offset)
            for number, (fields, parts) in enumerate(records(Stretch(file, size)), first):
                page, kind, refers = off_a_line(fields.get("page-id")), fields["warc-type"], off_a_line(fields.get("refers-to-page-id"))
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "revisit":
                    yield path, number, page, kind, refers, 0, None, int(fields["payload-length"]), digest, True
                    continue
                sha, done, chunk, held = hashlib.sha1(), 0, 0, b""
                for part in parts:
                    if held:
                        yield path, number, page, kind, refers, chunk, held if data else None, done, sha.hexdigest(), False
                        chunk += 1
                    sha.update(part)
                    done, held = done + len(part), part
                if sha.hexdigest() != digest:
                    raise ValueError(f"{path}: record {number} has another digest than its header says")
                yield path, number, page, kind, refers, chunk, held if data else None, done, digest, True

    names = [f.name for f in CHUNKS]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            weight = 0

            def out(held: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)

            for where in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "first", "bytes")), strict=True):
                for row in rows(*where):
                    held.append(row)
                    weight += 200 + len(row[6] or b"")
                    if weight > 8_000_000:
                        yield out(held)
                        held, weight = [], 0
            if held:
                yield out(held)

    stretches = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return stretches.coalesce(1).repartition(max(1, stretches.count())).mapInArrow(read, CHUNKS)


def page_digests(chunks: DataFrame, id_column: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """A row for each record: its last chunk has the length and digest of all."""
    as_id = lambda c: F.col(c).cast(id_type)
    kept: list[Column] = [as_id("page").alias(id_column), F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), F.col("record_type"), as_id("refers_to").alias("refers_to")]
    return chunks.where("last").select(*kept)
