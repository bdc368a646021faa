"""WARC archives with an embedded Zstandard dictionary: writer, reader and payload de-duplication.

Layout of a file: a skippable frame with a dictionary trained on the file's first records, then one Zstandard frame per
record, so a record can be read alone. Of equal payloads (SHA-1 and length) the one with the largest id is a response,
the others are revisits that name it. For that ids and digests are shuffled; the digests that occur more than once are joined back,
broadcast while there are at most `BROADCAST_DIGESTS` of them, so that payloads stay where they are. Beyond that payloads are
shuffled by digest.

Tasks write files of about `archive_bytes` of payload under unique names and return what they wrote; the list is stored
by Spark's committer, and only files on it are read. A lost or repeated task leaves a stray file and no wrong row. Reading
streams each file, checks every digest and never holds more than a record.

Edge cases: a null payload is empty; empty payloads are equal. A null id is smaller than any other; if all ids of equal payloads are null,
all are responses, and rows that repeat the largest id are responses too. A null url is replaced by the record's id.
Extra columns are not read. An empty table writes no file and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import place
from .tables import workspace, written

ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 110 << 10
# A broadcast row holds a digest, a size and an id: about 150 bytes in the hash table.
BROADCAST_DIGESTS = 300_000
# The skippable frame that holds a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNDATED = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = UNDATED) -> bytes:
    """One WARC record. A revisit has the HTTP headers only, whose length field tells the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    urn = lambda x: f"<urn:page:{quote(x, safe='')}>" if x is not None else "<urn:page>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page)}",
        f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!*()~') if url else urn(page)[1:-1]}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; of too few, their beginning itself."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 20)), records, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """One file: records are held until the sample is full, then the dictionary is built and all are written."""

    def __init__(self, address: str):
        self.address = f"{address}/{uuid.uuid4().hex}.warc.zst"
        where, path = place(self.address)
        where.create_dir(path.rsplit("/", 1)[0])
        self.out = where.open_output_stream(path, compression=None)
        self.held: list[bytes] = []
        self.compressor = None
        self.records = self.bytes = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        self.bytes += len(data)
        if self.compressor:
            self.out.write(self.compressor.compress(data))
            return
        self.held.append(data)
        if self.bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = build_dictionary(self.held)
        content = dictionary.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self._start()
        self.out.close()
        return self.address, self.records, self.bytes


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Archive all pages below the folder; returns the list of files (path, records, bytes).

    Payloads of fewer than `least_bytes` are responses however often they occur.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size")
    )
    same = rows.where(f"size >= {least_bytes}").groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    same = written(same.where("n > 1 AND first IS NOT NULL").drop("n"), f"{folder}/repeated")
    few = same.count() <= BROADCAST_DIGESTS
    linked = rows.join(F.broadcast(same) if few else same, ["digest", "size"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    linked = linked.select(F.col("id").cast("string"), "url", "payload", refers.cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page, address, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or ArchiveWriter(folder)
                writer.add(record(page, address, text.encode(), refers_to))
                if writer.bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            path, records, size = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return written(linked.mapInArrow(run, "path string, records long, bytes long"), f"{folder}/list")


def read_records(address: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file."""
    where, path = place(address)
    with where.open_input_stream(path, compression=None) as source:
        frame, size = struct.unpack("<II", source.read(8))
        if frame != DICTIONARY_FRAME:
            raise ValueError(f"{address} does not begin with a dictionary")
        dictionary = zstandard.ZstdCompressionDict(source.read(size))
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)
        while stream.readline().strip():
            headers = {}
            while line := stream.readline().decode().rstrip("\r\n"):
                name, _, value = line.partition(": ")
                headers[name] = value
            block = stream.read(int(headers["Content-Length"]))
            stream.read(4)
            yield headers, block


def _unquoted(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page>" else None


def read_archives(files: DataFrame) -> DataFrame:
    """Records of the listed files: page, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A revisit's payload is null; its length and digest are those of the full payload. A response whose payload does not have
    its digest stops the job.
    """
    n = max(1, files.count())
    schema = "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"

    def rows(headers: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rsplit(b"Content-Length: ", 1)[1])
        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
        if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        page, refers_to = _unquoted(headers["WARC-Record-ID"]), _unquoted(headers.get("WARC-Refers-To"))
        return page, headers["WARC-Target-URI"], kind, refers_to, size, digest, payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for headers, block in read_records(path):
                    held.append(rows(headers, block))
                    size += len(block)
                    if size > SAMPLE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return files.select("path").repartition(n).mapInArrow(run, schema)


def archive_folder(pages: DataFrame) -> str:
    return f"{workspace(pages, 'warc')}/archives"
