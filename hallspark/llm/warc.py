"""WARC archives in Zstandard: a writer with revisit records and a validating reader."""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_checked, materialize, new_folder

#: Fixed values of the formats: the skippable frame that holds a dictionary, Zstandard's frame and dictionary marks.
SKIPPABLE, FRAME, TRAINED = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    body = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if body == "none" else int(body)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is that of the payload it leaves out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode().split("\r\n"):
        name, mark, value = line.partition(":")
        if not mark or not name.strip():
            raise ValueError(f"not a header line: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes) -> tuple:
    """Validate one record's version line, headers, lengths and payload digest; the row of it."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not mark:
        raise ValueError("a record lacks its version line or the end of its headers")
    h = _headers(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise ValueError(f"a record lacks {sorted(missing)}")
    length = int(h["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a record's block has {len(rest) - 4} bytes, not {length}")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("a record's block has no HTTP header")
    size = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload differs from its length or digest")
        return _page(h["warc-record-id"]), size, digest, "response", None, h.get("warc-target-uri", "")
    if h["warc-type"] != "revisit" or payload:
        raise ValueError(f"unexpected record of type {h['warc-type']}")
    return _page(h["warc-record-id"]), size, digest, "revisit", _page(h["warc-refers-to"]), h.get("warc-target-uri", "")


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return (b"".join(samples)[-DICTIONARY_BYTES:]).removeprefix(TRAINED) or b"WARC/1.1\r\n"


def _opened(path: str):
    return fs.FileSystem.from_uri(path)


class _Archive:
    """An archive under a name of its own: a task that runs twice leaves a file that no manifest names."""

    def __init__(self, folder: str):
        self.path, self.records, self.held, self.size, self.out = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, [], 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out:
            self.out.write(self.packer.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        words = _dictionary([r[:65536] for r in self.held])
        system, at = _opened(self.path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=9).compress(words)
        self.out = system.open_output_stream(at)
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        for record in self.held:
            self.out.write(self.packer.compress(record))
        self.held = []

    def close(self) -> tuple[str, int] | None:
        if not self.records:
            return None
        if not self.out:
            self.start()
        self.out.close()
        return self.path, self.records


def write_archives(pages: DataFrame, *, least_shared: int = 1000) -> DataFrame:
    """Write a record per page (page_id, url, html) and return the manifest (path, records) of the archives.

    Payload: the html in UTF-8 (null: empty). Of the pages with equal payloads of at least ``least_shared`` bytes, that
    with the largest page_id is a response and the others revisit it; smaller payloads are all responses. Pages with a
    null id revisit, too; where all ids of a group are null, each is a response, and so is each repeated row that has
    the largest id. An empty table gives no archive. Other columns are ignored.

    Only narrow rows (id, digest) are grouped. Each task writes the archive of its pages to the shared folder, and the
    manifest holds those of the tasks that succeeded.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_shared).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    keepers = broadcast_checked(materialize(shared.select(F.col("digest").alias("own"), "keeper"), "warc-keepers"), 80)
    folder = new_folder(spark, "warc")
    joined = rows.join(keepers, F.col("digest") == F.col("own"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))

    def write(batches):
        archive = _Archive(folder)
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                page, url, body, digest, refers_to = (c[k].as_py() for c in columns)
                archive.add(record_bytes(page, url, body, digest, refers_to))
        if done := archive.close():
            yield pa.RecordBatch.from_pydict({"path": [done[0]], "records": [done[1]]})

    return materialize(joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(write, "path string, records long"), "warc-manifest")


def _exactly(stream, n: int) -> bytes:
    data = b""
    while len(data) < n:
        if not (more := stream.read(n - len(data))):
            raise ValueError("an archive ends early")
        data += more
    return data


def records_of(stream):
    """Decode an archive: its dictionary from the leading skippable frame, then one frame per record."""
    mark, size = struct.unpack("<II", _exactly(stream, 8))
    if mark != SKIPPABLE:
        raise ValueError("an archive doesn't begin with the frame of its dictionary")
    words = _exactly(stream, size)
    if words.startswith(FRAME):
        words = zstandard.ZstdDecompressor().decompress(words)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    frame, parts, data = decoder.decompressobj(), [], stream.read(1 << 16)
    fresh = True
    while data:
        if fresh and len(data) < 18:  # the longest header of a frame
            data += stream.read(1 << 16)
        if fresh:
            if not data.startswith(FRAME):
                raise ValueError("data between frames")
            expected, fresh = zstandard.frame_content_size(data), False
        parts.append(frame.decompress(data))
        if frame.eof:
            record, data = b"".join(parts), frame.unused_data
            if expected not in (-1, len(record)):
                raise ValueError(f"a frame holds {len(record)} bytes, not {expected}")
            yield record
            frame, parts, fresh = decoder.decompressobj(), [], True
        else:
            data = b""
        if not data:
            data = stream.read(1 << 16)
    if parts:
        raise ValueError("an archive ends within a frame")


def read_archives(manifest: DataFrame, *, batch_rows: int = 2048) -> DataFrame:
    """Read the archives that a manifest (path, records) names: a row per record, validated."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _opened(path)
                rows, seen = [], 0
                with system.open_input_stream(at) as stream:
                    for record in records_of(stream):
                        rows.append(parse_record(record))
                        if len(rows) == batch_rows:
                            yield batch_of(rows)
                            rows, seen = [], seen + batch_rows
                if seen + len(rows) != expected:
                    raise ValueError(f"{path} holds {seen + len(rows)} records, not {expected}")
                yield batch_of(rows)

    spark = manifest.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "records").repartition(spread).mapInArrow(read, RECORD)
