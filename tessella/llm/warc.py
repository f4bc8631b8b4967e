"""WARC archives with Zstandard: a writer and a validating reader.

An archive (`.warc.zst`) begins with a skippable frame that holds the archive's dictionary, then has one frame per
record. The writer trains the dictionary on the first records of its task; the reader loads it from the leading
frame, decodes frame by frame, and checks each record: version line, mandatory and well-formed headers, block length,
the end of the record, and the digests. Of equal payloads that are long enough, the page with the smallest id is a
`response`; the others are `revisit` records that refer to it and hold no payload.

Archives go to the shared folder through `pyarrow.fs` (file, HDFS, S3, GCS). A task writes names of its own and reports
them; only the archives of tasks that succeeded are in the manifest, so a repeated task leaves nothing but unread
files.

Defined results for odd input: null html is empty; a null id is written as such and never referred to unless all ids of
its group are null; rows equal in id and payload to their group's response are responses too; empty tables write nothing;
other columns are not read. A record of more than 2 GiB when decoded, which no Spark value can hold, ends the read with a `WarcError`.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, shared_dir, ship, texts

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
# Fixed values end.

RECORD_DATE = "1970-01-01T00:00:00Z"
#: Frames of no more than this when decoded; a record that claims more is refused.
MAX_RECORD = 1 << 31
#: Groups of equal payloads, 40 bytes each, up to so many are broadcast; more are joined by shuffling.
BROADCAST_GROUPS = 200_000


class WarcError(ValueError):
    pass


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def uri_page(uri: str):
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise WarcError(f"not a page's id: {uri!r}")
    text = uri[len("<urn:page:") : -1]
    return None if text == "null" else int(text)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record. A revisit keeps the HTTP headers, and with them the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # a URL cannot hold white space or controls; such bytes would break the header
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else page_uri(page_id)[1:-1]
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_uri(page_id)),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_uri(refers_to))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's `headers`, `http` headers and `payload` (None for a revisit), or a WarcError."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("no end of the headers")
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError(f"not a WARC version: {lines[0][:40]!r}")
    headers = _fields(lines[1:])
    for name in MANDATORY:
        if name.lower() not in headers:
            raise WarcError(f"{name} is missing")
    length = headers["content-length"]
    if not length.isdigit():
        raise WarcError(f"bad Content-Length {length!r}")
    block, end = rest[: int(length)], rest[int(length) :]
    if len(block) != int(length) or end != b"\r\n\r\n":
        raise WarcError(f"a block of {length} bytes doesn't end where the record does")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block doesn't match its digest")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"unknown type {kind!r}")
    http_head, sep, payload = block.partition(b"\r\n\r\n")
    http_lines = http_head.split(b"\r\n")
    if not sep or not http_lines[0].startswith(b"HTTP/"):
        raise WarcError("the block is not an HTTP response")
    http = _fields(http_lines[1:])
    size = http.get("content-length", "")
    if not size.isdigit():
        raise WarcError("the HTTP response has no length")
    digest = headers.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise WarcError("no SHA-1 payload digest")
    if kind == "response" and (len(payload) != int(size) or digest != f"sha1:{sha1_base32(payload)}"):
        raise WarcError("the payload doesn't match its length and digest")
    if kind == "revisit" and ("warc-refers-to" not in headers or payload):
        raise WarcError("a revisit refers to a record and has no payload")
    return {"headers": headers, "http": http, "payload": payload if kind == "response" else None}


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header {line[:60]!r}")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode()
    return out


def train(samples: list[bytes], size: int):
    """A dictionary from sample records; few or odd samples give a raw one of their first bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(dictionary) -> bytes:
    data = dictionary.as_bytes()
    return SKIPPABLE_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


class ArchiveReader:
    """Iterates over the records of an open archive, reading `chunk` bytes at a time."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self.stream, self.chunk, self.rest = stream, chunk, b""

    def _take(self, n: int) -> bytes:
        while len(self.rest) < n:
            more = self.stream.read(max(self.chunk, n - len(self.rest)))
            if not more:
                raise WarcError("the archive ends inside a frame")
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def dictionary(self):
        import zstandard

        if int.from_bytes(self._take(4), "little") != SKIPPABLE_MAGIC:
            raise WarcError("no dictionary frame at the start")
        data = self._take(int.from_bytes(self._take(4), "little"))
        if data[:4] == FRAME_MAGIC:  # the dictionary may be compressed itself
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
        return zstandard.ZstdCompressionDict(data, dict_type=kind)

    def __iter__(self) -> Iterator[bytes]:
        import zstandard

        decoder = zstandard.ZstdDecompressor(dict_data=self.dictionary(), max_window_size=1 << 27)
        while True:
            if not self.rest:
                self.rest = self.stream.read(self.chunk)
                if not self.rest:
                    return
            frame, parts, size = decoder.decompressobj(), [], 0
            while not frame.eof:
                if not self.rest:
                    self.rest = self.stream.read(self.chunk)
                    if not self.rest:
                        raise WarcError("the archive ends inside a frame")
                step, self.rest = self.rest[:8192], self.rest[8192:]
                try:
                    parts.append(frame.decompress(step))
                except zstandard.ZstdError as e:
                    raise WarcError(f"bad frame: {e}") from e
                size += len(parts[-1])
                if size > MAX_RECORD:
                    raise WarcError("the record is too large")
            self.rest = frame.unused_data + self.rest
            yield b"".join(parts)


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])


def _writer(folder: str, archive_bytes: int, dictionary_bytes: int, sample_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for b in batches:
                ids, urls, refers, revisits = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
                for lo in range(0, len(ids), 64):  # no more than 64 payloads are copied at once
                    for i, payload in enumerate(texts(b.column(2)[lo : lo + 64]), lo):
                        yield record(ids[i], urls[i], payload, refers[i], revisits[i])

        every = records()
        sample, size = [], 0
        for x in every:
            sample.append(x)
            size += len(x)
            if size >= sample_bytes:
                break
        if not sample:
            return
        dictionary = train([x[:100_000] for x in sample], dictionary_bytes)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
        store, base = fs.FileSystem.from_uri(folder)
        out, path, written, count = None, "", 0, 0
        done: list[tuple[str, int]] = []

        def both():
            yield from sample
            yield from every

        for x in both():
            if out is None:
                path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                out = store.open_output_stream(path)
                out.write(leading_frame(dictionary))
                written = count = 0
            frame = compressor.compress(x)
            out.write(frame)
            written, count = written + len(frame), count + 1
            if written >= archive_bytes:
                out.close()
                done.append((path, count))
                out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), MANIFEST.types)], schema=MANIFEST)

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = 32 << 20,
    dictionary_bytes: int = 16 << 10,
    sample_bytes: int = 1 << 20,
    level: int = 3,
) -> DataFrame:
    """Writes all pages and returns the manifest `(path, records)`; paths are inside `folder`'s file system."""
    ship(pages.sparkSession)
    folder = folder or f"{shared_dir(pages.sparkSession)}/tessella/warc-{uuid.uuid4().hex}"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.unhex(F.sha1(body.cast("binary"))).alias("digest")
    )
    groups = (
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    groups = materialise(groups, "warc-groups")
    small = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull() & F.col("page_id").isNull())
    ready = joined.select("page_id", "url", "html", F.col("first_id").alias("refers_to"), revisit.alias("revisit"))
    written = ready.mapInArrow(released(_writer(folder, archive_bytes, dictionary_bytes, sample_bytes, level)), "path string, records long")
    return materialise(written, "warc-manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(folder: str, with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(path) as stream:
                    for data in ArchiveReader(stream):
                        r = parse_record(data)
                        h = r["headers"]
                        revisit = h["warc-type"] == "revisit"
                        rows.append((uri_page(h["warc-record-id"]), h["warc-target-uri"], int(r["http"]["content-length"]), h["warc-payload-digest"][5:], h["warc-type"], uri_page(h["warc-refers-to"]) if revisit else None, r["payload"] if with_payload else None))
                        seen, held = seen + 1, held + (len(data) if with_payload else 200)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if seen != expected:
                    raise WarcError(f"{path} has {seen} records; {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def read_archives(manifest: DataFrame, folder: str | None = None, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's archives; any malformed archive fails the read with a WarcError."""
    spark = manifest.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark)
    spread = manifest.select("path", "records").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(released(_reader(folder, with_payload)), READ)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (d)
"""
