"""WARC archives compressed with Zstandard: writer and validating reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; after it comes one frame for each record.  Payloads that repeat an
earlier page's payload (same SHA-1 digest and size) are written as revisits of
the page with the smallest id.

Tasks write one archive, or one for each ``ARCHIVE_BYTES`` of payloads, for each shuffle
partition into a shared folder, each under a temporary name that is moved into place, so
that a repeated task replaces the same file with the same bytes.  The reader decodes frame by frame,
checks version, required headers, lengths, digests and the closing blank lines,
and raises ``ValueError`` on a malformed archive.

Null html is an empty payload; a null url is written as ``urn:page``.  Rows that
repeat the page_id and the payload of an original are responses as it is.  Rows with
a null page_id are never the original of others; without an original each is a
response.  The folder must be one that pyarrow's file systems reach.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shuffle as X

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_BYTES = 64 << 10
SAMPLE_PAGES = 256
ARCHIVE_BYTES = 1 << 30
SAMPLE_BYTES = 16 << 10
DATE = "2024-01-31T00:00:00Z"
_CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no block but the full payload's length and digest."""
    kind = "response" if refers_to is None else "revisit"
    record_id = lambda page, kind: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}|{kind}|{digest}')}>"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, kind)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or 'urn:page').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, 'response')}", f"WARC-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return _CRLF.join(h.encode("utf-8") for h in head) + _CRLF * 2 + block + _CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    end = raw.find(_CRLF * 2)
    if end < 0:
        raise ValueError("record without end of headers")
    lines = raw[:end].split(_CRLF)
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"not a WARC version: {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header: {line[:60]!r}")
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    n = int(headers["content-length"])
    if len(raw) != end + 4 + n + 4 or raw[-4:] != _CRLF * 2:
        raise ValueError("the record's length differs from Content-Length")
    return headers, raw[end + 4 : end + 4 + n]


def write_archive(out, dictionary: bytes, records: Iterator[bytes]) -> None:
    """The dictionary in the leading skippable frame, then one frame for each record."""
    import zstandard

    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
    params = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    c = zstandard.ZstdCompressor(level=3, write_checksum=True, **params)
    for r in records:
        out.write(c.compress(r))


def read_archive(source, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive; reads ahead one block or, for longer frames, one frame."""
    import zstandard

    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<II", head)[1]
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary frame is cut off")
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    params = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    d = zstandard.ZstdDecompressor(**params)
    data = b""
    while True:
        if not data:
            data = source.read(block)
            if not data:
                return
        frame, parts = d.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = source.read(block)
            if not data:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _write(folder: str, dictionary: bytes, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))))
        row = next(rows, None)
        while row is not None or number == 0:
            counts = [0, 0]

            def records():
                nonlocal row
                while row is not None and counts[1] < most:
                    page_id, url, html, refers = row
                    payload = (html or "").encode("utf-8")
                    counts[0] += 1
                    counts[1] += len(payload)
                    yield record(page_id, url, payload, digest32(payload), refers)
                    row = next(rows, None)

            name, own = f"part-{part:06d}-{number:04d}.warc.zst", f"{root}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(own, compression=None) as out:
                write_archive(out, dictionary, records())
            store.move(own, f"{root}/{name}")
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [counts[0]], "bytes": [counts[1]]})

    return write


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, expected in zip(b["path"].to_pylist(), b["records"].to_pylist()):
                rows, found = [], 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as source:
                    for raw in read_archive(source):
                        h, block = parse(raw)
                        digest, refers = h["warc-payload-digest"].removeprefix("sha1:"), h.get("warc-refers-to-page")
                        if h["warc-type"] == "response" and (digest32(block) != digest or len(block) != int(h["warc-payload-length"])):
                            raise ValueError(f"{path}: payload of {h['warc-record-id']} differs from its digest")
                        page = h["warc-page-id"]
                        rows.append((int(page) if page else None, int(h["warc-payload-length"]), digest, h["warc-type"], None if refers is None else int(refers), h["warc-target-uri"]))
                        found += 1
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if found != expected:
                    raise ValueError(f"{path} holds {found} records, {expected} were written")
                yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the first SAMPLE_BYTES of at most SAMPLE_PAGES pages, chosen by hash of their id."""
    import zstandard

    have = pages.where("html is not null")
    share = min(1.0, 2 * SAMPLE_PAGES / max(1, have.count()))
    few = have.withColumn("h", F.pmod(F.xxhash64("page_id"), F.lit(1 << 40))).where(F.col("h") < share * (1 << 40))
    rows = few.select("h", F.substring("html", 1, SAMPLE_BYTES).alias("html")).orderBy("h", "html").limit(SAMPLE_PAGES).collect()
    samples = [r.html.encode("utf-8") for r in rows if r.html]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # too few or too short samples for a dictionary
        return b""


def with_original(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html -> the same and refers_to: the smallest page_id with an equal payload, null for itself.

    Digests are counted before the exchange; a digest that very many pages share is a
    skewed side of the join, which adaptive execution splits."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    first = pages.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    joined = pages.join(first, "digest", "left")
    repeats = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id")) & (F.col("size") >= least_bytes)
    return joined.select("page_id", "url", "html", F.when(repeats, F.col("original")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) into ``folder``; returns path, records and bytes of each archive.

    An archive is closed once it holds ``most_bytes`` of payloads."""
    pages = pages.select("page_id", "url", "html")
    dictionary = train_dictionary(pages)
    manifest = with_original(pages, least_bytes).mapInArrow(_write(folder, dictionary, most_bytes), "path string, records long, bytes long")
    return X.cut(manifest, "manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Headers of all records of the archives that the manifest names, after validation."""
    files = manifest.select("path", "records")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = X.shared_dir(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(manifest, folder).drop("url")

