"""WARC archives in Zstandard frames: writer and validating reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is one Zstandard frame with its content size and a
checksum.  The writer trains the dictionary of each archive on a bounded sample
of its own payloads (``sample_bytes``); archives too small to train one have
none.  Files are written under a temporary name and renamed, with names that
follow from the task's partition, so a task that runs again replaces its own.

The reader walks block headers to find the end of a frame, decodes one frame per
record and checks: magic numbers, dictionary id, declared and real content size,
checksum, WARC version, the four required headers, Content-Length against the
block, the closing blank lines, block and payload digests.  A damaged record is
an error, or with ``strict=False`` a row whose ``error`` says what is wrong; reading
goes on behind it while frame boundaries can be found.

Cases: null html is an empty payload; null url gives no WARC-Target-URI; line
breaks in a url are percent-encoded; of equal payloads of ``revisit_bytes`` or more
the largest id is the response (repeated rows of that id each are), all others,
null ids included, revisit it; without any id all are responses; an empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import fresh_path, materialize, qualified, short_batches

DICTIONARY_FRAME, ZSTD_FRAME, ZSTD_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
# fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""
    http: dict[str, str] = field(default_factory=dict)


def digest_value(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(raw).digest()).decode()


def digest_hex(value: str) -> str:
    name, _, text = value.partition(":")
    if name.lower() != "sha1" or len(text) != 32:
        raise WarcError(f"digest not understood: {value[:60]}")
    return base64.b32decode(text).hex()


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header line {line[:60]!r}")
        out[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def decode_record(raw: bytes) -> Record:
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise WarcError(f"not a WARC record: {raw[:20]!r}")
    h = _headers(lines)
    if missing := [k for k in REQUIRED if k not in h]:
        raise WarcError(f"missing header {', '.join(missing)}")
    if not h["content-length"].isdigit():
        raise WarcError(f"Content-Length is {h['content-length'][:40]!r}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block with its blank lines has {len(rest)} bytes")
    r = Record(h, rest[:n])
    if "warc-block-digest" in h and digest_hex(h["warc-block-digest"]) != sha1(r.block).hexdigest():
        raise WarcError("block digest differs")
    r.payload = r.block
    if h.get("content-type", "").startswith("application/http"):
        http, blank, r.payload = r.block.partition(b"\r\n\r\n")
        if not blank:
            raise WarcError("HTTP headers do not end")
        r.http = _headers(http.split(b"\r\n")[1:])
    if h["warc-type"] == "response" and "warc-payload-digest" in h and digest_hex(h["warc-payload-digest"]) != sha1(r.payload).hexdigest():
        raise WarcError("payload digest differs")
    return r


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at ``at``, from its block headers."""
    try:
        head = bytes(data[at : at + 18])
        at += zstandard.frame_header_size(head)
        has_checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame header at {at}: {e}") from None
    last = 0
    while not last:
        if at + 3 > len(data):
            raise WarcError("truncated frame")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * has_checksum
    if at > len(data):
        raise WarcError("truncated frame")
    return at


def read_archive(content: bytes, max_record_bytes: int = 1 << 30) -> Iterator[Record | WarcError]:
    """The records of one archive; a damaged one as the error found in it."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (n,) = struct.unpack_from("<I", data, 4)
        if 8 + n > len(data):
            yield WarcError("truncated dictionary frame")
            return
        raw = bytes(data[8 : 8 + n])
        try:
            if raw[:4] == struct.pack("<I", ZSTD_FRAME):
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
            if raw[:4] != struct.pack("<I", ZSTD_DICTIONARY):
                raise zstandard.ZstdError("no dictionary magic")
            dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + n
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
        except zstandard.ZstdError as e:
            yield WarcError(f"the leading skippable frame holds no dictionary: {e}")
            return
    else:
        decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]  # any other skippable frame
            continue
        try:
            end = frame_end(data, at)
        except WarcError as e:
            yield e
            return
        frame, at = bytes(data[at:end]), end
        try:
            p = zstandard.get_frame_parameters(frame)
            if p.content_size in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR):
                raise WarcError("the frame does not declare its content size")
            if p.content_size > max_record_bytes:
                raise WarcError(f"a record of {p.content_size} bytes is above the limit")
            if p.dict_id and (dictionary is None or p.dict_id != dictionary.dict_id()):
                raise WarcError(f"the frame asks for dictionary {p.dict_id}")
            raw = decoder.decompress(frame, max_output_size=max_record_bytes)
            if len(raw) != p.content_size:
                raise WarcError(f"{p.content_size} bytes declared, {len(raw)} found")
            yield decode_record(raw)
        except (WarcError, zstandard.ZstdError) as e:
            yield e if isinstance(e, WarcError) else WarcError(f"frame: {e}")


def encode_archive(records: list[bytes], dictionary_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 6) -> bytes:
    """One archive; the dictionary is trained on evenly spaced records of ``sample_bytes`` in all."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = [r[: 1 << 17] for r in records[::step]]
    dictionary, out = None, []
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, sample, k=256, d=8)
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    except zstandard.ZstdError:  # too few or too short samples
        pass
    more = {"dict_data": dictionary} if dictionary else {}
    encoder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **more)
    return b"".join([*out, *map(encoder.compress, records)])


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    h = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date)]
    if url is not None:
        h.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    h += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest_value(block)), ("WARC-Payload-Digest", digest)]
    if refers_to is not None:
        h += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    return encode_record(h, block)


def _folder(base: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a qualified folder; one that pyarrow has no driver for is an error here, before anything is written elsewhere."""
    uri = re.sub(r"^file:/+", "file:///", base)
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri))


def _put(base: str, name: str, content: bytes) -> str:
    fs, path = _folder(base)
    temporary = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}.tmp"
    with fs.open_output_stream(temporary) as f:
        f.write(content)
    fs.move(temporary, f"{path}/{name}")
    return f"{path}/{name}"


def _written(base: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = count = 0

        def flushed() -> pa.RecordBatch:
            nonlocal records, held, count
            name = f"part-{TaskContext.get().partitionId():06d}-{count:04d}.warc.zst"
            content = encode_archive(records)
            row = pa.RecordBatch.from_pydict({"path": [_put(base, name, content)], "records": [len(records)], "bytes": [len(content)]})
            records, held, count = [], 0, count + 1
            return row

        for b in batches:
            for page, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html.as_py() or "").encode()
                records.append(page_record(page.as_py(), url.as_py(), payload, digest_value(payload), refers.as_py(), date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield flushed()
        if records:
            yield flushed()

    return run


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = 1000,
    archive_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> tuple[str, DataFrame]:
    """(folder, manifest): writes one record per row; an archive holds about ``archive_bytes`` before compression.

    Digests with more than one payload are found by a sum on the map side; the
    join back is on the digest and may be split by AQE where one is common.
    """
    spark = pages.sparkSession
    short_batches(spark)
    # a folder without a scheme is on the cluster's default file system, not on an executor's disk
    base = qualified(spark, fresh_path(spark, "warc"))
    fs, path = _folder(base)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    tops = (
        rows.filter(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and top is not null").select(F.col("digest").alias("of"), "top")
    )
    rows = rows.join(materialize(tops, "tops"), F.col("digest") == F.col("of"), "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
    manifest = rows.select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", "html").mapInArrow(
        _written(base, archive_bytes, date), "path string, records long, bytes long"
    )
    return base, materialize(manifest, "manifest")


def _page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _read(strict: bool, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                rows = []
                for r in read_archive(content.as_py()):
                    if isinstance(r, WarcError):
                        if strict:
                            raise WarcError(f"{path.as_py()}: {r}")
                        rows.append((None, None, None, None, None, None, None, str(r)))
                        continue
                    h = r.headers
                    full = h["warc-type"] != "revisit"
                    rows.append((
                        _page_of(h["warc-record-id"]), h["warc-type"], h.get("warc-target-uri"), _page_of(h.get("warc-refers-to")),
                        sha1(r.payload).hexdigest() if full else digest_hex(h["warc-payload-digest"]),
                        len(r.payload) if full else int(r.http["content-length"]), r.payload if full and with_payload else None, None,
                    ))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
                names = ["page_id", "record_type", "url", "refers_to", "payload_digest", "payload_bytes", "payload", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return run


def read_archives(spark: SparkSession, folder: str, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """(page_id, record_type, url, refers_to, payload_digest, payload_bytes, payload, error), one row per record, from any store Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(
        _read(strict, with_payload),
        "page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string",
    )
