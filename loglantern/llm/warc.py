"""Operator 4: WARC archives compressed with Zstandard, written and read back.

An archive begins with a skippable frame that holds the dictionary; every record is one
frame of its own. The archives are part files of Spark's own text writer, so its commit
protocol holds and any file system will do: a row is one frame, and what the writer puts
after each row is an empty skippable frame. The reader takes the dictionary from the
leading frame, walks from frame to frame by their block headers, decodes one frame per
record, and checks version, header lines, lengths and digests.

Of records with equal payloads (SHA-1) of at least ``min_revisit_bytes`` the one with the
smallest page_id is a response, the others revisit it and carry no payload. Digests are
compared in a narrow table; the pages are shuffled once, evenly by page_id, into archives
of about ``ARCHIVE_BYTES`` of payload. The dictionary is trained on the first bytes of at
most ``SAMPLE_PAGES`` pages picked by hash.

Defined cases: a null html is an empty payload; a null url gives the page's own URN; null
page_ids come last and are read back as null; repeated rows of the smallest page_id are all
responses; no rows give no archive; other columns do not matter. A broken archive fails.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, saved, table
from loglantern.sources.shared import new_dir

ARCHIVE_BYTES = 32 << 20
SAMPLE_PAGES = 500
SAMPLE_BYTES = 8192  # of each sampled page, for the dictionary alone
DICTIONARY_BYTES = 65536
LEVEL = 3
MIN_REVISIT_BYTES = 0

#: Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"


class BrokenArchive(ValueError):
    """An archive or record that is not what its headers say."""


# --- records ------------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    if urn is None:
        return None
    if not (urn.startswith("<urn:x-page:") and urn.endswith(">")):
        raise BrokenArchive(f"unknown record id {urn}")
    return None if urn[12:-1] == "none" else int(urn[12:-1])


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def make_record(page_id, url, html: str | None, sha1_hex: str, n_bytes: int, first, response: bool, date: str) -> bytes:
    payload = (html or "").encode() if response else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or _urn(page_id)[1:-1])
    lines = [
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest_text(bytes.fromhex(sha1_hex))}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise BrokenArchive(f"header line without a colon: {name[:60]}")
        fields[name.strip().lower()] = value.strip()
    return fields


def read_record(record: bytes) -> tuple:
    """The columns of ``_RECORD``; raises where record and headers do not agree."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not gap:
        raise BrokenArchive(f"not a record: {version[:20]!r}")
    fields = _fields(lines)
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BrokenArchive(f"{fields['warc-record-id']}: {len(rest) - 4} bytes, not {length}")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    n_bytes = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    algorithm, _, digest = fields["warc-payload-digest"].partition(":")
    kind = fields["warc-type"]
    if kind == "response":
        if algorithm != "sha1" or len(payload) != n_bytes or digest_text(hashlib.sha1(payload).digest()) != digest:
            raise BrokenArchive(f"{fields['warc-record-id']}: payload and digest differ")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise BrokenArchive(f"{fields['warc-record-id']}: not a response nor a revisit")
    return _page_of(fields["warc-record-id"]), kind, fields["warc-target-uri"], digest, n_bytes, _page_of(fields.get("warc-refers-to")), payload


# --- frames -------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    content_size = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content_size
    while True:
        if at + 3 > len(data):
            raise BrokenArchive("a frame is cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * (flags >> 2 & 1)
            if at > len(data):
                raise BrokenArchive("a frame is cut short")
            return at


def read_frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded one by one."""
    import zstandard

    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise BrokenArchive("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + size
            if end > len(data):
                raise BrokenArchive("a frame is cut short")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise BrokenArchive("the dictionary is not in the leading frame")
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8:end])))
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
            try:
                yield decoder.decompress(data[at:end])
            except zstandard.ZstdError as error:
                raise BrokenArchive(str(error)) from error
        else:
            raise BrokenArchive(f"no frame begins with {magic:#x}")
        at = end


# --- tables -------------------------------------------------------------------------


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most ``SAMPLE_PAGES`` pages; empty if they are too few."""
    import zstandard

    total = pages.count()
    if not total:
        return b""
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / (1 << 30)
    start = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")
    rows = pages.where(draw < min(1.0, 2 * SAMPLE_PAGES / total)).select(draw.alias("draw"), start).orderBy("draw", "html").limit(SAMPLE_PAGES).collect()
    samples = [r.html.encode() for r in rows if r.html]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """A record for each row of page_id, url, html in archives under ``path``."""
    pages = pick(pages, "page_id", "url", "html")
    body = F.coalesce("html", F.lit("")).cast("binary")
    sums = saved(pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes")), "warc-sums")
    total = sums.agg(F.sum("n_bytes")).first()[0] or 0
    firsts = sums.groupBy("sha").agg(F.min("page_id").alias("first"))
    plan = sums.dropDuplicates(["page_id", "sha"]).join(firsts, "sha").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "n_bytes", "first")
    archives = 1 + total // ARCHIVE_BYTES
    mine = pages.withColumn("sha", F.sha1(body)).repartition(archives, F.coalesce("page_id", F.lit(-1)))
    plan = plan.repartition(archives, F.coalesce("p", F.lit(-1)))
    joined = mine.join(plan, (F.coalesce("page_id", F.lit(-1)) == F.coalesce("p", F.lit(-1))) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")))
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("n_bytes") < min_revisit_bytes)
    rows = joined.select("page_id", "url", F.when(response, F.col("html")).alias("html"), "sha", "n_bytes", "first", response.alias("response"))
    dictionary = train_dictionary(pages)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        begun = not dictionary
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                frames = [] if begun else [dictionary_frame(dictionary)]
                begun = True
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    frames.append(encoder.compress(make_record(*row, date)))
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = rows.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                records = []
                for record in read_frames(content.as_py()):
                    fields = read_record(record)
                    records.append(fields if with_payload else (*fields[:-1], None))
                    if len(records) == 256:
                        yield _rows(records)
                        records = []
                yield _rows(records)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _RECORD)


def _rows(records: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*records)) if records else [()] * len(kinds)
    names = [x.split()[0] for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SQL = None  # DuckDB has no SHA-1; tests compare with hashlib
