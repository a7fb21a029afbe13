"""WARC archives: writing, normalising monolithic gzip files, and reading back.

``write_archives`` lets Spark's text writer make ordinary ``.gz`` files, each one gzip stream over all
of its records. ``normalise`` inflates each such stream once, from front to back, and rewrites every
record as a gzip member of its own. ``write_index`` reads the members and leaves a sidecar table with
the file, offset and length of every record, from which ``fetch`` opens single records. All files go
through Spark's readers and writers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted
from sluiceway.sources import balanced, lineage_cut

RECORDS_PER_FILE = 20_000
ROWS_PER_BATCH = 4096
CHUNK = 1 << 20
LEVEL = 6
_DATE = "2024-01-01T00:00:00Z"  # a fixed crawl date keeps archives reproducible
_PAGE = "urn:page:"

# The text writer ends every line with a separator. For records it is the end of a WARC record; for
# members it is an empty gzip member, so that the file stays a plain sequence of members.
_RECORD_END = "\r\n\r\n"


def _member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_EMPTY_MEMBER = _member(b"")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes, without padding.

    40 bits are 10 hex digits or 8 digits to the base 32, whose alphabet is then exchanged.
    """
    sha = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(keyed: DataFrame, least_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows that repeat the payload of a row with a larger id.

    Only ids and digests move. A hot digest is one row per task before the shuffle; its rows meet the
    group's row in a join that adaptive execution can split.
    """
    narrow = lineage_cut(keyed.filter(F.col("size") >= least_bytes).select("id", "digest"))
    groups = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
    groups = lineage_cut(groups.filter("n > 1 and refers_to is not null").drop("n"))
    return (
        narrow.join(groups, "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to")))
        .select("id", "digest", "refers_to").distinct()
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0,
                   per_file: int = RECORDS_PER_FILE) -> str:
    """One record per row, in gzip files of at most ``per_file`` records.

    Files are bounded by bytes as well: records are dealt out by size, so that a file inflates to about
    the session's advisory partition size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) of
    shuffled bytes, or to its one record if that is larger.
    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest id are
    responses, the others revisits without payload. Null payloads are empty; null ids lose against
    all others, and a group of null ids alone is all responses. White space in addresses is encoded.
    """
    payload = F.coalesce(quoted(html_col), F.lit(""))
    keyed = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).alias("url"),
                         payload.alias("payload")).withColumns({
        "digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload")})
    again = lineage_cut(revisits(keyed, least_bytes)).select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = keyed.join(
        again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    )
    repeat = F.col("refers_to").isNotNull()

    def name(c: str) -> Column:
        return F.concat(F.lit(f"<{_PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def header(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{key}: "), value)

    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(repeat, "revisit").otherwise("response"),
        header("WARC-Record-ID", name("id")), header("WARC-Date", F.lit(_DATE)),
        F.when(F.col("url").isNotNull(), header(
            "WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))).otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("X-Payload-Length", F.col("size").cast("string")),
        F.when(repeat, F.concat(header("WARC-Refers-To", name("refers_to")), header(
            "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        ))).otherwise(""),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(repeat, 0).otherwise(F.col("size")).cast("string")),
        F.lit(_RECORD_END), F.when(repeat, "").otherwise(F.col("payload")),
    )
    (balanced(rows.select(record.alias("value"))).write.option("lineSep", _RECORD_END)
     .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))
    return path


def _records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records, end mark included, from the inflated stream; only one is held at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                need = head + 4 + int(_field(held[:head], b"content-length") or 0) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def _field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode()
    return None


def _inflated(content: memoryview) -> Iterator[bytes]:
    unpacker = zlib.decompressobj(31)
    for at in range(0, len(content), CHUNK):
        data = content[at : at + CHUNK]
        while data:
            yield unpacker.decompress(data, CHUNK)
            data = unpacker.unconsumed_tail
            if unpacker.eof:  # also read what other tools have already cut into members
                data = unpacker.unused_data + data
                unpacker = zlib.decompressobj(31)


def _to_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for record in _records(_inflated(memoryview(content.as_buffer()))):
                held.append(_member(record))
                size += len(held[-1])
                if size > 4 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])


def normalise(spark: SparkSession, source: str, target: str) -> str:
    """Rewrites monolithic archives so that every record is a gzip member of its own."""
    files = spark.read.format("binaryFile").load(source).select("content")
    members = files.mapInArrow(_to_members, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
     .text(target))
    return target


_INDEX = (
    "file string, offset long, length long, id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string"
)


def _page_id(name: str | None) -> int | None:
    number = name.strip("<>").removeprefix(_PAGE) if name else ""
    return int(number) if number else None


def parse(record: bytes) -> tuple:
    """(id, url, record type, refers to, payload bytes, payload digest); payloads are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    payload = rest[: int(_field(head, b"content-length") or 0)]
    kind = _field(head, b"warc-type")
    digest = (_field(head, b"warc-payload-digest") or "").removeprefix("sha1:")
    size = len(payload)
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"payload of {_field(head, b'warc-record-id')} is damaged")
    else:
        size = int(_field(head, b"x-payload-length") or 0)
    return (_page_id(_field(head, b"warc-record-id")), _field(head, b"warc-target-uri"), kind,
            _page_id(_field(head, b"warc-refers-to")), size, digest)


def _members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of every member that is not empty."""
    at = 0
    while at < len(content):
        unpacker, data, end = zlib.decompressobj(31), bytearray(), at
        while not unpacker.eof:
            data += unpacker.decompress(content[end : end + CHUNK])
            end += CHUNK
        length = min(end, len(content)) - len(unpacker.unused_data) - at
        if data:
            yield at, length, bytes(data)
        at += length


def _to_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.string() if "string" in x else pa.int64() for x in _INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = ((path, at, length, *parse(data))
                    for at, length, data in _members(memoryview(content.as_buffer())))
            for some in batched(rows, ROWS_PER_BATCH):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def write_index(spark: SparkSession, archives: str, path: str) -> DataFrame:
    """Reads every record back and writes the sidecar table, one row per record."""
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    files.mapInArrow(_to_index, _INDEX).write.parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def fetch(spark: SparkSession, archives: str, index: DataFrame) -> DataFrame:
    """(id, payload) of the records of some index rows, each inflated on its own."""
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("parts"))
    files = spark.read.format("binaryFile").load(archives).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, parts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                records = [zlib.decompress(data[p["offset"] : p["offset"] + p["length"]], 31)
                           for p in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([parse(r)[0] for r in records], pa.int64()),
                    pa.array([r.partition(b"\r\n\r\n")[2][:-4] for r in records], pa.binary()),
                ], ["id", "payload"])

    both = files.join(wanted, files.path == wanted.file).select("content", "parts")
    return both.mapInArrow(run, "id long, payload binary")
