"""Content-addressed WARC archive: each payload is stored once under its digest, the exact record headers apart from it.

An archive is a folder with three tables:

* ``payloads``: digest (hex SHA-256), payload_bytes and packed (the payload as a zstandard frame), one row per digest;
* ``records``: record_no, page_id, digest and header, the exact bytes of a WARC/1.1 record header with its blank line;
* ``rows``: what came in, packed and numbered once, until the two others are written (see ``write_archive``).

A record is read back by a join on the digest: header, payload and two line breaks are its original bytes. Digests are
verified both ways: rows of equal digest must agree in length and two further checksums before one of them is stored, and
every payload that is read is hashed anew.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorepix.llm.store import shared_folder, small_batches, staged
from shorepix.llm.tokens import lean
from shorepix.operators.lookup import salted_lookup

#: Shorter payloads are never replaced by a reference.
LEAST_BYTES = 100
#: WARC-Date of the records; the pages come without the time they were fetched.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"
#: Bytes of payload that a task hands on at once; one longer payload goes alone.
BATCH_BYTES = 4 << 20


@lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    names = ["digest", "payload_bytes", "check", "packed"]
    for batch in batches:
        rows = [[] for _ in names]
        for value in batch.column(2):
            payload = memoryview(value.as_buffer() or b"")
            for column, x in zip(rows, (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload) << 32 | zlib.adler32(payload), compressor.compress(payload)), strict=True):
                column.append(x)
        check = pa.array(rows[2], pa.uint64()).view(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows[0]), pa.array(rows[1], pa.int64()), check, pa.array(rows[3], pa.binary())],
                                         names=["page_id", "url", *names])


def _record_id(page_id: Column, number: Column) -> Column:
    """A UUID that page id and record number decide."""
    name = F.sha2(F.concat_ws(":", F.lit("page"), page_id.cast("string"), number.cast("string")).cast("binary"), 256)
    parts = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("5"), F.substring(name, 14, 3)),
             F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(date: str) -> Column:
    """The header lines of a record, each closed by a line break, then an empty line. Fields without a value are left out."""
    first = F.col("record_type") == "response"
    lines = [("WARC-Type", F.col("record_type")), ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("record_no"))),
             ("WARC-Date", F.lit(date)),
             # A line break or blank in an address would end the header line or the field.
             ("WARC-Target-URI", F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(""))),
             ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
             ("X-Page-Id", F.col("page_id").cast("string")), ("X-Payload-Length", F.col("payload_bytes").cast("string")),
             ("WARC-Profile", F.when(~first, PROFILE)),
             ("WARC-Refers-To", F.when(~first, _record_id(F.col("kept_page"), F.col("kept_no")))),
             ("X-Refers-To-Page", F.when(~first, F.col("kept_page").cast("string"))),
             ("Content-Type", F.lit("text/html; charset=utf-8")),
             ("Content-Length", F.when(first, F.col("payload_bytes")).otherwise(0).cast("string"))]
    text = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit("")) for name, value in lines]
    return F.concat(F.lit(f"WARC/1.1{BREAK}"), *text, F.lit(BREAK)).cast("binary")


def write_archive(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, date: str = DATE) -> str:
    """Write the archive of ``pages`` (page_id, url, html) below ``folder``; returns the folder.

    One record per row. The payload is the html in UTF-8, none for a null. Of rows with equal payloads of at least
    ``least_bytes`` bytes the one with the smallest page_id is the response (of repeated rows one of them; null ids come
    last) and the others revisit it; every shorter payload is a response of its own, stored once all the same. Other
    columns are ignored; an empty table gives an archive without records.

    Rows are packed, hashed and numbered in one pass and written, so that all later steps see the same rows. Groups of equal
    payloads are combined before the shuffle, and rows find their group by a lookup that spreads hot digests.
    """
    spark = pages.sparkSession
    folder = (folder or shared_folder(spark)).rstrip("/")
    rows = staged(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
                  .mapInArrow(_packed, "page_id long, url string, digest string, payload_bytes long, check long, packed binary")
                  .withColumn("record_no", F.monotonically_increasing_id()))
    meant = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_no")
    same = (F.col("least") == F.col("most")) & (F.col("shortest") == F.col("longest"))
    groups = staged(rows.groupBy("digest")
                    .agg(F.min(meant).alias("kept"), F.min("check").alias("least"), F.max("check").alias("most"),
                         F.min("payload_bytes").alias("shortest"), F.max("payload_bytes").alias("longest"), F.count("*").alias("__n"))
                    .select("digest", "__n", F.when(same, F.col("kept.page_id")).otherwise(F.raise_error(F.concat(F.lit("different payloads have digest "), F.col("digest"))).cast("long")).alias("kept_page"),
                            F.col("kept.record_no").alias("kept_no")))
    kept = groups.select("digest", F.col("kept_no").alias("record_no"))
    with small_batches(spark):
        (rows.select("digest", "record_no", "payload_bytes", "packed").join(kept, ["digest", "record_no"], "left_semi")
         .select("digest", "payload_bytes", "packed").write.parquet(f"{folder}/payloads"))
    named = salted_lookup(rows.drop("packed", "check"), groups.select("digest", "kept_page", "kept_no"), ["digest"], counts=groups.select("digest", "__n"))
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("record_no") != F.col("kept_no"))
    (named.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
     .select("record_no", "page_id", "digest", _header(date).alias("header")).write.parquet(f"{folder}/records"))
    return folder


def header_field(name: str, header: Column) -> Column:
    """The value of a header line, null without it."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_no, header, payload), with every payload checked against the digest of its header."""
    import zstandard

    decompressor, digest, payload = zstandard.ZstdDecompressor(), None, b""
    for batch in batches:
        numbers, headers, payloads, held = [], [], [], 0
        for number, header, wanted, packed in zip(*(batch.column(k) for k in range(4)), strict=True):
            wanted = wanted.as_py()
            if wanted != digest:  # equal payloads often follow each other
                payload = decompressor.decompress(packed.as_buffer())
                digest = hashlib.sha256(payload).hexdigest()
                if digest != wanted:
                    raise ValueError(f"the payload stored as {wanted} is damaged")
            numbers.append(number)
            headers.append(header)
            payloads.append(payload)
            held += len(payload)
            if held >= BATCH_BYTES:
                yield _records(numbers, headers, payloads)
                numbers, headers, payloads, held = [], [], [], 0
        if numbers:
            yield _records(numbers, headers, payloads)


def _records(numbers: list, headers: list, payloads: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in numbers], pa.int64()), pa.array([x.as_py() for x in headers], pa.binary()),
                                       pa.array(payloads, pa.binary())], names=["record_no", "header", "payload"])


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """record_no, header and payload of every record: the exact header bytes and the whole payload, of revisits too.

    Headers meet the stored payloads in a join on the digest that spreads hot digests. A payload that does not have its digest
    raises, as does a header whose payload is missing.
    """
    payloads = spark.read.schema("digest string, payload_bytes long, packed binary").parquet(f"{folder}/payloads")
    records = spark.read.schema("record_no long, page_id long, digest string, header binary").parquet(f"{folder}/records")
    found = salted_lookup(records.select("record_no", "header", "digest"), payloads.select("digest", "packed"), ["digest"], how="left")
    there = F.when(F.col("packed").isNull(), F.raise_error(F.concat(F.lit("no payload is stored as "), F.col("digest"))).cast("binary")).otherwise(F.col("packed"))
    return found.select("record_no", "header", "digest", there.alias("packed")).mapInArrow(lean(_restored), "record_no long, header binary, payload binary")


def record_facts(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that were read: type and ids from the
    header, size and digest from the payload itself."""
    field = lambda name: header_field(name, F.col("header"))
    return records.select(field("X-Page-Id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                          F.sha2("payload", 256).alias("payload_digest"), field("WARC-Type").alias("record_type"),
                          field("X-Refers-To-Page").cast("long").alias("refers_to"))


def _block(header: bytes, payload: bytes) -> bytes:
    """The bytes of one record in a WARC file; a revisit carries no payload."""
    body = b"" if b"\r\nWARC-Type: revisit\r\n" in header else payload
    return header + body + b"\r\n\r\n"


def export_warc(spark: SparkSession, folder: str, target: str, parts: int | None = None) -> DataFrame:
    """Write the records as WARC files, one gzip member per record, below ``target``; returns path and n_records of each file.

    A task writes under a name of its own attempt and only the attempt that succeeds is named, so lost tasks leave nothing
    but an unnamed file.
    """
    from shorepix.llm.token_files import _filesystem

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(target)
        system.create_dir(root, recursive=True)
        name, out, written = f"records-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = out or system.open_output_stream(f"{root}/{name}", compression=None)
            for header, payload in zip(batch.column(1), batch.column(2), strict=True):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(_block(header.as_py(), payload.as_py())) + packer.flush())
                written += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{target.rstrip('/')}/{name}"], "n_records": [written]})

    records = read_archive(spark, folder)
    if parts:
        records = records.repartition(parts, "record_no")
    return staged(records.mapInArrow(lean(write), "path string, n_records long"))


def read_warc(files: DataFrame) -> DataFrame:
    """header and body (bytes) of every record in the files that the ``path`` column names; files are read as streams."""
    from shorepix.llm.token_files import _filesystem

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _filesystem(path)
                with system.open_input_stream(name, compression="gzip") as stream:
                    for header, body in parse_records(stream):
                        yield pa.RecordBatch.from_arrays([pa.array([header], pa.binary()), pa.array([body], pa.binary())], names=["header", "body"])

    return files.select("path").mapInArrow(lean(read), "header binary, body binary")


def parse_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(header, body) of each record of a plain WARC stream; a record that breaks off raises."""
    held = b""

    def more(size: int) -> bool:
        nonlocal held
        piece = stream.read(size)
        held += piece
        return bool(piece)

    while held or more(1 << 20):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more(1 << 20):
                raise ValueError("the file ends inside a record header")
        header = held[:end + 4]
        length = next((int(line[15:]) for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
        if length is None or not header.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        while len(held) < end + 4 + length + 4:
            if not more(max(1 << 20, end + 8 + length - len(held))):
                raise ValueError("the file ends inside a record")
        yield header, held[end + 4:end + 4 + length]
        held = held[end + 4 + length + 4:]
