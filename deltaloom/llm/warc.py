"""WARC archives: writing records, and normalising monolithic gzip files to one gzip member a record.

``write_monolithic`` writes records as whole-file gzip streams.  ``normalise`` inflates each such
stream once, from front to end, writes every record as a gzip member of its own, and writes a sidecar
table with the offset and length of each member, by which ``read_records`` inflates single records.
Files are read and written by Spark, so they can be in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.storage import HOT_KEYS, written

#: Bytes of records that one archive holds, about.
ARCHIVE_BYTES = 32 << 20
LEVEL = 4
#: At most so many rows are broadcast; more are joined by a shuffle.
SMALL = 500_000
#: A member's header with one extra field, ``sl``, of 8 bytes: the member's and the record's length.
_HEAD = struct.Struct("<2sBBIBBH2sHII")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no block, only the digest and length of the payload it stands for."""
    name = "null" if page_id is None else str(page_id)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[:end].decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    n = int(fields["content-length"])
    return fields, raw[end + 4 : end + 4 + n]


def split_records(stream: bytes) -> Iterator[bytes]:
    """The records of an inflated archive."""
    at = 0
    while at < len(stream):
        head = stream.index(b"\r\n\r\n", at)
        n = int(re.search(rb"\r\ncontent-length: *(\d+)", stream[at:head] + b"\r\n", re.I)[1])
        end = head + 4 + n + 4
        yield stream[at:end]
        at = end


def inflate(content: bytes) -> bytes:
    """A gzip file of one or more members, inflated in one pass."""
    out = []
    while content:
        z = zlib.decompressobj(31)
        out += [z.decompress(content), z.flush()]
        content = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def member(raw: bytes) -> bytes:
    """A record as a gzip member whose extra field ``sl`` gives its own and the record's length."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = _HEAD.size + len(body) + 8
    return _HEAD.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def payloads(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """page_id, url, html (null: empty), its SHA-1 in hex, and its length."""
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("html"))
    return rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))


def originals(keys: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(sha1, refers_to, n): for each payload that rows of several ids have, the largest id and the number of rows."""
    grouped = keys.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1")
    latest = grouped.agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("n"), F.count("page_id").alias("named"))
    return latest.where("least < refers_to OR (named > 0 AND named < n)").select("sha1", "refers_to", "n")


def dealt(rows: DataFrame, latest: DataFrame, n_rows: int, files: int) -> DataFrame:
    """The rows with refers_to, dealt to files of like size in one shuffle.

    Where ``latest`` is small it is broadcast.  Otherwise only payloads of very many rows are, at
    most ``HOT_KEYS`` of them, whose rows are dealt by their ids; other rows meet theirs in the file
    of their digest.
    """
    if latest.count() <= SMALL:
        return rows.repartition(files, "page_id", "sha1").join(F.broadcast(latest.drop("n")), "sha1", "left")
    is_hot = F.col("n") > max(1000, n_rows // HOT_KEYS)
    hot = latest.where(is_hot).select("sha1", F.col("refers_to").alias("hot_refers_to"), F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id"), F.lit(files))).otherwise(0)
    salted = rows.join(F.broadcast(hot), "sha1", "left").withColumn("salt", salt).repartition(files, "sha1", "salt")
    few = latest.where(~is_hot).select("sha1", F.lit(0).cast("long").alias("salt"), "refers_to").repartition(files, "sha1", "salt")
    return salted.join(few, ["sha1", "salt"], "left").withColumn("refers_to", F.coalesce("hot_refers_to", "refers_to"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, sha1, refers_to) to records, without their last byte, which the writer adds."""
    for batch in batches:
        out = []
        for page_id, url, html, sha1, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
            payload = html.encode()
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            kind = "response" if refers is None else "revisit"
            out.append(record(kind, page_id, url, digest, payload if refers is None else b"", len(payload), refers)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_monolithic(pages: DataFrame, path: str, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> None:
    """Write a record for each row to whole-file gzip streams; rows with equal payloads revisit the one of largest id.

    Which rows revisit is found on digests alone; payloads are shuffled once, to files of like size.
    """
    rows = payloads(pages, id_column, url_column, payload_column)
    keys = written(rows.select("page_id", "sha1", "payload_bytes"), "digests")
    total = keys.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    files = max(1, (total[0] + 400 * total[1]) // ARCHIVE_BYTES + 1)
    found = dealt(rows, written(originals(keys, least_bytes), "originals"), total[1], files)
    again = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    ready = found.select("page_id", "url", "html", "sha1", again.alias("refers_to"))
    ready.mapInArrow(_records, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


def run(members: list[bytes]) -> bytes:
    """Members end to end without their last byte, which is 0 and is written as the end of a line.

    A member ends with the upper byte of its record's length; after a record of 16 MB or more an
    empty member follows.
    """
    raw = b"".join(members)
    return (raw + member(b"") if raw[-1] else raw)[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for raw in split_records(inflate(content.as_buffer().to_pybytes())):
                held.append(member(raw))
                size += len(held[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([run(held)], pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([run(held)], pa.binary())], names=["value"])


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_buffer()
            view = memoryview(raw)
            at, rows = 0, []
            while at < len(view):
                size, n = _HEAD.unpack_from(view, at)[-2:]
                if n:
                    rows.append((at, size, n))
                at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.rpartition("/")[2]] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], names=["archive", "at", "length", "record_bytes"]
            )


def _number(name: str) -> int | None:
    value = name.rpartition(":")[2].rstrip(">")
    return None if value == "null" else int(value)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, members in zip(batch.column(0), batch.column(1)):
            view = memoryview(content.as_buffer())
            rows = []
            for x in members.as_py():
                fields, block = parse(zlib.decompress(view[x["at"] : x["at"] + x["length"]], 31))
                digest, n = fields["warc-payload-digest"].partition(":")[2], int(fields["x-payload-length"])
                if fields["warc-type"] == "response" and (sha1_base32(block), len(block)) != (digest, n):
                    raise ValueError(f"record {fields['warc-record-id']} does not have the payload of its header")
                name, refers = fields["warc-record-id"], fields.get("warc-refers-to")
                rows.append((_number(name), n, digest, fields["warc-type"], _number(refers) if refers else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def normalise(spark: SparkSession, source: str, target: str, index: str) -> None:
    """Rewrite the archives of a folder with one gzip member a record, and write the members' offsets.

    Each file is inflated once; its records go to one new file, whose number is that of the task.
    The index has archive (file name), at (offset), length and record_bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source)
    # the writer ends each run of members with the zero byte that ``run`` leaves to it
    files.select("content").mapInArrow(_members, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(target)
    made = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("path", "content")
    made.mapInArrow(_offsets, "archive string, at long, length long, record_bytes long").write.parquet(index)


def read_records(spark: SparkSession, target: str, index: str) -> DataFrame:
    """Rows page_id, payload_bytes, payload_digest, record_type, refers_to from normalised archives, by their index.

    The digest and length of a response are taken from its payload and held against its header.
    """
    where = spark.read.schema("archive string, at long, length long, record_bytes long").parquet(index)
    small = where.count() <= SMALL
    where = where.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("members"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.join(F.broadcast(where) if small else where, "archive").select("content", "members").mapInArrow(_read, schema)


def archived(pages: DataFrame, folder: str, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write the pages to monolithic archives in ``folder``, normalise them, and read the records back.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is
    the response and the others revisit it; all other rows are responses.

    Defined results: a null payload is empty, a null URL an empty one; a null page_id is smaller than
    any; rows of null id alone, and repeated rows of the largest id, are each responses; an empty
    table gives an empty table; extra columns are ignored.
    """
    spark = pages.sparkSession
    write_monolithic(pages, f"{folder}/monolithic", least_bytes, id_column, url_column, payload_column)
    normalise(spark, f"{folder}/monolithic", f"{folder}/archives", f"{folder}/index")
    return read_records(spark, f"{folder}/archives", f"{folder}/index")
