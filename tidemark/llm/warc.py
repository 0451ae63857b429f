"""WARC archives: a writer that turns repeated payloads into revisits, and a reader that splits gzip files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, delete_folder, new_folder

# Fixed values of the formats: a gzip member's first bytes, line ends, media types, and the revisit profile.
MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, path string, at bigint, sound boolean"
WRITTEN = "path string, bytes bigint, records bigint"
#: Bytes read at once.
BLOCK = 1 << 20


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds a page_id; a random version 4 UUID for null."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    h = f"{page_id & 0xFFFFFFFFFFFFFFFF:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-000000000000>"


def page_of(rid: str | None) -> int | None:
    """The page_id in a record_id; null if it holds none."""
    m = re.fullmatch(r"<urn:uuid:(\w{8})-(\w{4})-8(\w{3})-8(\w)00-0{12}>", rid or "")
    if not m:
        return None
    v = int("".join(m.groups()), 16)
    return v - (1 << 64) if v >> 63 else v


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member: a response, or with refers_to a revisit that has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), "WARC-Record-ID: " + record_id(page_id), "WARC-Date: " + date, "WARC-Payload-Digest: sha1:" + digest]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Refers-To: " + record_id(refers_to), "WARC-Profile: " + PROFILE]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_headers(raw: bytes) -> dict[str, str] | None:
    """Header fields, names in lower case, of a record's head; null if it isn't one."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d\.\d", lines[0]):
        return None
    found = {}
    for line in lines[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            return None
        found[name.strip().lower()] = value.strip()
    return found if found.get("content-length", "").isdigit() and "warc-type" in found else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        # a task that is tried again writes another file; only the files named in its result count
        name = f"{top}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        total = records = 0
        out = None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                page_id, url, payload, digest, refers_to = row
                out = out or files.open_output_stream(name, compression=None)
                total += out.write(encode_record(page_id, url, payload, digest, refers_to, date))
                records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

    return run


def base32(column: Column) -> Column:
    """Upper-case base32 of a 160-bit value given as 40 hex digits, by table: 20 bits are 5 hex digits or 4 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.conv  # of base 16 to base 32, whose digits are 0-9 and A-V
    parts = [F.lpad(bits(F.substring(column, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", letters)


def plan_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, broadcast_groups: int = 200_000) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to) of pages.

    Of rows with equal payloads of at least least_bytes, those with the largest page_id are responses and the
    others revisits of it. Null html is an empty payload. Rows with a null page_id are always responses that
    nothing refers to; rows that repeat the largest page_id with the same payload are responses too.

    Only digests and ids are grouped. The groups of several rows, one row each, go to the payloads by a broadcast if there
    are at most broadcast_groups of them (some 100 bytes each), so no payload is shuffled. Beyond that payloads meet
    their group by its digest, dealt by a salt of the page_id, so that the copies of one common page are not one task's.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", base32(F.sha1("payload")))
    many = cut(
        rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy(F.col("payload_digest").alias("d"), F.octet_length("payload").alias("n"))
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .where("first < last")
        .drop("first")
    )
    same = (F.col("payload_digest") == F.col("d")) & (F.octet_length("payload") == F.col("n"))
    if many.count() <= broadcast_groups:
        out = rows.join(F.broadcast(many), same, "left")
    else:
        salts = 32
        salted = many.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(salts)), F.lit(0)).cast("int")).join(salted, same & (F.col("salt") == F.col("m_salt")), "left")
    return out.select("page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, **how: object) -> DataFrame:
    """Writes a .warc.gz file for each partition into the folder, a URI that all executors reach: (path, bytes, records) of the files.

    The result is written to the shared folder, so that a lost executor doesn't write files again. Empty
    partitions write no file.
    """
    return cut(plan_records(pages, **how).mapInArrow(_writer(folder), WRITTEN))


class _Member:
    """Decodes one gzip member from a file at an offset, block by block."""

    def __init__(self, source, at: int, size: int):
        self.source, self.pos, self.size = source, at, size
        self.z = zlib.decompressobj(31)

    def read(self, until=None) -> bytes | None:
        """Decoded bytes to the end of the member, or to at least the first `until`; null if it isn't sound."""
        out = bytearray()
        while not self.z.eof and (until is None or until not in out) and self.pos < self.size:
            self.source.seek(self.pos)
            raw = self.source.read(min(BLOCK if until is None else 4096, self.size - self.pos))
            self.pos += len(raw)
            try:
                out += self.z.decompress(raw)
            except zlib.error:
                return None
            if until is not None and not b"WARC/".startswith(bytes(out[:5])):
                return None
        return bytes(out) if self.z.eof or until is not None else None

    @property
    def end(self) -> int:
        return self.pos - len(self.z.unused_data)


def records_in(source, size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records whose members start in [start, stop).

    From `start` the bytes are searched for gzip magic; a candidate counts if it decodes to the head of a
    WARC record. After a record the next one is where its member ends. What isn't a sound record is
    skipped by searching on from the next byte.
    """
    pos, held, held_at = start, b"", start
    while pos < min(stop, size):
        if not held_at <= pos <= held_at + len(held) - len(MAGIC):
            source.seek(pos)
            held, held_at = source.read(min(BLOCK, size - pos)), pos
            if len(held) < len(MAGIC):
                return
        found = held.find(MAGIC, pos - held_at)
        if found < 0:
            pos = held_at + len(held) - len(MAGIC) + 1  # the magic may straddle blocks
            continue
        pos = held_at + found
        if pos >= stop:
            return
        member = _Member(source, pos, size)
        head = member.read(until=CRLF + CRLF)
        fields = parse_headers(head.partition(CRLF + CRLF)[0]) if head and CRLF + CRLF in head else None
        rest = member.read() if fields and not member.z.eof else b""
        if fields and rest is not None and member.z.eof:
            block = (head + rest).partition(CRLF + CRLF)[2][: int(fields["content-length"])]
            if len(block) == int(fields["content-length"]):
                yield pos, fields, block
                pos = member.end
                continue
        pos += 1


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    rows, held = [], 0
    for b in batches:
        for path, folder, size, start, stop in zip(*(b.column(c).to_pylist() for c in ("path", "folder", "bytes", "start", "stop")), strict=True):
            files, _ = fs.FileSystem.from_uri(folder)
            with files.open_input_file(path) as source:
                for at, fields, block in records_in(source, size, start, stop):
                    http, _, payload = block.partition(CRLF + CRLF)
                    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    n, digest, whole = int(length[1]) if length else None, said, fields["warc-type"] == "response"
                    if whole:  # what the payload is, not what the headers say
                        n, digest, sound = len(payload), digest_of(payload), n in (None, len(payload)) and said in (None, digest_of(payload))
                    rows.append((page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"], digest, n, page_of(fields.get("warc-refers-to")), payload if whole else None, path, at, sound if whole else None))
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
    if rows:
        yield batch(rows)


def read(files: DataFrame, folder: str, split_bytes: int = 16 << 20, most_tasks: int = 50_000) -> DataFrame:
    """The records of archives: files has (path, bytes); every file is read in byte ranges of split_bytes.

    A range owns the records that start in it, so each record is read once however files are cut. Ranges are dealt
    evenly to as many tasks as there are ranges, at most most_tasks: a given number of partitions is not merged, as small as the
    rows that name the ranges are. Columns: see RECORDS; payload_bytes and payload_digest of a response are those of the
    payload as read, and sound tells whether the headers agree with them; the payload of a revisit is null, its
    payload_bytes and digest are those of what it revisits, by its headers. Without files the result is empty.
    """
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0]
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "bytes", F.lit(folder).alias("folder"), F.explode(starts).alias("start")).withColumn("stop", F.col("start") + split_bytes)
    return ranges.repartition(max(1, min(int(n or 1), most_tasks))).mapInArrow(_reader, RECORDS)


def read_folder(spark: SparkSession, folder: str, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of every .warc.gz file directly in a folder, listed by the driver."""
    files, top = fs.FileSystem.from_uri(folder)
    found = [(f.path, f.size, 0) for f in files.get_file_info(fs.FileSelector(top)) if f.is_file and f.path.endswith(".warc.gz")]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
    return read(spark.createDataFrame(found, schema), folder, split_bytes)


def round_trip(pages: DataFrame, split_bytes: int = 16 << 20, **how: object) -> DataFrame:
    """What reading says of pages written to archives: the columns of read() but for the payloads, a row for each row of pages.

    The archives are written to a folder of their own in the shared one, read back record by record, and deleted when what was
    read is in the shared folder. Null html is an empty payload; null and repeated page_ids, repeated rows and urls that
    are null stay as they are; payloads of any length are read whole, a record at a time; other columns of pages are left
    out; an empty table gives an empty table.
    """
    folder = new_folder(pages.sparkSession, "warc")
    records = cut(read(write(pages, folder, **how), folder, split_bytes).drop("payload"))
    delete_folder(pages.sparkSession, folder)
    return records
