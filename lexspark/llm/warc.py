"""WARC archives: a deduplicating writer and a splittable reader.

Writing: every record is a gzip member of its own. Of records with equal payloads the one with the largest id is a
response, the others are revisits of it without the payload. Each task writes files of its own name into a shared folder
and returns their names; only the names that Spark committed, kept as a manifest beside them, are read, so what a lost or
repeated task leaves behind is never seen.

Reading: files are cut into byte ranges, one range a task. A task scans its range for gzip magic, takes a candidate as a
member if its first bytes inflate to a WARC header, and then follows member after member; it owns the records that start
inside its range, and reads past the range's end only to finish the last one. A response's length and digest are those
of the payload as read, and `intact` says whether its header states the same.

Defined cases: a null html is an empty payload; a payload of any length is one record, inflated in one task; records of rows repeated whole, id included, are all alike; rows that
share the largest id of a payload are all responses; payloads below `min_revisit_bytes` are never revisits; a null id is
written as an empty id; an empty table writes no file and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import checkpointed, remove_folder, shared_dir, small_side

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: A task reads so many bytes, and more where there would be more tasks than MOST_RANGES.
RANGE_BYTES, MOST_RANGES = 8 << 20, 40_000
FILE_BYTES = 256 << 20
CHUNK_BYTES = 1 << 18
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture

MANIFEST = "path string, records long, bytes long"
RECORDS = "path string, start long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, url string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def _one_line(value: object) -> str:
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, inflated. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    header = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, url),
        "WARC-Target-URI": _one_line(url),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": _one_line(page_id),
    }
    if revisit:
        header |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(refers_to)}
    header["Content-Length"] = str(len(block))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in header.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> dict:
    """A record's header fields by lower-case name, its HTTP header's as http, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")[1:]
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    fields["payload"] = payload
    return fields


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary, never null) and refers_to, the id to revisit; null for responses.

    Only digests and ids are grouped; the digests that occur under several ids come to the pages by broadcast while they
    are few, so that payloads stay where they are, and by a join on the digest beyond.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    key = F.unhex(F.sha2("html", 256))
    light = rows.where(F.length("html") >= min_revisit_bytes).select(key.alias("_repeated"), "page_id")
    largest = light.groupBy("_repeated").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first"))
    repeated = small_side(largest.where(F.col("_first") < F.col("_last")).select("_repeated", "_last"))
    joined = rows.withColumn("_key", key).join(repeated, F.col("_key") == F.col("_repeated"), "left")
    return joined.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id"), F.col("_last") - 1) < F.col("_last"), F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for every row into files under folder, and returns the manifest (path, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4()}.warc.gz"
                    store.create_dir(base, recursive=True)
                    out, count, size = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                member = gzip_member(record(page_id, url, html, digest_of(html), refers_to))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{path}", count, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", count, size))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    manifest = f"{folder}/manifest"
    with_revisits(pages, min_revisit_bytes).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


class _Window:
    """A file read forwards in chunks, with the bytes from `at` on at hand."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""

    def more(self) -> bool:
        begin = self.at + len(self.data)
        got = self.file.read_at(min(CHUNK_BYTES, self.size - begin), begin) if begin < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]


def _is_record(window: _Window, k: int) -> bool:
    """Whether the bytes from k on begin a gzip member that inflates to a WARC header."""
    opener, out, at = zlib.decompressobj(31), b"", k
    try:
        while len(out) < len(VERSION) and not opener.eof:
            if at >= len(window.data) and not window.more():
                return False
            out += opener.decompress(window.data[at : at + 256], 64)
            at += 256
    except zlib.error:
        return False
    return out.startswith(b"WARC/1.")


def _member(window: _Window) -> tuple[bytes, int] | None:
    """The inflated member at the window's start, and its length in the file; None if it's broken or cut off."""
    opener, parts, at = zlib.decompressobj(31), [], 0
    try:
        while not opener.eof:
            if at >= len(window.data) and not window.more():
                return None
            parts.append(opener.decompress(window.data[at:]))
            at = len(window.data)
    except zlib.error:
        return None
    return b"".join(parts), at - len(opener.unused_data)


def records_in(file: pa.NativeFile, size: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(start, inflated record) of every record that starts in [begin, end)."""
    window = _Window(file, begin, size)
    while window.at < end:
        if len(window.data) < len(MAGIC):
            window.more()
        if not window.data.startswith(MAGIC) or not _is_record(window, 0):
            k = window.data.find(MAGIC, 1)
            if k < 0:
                if not window.more():
                    return
                k = max(1, window.data.find(MAGIC, 1)) if MAGIC in window.data[1:] else len(window.data) - len(MAGIC) + 1
            window.skip(max(1, k))
            continue
        found = _member(window)
        if found is None:
            window.skip(1)
            continue
        yield window.at, found[0]
        window.skip(found[1])


def range_size(total: int) -> int:
    """Bytes of a range for archives of so many bytes together."""
    return max(RANGE_BYTES, -(-total // MOST_RANGES))


def read_archives(files: DataFrame, range_bytes: int | None = None, payloads: bool = True) -> DataFrame:
    """One row per record of the files (path, bytes), read range by range; ranges grow with the total unless stated."""
    range_bytes = range_bytes or range_size(files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(range_bytes).cast("long")))
    ranges = files.where(F.col("bytes") > 0).select("path", F.col("bytes").alias("size"), starts.alias("begin"))
    # a stated number of partitions is never coalesced; by range, as a hash would put several into one
    spread = ranges.repartitionByRange(max(1, ranges.count()), "path", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary())
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(name) as file:
                    for start, data in records_in(file, size, begin, min(begin + range_bytes, size)):
                        x = parse_record(data)
                        number = lambda k: int(x[k]) if x.get(k) else None  # noqa: B023, E731
                        stated = (int(x["http"].get("content-length", len(x["payload"]))), x.get("warc-payload-digest", "").removeprefix("sha1:"))
                        # a revisit holds no payload: what its header says is all there is
                        found = stated if x.get("warc-type") == "revisit" else (len(x["payload"]), digest_of(x["payload"]))
                        rows.append((path, start, number("x-page-id"), *found, x.get("warc-type"), number("x-refers-to-page-id"), found == stated, x.get("warc-target-uri"), x["payload"] if payloads else None))
                        held += len(data) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spread.mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages as archives, and reads back what their records say.

    The archives go into the given folder, which the caller owns, or else into a new shared one, which is deleted when
    the records' figures have been read.
    """
    own = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    manifest = write_archives(pages, own, min_revisit_bytes)
    read = read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    if folder:
        return read
    kept = checkpointed(read)
    remove_folder(spark, own)
    return kept
