"""WARC archives written and read by Spark tasks through an index.

Writing gives archives of gzip members, one record each, and an index with file, offset, length, URL and digest per
record. Reading starts from (a selection of) the index: its byte ranges are sorted, neighbouring ranges are
fetched in one read, and only the members asked for are unpacked. Files are reached through Arrow's file
systems, so tasks on all executors read and write the shared store by URI.
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

from armwave.llm.graph import stored
from armwave.session import scratch_path

REVISIT_FROM = 1000          # bytes of payload from which equal payloads are written once
ARCHIVE_BYTES = 256 << 20    # a task starts a new archive beyond this size
GAP_BYTES = 64 << 10         # ranges nearer than this are fetched together
FETCH_BYTES = 8 << 20        # ... up to this size
TASK_BYTES = 16 << 20       # packed bytes a task reads
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark writes it (``file:/x``, ``s3a://b/x``, ``hdfs://h/x``)."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    return fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    return "".join(ch for ch in value if ch >= " ")


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the length of the payload it stands for, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(header fields in lower case, payload, length of the full payload) of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields, payload, size


def _hex(digest: str) -> str:
    return base64.b32decode(digest.partition(":")[2]).hex()


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives under ``path`` with one record per row, and their index (written beside them, returned).

    Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one with the largest key is the response (a
    null key only if there is no other; of rows that repeat the key, one), the others revisit it. A null payload
    is empty, a null URL has no URI line, control characters in a URL go. Rows are staged first, so that a task that runs again sees the same rows; files of
    attempts that failed are not in the index. Payloads are not grouped: a digest that many rows share is
    reduced to its largest key before anything is joined.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary") if dict(pages.dtypes)[payload] == "string" else F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = stored(pages.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"))
                  .select("*", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("digest")), "pages", "zstd")
    best = (rows.where(F.col("n") >= REVISIT_FROM).groupBy("digest").agg(F.max(F.struct("key", "uid")).alias("best"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").select(F.col("digest").alias("match"), F.col("best.key").alias("best_key"), F.col("best.uid").alias("best_uid")))
    match = F.when(F.col("n") >= REVISIT_FROM, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("uid").cast("string")))
    work = rows.withColumn("match", match).join(best, "match", "left")
    name = lambda k, u: F.concat(F.lit("urn:page:"), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit(":"), F.col(u).cast("string"))
    revisit = F.col("best_uid").isNotNull() & (F.col("best_uid") != F.col("uid"))
    work = work.select(F.when(revisit, "revisit").otherwise("response").alias("kind"), name("key", "uid").alias("id"), "url",
                       F.when(~revisit, F.col("body")).alias("body"), "n", "digest", F.when(revisit, name("best_key", "best_uid")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
        part, file, name, offset = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in batches:
                out = []
                for row in range(batch.num_rows):
                    kind, record_id, url, body, n, digest, refers_to = (batch.column(i)[row].as_py() for i in range(7))
                    url = None if url is None else _clean(url)
                    if file is None or offset >= ARCHIVE_BYTES:
                        if file is not None:
                            file.close()
                        name, offset = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        file = store.open_output_stream(f"{folder}/{name}", compression=None)
                    member = record_bytes(kind, record_id, url, body, n, digest, refers_to)
                    file.write(member)
                    out.append((f"{path}/{name}", offset, len(member), url, digest, kind, record_id))
                    offset += len(member)
                names = ["file", "offset", "length", "url", "digest", "record_type", "record_id"]
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        finally:
            if file is not None:
                file.close()

    work.mapInArrow(run, INDEX).write.parquet(f"{path}/index.parquet")
    return pages.sparkSession.read.parquet(f"{path}/index.parquet")


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all ``*.warc.gz`` archives under a folder that have none: one task reads one archive from start to end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, name = open_store(uri)
                out, offset = [], 0
                with store.open_input_stream(name, compression=None) as f:
                    left = f.read(FETCH_BYTES)
                    while left:
                        unpacker, used, data = zlib.decompressobj(31), 0, []
                        while not unpacker.eof:
                            if not left:
                                left = f.read(FETCH_BYTES)
                                if not left:
                                    raise ValueError(f"{uri}: the record at {offset} is cut off")
                            used += len(left)
                            data.append(unpacker.decompress(left))
                            left = unpacker.unused_data
                        used -= len(left)
                        fields, _, _ = parse_record(b"".join(data))
                        if "warc-payload-digest" in fields:
                            out.append((uri, offset, used, fields.get("warc-target-uri"), _hex(fields["warc-payload-digest"]), fields["warc-type"], fields["warc-record-id"][1:-1]))
                        offset += used
                        left = left or f.read(FETCH_BYTES)
                names = ["file", "offset", "length", "url", "digest", "record_type", "record_id"]
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return files.repartition(F.col("path")).mapInArrow(run, INDEX)


def read(index: DataFrame) -> DataFrame:
    """(record_id, refers_to, record_type, url, digest, payload_bytes, payload) of the records of an index or a selection of it.

    ``payload_bytes`` is the length of the full payload, for revisits too; their ``payload`` is null. A payload that
    does not match its digest is an error.
    """
    shape = "record_id string, refers_to string, record_type string, url string, digest string, payload_bytes long, payload binary"
    names = [x.split()[0] for x in shape.split(", ")]
    kinds = [*[pa.string()] * 5, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        make = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        try:
            for batch in batches:
                ranges = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
                at, out, held = 0, [], 0
                while at < len(ranges):
                    name, begin, size = ranges[at]
                    last, end = at + 1, begin + size
                    while last < len(ranges) and ranges[last][0] == name and ranges[last][1] - end <= GAP_BYTES and ranges[last][1] + ranges[last][2] - begin <= FETCH_BYTES:
                        end = ranges[last][1] + ranges[last][2]
                        last += 1
                    if name != uri:
                        if file is not None:
                            file.close()
                        store, local = open_store(name)
                        uri, file = name, store.open_input_file(local)
                    data = file.read_at(end - begin, begin)
                    for _, offset, length in ranges[at:last]:
                        fields, payload, full = parse_record(zlib.decompress(data[offset - begin: offset - begin + length], 31))
                        digest, kind = _hex(fields["warc-payload-digest"]), fields["warc-type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload at {offset} does not match its digest")
                        refers = fields.get("warc-refers-to")
                        out.append((fields["warc-record-id"][1:-1], refers and refers[1:-1], kind, fields.get("warc-target-uri"), digest, full, payload if kind == "response" else None))
                        held += len(payload)
                        if held >= BATCH_BYTES:
                            yield make(out)
                            out, held = [], 0
                    at = last
                if out:
                    yield make(out)
        finally:
            if file is not None:
                file.close()

    # Rows of the index are short, so the number of tasks follows the bytes they point to.
    tasks = max(1, -(-int(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    ranges = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(run, shape)


def page_of(record_id: str):
    """The page key in a record id written by :func:`write` (null for an empty one)."""
    part = F.split_part(F.col(record_id), F.lit(":"), F.lit(3))
    return F.when(part != "", part.cast("long"))


def written_and_read(pages: DataFrame) -> DataFrame:
    """All pages through archives in the shared folder and back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc")))
