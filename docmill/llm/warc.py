"""WARC archives as seekable Zstandard bundles: records in independent frames, a footer seek table, a record index.

A bundle is: frames of whole records; a skippable frame that maps record identifiers to (frame, offset in the frame,
length); the seek table of the public seekable format (skippable frame 0x184D2A5E with each frame's compressed and
decompressed size, ended by the count, a descriptor byte and 0x8F92EAB1). Any zstd tool decompresses it to plain WARC.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import by_bytes, fresh, look_up, shuffle_partitions, table, text_of, written

#: Bytes of records that go into a frame, and compressed bytes after which a task begins another bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 30
SKIP_SEEK, SKIP_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from built-in functions: each five hex digits are four base32 digits."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of revisits alone, a row for each (page_id, digest).

    Of equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response. Digests are
    pre-aggregated before the shuffle and hot ones broadcast, so one payload may hold any share of the rows.
    """
    thin = written(pages.select("page_id", F.octet_length("payload").alias("_n"), base32_sha1(F.col("payload")).alias("digest")).where(F.col("_n") >= least_bytes), "digests")
    groups = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_rows")).where("_rows > 1")
    groups = written(groups, "payloads")
    return look_up(thin.select("page_id", "digest"), groups, ["digest"], "inner", "_rows").where("page_id <> refers_to or page_id is null").select("page_id", "digest", "refers_to").distinct()


def record_id(page_id: int | None, digest: str, k: int = 0) -> str:
    """Unique: rows that share page_id and payload are told apart by ``k``."""
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}" + (f":{k}" if k else "")


def record(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None, k: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but tells its digest and size."""
    revisit = refers_to is not None
    clean = "".join(c for c in (url or "") if c.isprintable() and c != " ") or "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest, k)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {REVISIT}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    body = data[end + 4 : stop]
    return head, body[body.index(b"\r\n\r\n") + 4 :], stop + 4


class BundleWriter:
    """Writes records to a bundle; holds one frame and the index."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_n, self.frames, self.index, self.written = [], 0, [], [], 0

    def add(self, name: str, data: bytes) -> None:
        if self.held and self.held_n + len(data) > self.frame_bytes:
            self._frame()
        self.index.append([name, len(self.frames), self.held_n, len(data)])
        self.held.append(data)
        self.held_n += len(data)

    def _frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.sink.write(packed)
        self.written += len(packed)
        self.frames.append((len(packed), self.held_n))
        self.held, self.held_n = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.zstd.compress(json.dumps(self.index).encode())
        self.sink.write(struct.pack("<II", SKIP_INDEX, len(index) + 4) + index + struct.pack("<I", len(index)))
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class BundleReader:
    """Seeks to any record through the footer, or streams frame by frame."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        raw = source.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for c, d in struct.iter_unpack("<II", raw):
            self.frames.append((at, c, d))
            at += c
        self.index_end = size - 9 - 8 * n - 8
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, c, d = self.frames[k]
        return self.zstd.decompress(self.source.read_at(c, at), max_output_size=d)

    def index(self) -> list[list]:
        (n,) = struct.unpack("<I", self.source.read_at(4, self.index_end - 4))
        return json.loads(self.zstd.decompress(self.source.read_at(n, self.index_end - 4 - n)))

    def record(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame)[offset : offset + length], 0)[:2]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                head, payload, at = parse(data, at)
                yield head, payload


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> list[str]:
    """Write a record a row of ``pages`` (page_id, url, html) below ``path``; the bundles' files.

    A task begins another bundle after ``bundle_bytes``, so that a bundle and its index are bounded at any size.

    A null html is an empty payload; an empty table writes nothing; null page_ids are never the response of a group that
    has others, else that of theirs; of rows that repeat page_id and payload one is as decided above, the others revisit
    it. Other columns are ignored. Bodies are shuffled once, by page_id and digest, which spreads any hot payload.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text_of("html"), "UTF-8").alias("payload"))
    n = shuffle_partitions(pages.sparkSession)
    key = lambda d: d.withColumn("_null", F.col("page_id").isNull()).withColumn("_page", F.coalesce("page_id", F.lit(0)))
    rows = key(src.withColumn("digest", base32_sha1(F.col("payload")))).repartition(n, "_null", "_page", "digest")
    seen = key(decide(src, least_bytes)).drop("page_id")
    # the join keeps the partitioning of its left side, so bodies move once
    rows = rows.join(seen, ["_null", "_page", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    rows = rows.sortWithinPartitions("page_id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        out, files, k, last = None, [], 0, None

        def close() -> None:
            out.close()
            out.sink.close()
            fs.move(f"{root}/.{files[-1]}-{ctx.taskAttemptId()}", f"{root}/{files[-1]}")

        for b in by_bytes(batches, 2):
            for page, url, payload, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                page, digest, payload, refers = page.as_py(), digest.as_py(), payload.as_py(), refers.as_py()
                k = k + 1 if (page, digest) == last else 0
                last = (page, digest)
                if k and refers is None and len(payload) >= least_bytes and page is not None:
                    refers = page
                if out is not None and out.written >= bundle_bytes:
                    close()
                    out = None
                if out is None:
                    files.append(f"part-{ctx.partitionId():06d}-{len(files):05d}.warc.zst")
                    out = BundleWriter(fs.open_output_stream(f"{root}/.{files[-1]}-{ctx.taskAttemptId()}"), frame_bytes)
                out.add(record_id(page, digest, k), record(page, url.as_py(), payload, len(payload), digest, refers, k))
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{f}" for f in files])], names=["file"])

    return sorted(r.file for r in rows.mapInArrow(write, "file string").collect())


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, frame by frame.

    A response's size and digest are of the payload read; a revisit's are those its record states.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not files:
        return spark.createDataFrame([], schema)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    number = lambda x: None if x is None or x.startswith("<urn:page:null:") else int(x.split(":")[2])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, where = pafs.FileSystem.from_uri(file)
                out: list[list] = [[] for _ in types]
                with fs.open_input_file(where) as source:
                    for head, payload in BundleReader(source).records():
                        stated = head["WARC-Payload-Digest"][5:]
                        if head["WARC-Type"] == "response":
                            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest != stated or n != int(head["X-Payload-Length"]):
                                raise ValueError(f"{file}: {head['WARC-Record-ID']} is damaged")
                        else:
                            n, digest = int(head["X-Payload-Length"]), stated
                        for c, v in zip(out, (number(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], number(head.get("WARC-Refers-To")))):
                            c.append(v)
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                            out = [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(table(spark, sf_dir, "pages"), fresh(spark, "warc")))


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    digits = " || ".join(f"list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(h, {5 * i + 1}, 5))::int >> b) & 31 as int) + 1, 1)), lambda x, y: x || y)" for i in range(8))
    return f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
q as (select page_id, payload_bytes, {digits} as payload_digest, max(page_id) over (partition by h) as top from p)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to from q"""
