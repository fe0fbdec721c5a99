"""Token-id files: fixed-size id blocks transposed into byte or bit planes, each plane zstd-compressed, with a chunk index.

Layout of a shard: 8 bytes magic; the chunks' planes one after another; zstd of the documents' lengths (uint64);
zstd of the documents' ids (int64) and their null marks (bytes); zstd of the chunk index (uint64 rows: file position, ids, then
each plane's bytes); a fixed footer with the sizes of those parts, the plane kind and count, and the magic again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import by_bytes, fresh, shuffle_partitions, table, text_of
from docmill.llm.tokens import encoder, family_of

MAGIC = b"DMPLANE1"
FOOTER = struct.Struct("<QQQQQQBBxxxxxx8s")
BLOCK = 1 << 16
#: Compressed bytes and documents after which a task begins another shard.
SHARD_BYTES, SHARD_DOCS = 1 << 30, 1 << 22


def to_planes(ids: np.ndarray, planes: int, kind: str) -> list[bytes]:
    """``ids`` (uint32) as ``planes`` byte planes, or bit planes of eight ids a byte; lowest first."""
    if kind == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes]]
    return [np.packbits((ids >> k) & 1 != 0, bitorder="little").tobytes() for k in range(planes)]


def from_planes(data: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(data):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4").astype(np.uint32, copy=False)
    ids = np.zeros(n, np.uint32)
    for k, p in enumerate(data):
        ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


class Writer:
    """Streams documents' ids into one shard; at most one block is held."""

    def __init__(self, sink, top_id: int, kind: str = "byte", block: int = BLOCK, level: int = 3) -> None:
        bits = max(1, int(top_id).bit_length())
        self.sink, self.kind, self.block = sink, kind, block
        self.planes = -(-bits // 8) if kind == "byte" else bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_n, self.index, self.docs, self.lengths = [], 0, [], [], []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.planes, self.kind)]
        self.index.append([self.at, len(ids), *map(len, packed)])
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def add(self, doc: int | None, data: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(data) // 4)
        self.held.append(data)
        self.held_n += len(data) // 4
        if self.held_n >= self.block:
            ids = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(ids[i : i + self.block])
            self.held, self.held_n = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> int:
        if self.held_n:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        parts = [
            np.array(self.lengths, "<u8").tobytes(),
            np.array([0 if d is None else d for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs),
            np.array(self.index, "<u8").tobytes(),
        ]
        packed = [self.zstd.compress(p) for p in parts]
        for p in packed:
            self.sink.write(p)
        total = sum(self.lengths)
        self.sink.write(FOOTER.pack(*map(len, packed), len(self.docs), len(self.index), total, self.planes, self.kind == "bit", MAGIC))
        return total


class Reader:
    """Random access to one shard: the footer, the tables, then any chunk by itself."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        foot = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if foot[8] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token-id shard")
        *lens, self.n_docs, n_chunks, self.n_ids, self.planes, bit = foot[:8]
        self.kind = "bit" if bit else "byte"
        at, parts, z = size - FOOTER.size - sum(lens), [], zstandard.ZstdDecompressor()
        for n in lens:
            parts.append(z.decompress(source.read_at(n, at)))
            at += n
        self.lengths = np.frombuffer(parts[0], "<u8").astype(np.int64)
        ids, null = np.frombuffer(parts[1][: 8 * self.n_docs], "<i8"), parts[1][8 * self.n_docs :]
        self.docs = [None if e else int(d) for d, e in zip(ids, null, strict=True)]
        self.index = np.frombuffer(parts[2], "<u8").astype(np.int64).reshape(n_chunks, 2 + self.planes)
        self.zstd = z

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.index[k])
        data = self.source.read_at(sum(sizes), at)
        out = []
        for s in sizes:
            out.append(self.zstd.decompress(data[:s]))
            data = data[s:]
        return from_planes(out, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's ids, chunk by chunk; what is held is a document and a chunk."""
        held, k = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.docs, self.lengths, strict=True):
            if len(held) < n:
                more = [held]
                have = len(held)
                while have < n:
                    more.append(self.chunk(k))
                    have, k = have + len(more[-1]), k + 1
                held = np.concatenate(more)
            yield doc, held[:n]
            held = held[n:]


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, kind: str = "byte", block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> list[tuple[str, int, int]]:
    """Write the ids of all texts in ascending doc_id order below ``path``; (file, documents, ids) of each shard, in order.

    A null text is empty, so has the end id alone; null doc_ids come first; rows that repeat a doc_id are ordered by
    text; an empty table writes no shard. Other columns are ignored. Ranges of doc_id (and of text hashes, so that one
    doc_id may span ranges) go to tasks; a task writes beside and then renames, so a retry replaces its own shard only.
    A task begins another shard after ``shard_bytes`` or SHARD_DOCS documents, so a shard's tables are bounded at any
    size. The returned manifest has one row a shard; file names sort in the order of the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    end, family = int(end_id).to_bytes(4, "little"), family_of(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(tokenizer, family), TaskContext.get()
        top = max(end_id, enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1)
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        writer, files = None, []

        def close() -> None:
            total = writer.close()
            writer.sink.close()
            fs.move(f"{root}/.{files[-1][0]}-{ctx.taskAttemptId()}", f"{root}/{files[-1][0]}")
            files[-1] += [len(writer.docs), total]

        for b in by_bytes(batches, 1):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is not None and (writer.at >= shard_bytes or len(writer.docs) >= SHARD_DOCS):
                    close()
                    writer = None
                if writer is None:
                    files.append([f"part-{ctx.partitionId():06d}-{len(files):05d}.ids"])
                    writer = Writer(fs.open_output_stream(f"{root}/.{files[-1][0]}-{ctx.taskAttemptId()}"), top, kind, block)
                writer.add(doc, enc.encode(text.as_py()) + end)
        if writer is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{f}" for f, _, _ in files]), pa.array([d for _, d, _ in files], pa.int64()), pa.array([n for _, _, n in files], pa.int64())], names=["file", "docs", "ids"])

    made = rows.mapInArrow(write, "file string, docs long, ids long").collect()
    return sorted((r.file, r.docs, r.ids) for r in made)


def read_files(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ``start`` counts all ids before it."""
    schema, names = "doc_id long, start long, n_tokens long, ids_crc32 long", ["doc_id", "start", "n_tokens", "ids_crc32"]
    if not manifest:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0, *[m[2] for m in manifest]])
    shards = spark.createDataFrame([(m[0], int(s)) for m, s in zip(manifest, starts)], "file string, start long").repartition(len(manifest))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, where = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(where) as source:
                    out: list[list[int]] = [[], [], [], []]
                    for doc, ids in Reader(source).documents():
                        for c, v in zip(out, (doc, at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()))):
                            c.append(v)
                        at += len(ids)
                        if len(out[0]) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
                            out = [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return shards.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_files(spark, write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh(spark, "token-files")))
