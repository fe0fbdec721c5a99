"""Best-fit packing: bounded-space online best fit of token pieces into fixed-size sequences."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import by_bytes, table, text_of, written
from docmill.llm.tokens import encoder, family_of

CAPACITY, END_ID = 4096, 1
#: Bins open at once in a task, and sequences a task is meant to fill (its tail of open bins is then no part of note).
OPEN_BINS, SEQUENCES_PER_TASK = 2048, 16_384


class BestFit:
    """Online best fit with at most ``max_open`` open bins, kept in a bitset whose bit f says that a bin with f free is open.

    A piece goes where the least space stays free; when no open bin takes it and all are open, the fullest closes.
    """

    def __init__(self, capacity: int = CAPACITY, max_open: int = OPEN_BINS) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.mask, self.open, self.bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.mask ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the place there of a piece of 1 to ``capacity`` tokens."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has 1 to {self.capacity} tokens, not {length}")
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            if self.open >= self.max_open:
                fullest = (self.mask & -self.mask).bit_length() - 1
                self._take(fullest)
            self.by_free[left].append(bin_id)
            self.mask |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and an end id, cut at ``capacity`` if longer.

    A null or empty text has the end id alone; a null doc_id stays null; repeated rows stay repeated; other columns of
    ``docs`` are ignored. ``ids``: little-endian unsigned 32-bit ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if keep_ids else []))
    end, family = int(end_id).to_bytes(4, "little"), family_of(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, family).encode
        for b in by_bytes(batches, 1):
            out: list[list] = [[] for _ in schema.names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(cut, kind)


def pack(items: DataFrame, capacity: int = CAPACITY, max_open: int = OPEN_BINS, sequences_per_task: int = SEQUENCES_PER_TASK) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32, …) with sequence_id and offset; an empty table gives an empty one.

    ``items`` should be a written table: its total length decides the number of tasks, so that a task's share is bounded
    at any size. Shares are drawn by hash and sorted, so a retried task packs alike. Only these thin rows are shuffled.
    """
    total = items.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / (capacity * sequences_per_task)))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(11))
    share, names = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)).cast("int"), items.columns
    rows = items.select(F.struct("*").alias("_row"), share.alias("_share"), key.alias("_key"))
    # the share is the partition's own number: hashed again, some partitions would have several and others none
    rows = rows.repartitionById(tasks, "_share").sortWithinPartitions("_share", "_key", "_row.doc_id", "_row.piece", "_row.start")
    rows = rows.select("_row.*", F.col("_share"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bins = None, None
        for b in batches:
            seq, off = [], []
            for s, n in zip(b.column(len(names)).to_pylist(), b.column(names.index("length")).to_pylist(), strict=True):
                if s != share:
                    share, bins = s, BestFit(capacity, max_open)
                i, o = bins.place(n)
                seq.append((s << 32) | i)
                off.append(o)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, `offset` long"
    return rows.mapInArrow(fill, kind)


def pack_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = False, **limits: int) -> DataFrame:
    """Documents to packed pieces; ``keep_ids`` adds each piece's ids."""
    return pack(written(pieces(docs, tokenizer, keep_ids=keep_ids), "pieces"), **limits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
