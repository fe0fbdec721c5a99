"""SimHash near-duplicates by a positional byte index with count filtering.

Fingerprints of 8 bytes that differ in at most 4 bits share at least 4 of their 8 positional bytes. The pairs that
share so many are those that agree on some set of m positions, for any m up to 4, taken from a family that meets every
4-set of positions. Posting lists are therefore kept not for single bytes, whose lists grow with the table, but for
the m-byte sets of such a family (20 sets of 3, or all 70 of 4): a list holds only fingerprints that already share m
bytes. Inside a list the shared positional bytes of each pair are tallied, pairs below 4 are dropped, the rest verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import blocked, components, look_up, runs, spanning, table, text_of, written

SHINGLE, BITS, SEED = 4, 4, 42
#: Distinct fingerprints up to which three-byte lists stay short; beyond it four bytes are used. Both find the same pairs.
THREE_BYTES_UP_TO = 50_000_000
#: Rows of a list compared at once, and rows beyond which a list is cut into blocks that different tasks compare.
BLOCK = 1024
SPLIT = 4096
_BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str) -> int:
    """The fingerprint as an unsigned 64-bit number; see ``fingerprints``."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, total, m = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64), n - SHINGLE + 1
    cuts = zip(starts[:m].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in cuts), np.uint64, m).astype("<u8").view(np.uint8).reshape(m, 8)
    for k in range(8):
        total[k] = np.bincount(hashes[:, k], minlength=256)
    bits = (2 * (total @ _BITS) > m).reshape(64)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """(doc_id, fp[, h]): a signed 64-bit fingerprint of every whole text, and the text's own hash if asked for.

    A-Z lower-cased, words between ASCII white space, four-word shingles with repeats (fewer words: the whole sequence;
    none, so also for a null text: zero), XXH64 with seed 42, majority by bit (ties are 0). Other columns are ignored.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            cols = [b.column(0), pa.array(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))]
            if hashed:  # as Spark's xxhash64 of the same text
                cols.append(pa.array(np.fromiter((xxhash.xxh64_intdigest(t.encode(), 42) for t in texts), np.uint64, len(texts)).view(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "h"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(make, "doc_id long, fp long" + (", h long" if hashed else ""))


def position_sets(m: int) -> list[tuple[int, ...]]:
    """Sets of ``m`` byte positions of which every four of the eight positions contain at least one."""
    if m == 4:
        return list(combinations(range(8), 4))
    if m != 3:
        raise ValueError("sets have three or four positions")
    # three parts; a triple inside a part, or two of a part and one of the next: any four positions hold one of these
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    sets = [p for p in parts if len(p) == 3]
    for i, p in enumerate(parts):
        sets += [tuple(sorted((*two, one))) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return sets


def links_within(fp: np.ndarray, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j, or i in ``fp`` and j in ``other``) at most BITS apart: bytes tallied, then bits verified, by blocks."""
    same = other is None
    other = fp if same else other
    for i in range(0, len(fp), BLOCK):
        a = fp[i : i + BLOCK]
        for j in range(i if same else 0, len(other), BLOCK):
            x = a[:, None] ^ other[None, j : j + BLOCK]
            shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
            p, q = np.nonzero(shared >= 8 - BITS)
            ok = np.bitwise_count(x[p, q]) <= BITS
            p, q = p[ok] + i, q[ok] + j
            if same:
                p, q = p[p < q], q[p < q]
            yield p, q


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect the same fingerprints as all links would.

    A list of up to SPLIT rows is compared in one task, in blocks; a longer one is cut by hash into parts, and each pair
    of parts is a task's, so that no task holds or compares more than two parts. Only a spanning set of links leaves a task.
    """
    n = fps.count()
    sets = position_sets(3 if n <= THREE_BYTES_UP_TO else 4)
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(0xFF))

    def key(i: int, s: tuple[int, ...]):
        k = F.lit(i).cast("long")
        for p in s:
            k = F.shiftleft(k, 8).bitwiseOR(byte(p))
        return k

    lists = fps.select("fp", F.explode(F.array(*[key(i, s) for i, s in enumerate(sets)])).alias("key"))
    rows = blocked(lists, "fp", SPLIT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for t in runs(batches, ["key", "pa", "pb"]):
            if t.num_rows < 2:
                continue
            fp, side = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy()
            split = t.column("pa")[0].as_py() != t.column("pb")[0].as_py()
            k = int((side == 0).sum())
            found = ((p, q + k) for p, q in links_within(fp[:k], fp[k:])) if split else links_within(fp)
            signed = fp.view(np.int64)
            for a, b in spanning(found, len(fp)):
                out_a.append(int(signed[a]))
                out_b.append(int(signed[b]))
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _classes(rows: DataFrame, least) -> DataFrame:
    """(fp, n, best): the rows of each fingerprint, and the least ``least`` over all rows of its component."""
    classes = written(rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")), "classes")
    roots = components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("best"))
    return written(rooted.join(lowest, "root").select("fp", "n", "best"), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link at most BITS bits apart, the zero of texts without words included; component_id is the smallest
    doc_id reachable (null only where all are null). Equal fingerprints are one class however many rows hold them;
    repeated rows and doc_ids each get a row; an empty table gives an empty one.
    """
    rows = written(fingerprints(docs), "fingerprints")
    named = _classes(rows, F.col("doc_id"))
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return look_up(rows, named, ["fp"], "inner", "n").select("doc_id", hex_.alias("fingerprint"), F.col("best").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id (then text hash); null doc_ids come last.

    Of rows that repeat doc_id and text one stays; null texts are empty; an empty table gives an empty one. Rows travel
    as one struct, so columns may have any name, and are shuffled once, by doc_id and hash, which no group makes hot.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = written(fingerprints(keyed, hashed=True), "fingerprints")
    best = _classes(rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).select("best.none", F.coalesce("best.doc_id", F.lit(0)).alias("d"), "best.h").distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(text_of("text")).alias("h"))
    # both steps have the same keys, none of them null, so the second needs no exchange of its own
    return marked.join(best, ["none", "d", "h"], "left_semi").dropDuplicates(["none", "d", "h"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
