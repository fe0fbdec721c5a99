"""Embedding near-duplicates: iterative quantisation to balanced binary codes, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import blocked, components, look_up, runs, spanning, table, written

COSINE = 0.9
#: Vectors the rotations are fitted on, at most; every vector is indexed. Share of simulated pairs at the threshold that must meet.
FIT_ROWS, RECALL, MOST_TABLES = 4096, 0.975, 160
#: Vectors a bucket of a table should hold on average; rows of a bucket compared at once; rows beyond which it is cut.
PER_BUCKET, BLOCK, SPLIT = 8, 1024, 4096


def rotation(v: np.ndarray, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    """An orthogonal matrix R, fitted by alternation, that brings ``v @ R`` close to its signs (Gong and Lazebnik's ITQ)."""
    d = v.shape[1]
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def threshold_pairs(sample: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A vector at the threshold's cosine from each of ``sample``, off in the direction of ``noise``."""
    noise = noise - (noise * sample).sum(axis=1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    return COSINE * sample + math.sqrt(1 - COSINE**2) * noise


class Tables:
    """Substring tables over the bits of as many learnt rotations as simulated threshold pairs need to be met.

    Pairs differ by isotropic noise and by noise of the sample's own covariance; both kinds must meet. Rotations
    are fitted on one half of the sample, pairs made from the other. If MOST_TABLES
    don't do, substrings are narrowed bit by bit; of width 0, one table holds all vectors, and the comparison is exact.
    """

    def __init__(self, sample: np.ndarray, width: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(axis=0)
        fitted = sample[::2] - self.mean
        sample = sample[1::2] if len(sample) > 1 else sample
        v = sample - self.mean
        plain = rng.standard_normal(sample.shape)
        own = rng.standard_normal((len(sample), len(sample))) @ v
        own = np.where(np.linalg.norm(own, axis=1, keepdims=True) > 1e-9, own, plain)
        near = [threshold_pairs(sample, noise) - self.mean for noise in (plain, own)]
        rs: list[np.ndarray] = []
        bits_a, bits_b = np.zeros((len(sample), 0), bool), np.zeros((2, len(sample), 0), bool)
        for self.width in range(width, -1, -1):
            met = np.zeros((2, len(sample)), bool)
            self.tables = 0
            while self.tables < (MOST_TABLES if self.width else 1) and met.mean(axis=1).min() < RECALL:
                cut = slice(self.tables * self.width, (self.tables + 1) * self.width)
                while bits_a.shape[1] < cut.stop:
                    rs.append(rotation(fitted, rng))
                    bits_a = np.hstack([bits_a, v @ rs[-1] >= 0])
                    bits_b = np.concatenate([bits_b, np.stack([x @ rs[-1] >= 0 for x in near])], axis=2)
                met |= (bits_a[:, cut] == bits_b[:, :, cut]).all(axis=2)
                self.tables += 1
            if met.mean(axis=1).min() >= RECALL:
                break
        self.r = np.hstack([np.zeros((d, 0)), *rs])[:, : self.tables * self.width]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The substring of each vector in each table, as int64 (vectors, tables)."""
        bits = ((x - self.mean) @ self.r >= 0).reshape(len(x), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def unit(data: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(classes: DataFrame, dim: int, dtype: str, n: int) -> DataFrame:
    """(a, b, links): per run, each class's count of linked rows, and a spanning set of links between classes."""
    sample = classes.orderBy(F.xxhash64("bytes"), "cid").limit(FIT_ROWS).select("bytes").collect()
    tables = Tables(unit([bytes(r.bytes) for r in sample], dtype), min(30, max(8, math.ceil(math.log2(max(n, 2) / PER_BUCKET)))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = tables.keys(unit(part.column("bytes").to_pylist(), dtype))
                m = len(keys)
                all_keys = pa.array([k.tobytes() for k in keys.astype("<i4")], pa.binary())
                for t in range(tables.tables):
                    yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << 40) | keys[:, t]), part.column("cid"), part.column("n"), part.column("bytes"), all_keys], names=["key", "cid", "n", "bytes", "keys"])

    lists = classes.select("cid", "n", "bytes").mapInArrow(index, "key long, cid long, n long, bytes binary, keys binary")
    rows = blocked(lists, "cid", SPLIT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["a", "b", "links"], [pa.int64()] * 3
        held: list[list[np.ndarray]] = [[], [], []]
        for t in runs(batches, ["key", "pa", "pb"]):
            m = t.num_rows
            if m < 2:
                continue
            table_no = t.column("key")[0].as_py() >> 40
            cid, many, side = (t.column(c).to_numpy() for c in ("cid", "n", "side"))
            x = unit(t.column("bytes").to_pylist(), dtype)
            keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<i4").reshape(m, -1)[:, :table_no]
            split = t.column("pa")[0].as_py() != t.column("pb")[0].as_py()
            k = int((side == 0).sum()) if split else m
            links = np.zeros(m, np.int64)

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i in range(0, k, BLOCK):
                    for j in range(k if split else i, m, BLOCK):
                        p, q = np.nonzero(x[i : min(i + BLOCK, k)] @ x[j : j + BLOCK].T >= COSINE)
                        p, q = p + i, q + j
                        if not split:
                            p, q = p[p < q], q[p < q]
                        for c in range(0, len(p), 1 << 16):  # a pair counts in the first table where it meets
                            a, b = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
                            first = ~(keys[a] == keys[b]).any(axis=1)
                            a, b = a[first], b[first]
                            np.add.at(links, a, many[b])
                            np.add.at(links, b, many[a])
                            yield a, b

            edges = spanning(pairs(), m)
            some = np.flatnonzero(links)
            if len(some):
                held[0].append(cid[some]); held[1].append(cid[some]); held[2].append(links[some])  # noqa: E702
            if edges:
                e = np.array(edges)
                held[0].append(cid[e[:, 0]]); held[1].append(cid[e[:, 1]]); held[2].append(np.zeros(len(e), np.int64))  # noqa: E702
            if sum(map(len, held[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h), t) for h, t in zip(held, types)], names=names)
                held = [[], [], []]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h), t) for h, t in zip(held, types)], names=names)

    return written(rows.mapInArrow(compare, "a long, b long, links long"), "links")


def near_duplicates(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; vectors of different
    lengths don't link. Equal vectors are one class, expanded in the counts only. A null vec_id has component null.
    Repeated rows each count; an empty table gives an empty one; other columns are ignored.
    """
    kind = vectors.schema[column].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    x = F.col(column)
    good = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(math.inf))) & F.exists(x, lambda e: e != 0)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, x if kind in ("float", "double") else x.cast("array<double>")).alias("v"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if v is None else (np.array(v, dtype) + 0).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["vec_id", "bytes"])

    rows = written(kept.mapInArrow(to_bytes, "vec_id long, bytes binary"), "vectors")
    classes = rows.where("bytes is not null").groupBy("bytes").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.withColumn("dim", F.octet_length("bytes")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row for each vector length
        part = _links(classes.where(F.col("dim") == r.dim), r.dim, dtype, r.n)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("a = b").groupBy("a").agg(F.sum("links").alias("others"))
    roots = components(found.where("a <> b").select("a", "b"))
    named = classes.join(counts, F.col("cid") == F.col("a"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    named = named.select("bytes", "n", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    named = written(named, "named-classes")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(lowest, "root").select("bytes", "n", "n_links", "component_id"), "components")
    out = look_up(rows.where("bytes is not null"), named, ["bytes"], "inner", "n").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(rows.where("bytes is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
