"""Plumbing shared by the training-data operators: shared storage, tables, skew-safe lookups, prefix sums."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only when its row count was measured and is at most this many.
BROADCAST_ROWS = 20_000
#: Bytes that the cache of a Python worker may take, and those that an entry takes besides its key and value.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 190
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``; in plain local mode a folder of our own if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="docmill-")
    return _own["dir"]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", weight: str | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (unique by ``keys``) without sending a hot key to one task.

    ``small`` is broadcast when it has at most BROADCAST_ROWS rows. Otherwise, with ``weight`` (rows of ``big`` a key
    has), the at most BROADCAST_ROWS keys above 1/BROADCAST_ROWS of all rows are broadcast and the rest is shuffled.
    """
    n = small.count()
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    if weight is None:
        return big.join(small, keys, how)
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = small.where(F.col(weight) > max(1, math.ceil(total / BROADCAST_ROWS)))
    cold = small.where(~(F.col(weight) > max(1, math.ceil(total / BROADCAST_ROWS))))
    marked = big.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    one = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), keys, "inner")
    two = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, keys, how)
    return one.unionByName(two)


def by_bytes(batches: Iterator[pa.RecordBatch], text: int, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts in column ``text`` of one have at most ``most`` bytes (one longer text is alone)."""
    for b in batches:
        if b.nbytes <= most:
            yield b
            continue
        size, at, held = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist(), 0, 0
        for i, n in enumerate(size):
            if held and held + n > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        yield b.slice(at)


class WorkerCache:
    """Values by key in at most ``most`` bytes, counted: a young and an old half. A full young half becomes the old one."""

    def __init__(self, most: int) -> None:
        self.most, self.size = most // 2, 0
        self.new: dict = {}
        self.old: dict = {}

    def add(self, key, value) -> None:
        self.new[key] = value
        self.size += ENTRY_BYTES + len(key) + (len(value) if isinstance(value, bytes) else 0)

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that have to be added; the others are in ``new`` from then on, until the next call."""
        if _cache.get("cache") is not self:
            worker_cache(self)
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        lack = keys.difference(self.new)
        if lack and self.old:
            absent = lack.difference(self.old)  # unlike an intersection, this does not walk the dict
            for k in lack - absent:
                self.add(k, self.old[k])
            lack = absent
        return lack


_cache: dict[str, WorkerCache] = {}


def worker_cache(cache: WorkerCache | None = None, most: int | None = None) -> WorkerCache:
    """The cache in use, a new one if none is given; any other of this Python process is emptied, so there is ever one."""
    for other in _cache.values():
        other.new, other.old, other.size = {}, {}, 0
    _cache["cache"] = cache or WorkerCache(CACHE_BYTES if most is None else most)
    return _cache["cache"]


def running_sum(df: DataFrame, group: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the group before this one, by ``bucket`` then ``order``.

    Two levels, so that no task holds a whole group: sums inside a (group, bucket), plus the sums of earlier buckets.
    ``df`` is read twice, so it should be a written table.
    """
    per = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = per.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    safe = [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in [*group, bucket]]
    names = before.select(*[F.col(g).alias(f"_b_{g}") for g in [*group, bucket]], "_before")
    on = safe[0]
    for c in safe[1:]:
        on = on & c
    return df.withColumn("_in", inside).join(names, on).withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_in", "_before", *[f"_b_{g}" for g in [*group, bucket]])


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int = 1 << 62) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` as tables, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(b.schema.get_field_index(k))) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in cols)
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                held.append(b.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], int(cut)
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges``, by alternating large-star and small-star.

    Every round works on edges only and is written to the shared folder; no component is held in one task: stars
    around a node are joined to its aggregated minimum, never collected.
    """
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: the larger neighbours of u are tied to the smallest one of the neighbourhood
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        # small-star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.where("u <> v").distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Those of ``pairs`` that first connect two of ``n`` nodes: at most n - 1, with the same components."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for p, q in pairs:
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def blocked(lists: DataFrame, item: str, split: int) -> DataFrame:
    """Rows of posting lists (``key``, ``item``, ...) shuffled and sorted so that a task meets each list, or pair of its parts, in a run.

    A list of up to ``split`` rows is one run with pa = pb = 0. A longer one is cut by hash of ``item`` into parts, and
    each pair of parts (pa, pb) is a run of its own: side 0 has the rows of part pa, side 1 those of pb. So a task
    holds at most two parts, and every pair of a list's rows meets at least once. A full sort key keeps retries alike.
    """
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split)
    long = written(sizes.withColumn("parts", F.ceil(F.col("n") / (split // 2)).cast("int")), "long-lists")
    rows = lists.withColumn("pa", F.lit(0)).withColumn("pb", F.lit(0)).withColumn("side", F.lit(0))
    if not long.isEmpty():
        n = F.coalesce("parts", F.lit(1))
        cut = look_up(lists, long, ["key"], "left", "n").withColumn("part", F.pmod(F.xxhash64(item), n).cast("int"))
        meet = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(o, "part").alias("pa"), F.greatest(o, "part").alias("pb"), (F.col("part") > o).cast("int").alias("side")))
        rows = cut.withColumn("x", F.explode(meet)).select(*lists.columns, "x.*")
    return rows.repartition(shuffle_partitions(lists.sparkSession), "key", "pa", "pb").sortWithinPartitions("key", "pa", "pb", "side", item)
