"""Sharding by rendezvous hashing of stable record keys over weighted shards; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import running_sum, table, text_of, written

SHARDS, ROWS_PER_BUCKET = 40, 200_000


def score(key: Column, shard: Column, weight: Column, seed: int = 0) -> Column:
    """The weighted rendezvous score of a key at a shard: -weight / ln(u), u uniform in (0, 1) from a hash of both."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, shard), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -weight / F.ln(u)


def best(key: Column, weights: Sequence[float], first: int = 0, seed: int = 0) -> Column:
    """struct(score, shard) of the winner among shards ``first`` … with these ``weights``; ties go to the larger shard."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("shards need finite weights above 0")
    w = F.array(*[F.lit(float(x)) for x in weights])
    one = lambda s: F.struct(score(key, s + F.lit(first), F.element_at(w, s + F.lit(1)), seed).alias("score"), (s + F.lit(first)).alias("shard"))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), one))


def shard_rows(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` and, given the weight of one more shard, ``grown_shard``.

    Only the key, the shard numbers and the weights decide, so another shard takes rows only into itself; null keys all
    go to one shard; repeated keys go together. No shuffle.
    """
    out = df.withColumn("_best", best(F.col(key), weights, 0, seed)).withColumn("shard", F.col("_best.shard").cast("int"))
    if grown_weight is not None:
        more = score(F.col(key), F.lit(len(weights)), F.lit(float(grown_weight)), seed)
        out = out.withColumn("grown_shard", F.when(more >= F.col("_best.score"), F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    return out.drop("_best")


def shard_documents(docs: DataFrame, weights: Sequence[float], seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by law ``key``.

    A null text counts 0 bytes (and the crc32 of none); a null doc_id is a key like others; repeated rows get a slot
    each; an empty table gives an empty one; other columns are ignored. Slots are gapless from 0 in each shard: a shard is
    cut into buckets of about ROWS_PER_BUCKET rows, numbered inside, and shifted by the rows of earlier buckets, so no
    task orders a whole shard. The number in the file splits rows that share a doc_id over buckets.
    """
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of("text")) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text_of("text"), "UTF-8")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    thin = written(shard_rows(thin, "doc_id", weights, sum(weights) / len(weights), seed), "sharded")
    buckets = max(1, math.ceil(thin.count() / (len(weights) * ROWS_PER_BUCKET)))
    thin = thin.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "_row"), F.lit(buckets))).withColumn("_one", F.lit(1))
    out = running_sum(thin, ["shard"], ["doc_id", "text_crc32", "_row"], "_bucket", "_one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def sizes(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each shard, and their share of all bytes."""
    per = sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    return per.withColumn("share", F.col("n_bytes") / F.sum("n_bytes").over(W.partitionBy()))
