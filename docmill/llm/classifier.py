"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, trained by numpy SGD.

A word's vector is the mean of the learnt vectors of its hash bucket and of its character n-grams' buckets; a document's
is the mean over its words, with one more token for each word equal to the one before it (the word bigram "same again").
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import by_bytes, table, text_of, worker_cache

#: Hash buckets, dimensions, character n-grams, and the most labelled documents that the model is fitted on.
BUCKETS, DIM, GRAM, FIT_ROWS = 1 << 16, 8, 3, 4000
#: Passes over the sample, and the least steps in all: small samples are passed more often.
EPOCHS, STEPS, RATE, SEED = 4, 12_000, 0.5, 3
THRESHOLD, FOLDS = 0.3, 5
SAME = b"\x00same"


def buckets(word: bytes, n: int = BUCKETS) -> list[int]:
    """Hash buckets of a word and of its character n-grams (UTF-8 bytes, ends marked); of SAME, its own alone."""
    crc, w = zlib.crc32, b"<" + word + b">"
    if word == SAME:
        return [crc(SAME) % n]
    return [crc(word) % n, *[crc(w[i : i + GRAM]) % n for i in range(len(w) - GRAM + 1)]]


def bag(text: str, of=buckets, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The document's vector as weights over buckets: bucket numbers and weights that add up to 1 (none for no words)."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    seen = Counter(words)
    if same := sum(map(eq, words, words[1:])):
        seen[SAME] = same
    each = [of(w) for w in seen]
    lens = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter(chain.from_iterable(each), np.int64, int(lens.sum()))
    weight = np.fromiter(seen.values(), np.float64, len(each)) / (lens * (len(words) + same))
    out = np.bincount(flat, np.repeat(weight, lens), n)
    at = np.flatnonzero(out)
    return at.astype(np.int32), out[at].astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Two-class softmax: what counts is the difference of the classes' outputs, a number for each bucket."""

    margin: np.ndarray
    bias: float

    def scorer(self):
        """A function from text to the probability of label 1; words' margins are cached."""
        margin, n = self.margin.tolist(), len(self.margin)

        def of(word: bytes) -> float:
            b = buckets(word, n)
            return sum([margin[i] for i in b]) / len(b)

        cache, same_margin = worker_cache(), of(SAME)

        def score(text: str) -> float:
            words = text.encode().split()
            z = self.bias
            if words:
                for w in cache.missing(set(words)):
                    cache.add(w, of(w))
                same = sum(map(eq, words, words[1:]))
                z += (sum(map(cache.new.__getitem__, words)) + same * same_margin) / (len(words) + same)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the log loss, one document a step, the rate falling to 0; of one class alone, its share."""
    y = np.asarray(labels, int)
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(n), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (n, dim))
    epochs = max(epochs, -(-STEPS // len(y)))
    out, bias, steps, done = np.zeros((dim, 2)), np.zeros(2), epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - done / steps)
            done += 1
            at, w = bags[i]
            rows = vectors[at]
            h = w @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if len(at):  # the step along the bag is scaled by its length: bags of many small weights would hardly move
                vectors[at] = rows - np.outer(w * (lr / max(float(w @ w), 1e-9) * 0.2), out @ p)
            out -= lr * np.outer(h, p)
            bias -= lr * p * 0.1
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out fold, drawn by hash.

    Executors turn the documents, whole, into bags of at most BUCKETS weights; only those reach the driver. Labels other
    than 0 and 1 are ignored, of repeated labels the larger counts, of repeated doc_ids the text of the least hash.
    Without labels, or documents of labels, every score is 0.5.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of("text").alias("text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("_label").alias("_label")).select("_id", F.col("t.text").alias("text"), "_label")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            made = [bag(t.as_py(), lru_cache(maxsize=None)(buckets)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())], names=["id", "label", "at", "w"])

    rows = texts.select("_id", "text", "_label").mapInArrow(make, "id long, label int, at binary, w binary").toArrow().sort_by([("id", "ascending"), ("at", "ascending")])
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(w, np.float32)) for a, w in zip(rows.column("at").to_pylist(), rows.column("w").to_pylist(), strict=True)]
    return fit(bags, rows.column("label").to_pylist())


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` of every row; a null text is empty, an empty table gives an empty one; each text is scored whole.

    A kept column that is itself called ``score`` comes out as ``score_``; repeated rows are scored each.
    """
    schema = docs.select(*[F.col(c).alias("score_" if c == "score" else c) for c in keep]).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model.margin.tobytes(), model.bias)
        for b in by_bytes(batches, len(keep)):
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([score(t.as_py()) for t in b.column(len(keep))], pa.float64())], names=[*names, "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", score double"
    return docs.select(*keep, text_of("text")).mapInArrow(run, kind)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; nothing is shuffled.

    A null text is empty; repeated rows are judged each; an empty table gives an empty one; columns of any name pass.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model.margin.tobytes(), model.bias)
        for b in by_bytes(batches, at):
            yield b.filter(pa.array([score(t.as_py() or "") >= threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@lru_cache(maxsize=1)
def _scorer(margin: bytes, bias: float):
    """Kept by worker, so that its cache of words serves many tasks."""
    return Model(np.frombuffer(margin), bias).scorer()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
