"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import look_up, running_sum, table, text_of, written

#: The exponent is a multiple of 1/GRID. The wanted entropy is a share of the most possible; no source repeats more often.
GRID, ENTROPY, REPEATS = 1024, 0.97, 3.0
#: Estimated tokens of a block of the mixture, and rows that a bucket of a source's permutation is meant to hold.
BLOCK_TOKENS, ROWS_PER_BUCKET, SEED = 500_000, 100_000, 7
ROOT_TOKENS = 4


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(ROOT_TOKENS))).cast("long")


def _weights(shares: Column, k: Column) -> Column:
    """Normalised shares to the power k / GRID."""
    powers = F.transform(shares, lambda s: F.pow(s, k / F.lit(float(GRID))))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def exponent(tokens: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """One row: the sources, their tokens (an array each), the budget, ``k`` and the normalised ``weights``.

    ``tokens``: (source, n_tokens), a row a source. A smaller exponent raises the entropy and the repetition of small
    sources; both are monotone in it. The largest k whose entropy is at least ``entropy`` times ln(sources) is bisected,
    and, where the budget would then repeat a source more than ``repeats`` times, the least k that does not (k = GRID,
    the natural shares, if none). The whole search is one expression over the arrays of sources.
    """
    one = tokens.where("n_tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "n_tokens"))).alias("s"))
    one = one.select(F.col("s.source").alias("sources"), F.col("s.n_tokens").alias("tokens")).where(F.size("sources") > 0)
    one = one.withColumn("total", _sum(F.transform("tokens", lambda t: t.cast("double"))))
    one = one.withColumn("budget", (F.lit(budget) if budget is not None else F.col("total")).cast("long"))
    one = one.withColumn("shares", F.transform("tokens", lambda t: t / F.col("total")))
    wanted = F.lit(float(entropy)) * F.ln(F.size("sources").cast("double")) - F.lit(1e-9)

    def spread(k: Column) -> Column:
        return _sum(F.transform(_weights(F.col("shares"), k), lambda w: F.when(w > 0, -w * F.ln(w)).otherwise(0.0)))

    def repeated(k: Column) -> Column:
        pairs = F.arrays_zip(_weights(F.col("shares"), k).alias("w"), F.col("tokens").alias("t"))
        return F.array_max(F.transform(pairs, lambda p: p["w"] * F.col("budget") / p["t"]))

    steps = F.sequence(F.lit(1), F.lit(GRID.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(GRID + 1).alias("hi"))

    def bisect(low_side) -> Column:
        """The last k in 0 to GRID where ``low_side`` still holds, -1 if it doesn't at 0; it holds up to there."""
        def step(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            ok = low_side(mid)
            return F.when(a["hi"] - a["lo"] <= 1, a).when(ok, F.struct(mid.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

        return F.when(low_side(F.lit(0)), F.aggregate(steps, start, step)["lo"]).otherwise(F.lit(-1))

    one = one.withColumn("k_entropy", F.greatest(F.lit(0), bisect(lambda k: spread(k) >= wanted)))
    one = one.withColumn("k_repeats", F.least(F.lit(GRID), bisect(lambda k: repeated(k) > F.lit(float(repeats))) + F.lit(1)))
    one = one.withColumn("k", F.greatest("k_entropy", "k_repeats"))
    return one.withColumn("weights", F.transform(_weights(F.col("shares"), F.col("k")), lambda w: F.round(w, 12)))


def mix(docs: DataFrame, keep: list[str], entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, tokens and ``keep``) as often as the mixture wants them, with epoch, block and place.

    A source with quota q passes through its documents in permuted order, epoch after epoch, each epoch permuted anew;
    a document is emitted in an epoch if it ends within q. The documents' places in the source's run spread evenly over
    the blocks, and ``place`` orders a block by hash. Null sources are one source; null doc_ids and repeated rows are
    documents like others; an empty table gives an empty one. ``docs`` should be a written table with columns
    doc_id, source, tokens, _row (any number that tells repeated rows apart).
    """
    per = written(docs.groupBy("source").agg(F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_docs")), "sources")
    plan = exponent(per, entropy, repeats, budget)
    quota = plan.select("budget", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("tokens").alias("n_tokens"), F.col("weights").alias("weight"))).alias("x")).select("budget", "x.*")
    quota = quota.withColumn("quota", F.floor(F.col("weight") * F.col("budget")).cast("long"))
    quota = written(quota.withColumn("epochs", F.ceil(F.col("quota") / F.col("n_tokens")).cast("int")).where("epochs > 0").withColumnRenamed("source", "_source"), "quota")
    quota = quota.join(per.select(F.col("source").alias("_source2"), "n_docs"), F.col("_source").eqNullSafe(F.col("_source2"))).drop("_source2")
    small = quota.withColumn("_null", F.col("_source").isNull()).withColumn("_key", F.coalesce("_source", F.lit("")))
    big = docs.withColumn("_null", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit("")))
    rows = look_up(big, small.drop("_source"), ["_null", "_key"], "inner", "n_docs").drop("_null", "_key")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    rows = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("_row").cast("string"))))
    spread = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(spread * F.ceil(F.col("n_docs") / F.lit(ROWS_PER_BUCKET)) / F.lit(1 << 32)).cast("int"))
    rows = running_sum(written(rows, "epochs"), ["source", "epoch"], ["_order"], "_bucket", "tokens", "_cum")
    rows = rows.withColumn("_at", F.col("epoch") * F.col("n_tokens") + F.col("_cum")).where("_at + tokens <= quota")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.lit(block_tokens)))
    # divided first: the product of tokens and blocks would leave the range of long integers at tens of terabytes
    rows = rows.withColumn("block", F.least(blocks - 1, F.floor(F.col("_at").cast("double") / F.col("quota").cast("double") * blocks.cast("double"))).cast("long"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("_order")) - F.lit(1))
    return rows.select("doc_id", "source", "tokens", F.col("weight"), "epoch", "block", "place", *keep)


def thin(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, _row): ``_row`` tells rows with the same doc_id apart by their text's hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), estimated_tokens(text_of("text")).alias("tokens"), F.xxhash64(text_of("text")).alias("_row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), estimated_tokens(text_of("text")).alias("tokens"), F.lit(0).alias("_row"))
    return mix(written(rows, "mix-input"), [])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: the columns of ``docs``, a row for each emitted copy; every emitted document whole.

    A null text counts one token; null sources are one source; rows that repeat doc_id and text share their copies out;
    an empty table gives an empty one. Rows travel as one struct, so columns may have any name.
    """
    small = written(mix(written(thin(docs), "mix-input"), ["_row"], **options).groupBy("doc_id", "_row").agg(F.count("*").alias("copies")), "mixed")
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d")]
    small = small.select(*key, F.col("_row").alias("h"), "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("h")).select(*key, "h", "row")
    same = rows.join(small, ["none", "d", "h"])
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        each = same.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    else:
        w = W.partitionBy("none", "d", "h")
        share = F.floor((F.col("copies") + F.count("*").over(w) - F.row_number().over(w.orderBy("d"))) / F.count("*").over(w)).cast("int")
        each = same.withColumn("s", share).where("s > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("s"))))
    return each.select("row.*")


def oracle() -> str:
    """DuckDB SQL for ``query``: the exponent by trying the whole grid, prefix sums by plain windows."""
    return f"""
with d as (select doc_id, source, greatest(1, cast(ceil(strlen(coalesce(text, '')) / {float(ROOT_TOKENS)}) as bigint)) as tokens from documents),
per as (select source, cast(sum(tokens) as bigint) as n_tokens from d group by source),
tot as (select cast(sum(n_tokens) as bigint) as budget, count(*) as n from per),
grid as (select k, p.source, p.n_tokens, pow(p.n_tokens / tot.budget::double, k / {float(GRID)}) as p, tot.budget, tot.n from per p, tot, range(0, {GRID + 1}) g(k)),
w as (select *, p / sum(p) over (partition by k) as w from grid),
per_k as (select k, sum(-w * ln(w)) as h, max(w * budget / n_tokens) as r, max(n) as n from w group by k),
pick as (select greatest(coalesce(max(k) filter (where h >= {ENTROPY} * ln(n) - 1e-9), 0), least({GRID}, coalesce(max(k) filter (where r > {REPEATS}), -1) + 1)) as k from per_k),
q as (select w.source, n_tokens, budget, round(w, 12) as weight, cast(floor(round(w, 12) * budget) as bigint) as quota from w join pick using (k)),
e as (select q.*, u.epoch from q, lateral (select unnest(range(0, cast(ceil(quota / n_tokens::double) as bigint))) as epoch) u),
o as (select d.doc_id, d.source, d.tokens, e.weight, e.n_tokens, e.budget, e.quota, cast(e.epoch as int) as epoch, md5('{SEED}:' || e.epoch || ':' || d.doc_id || ':0') as ord from d join e on d.source = e.source),
s as (select *, epoch * n_tokens + coalesce(sum(tokens) over (partition by source, epoch order by ord rows between unbounded preceding and 1 preceding), 0) as pos from o),
b as (select *, cast(least(greatest(1, ceil(budget / {float(BLOCK_TOKENS)})) - 1, floor(pos::double / quota::double * greatest(1, ceil(budget / {float(BLOCK_TOKENS)})))) as bigint) as block from s where pos + tokens <= quota)
select doc_id, source, tokens, weight, epoch, block, cast(row_number() over (partition by block order by ord) - 1 as int) as place from b"""
