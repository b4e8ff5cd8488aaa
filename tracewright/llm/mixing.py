"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the corpus over its actual share (times ``scale``). Each
document's count of copies is the inverse of the Poisson distribution with that mean at a
hash-seeded uniform number, so it depends on the seed and the document alone: any retry, order
or partitioning gives the same rows. Copies are exploded, dealt out by a seeded hash and ordered by
it inside each partition (global shuffle).
Means above BLOCK are sums of independent Poisson parts, so that no term underflows.

Defined results: a source without a weight, or with weight 0 or less, gets no copy; a null source
is the empty string; repeated rows get the same count each; null texts pass through; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unit_hash

BLOCK = 8.0
#: Terms of the sum; the tail beyond them at mean BLOCK is below 2 ** -53.
TERMS = 48
#: Sources whose rates are broadcast (about 2 MB), and the salts of each source beyond that.
MOST_SOURCES, SALTS = 20_000, 64


def poisson_inverse(mean: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u for X Poisson with the mean (at most BLOCK)."""
    zero = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i.cast("double")
        return F.when(acc["c"] > u, acc).otherwise(F.struct((acc["k"] + 1).alias("k"), p.alias("p"), (acc["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["k"])


def rates(documents: DataFrame, weights: DataFrame, source: str = "source", scale: float = 1.0) -> DataFrame:
    """(source, rate): target share over actual share. ``weights``: (source, weight), weights in any unit."""
    name = F.coalesce(F.col(source), F.lit("")).alias("_source")
    have = documents.groupBy(name).agg(F.count("*").alias("n"))
    want = weights.filter("weight > 0").groupBy(name).agg(F.sum("weight").alias("w"))
    found = have.join(want, "_source")
    total, weight = have.agg(F.sum("n")).first()[0] or 0, found.agg(F.sum("w")).first()[0] or 1.0  # two numbers
    return found.select("_source", (F.lit(float(scale)) * F.col("w") / F.lit(float(weight)) * F.lit(float(total)) / F.col("n")).alias("rate"))


def mixed(documents: DataFrame, rate: DataFrame, seed: int, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents with ``replica`` (0, 1, ...), each as often as its Poisson count says, shuffled.

    ``rate`` has a row per source. Up to MOST_SOURCES rows (they are counted) it is broadcast; beyond,
    sources are salted, so that a hot one is dealt to SALTS tasks.
    """
    # the caller's row travels as one column, so that no name of its own can meet one of ours
    r = rate.select(F.col("_source").alias("_s"), "rate")
    kept = [c for c in documents.columns if c != "replica"]
    d = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col(source), F.lit("")).alias("_name"), F.col(id_col).alias("_id"))
    if r.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        d = d.join(F.broadcast(r), F.col("_name") == F.col("_s"))
    else:
        r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("_mine", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(r, (F.col("_name") == F.col("_s")) & (F.col("_mine") == F.col("_salt")))
    parts = F.ceil(F.col("rate") / BLOCK).cast("int")
    u = lambda j: unit_hash(F.lit(str(seed)), F.col("_id").cast("string"), j.cast("string"))
    sums = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, j: acc + poisson_inverse(F.col("rate") / parts, u(j)))
    d = d.withColumn("_k", sums).filter("_k > 0")
    d = d.select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("replica"))
    # the whole order is that of seeded hashes; the place of origin parts rows that are equal
    d = d.withColumn("_key", F.xxhash64(F.lit(seed), F.col("_id"), F.col("replica"))).withColumn("_from", F.spark_partition_id())
    return d.repartition("_key", "_from").sortWithinPartitions("_key", "_from").select("_row.*", "replica")


#: Target weights of the query: sources in three tiers by the last digit of their names.
SEED = 17


def target_weights(documents: DataFrame, source: str = "source") -> DataFrame:
    """A weight for each source: 3 for names ending in 1-3, 1 for those ending in 0, else 2."""
    last = F.substring("source", -1, 1)
    return documents.select(F.coalesce(F.col(source), F.lit("")).alias("source")).distinct().select("source", F.when(last.isin("1", "2", "3"), 3.0).when(last == "0", 1.0).otherwise(2.0).alias("weight"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rate = rates(docs, target_weights(docs))
    return mixed(docs, rate, SEED).select("doc_id", "replica", "text", "lang", "source", "n_chars")


ORACLE = f"""
WITH RECURSIVE have AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
want AS (SELECT s, n, CASE WHEN s[-1:] IN ('1', '2', '3') THEN 3.0 WHEN s[-1:] = '0' THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM have),
rate0 AS (SELECT s, w / (SELECT sum(w) FROM want) * (SELECT sum(n) FROM have)::DOUBLE / n::DOUBLE AS rate FROM want),
rate AS (SELECT s, rate / ceil(rate / {BLOCK}) AS m, ceil(rate / {BLOCK})::INT AS parts FROM rate0),
cdf(s, k, m, p, c) AS (SELECT s, 0, m, exp(-m), exp(-m) FROM rate UNION ALL SELECT s, k + 1, m, p * m / (k + 1)::DOUBLE, c + p * m / (k + 1)::DOUBLE FROM cdf WHERE k < {TERMS}),
drawn AS (SELECT d.doc_id, d.s, ('0x' || substr(md5('{SEED}:' || d.doc_id::VARCHAR || ':' || j::VARCHAR), 1, 13))::BIGINT::DOUBLE / {2.0**52!r} AS u
  FROM (SELECT doc_id, coalesce(source, '') AS s FROM documents) d JOIN rate USING (s), generate_series(1, parts) g(j)),
counts AS (SELECT doc_id, sum(k)::INT AS n FROM (SELECT dr.doc_id, dr.u, (SELECT least(min(k), {TERMS}) FROM cdf WHERE cdf.s = dr.s AND cdf.c > dr.u) AS k FROM drawn dr) GROUP BY doc_id)
SELECT doc_id, replica::INT AS replica, text, lang, source, n_chars FROM documents JOIN counts USING (doc_id), generate_series(0, n - 1) r(replica) WHERE n > 0
"""
