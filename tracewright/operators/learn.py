"""Learning studies on labelled vectors: grouped cross-validation, clustering, projections, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote(neighbours: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    """(query, predicted): the label with most (or most inverse-distance) votes of the k nearest;
    ties go to the lesser label."""
    w = F.when(F.col("distance") > 0, 1 / F.col("distance")).otherwise(1e9) if weighted else F.lit(1.0)
    v = neighbours.filter(F.col("rank") <= k).groupBy("query", "label").agg(F.round(F.sum(w), 9).alias("v"))
    return v.groupBy("query").agg(F.max(F.struct("v", (-F.col("label")).alias("n"))).alias("m")).select("query", (-F.col("m.n")).alias("predicted"))


def scores(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, macro_f1, balanced_accuracy over the classes of the truth."""
    c = pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    per = c.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    made = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("p"))
    d = per.join(made, "class", "left").withColumn("f1", 2 * F.col("hit") / (F.col("t") + F.coalesce("p", F.lit(0))))
    return d.agg(F.sum("t").alias("n"), (F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.col("hit") / F.col("t")).alias("balanced_accuracy"))


def percentile_of(values: DataFrame, cases: DataFrame, keys, x: str) -> DataFrame:
    """Each case with the share of its class's values that are no greater: running sums over the
    distinct values of a class, so that no class meets in one task. Cases without a value go."""
    from .stats import running

    both = values.select(*keys, x, F.lit(1).alias("_v")).unionByName(cases.select(*keys, x, F.lit(0).alias("_v")))
    r = running(both, keys, x, {"k": F.sum("_v")}).select(*keys, x, ((F.col("k_below") + F.col("k")) / F.col("k_total")).alias("share"))
    return cases.join(r, [*keys, x])


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans_sweep(df: DataFrame, vec: str, ks, seed: int = 7) -> DataFrame:
    """(k, inertia, silhouette) of k-means for each k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    data = _vectors(df, vec)
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(data)
        rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(data)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def contingency(df: DataFrame, vec: str, label: str, k: int, seed: int = 7) -> DataFrame:
    """(cluster, label, n, purity): labels within the clusters and the share of the most frequent one."""
    from pyspark.ml.clustering import KMeans

    data = _vectors(df, vec)
    c = KMeans(k=k, seed=seed).fit(data).transform(data).groupBy(F.col("prediction").alias("cluster"), label).agg(F.count("*").alias("n"))
    return c.withColumn("purity", F.max("n").over(Window.partitionBy("cluster")) / F.sum("n").over(Window.partitionBy("cluster")))


def pca(df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """The rows with ``map``, their first principal components on z-scored dimensions."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    data = _vectors(df, vec)
    z = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_z").fit(data).transform(data)
    return PCA(k=k, inputCol="_z", outputCol="_p").fit(z).transform(z).withColumn("map", vector_to_array("_p")).drop("features", "_z", "_p")
