"""Sensor sidecar files, annotation files and dataset metadata, by Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = re.compile(r"^p_(\d+)_f([xyz])$")


def present(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns; those that the files lack come as nulls of their type."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def sidecar(spark: SparkSession, path: str, clock: str = "timestamp_ns", floor: float = 0.2) -> DataFrame:
    """(file, ns, t, fx, fy, fz, points): a sensor CSV with ``p_NN_f[xyz]`` columns as an array of
    (fx, fy, fz). A block of zeros under a resultant above the floor takes the last good block."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("file", F.input_file_name())
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    found: dict[int, dict[str, str]] = {}
    for c in raw.columns:
        if m := POINT.match(c):
            found.setdefault(int(m[1]), {})[m[2]] = c
    whole = [found[k] for k in sorted(found) if len(found[k]) == 3]
    num = lambda c: F.col(c).cast("double")
    points = F.array(*[F.struct(*[num(p[a]).alias(f"f{a}") for a in "xyz"]) for p in whole]) if whole else F.array().cast("array<struct<fx:double,fy:double,fz:double>>")
    d = raw.select("file", F.col(clock).cast("long").alias("ns"), *[(num(f) if f in raw.columns else F.lit(None).cast("double")).alias(f) for f in ("fx", "fy", "fz")], points.alias("_p"))
    w = Window.partitionBy("file").orderBy("ns")
    empty = F.forall("_p", lambda p: (p["fx"] == 0) & (p["fy"] == 0) & (p["fz"] == 0)) & (F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2) > floor)
    good = F.last(F.when(~F.coalesce(empty, F.lit(False)), F.col("_p")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select("file", "ns", ((F.col("ns") - F.min("ns").over(Window.partitionBy("file"))) / 1e9).alias("t"), "fx", "fy", "fz", F.coalesce(good, "_p").alias("points"))


def epoch_range(spark: SparkSession, path: str, clock: str) -> DataFrame:
    """(file, first, last) of a clock column; files without two different times are left out."""
    d = spark.read.option("header", True).csv(path).select(F.input_file_name().alias("file"), F.col(clock).cast("long").alias("c"))
    return d.groupBy("file").agg(F.min("c").alias("first"), F.max("c").alias("last")).filter("last > first")


ATOM = T.StructType([T.StructField(c, t) for c, t in (("role", T.StringType()), ("content", T.StringType()), ("style", T.StringType()), ("timestamp", T.DoubleType()), ("camera", T.StringType()))])
ANNOTATION = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("episode_index", T.LongType()), T.StructField("saved_at", T.StringType()), T.StructField("atoms", T.ArrayType(ATOM))])


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per atom of annotation files; a file that is no such JSON is an error, not empty."""
    d = spark.read.schema(ANNOTATION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return d.select("episode_index", F.explode_outer("atoms").alias("a")).select("episode_index", "a.*")


def write_annotations(atoms: DataFrame, path: str) -> None:
    """One JSON record per episode, atoms in order of time, style and role."""
    order = F.array_sort(F.collect_list(F.struct("timestamp", "style", "role", "content", "camera")))
    atoms.groupBy("episode_index").agg(order.alias("atoms")).select(F.lit(2).alias("schema_version"), "episode_index", "atoms").write.mode("errorifexists").json(path)


def episode_metadata(spark: SparkSession, root: str) -> DataFrame:
    """All metadata rows below ``meta/episodes``; a missing video end is 30 s."""
    d = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    ends = [c for c in d.columns if c.startswith("videos/") and c.endswith("/to_timestamp")]
    return d.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(30.0)) for c in ends}) if ends else d


def feature_schema(features: dict) -> T.StructType:
    """A table schema from the declared features: name to dtype and shape."""
    kinds = {"float32": T.FloatType(), "float64": T.DoubleType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "bool": T.BooleanType(), "string": T.StringType()}
    out = []
    for name, f in features.items():
        if f["dtype"] == "video":
            continue
        kind = kinds[f["dtype"]]
        for _ in range(len([n for n in f.get("shape", [1])]) if f.get("shape", [1]) != [1] else 0):
            kind = T.ArrayType(kind)
        out.append(T.StructField(name, kind))
    return T.StructType(out)
