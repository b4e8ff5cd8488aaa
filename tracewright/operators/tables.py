"""Tables between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..streaming.runner import shared_dir

#: Spark's setting that removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: a lost executor costs a read, not the jobs before,
    and what several steps read is planned and computed once. What the write shuffled goes with its end: nothing
    after it reads those files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete the files of a table made by ``kept`` that nothing reads any more."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._kept)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
