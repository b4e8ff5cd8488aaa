"""Run a stream over what is there now, and read its result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a stream runs batches without data.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs in this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of the table."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def with_closing(table: DataFrame, closing: DataFrame, mode: str, run) -> DataFrame:
    """The result of ``run`` on a streamed table with rows that end it, which arrive when all else has.

    ``run`` makes the result's stream of the rows. The query runs twice on one state: over the table,
    and then over the closing rows, which come through a source of their own. They end every key, so that
    batches without data, which only let through what waits, would add nothing: there are none.
    """
    spark = table.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    closing.limit(0).write.parquet(f"{root}-end")
    stream = run(table.unionByName(spark.readStream.schema(closing.schema).parquet(f"{root}-end")))
    available_now(stream, mode, root, idle=False)
    closing.write.mode("append").parquet(f"{root}-end")
    return available_now(stream, mode, root, idle=False)


def available_now(stream: DataFrame, mode: str, root: str | None = None, idle: bool = True) -> DataFrame:
    """Everything that the stream gives in all batches (``append``), or its last state (``complete``).
    ``idle``: batches without data follow where the watermark has moved.

    Each batch is a table in the shared folder, named by its number: a batch that is run again
    after a failure replaces its own table.
    """
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        last["n"] = number

    sink = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/_state").trigger(availableNow=True)
    # a query takes the session's settings as they are at its start
    before = spark.conf.get(IDLE)
    spark.conf.set(IDLE, before if idle else "false")
    try:
        q = sink.start()
    finally:
        spark.conf.set(IDLE, before)
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{root}/batch={last['n']}")
    return spark.read.schema(stream.schema).parquet(*[f"{root}/batch={n}" for n in range(last["n"] + 1)])
