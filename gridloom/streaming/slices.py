"""Streams of slices: Structured Streaming over rows that carry the index of their slice, and time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..frame import ArrayFrame


def read_slices(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def loop(stream: DataFrame, dims, tool: Callable[[ArrayFrame], ArrayFrame], sink: str, checkpoint: str):
    """tool over every micro-batch of slices; results are Parquet, a folder for each batch, so that a batch that is
    tried again replaces its own. A slice index must arrive whole."""

    def step(df: DataFrame, batch: int) -> None:
        tool(ArrayFrame.of(df, dims)).df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loop_whole(stream: DataFrame, dims, slice_dim: int, cells: int, tool: Callable[[ArrayFrame], ArrayFrame], store: str, sink: str, checkpoint: str):
    """Like loop, for slices whose rows may be spread over micro-batches and come in any order: rows wait in store until
    their slice (of so many rows) is whole, and the tool sees every slice once."""
    key = f"d{slice_dim}"

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{store}/batch={batch}")
        held = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(store).where(F.col("batch") <= batch)
        whole = held.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("last")).where((F.col("n") == cells) & (F.col("last") == batch))
        ready = held.join(F.broadcast(whole.select(key)), key).drop("batch").select(*df.columns)
        tool(ArrayFrame.of(ready, dims)).df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tee(stream: DataFrame, sinks: list[str], checkpoint: str):
    """Each micro-batch to several sinks, a folder for each batch."""

    def step(df: DataFrame, batch: int) -> None:
        df.persist()
        for s in sinks:
            df.write.mode("overwrite").parquet(f"{s}/batch={batch}")
        df.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) so far, as a stateful aggregation; for output mode complete or update."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def collected(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives when it has read all that is there: run once, kept in a table of the session."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def tumbling(df: DataFrame, time: str, width: str, value: str, late: str | None = None) -> DataFrame:
    """Count and mean for each window; with late, a watermark for streams."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def sliding(df: DataFrame, time: str, width: str, step: str, value: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.window(time, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def sessions(df: DataFrame, time: str, key: str, gap: str, value: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")
