"""The manifest pipeline over streams, and streaming retention. The transformations are those of the batch pipeline.

Extensions beyond a plain stream of rows are marked as such: session merging and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kikitori.operators.metrics import best_n
from kikitori.session import drop_table


def stream_files(spark: SparkSession, kind: str, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream; ``files_per_batch`` bounds what waits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def run_once(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Everything there is, written exactly once to a folder of Parquet, then read back."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def retain_best(stream: DataFrame, score: str, step: str, n: int, checkpoint: str) -> Callable[[], DataFrame]:
    """Online retention of the n lowest (score, step): each micro-batch is merged into a table of at most n rows. Returns a
    function that gives the table after the run.

    The table lies beside the checkpoint, one folder for each batch, so a query that starts again from the checkpoint goes on
    with what it kept; a batch that is run again merges into the table of the batch before it and overwrites its own."""
    spark = stream.sparkSession
    schema = stream.select(step, score).schema
    kept = f"{checkpoint.rstrip('/')}-kept"

    def batches() -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(kept)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(f.getPath().getName().removeprefix("batch-")) for f in fs.listStatus(path) if done(f.getPath())) if fs.exists(path) else []

    def merge(batch: DataFrame, number: int) -> None:
        one, before = batch.select(step, score), [b for b in batches() if b < number]
        if before:
            one = one.unionByName(spark.read.schema(schema).parquet(f"{kept}/batch-{before[-1]}"))
        best_n(one, score, step, n).select(step, score).coalesce(1).write.mode("overwrite").parquet(f"{kept}/batch-{number}")
        for old in before[:-1]:  # the last one is what this batch would be run again from
            drop_table(spark, f"{kept}/batch-{old}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

    def table() -> DataFrame:
        found = batches()
        return spark.read.schema(schema).parquet(f"{kept}/batch-{found[-1]}") if found else spark.createDataFrame([], schema)

    return table


def smoothed(stream: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """Exponential smoothing of a stream per key: keys, order, value, smoothed. Each micro-batch's rows of a key are taken in
    ``order``; the level goes on from batch to batch as state. Null values leave the level as it is."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    import pandas as pd

    picked = stream.select(*keys, order, value)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields]

    def go_on(key, parts, state):
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for v in rows[value]:
            if pd.notna(v):
                level = float(v) if level is None else alpha * float(v) + (1 - alpha) * level
            out.append(level)
        if level is not None:
            state.update((level,))
        rows["smoothed"] = pd.Series(out, index=rows.index, dtype="float64")
        yield rows

    return picked.groupBy(*keys).applyInPandasWithState(go_on, ", ".join([*fields, "smoothed double"]), "level double", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Extension: rows of a key joined while they follow within ``gap``, with late rows up to ``late``."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, keys: list[str], ts: str, width: str, late: str) -> DataFrame:
    """Extension: counts in tumbling windows of event time."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"))
