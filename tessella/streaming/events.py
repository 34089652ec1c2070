"""Streaming forms: windowed counts with a watermark, and idempotent incremental import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tessella.sources.tables import existing, shared_folder


def windowed_counts(events: DataFrame, time: str, group: str, value: str, width: str = "1 day", late: str = "10 days") -> DataFrame:
    """Counts and sums in tumbling windows, of a stream or a batch; events later than ``late`` behind the newest are dropped from a stream."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    counts = e.groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), group, "n", "total")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and return its last result, written where executors share it."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")


def import_stream(batches: DataFrame, path: str, key: str, state: str) -> None:
    """Append each micro-batch's rows whose key no earlier batch stored.

    A batch is put down under its own number, over what an attempt of it left, and looks at
    earlier batches only: a batch that is run again, after a loss or a restart, adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if number and existing(spark, f"{path}/batch=0"):
            before = spark.read.parquet(path).where(F.col("batch") < number)
            fresh = fresh.join(before.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    batches.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def first_of_each(stream: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``accepted`` of every row of a stream: the first row of a key is accepted, in later batches as well; all others are not.

    The state of a key is that it was taken. Within a batch rows of a key are taken in ``order``;
    rows without a key are never accepted.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", accepted boolean"

    def decide(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        taken = state.exists or rows[key].iloc[0] is None
        out = rows[keep].assign(accepted=False)
        if not taken:
            out.iloc[0, out.columns.get_loc("accepted")] = True
            state.update((True,))
        yield out

    return stream.groupBy(key).applyInPandasWithState(decide, schema, "taken boolean", "append", "NoTimeout")


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream of new rows over what is there now and return them, written where executors share it."""
    out = shared_folder(stream.sparkSession, name)
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/result").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/result")


def chain_increment(path: str, first: DataFrame, second: DataFrame, number: int) -> None:
    """Add to ``path`` the pairs of a chain that new edges ``first`` (s, m) and ``second`` (m, o) make with each other and with all earlier ones.

    What is materialised is never computed again: new edges meet old ones and new ones only. A
    batch is put down under its number, so running it again changes nothing.
    """
    spark = first.sparkSession
    first.select("s", "m").distinct().write.mode("overwrite").parquet(f"{path}/first/batch={number}")
    second.select("m", "o").distinct().write.mode("overwrite").parquet(f"{path}/second/batch={number}")
    a, b = spark.read.parquet(f"{path}/first"), spark.read.parquet(f"{path}/second")
    new, old = F.col("batch") == number, F.col("batch") < number
    pairs = a.where(new).drop("batch").join(b.where(F.col("batch") <= number).drop("batch"), "m").unionByName(a.where(old).drop("batch").join(b.where(new).drop("batch"), "m"))
    fresh = pairs.select("s", "o").distinct()
    if number:
        fresh = fresh.join(spark.read.parquet(f"{path}/pairs").where(old).select("s", "o"), ["s", "o"], "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")
