"""Live data: lines released in order, and a work queue replayed, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scatterlake.session import work_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the schema is that of the files at hand."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What the stream gives from all input at hand, through a parquet sink."""
    spark = stream.sparkSession
    out = work_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", work_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def released_lines(stream: DataFrame, scan: str = "user_id", line: str = "event_id", value: str = "value") -> DataFrame:
    """(scan, line, value): a line is released once a later line of its scan has come.

    State holds one waiting line for each scan. Lines of a scan are taken in
    order of ``line`` within a batch; one that comes after a later line was
    released passes at once.
    """

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if state.exists:
            waiting = state.get
            rows = pd.concat([pd.DataFrame({line: [waiting[0]], value: [waiting[1]]}), rows[[line, value]]])
        rows = rows.sort_values(line, kind="stable")
        last = rows.iloc[-1]
        state.update((int(last[line]), float(last[value])))
        done = rows.iloc[:-1]
        yield pd.DataFrame({"scan": key[0], "line": done[line].astype("int64"), "value": done[value].astype("float64")})

    grouped = stream.where(F.col(value).isNotNull()).select(scan, line, value).groupBy(scan)
    return grouped.applyInPandasWithState(release, "scan long, line long, value double", "line long, value double", "append", GroupStateTimeout.NoTimeout)


def replay_queue(stream: DataFrame, accept, label: str = "queue") -> DataFrame:
    """(status, rows...) of a work queue: rows that ``accept`` takes are done, the others failed.

    Each micro batch writes both parts under its own number, so a batch that
    is run again after a failure overwrites itself.
    """
    spark = stream.sparkSession
    out = work_path(spark, label)

    def work(batch: DataFrame, number: int) -> None:
        status = F.when(F.coalesce(accept, F.lit(False)), "done").otherwise("failed")
        batch.withColumn("status", status).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", work_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
