"""The polling loops as Structured Streaming: publishing, appending, deduplication, alerts, archiving, supervision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.session import small


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """A stream of the files under a path (which may be a pattern); `per_batch` files a batch hold back the rest."""
    r = spark.readStream.schema(schema)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.format(fmt).load(path)


def _start(writer, every: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream as JSON lines. Started again it goes on after what is committed; without `every` it ends with what is there."""
    return _start(stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint), every)


def publish(stream: DataFrame, push: Callable[[DataFrame, int], None], pending: str, checkpoint: str, threshold: int, every: str | None = None) -> StreamingQuery:
    """Calls `push` (rows, batch number) when at least `threshold` rows came since the last push that succeeded.

    Rows wait in the folder `pending`, one folder per batch, which a batch that runs again replaces; a push that fails leaves
    them there, and the next batch tries again."""

    def on_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{pending}/batch={batch}")
        waiting = spark.read.schema(rows.schema).parquet(pending).drop("batch")
        if waiting.limit(threshold).count() >= threshold:
            push(waiting, batch)
            p = spark._jvm.org.apache.hadoop.fs.Path(pending)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return _start(stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint), every)


def distinct(stream: DataFrame, key: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first arrival of each key. With an event time and a delay the state of old keys is dropped; without, it grows with the keys."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def distinct_into(stream: DataFrame, key: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends the first arrival of each key to a table, of which one folder is written per batch. What has come is known from the
    table itself, so that no state is kept in memory however many keys there are; a batch that runs again replaces its folder."""

    def on_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, batch_no bigint").parquet(path)
            new = new.join(old.filter(F.col("batch_no") < batch).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch_no={batch}")

    return _start(stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint), every)


def probe(stream: DataFrame, results: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "step", every: str | None = None) -> StreamingQuery:
    """Runs `compute` on the keys of each batch that have no result yet, and appends what it returns."""
    from granary.sources.sinks import append_missing

    def on_batch(rows: DataFrame, batch: int) -> None:
        append_missing(compute(rows.dropDuplicates([key])), results, key)

    return _start(stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint), every)


def archive(stream: DataFrame, targets: DataFrame, store: str, checkpoint: str, key: str = "step", every: str | None = None) -> StreamingQuery:
    """Keeps the rows whose key is a target and isn't kept yet. A batch that runs again adds nothing twice."""
    return probe(stream.join(small(targets.select(key).distinct()), key), store, lambda rows: rows, checkpoint, key, every)


ALERT = "series string, kind string, step bigint, value double"


def alerts(stream: DataFrame, series: str, step: str, value: str, most: int, failing: Callable[[pd.DataFrame], pd.Series], streak: int = 4, parts: int = 10) -> DataFrame:
    """(series, kind, step, value): 'milestone' for each further tenth of `most` steps, 'outage' after `streak` failing rows in a
    row and 'recovered' at the next sound one. State per series: last tenth, streak, whether it is out."""

    def on_rows(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tenth, run, out = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(frames)).sort_values(step)
        found = []
        for s, v, bad in zip(rows[step], rows[value], failing(rows)):
            if s * parts // most > tenth:
                tenth = int(s * parts // most)
                found.append((key[0], "milestone", s, v))
            run = run + 1 if bad else 0
            if run == streak and not out:
                out = True
                found.append((key[0], "outage", s, v))
            elif out and not bad:
                out = False
                found.append((key[0], "recovered", s, v))
        state.update((tenth, run, out))
        yield pd.DataFrame(found, columns=["series", "kind", "step", "value"])

    return stream.groupBy(series).applyInPandasWithState(on_rows, ALERT, "tenth int, run int, out boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per window of event time and key; rows later than the delay are left out, and a window is final when the delay is over."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
