"""Queries that run a stream over what is there and return its outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.registry import query
from granary.session import scratch, table
from granary.streaming import loops


def _stream(spark: SparkSession, where: str, name: str) -> DataFrame:
    # a table may be one file or a folder of files; the pattern fits both
    return loops.files(spark, f"{where}/{name}.parque[t]", table(spark, where, name).schema)


@query("select event_id, user_id, event_type from events")
def stream_append_publish(spark: SparkSession, where: str) -> DataFrame:
    """Events appended as JSON lines by one stream, and pushed from there by another when enough have come."""
    at, schema = scratch(spark), "event_id bigint, user_id bigint, event_type string"
    loops.append(_stream(spark, where, "events").select("event_id", "user_id", "event_type"), f"{at}/lines", f"{at}/state").awaitTermination()
    lines = loops.files(spark, f"{at}/lines", schema, "json")
    push = lambda rows, batch: rows.write.parquet(f"{at}/pushed/batch={batch}")
    loops.publish(lines, push, f"{at}/pending", f"{at}/push", 100).awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/pushed").drop("batch")


@query("select 0 as n_pushed, count(*) as n_pending from events")
def stream_publish_waits(spark: SparkSession, where: str) -> DataFrame:
    """Under the threshold nothing is pushed; the rows wait."""
    at = scratch(spark)

    def push(rows: DataFrame, batch: int) -> None:
        raise AssertionError("pushed under the threshold")

    loops.publish(_stream(spark, where, "events").select("event_id"), push, f"{at}/pending", f"{at}/push", 10**9).awaitTermination()
    return spark.read.parquet(f"{at}/pending").agg(F.lit(0).alias("n_pushed"), F.count("*").alias("n_pending"))


@query("select distinct md5(text) as digest from documents where text is not null")
def stream_dedup(spark: SparkSession, where: str) -> DataFrame:
    """The distinct texts of a stream of documents; which row of equal ones comes first is open."""
    at = scratch(spark)
    s = _stream(spark, where, "documents").filter("text is not null").select(F.md5("text").alias("digest"))
    loops.distinct_into(s, "digest", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("digest")


@query("select distinct event_id % 50 as step, case when event_id % 50 < 10 then -1 else event_id % 50 * 2 end as result from events")
def stream_probe(spark: SparkSession, where: str) -> DataFrame:
    """Steps that come by stream are probed once; ten have a result already."""
    at = scratch(spark)
    spark.range(10).select(F.col("id").alias("step"), F.lit(-1).cast("bigint").alias("result")).write.parquet(f"{at}/results")
    steps = _stream(spark, where, "events").select((F.col("event_id") % 50).alias("step"))
    loops.probe(steps, f"{at}/results", lambda rows: rows.select("step", (F.col("step") * 2).alias("result")), f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/results")


@query("select distinct event_id % 200 as step from events where event_id % 200 % 7 = 0")
def stream_archive(spark: SparkSession, where: str) -> DataFrame:
    """Of the steps that come by stream those that are a target are kept, once."""
    at = scratch(spark)
    steps = _stream(spark, where, "events").select((F.col("event_id") % 200).alias("step"))
    loops.archive(steps, spark.range(0, 200, 7).withColumnRenamed("id", "step"), f"{at}/kept", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/kept")


@query(
    """with e as (select event_type as series, event_id as step, value, value < 20 as bad, event_id * 10 // 10000 as tenth from events),
m as (select *, coalesce(max(tenth) over (partition by series order by step rows between unbounded preceding and 1 preceding), 0) as prev, sum(case when bad then 0 else 1 end) over (partition by series order by step) as grp from e),
r as (select *, row_number() over (partition by series, grp, bad order by step) as run from m), p as (select *, lag(bad) over w as was_bad, lag(run) over w as was_run from r window w as (partition by series order by step))
select series, 'milestone' as kind, step, value from p where tenth > prev union all select series, 'outage', step, value from p where bad and run = 4 union all select series, 'recovered', step, value from p where not bad and was_bad and was_run >= 4"""
)
def stream_alerts(spark: SparkSession, where: str) -> DataFrame:
    """Milestones, outages and recoveries of each event type, with keyed state."""
    at = scratch(spark)
    s = _stream(spark, where, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("step"), "value")
    out = loops.alerts(s, "series", "step", "value", 10_000, lambda rows: rows["value"] < 20)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(loops.ALERT).parquet(f"{at}/out")
