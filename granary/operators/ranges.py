"""Running sums and ranks over a whole table, without a window that gathers it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize, small


def running(df: DataFrame, order: list[Column], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`df` with, for each name in `values`, the sum of that value over all rows that come before in `order`, which should be unique.

    The table is cut into ranges of the order and written; each range is summed; the sums of the ranges (one row each) are
    summed in order and broadcast; within a range a window adds the rest. Null values count 0. A column of `df` with the name
    of a value is replaced; other names can't clash, as the row travels as one struct. An empty table stays empty."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in df.columns if c not in values]
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.struct(*order).alias("order"), F.struct(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in values.items())).alias("v"))
    keyed = materialize(keyed.repartitionByRange(n, "order").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    sums = keyed.groupBy("range").agg(*(F.sum(f"v.{k}").alias(k) for k in values))
    sums = sums.select("range", F.struct(*(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in values)).alias("b"))
    inside = Window.partitionBy("range").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(F.broadcast(sums), "range")
    return out.select("row.*", *((F.col(f"b.{k}") + F.coalesce(F.sum(f"v.{k}").over(inside), F.lit(0))).alias(k) for k in values))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """`df` with its rows numbered from 1 in `order`."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, parts).withColumn(name, F.col(name) + 1)


def rank_within(df: DataFrame, by: str, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """`df` with the rows of each `by` numbered from 1 in `order`; a group with a third of all rows is cut into ranges like the rest. Rows with a null `by` are left out."""
    r = materialize(ranked(df.filter(F.col(by).isNotNull()), [F.col(by), *order], "_rank", parts), "ranked")
    starts = r.groupBy(by).agg((F.min("_rank") - 1).alias("_start"))
    return r.join(small(starts), by).withColumn(name, F.col("_rank") - F.col("_start")).drop("_rank", "_start")
