"""Synthesis around a generator: cells of a taxonomy, prompts, parsing of replies, clean snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import order_key
from granary.session import small

CLUSTER = "struct<passage:string,queries:array<string>,hard_negative:string>"


def draw(seed: int, name: str, n: int, *key: Column) -> Column:
    """A number from 0 to n - 1, by hash of the seed, a name and the key; draws of other names are independent."""
    return F.pmod(F.conv(F.substring(order_key(seed, F.lit(name), *key), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def cells(spark: SparkSession, n: int, seed: int, options: dict[str, list[str]]) -> DataFrame:
    """(cell_id, one column per attribute): n cells with independent draws."""
    return spark.range(n).withColumnRenamed("id", "cell_id").select("cell_id", *(F.element_at(F.array(*map(F.lit, o)), draw(seed, k, len(o), F.col("cell_id")).cast("int") + 1).alias(k) for k, o in options.items()))


def with_attribute(cells: DataFrame, options: DataFrame, by: str, several: str, name: str, seed: int, key: str = "cell_id") -> DataFrame:
    """Cells joined with the options of their category (by, several), of which each draws one as `name`."""
    j = cells.join(small(options.select(by, several)), by)
    h = F.conv(F.substring(order_key(seed, F.lit(name), F.col(key)), 1, 8), 16, 10).cast("bigint")
    return j.withColumn(name, F.element_at(several, (F.pmod(h, F.size(several)) + 1).cast("int"))).drop(several)


def coverage(rows: DataFrame, by: str, options: DataFrame) -> DataFrame:
    """(by, n): how often each option occurs, those that don't with 0."""
    return options.join(rows.groupBy(by).agg(F.count("*").alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def prompt(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


def parse_cluster(reply: Column, least_passage: int = 120, least_query: int = 8, most_query: int = 300) -> Column:
    """The cluster in a reply, or null: what stands from the first { to the last }, read as JSON. The passage is trimmed and must
    have `least_passage` characters; queries are trimmed and kept within their lengths, at least one must be left; a hard
    negative shorter than a passage is null. Fences and prose around the JSON don't matter."""
    c = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), CLUSTER)
    queries = F.filter(F.transform(c["queries"], lambda q: F.trim(q)), lambda q: F.length(q).between(least_query, most_query))
    hard = F.trim(c["hard_negative"])
    good = F.struct(F.trim(c["passage"]).alias("passage"), queries.alias("queries"), F.when(F.length(hard) >= least_passage, hard).alias("hard_negative"))
    return F.when((F.length(F.trim(c["passage"])) >= least_passage) & (F.size(queries) > 0), good)


def snapshot(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the lines that are JSON objects, and one row with the number of lines, blank, broken and kept ones."""
    marked = lines.withColumn("_blank", F.trim(F.coalesce(line, F.lit(""))) == "").withColumn("_ok", F.col(line).isNotNull() & F.trim(line).startswith("{") & F.try_parse_json(line).isNotNull())
    counts = marked.agg(F.count("*").alias("n_lines"), F.count_if("_blank").alias("n_blank"), F.count_if(~F.col("_blank") & ~F.col("_ok")).alias("n_broken"), F.count_if("_ok").alias("n_kept"))
    return marked.filter("_ok").select(*lines.columns), counts
