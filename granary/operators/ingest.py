"""Ingestion: minimum length, budgets, unions of sources, sections of filings, corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import order_key
from granary.operators.ranges import running
from granary.session import materialize, small

MIN_CHARS = 200


def long_enough(docs: DataFrame, text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """Documents of at least `least` characters after trimming."""
    return docs.filter(F.length(F.trim(text)) >= least)


def prefix_budget(docs: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows in order until the running size reaches the budget; the row that crosses it is kept. Adds `before`, the size of all rows before.

    Only the columns of the order, which must be unique, and sizes are summed; the few rows that stay are then read by them."""
    run = running(docs.select(*order, size.alias("_size")), [F.col(o) for o in order], {"before": F.col("_size")})
    return _rows_of(docs, materialize(run.filter(F.col("before") < budget).drop("_size"), "kept"), order)


def _rows_of(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(small(kept), keys)


def first_of_each(parts: dict[str, DataFrame], order: list[str], most: int, name: str = "part") -> DataFrame:
    """The first `most` rows of each of some tables in order, with the table's name, as builders that stop at a number of rows take them."""
    return union_all([p.orderBy(*order).limit(most).withColumn(name, F.lit(k)) for k, p in parts.items()])


def union_of_halves(first: DataFrame, second: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """Two sources with half of the budget each."""
    return prefix_budget(first, order, size, budget // 2).unionByName(prefix_budget(second, order, size, budget // 2), allowMissingColumns=True)


def sections_text(filings: DataFrame, sections: list[str] | None = None) -> Column:
    """The non-blank sections of a filing joined by blank lines; an empty text if there is none."""
    names = sections or [c for c in filings.columns if c.startswith("section_")]
    return F.concat_ws("\n\n", *(F.when(F.trim(F.regexp_replace(F.col(c), r"[\s\p{Z}]+", " ")) != "", F.col(c)) for c in names))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def shuffled_files(paths: DataFrame, seed: int, path: str = "path") -> DataFrame:
    """Paths with their place in a seeded order."""
    return paths.withColumn("place", order_key(seed, F.col(path)))


def corpus_stats(docs: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Documents, characters, bytes, longest document and share of all characters, per source and in total (`by` null, is_total)."""
    aggs = [F.count("*").alias("n_docs"), F.count(text).alias("n_texts"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n_bytes"), F.coalesce(F.max(F.length(text)), F.lit(0)).cast("bigint").alias("longest")]
    r = materialize(docs.rollup(by).agg(*aggs, F.grouping(by).cast("int").alias("is_total")), "stats")
    total = r.agg(F.max(F.when(F.col("is_total") == 1, F.col("n_chars")))).scalar()
    return r.withColumn("share", F.round(F.col("n_chars") / F.greatest(total, F.lit(1)), 9))


def budget_per_source(docs: DataFrame, by: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """The prefix of each source, in order, until its running size reaches the budget. One pass for all sources: the running
    sum over (source, order), which must be unique, less what stands before the source (one row per source). Only those
    columns and sizes are summed; the rows that stay are then read by them. Rows with a null source are left out."""
    keys = [by, *order]
    run = materialize(running(docs.select(*keys, size.alias("_size")), [F.col(k) for k in keys], {"before": F.col("_size")}), "run")
    starts = run.groupBy(by).agg(F.min("before").alias("_start"))
    own = run.join(small(starts), by).withColumn("before", F.col("before") - F.col("_start")).filter(F.col("before") < budget).drop("_start", "_size")
    return _rows_of(docs, materialize(own, "kept"), keys)
