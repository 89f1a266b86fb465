"""Where queries and their SQL are registered, and pieces of SQL that many share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import small, table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space as the engine has it, for DuckDB.
SPACE = r"[\s\x0B\p{Z}]+"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def collapsed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def runs_key(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({c}), '[0-9]+', '#', 'g'), '[^\p{{L}}\p{{N}}_\s#]', '', 'g')"


def tokens(c: str) -> str:
    """Lexical tokens of a text, as a list."""
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def documents(spark: SparkSession, where: str) -> DataFrame:
    """Documents with a text, and the rank of their source (999 without one)."""
    ranks = small(table(spark, where, "source_targets").select("source", "src_rank"))
    return texts(spark, where, "documents").filter("text is not null").join(ranks, "source", "left").withColumn("src_rank", F.coalesce("src_rank", F.lit(999)))


DOCUMENTS = "d as (select documents.*, coalesce(src_rank, 999) as src_rank from documents left join source_targets using (source) where text is not null)"
