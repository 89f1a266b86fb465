"""Training pairs: from sections, from labels, with mined negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import collapse, order_key, passage_text, query_text, without_prefixes
from granary.operators.ranges import rank_within
from granary.session import small


def section_pairs(filings: DataFrame, questions: dict[str, str], least: int = 100, most: int = 3000) -> DataFrame:
    """(filename, section, anchor, positive): one pair per section that `questions` has a question for and that has more than `least` characters."""
    long = filings.unpivot(["filename"], list(questions), "section", "text").filter(F.length(collapse(F.col("text"))) > least)
    q = F.create_map(*(F.lit(x) for kv in questions.items() for x in kv))
    return long.select("filename", "section", query_text(q[F.col("section")]).alias("anchor"), passage_text(F.substring("text", 1, most)).alias("positive"))


def label_pairs(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """(label, first, second): members of a label paired in a seeded order, odd places with the next; a label with one member gives none."""
    r = rank_within(rows.select(label, key).filter(F.col(label).isNotNull()), label, [order_key(seed, F.col(key)), F.col(key)])
    slot = r.withColumn("_slot", F.expr("(rank + 1) div 2"))
    return slot.groupBy(label, "_slot").agg(F.min_by(key, "rank").alias("first"), F.max_by(key, "rank").alias("second"), F.count("*").alias("_n")).filter("_n = 2").select(label, "first", "second")


def with_members(rows: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of labels with at least `least` members."""
    return rows.join(small(rows.groupBy(label).count().filter(F.col("count") >= least).select(label)), label, "left_semi")


def mined_once(mined: DataFrame) -> DataFrame:
    """(id, negatives): of an id that was mined more than once the longest list, of equally long ones the last as JSON."""
    return mined.groupBy("id").agg(F.max_by("negatives", F.struct(F.coalesce(F.size("negatives"), F.lit(-1)), F.to_json("negatives"))).alias("negatives"))


def negatives(pairs: DataFrame, mined: DataFrame, most: int = 4) -> DataFrame:
    """(id, negative_0 .. negative_{most-1}): the positives of the mined ids in their order; places beyond a list, and ids that don't exist, are null.

    Ids mined twice count once, with the longer list."""
    once = mined_once(mined)
    at = once.select("id", F.posexplode("negatives").alias("pos", "other")).filter(F.col("pos") < most)
    text = pairs.select(F.col("id").alias("other"), F.col("positive").alias("text"))
    got = at.join(text, "other", "left").groupBy("id").agg(*(F.max(F.when(F.col("pos") == k, F.col("text"))).alias(f"negative_{k}") for k in range(most)))
    return once.select("id").join(got, "id", "left")


def longer_than(pairs: DataFrame, least: dict[str, int], text: str = "positive", otherwise: int = 0) -> DataFrame:
    """Pairs whose text has more characters than its source asks for."""
    limit = F.lit(otherwise)
    for source, n in least.items():
        limit = F.when(F.col("source") == source, n).otherwise(limit)
    return pairs.filter(F.length(text) > limit)


def common_columns(rows: DataFrame, prefix: str = "negative_") -> list[str]:
    """Of the columns negative_k those that every row has: only they are exported."""
    names = [c for c in rows.columns if c.startswith(prefix)]
    missing = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names)).first()
    return [c for c in names if missing[c] == 0]


def bare(pairs: DataFrame) -> DataFrame:
    """Anchors and positives without their prefixes; empty ones are null."""
    return pairs.withColumn("anchor", without_prefixes(F.col("anchor"))).withColumn("positive", without_prefixes(F.col("positive")))


def corpus(pairs: DataFrame, mined: DataFrame) -> DataFrame:
    """(corpus_id, text): the passages to search, positives 'p<id>' and mined negatives 'n<id>-<place>', without empty ones; of an id mined twice the longer list."""
    own = pairs.select(F.concat(F.lit("p"), "id").alias("corpus_id"), F.col("positive").alias("text"))
    at = mined_once(mined).select("id", F.posexplode("negatives").alias("pos", "other"))
    other = at.join(pairs.select(F.col("id").alias("other"), F.col("positive").alias("text")), "other").select(F.concat(F.lit("n"), "id", F.lit("-"), "pos").alias("corpus_id"), "text")
    return own.unionByName(other).filter(F.length("text") > 0)


def by_row(rows: DataFrame, *beside: DataFrame, key: str = "row_id") -> DataFrame:
    """Tables that belong together row by row, joined on an explicit row number; rows that one of them lacks are left out."""
    for b in beside:
        rows = rows.join(b, key)
    return rows
