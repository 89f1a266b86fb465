"""Batches in which no label comes twice."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import order_key
from granary.operators.ranges import rank_within


def label_free(rows: DataFrame, label: str, key: str, size: int, seed: int) -> DataFrame:
    """(key, label, batch_round, batch_no): full batches of `size` rows with distinct labels; rows left over in a round are dropped.

    The n-th row of each label, in a seeded order, is in round n, so that a round has each label at most once; within a
    round the rows are cut into batches in seeded order. Rows without a label are left out."""
    place = order_key(seed, F.col(key))
    r = rank_within(rows.select(key, label), label, [place, F.col(key)], "batch_round")
    r = rank_within(r, "batch_round", [order_key(seed + 1, F.col(key)), F.col(key)], "_n").withColumn("batch_no", F.expr(f"(_n - 1) div {size}"))
    full = r.groupBy("batch_round").agg(F.expr(f"count(*) div {size}").alias("_full"))
    return r.join(full, "batch_round").filter("batch_no < _full").select(key, label, "batch_round", "batch_no")


def greedy(order: list[tuple[int, str]], size: int, seed: int) -> Iterator[list[int]]:
    """The exact greedy filling, for a stream that one machine holds: the open batch has one row per label; a row whose label it
    has is put off to a second round, in shuffled order, and left out if it collides there too. A short last batch is dropped."""
    open_: dict[str, int] = {}
    put_off: list[tuple[int, str]] = []
    for second in (False, True):
        if second:
            random.Random(seed).shuffle(put_off)
        for key, label in list(put_off) if second else order:
            if label not in open_:
                open_[label] = key
                if len(open_) == size:
                    yield list(open_.values())
                    open_ = {}
            elif not second:
                put_off.append((key, label))
