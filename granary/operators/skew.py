"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that may be salted. A group outside of the largest HOT_GROUPS has at most rows / HOT_GROUPS rows.
HOT_GROUPS = 4096
ROWS_PER_SALT = 50_000


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner join of `rows` with `groups` (one row per key, `size` = its number of rows) on `keys`.

    Keys of more than `rows_per_salt` rows are cut into salts: their one row of `groups` is repeated per salt, their rows
    choose a salt by hash of `spread`. Only the keys and salts of the HOT_GROUPS largest groups are broadcast, a fixed
    number of fixed-width rows. Null keys match nothing."""
    hot = (
        groups.filter(F.col(size) > rows_per_salt)
        .orderBy(F.desc(size))
        .limit(HOT_GROUPS)
        .select(*keys, F.ceil(F.col(size) / rows_per_salt).cast("int").alias("_salts"))
    )
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = groups.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
