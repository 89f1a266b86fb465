"""Seeded samples and splits. Every choice is a hash of the seed and a key, so that it is the same however the data lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import let
from granary.functions.text import order_key, pieces, snap_head, snap_tail, torn, without_controls
from granary.operators.ranges import ranked, running
from granary.session import materialize, small


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """Adds `place`, whose order is a seeded shuffle."""
    return df.withColumn("place", order_key(seed, *(F.col(k) for k in key)))


def head(df: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """n rows without replacement: the first of the seeded order, found by a top-k, not a sort of the whole."""
    return shuffled(df, seed, *key).orderBy("place", *key).limit(n)


def quota(df: DataFrame, strata: str, quotas: dict[str, int], seed: int, *key: str) -> DataFrame:
    """The first rows of the seeded order of each stratum, as many as its quota; strata without one are left out.

    A first cut per (stratum, part of the order) leaves at most 64 times the quota of a stratum before the last ranking,
    so that a large stratum isn't sorted in one task."""
    q = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    r = shuffled(df.filter(F.col(strata).isin(list(quotas))), seed, *key).withColumn("_quota", q[F.col(strata)]).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(64)))
    order = [F.col("place"), *(F.col(k) for k in key)]
    first = r.withColumn("_rn", F.row_number().over(Window.partitionBy(strata, "_part").orderBy(*order))).filter(F.col("_rn") <= max(quotas.values())).filter("_rn <= _quota")
    return first.withColumn("_rn", F.row_number().over(Window.partitionBy(strata).orderBy(*order))).filter(F.col("_rn") <= max(quotas.values())).filter("_rn <= _quota").drop("_rn", "_part", "_quota")


def windows(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(other columns, window_no, chunk): consecutive windows of `size` characters, so that a document has as many as its length asks."""
    keep = [c for c in docs.columns if c != text]
    return docs.filter(F.length(text) > 0).select(*keep, F.posexplode(pieces(F.col(text), size)).alias("window_no", "chunk"))


def clean_chunk(c: Column) -> Column:
    """A window snapped to white space, without control characters; null if it is torn."""
    return let(let(c, lambda x: snap_head(x)), lambda h: let(snap_tail(h), lambda s: F.when(~torn(s), F.trim(without_controls(s)))))


def distinct_heads(chunks: DataFrame, order: list[str], head: str = "head") -> DataFrame:
    """Of chunks with the same head (a key of their first characters) the first by `order`. The texts need not be there."""
    first = chunks.groupBy(head).agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    return chunks.join(first, order, "left_semi")


def passage(c: Column, key: Column, seed: int, size: int) -> tuple[Column, Column]:
    """(start, passage): a passage of `size` characters from a place that the key's hash chooses; a shorter text as a whole, from 0. One that begins within the text is snapped to its first space."""
    span = F.greatest(F.length(c) - size, F.lit(0)) + 1
    start = F.pmod(F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("bigint"), span.cast("bigint"))
    cut = F.substring(c, (start + 1).cast("int"), F.lit(size))
    return start, F.when(start > 0, snap_head(cut)).otherwise(cut)


def by_length(df: DataFrame, seed: int, n: int, key: str, text: str = "text") -> DataFrame:
    """n rows without replacement with a chance in proportion to their length: the smallest -ln(u) / length."""
    u = (F.conv(F.substring(order_key(seed, F.col(key)), 1, 8), 16, 10).cast("double") + 1.0) / F.lit(4294967297.0)
    return df.filter(F.length(text) > 0).withColumn("weight_key", F.round(-F.ln(u) / F.length(text), 12)).orderBy("weight_key", key).limit(n)


def holdout(df: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """Adds `split`: 'val' for the first n rows of the seeded order, else 'train'."""
    last = head(df, seed, n, *key).agg(F.max(F.struct("place", *key))).scalar()
    return shuffled(df, seed, *key).withColumn("split", F.when(F.struct("place", *key) <= last, "val").otherwise("train")).drop("place")


def fraction(df: DataFrame, seed: int, share: float, *key: str) -> DataFrame:
    """Adds `split`: 'test' for the first ceil(share x rows) rows of the seeded order."""
    r = shuffled(df, seed, *key)
    n = F.ceil(F.lit(share) * r.count())
    return ranked(r, [F.col("place"), *(F.col(k) for k in key)]).withColumn("split", F.when(F.col("rank") <= n, "test").otherwise("train")).drop("rank", "place")


def round_robin(docs: DataFrame, by: str, order: list[str], size: Column, per_source: int, total: int) -> DataFrame:
    """Rows in turn from each source, until a source has given `per_source` and all together `total`; rows that cross a limit are kept.

    Adds `turn` (a row's number within its source) and `before` (the size given before it). Numbers and sums within a source
    are those over the order of all sources less what stands before the source, so that a large one is cut into ranges. Only
    the columns of the order, which must be unique, and sizes are summed; the rows that are taken are then read by them."""
    keys = [by, *order]
    sized = docs.filter(F.col(by).isNotNull()).select(*keys, size.alias("_size"))
    run = materialize(running(sized, [F.col(k) for k in keys], {"turn": F.lit(1).cast("bigint"), "before": F.col("_size")}), "run")
    starts = small(run.groupBy(by).agg(F.min("turn").alias("_t"), F.min("before").alias("_b")))
    own = run.join(starts, by).withColumn("turn", F.col("turn") - F.col("_t") + 1).filter(F.col("before") - F.col("_b") < per_source).drop("_t", "_b")
    own = running(own, [F.col("turn"), *(F.col(k) for k in keys)], {"before": F.col("_size")}).filter(F.col("before") < total).drop("_size")
    return docs.join(small(materialize(own, "taken")), keys)


def masked_positions(tokens: Column, seed: int, epoch: int, per_mille: int, key: Column) -> Column:
    """For each position of a row's tokens whether it is masked in that epoch, about `per_mille` of 1,000, by hash of seed, epoch, key and position."""
    return F.transform(tokens, lambda _, i: F.pmod(F.conv(F.substring(order_key(seed, F.lit(epoch), key, i), 1, 8), 16, 10).cast("bigint"), F.lit(1000)) < per_mille)


def strided_tokens(placed: DataFrame, tokens: Column, every: int, most: int | None = None) -> DataFrame:
    """(token_ord, token): every `every`-th token of a stream whose rows know the place of their first token (`token_start`), at
    most `most` of them. Each row picks its own; nothing is sorted."""
    first = F.pmod(F.lit(every) - F.pmod(F.col("token_start"), F.lit(every)), F.lit(every))
    own = F.when(F.size(tokens) > first, F.transform(F.sequence(first.cast("int"), F.size(tokens) - 1, F.lit(every)), lambda i: F.struct((F.col("token_start") + i).alias("token_ord"), F.get(tokens, i).alias("token"))))
    out = placed.select(F.explode(own).alias("x")).select("x.*")
    return out if most is None else out.filter(F.col("token_ord") < most * every)


def masked(positions: DataFrame, seed: int, per_mille: int, *key: str) -> DataFrame:
    """Adds `is_masked` for about `per_mille` of 1,000 positions."""
    return positions.withColumn("is_masked", F.pmod(F.conv(F.substring(order_key(seed, *(F.col(k) for k in key)), 1, 8), 16, 10).cast("bigint"), F.lit(1000)) < per_mille)


def stride(df: DataFrame, order: list[Column], every: int, most: int | None = None) -> DataFrame:
    """Every `every`-th row in order, from the first on; at most `most` rows."""
    r = ranked(df, order, "_at").filter(F.col("_at") % every == 1 % every)
    return (r if most is None else r.filter(F.col("_at") <= (most - 1) * every + 1)).drop("_at")
