"""Problem 4: texts into blocks of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tokens import DEFAULT, FOLDER, token_counts
from granary.session import materialize, small

#: Items that are packed together. A group's loss is about one block, so that larger groups waste less and take longer.
GROUP_ITEMS = 8192
SEED = 20
#: Profiles that one call may pack for; they are read to the driver.
MAX_PROFILES = 1000


class Tree:
    """A tournament tree over the free space of bins: each node has the most of its two children; the winner of a match is the
    left child if it fits. `place` finds the leftmost bin with enough space in log2(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        bin_no = i - self.leaves
        free[i] -= size
        while i > 1:
            i //= 2
            most = free[2 * i] if free[2 * i] >= free[2 * i + 1] else free[2 * i + 1]
            if free[i] == most:
                break
            free[i] = most
        return bin_no


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items are taken in falling order of size, ties in the order given. No item exceeds the capacity."""
    out = np.zeros(len(sizes), np.int64)
    if len(sizes):
        tree = Tree(len(sizes), capacity)
        for i in np.argsort(-sizes, kind="stable").tolist():
            out[i] = tree.place(int(sizes[i]))
    return out


def pieces(counts: DataFrame, settings: DataFrame, key: str = "doc_ord") -> DataFrame:
    """(profile, block_size, key, piece, first_token, n_tokens): one piece per text, or for a text over the block size its full blocks and the rest."""
    known = settings.filter("block_size > 0").select("profile", "block_size").orderBy("block_size", "profile").limit(MAX_PROFILES + 1).collect()
    if len(known) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    options = F.array(*(F.struct(F.lit(r["profile"]).cast("string").alias("profile"), F.lit(r["block_size"]).cast("int").alias("block_size")) for r in known))
    sized = counts.filter("n_tokens > 0").select(key, "n_tokens", F.explode(options.cast("array<struct<profile:string,block_size:int>>")).alias("o")).select(key, "n_tokens", "o.*")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n_tokens - 1) div block_size"))))
    return cut.select("profile", "block_size", key, "piece", (F.col("piece") * F.col("block_size")).alias("first_token"), F.least("block_size", F.col("n_tokens") - F.col("piece") * F.col("block_size")).alias("n_tokens"))


def pack(records: DataFrame, settings: DataFrame, key: str = "doc_ord", text: str = "text", group_items: int = GROUP_ITEMS, name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """(profile, block_id, doc_ord, piece, first_token, n_tokens, fill): the block of each text or piece under each profile, and the tokens in that block.

    Method: first-fit decreasing over a tournament tree of free space, apart in groups of about `group_items` items that a
    hash of the key makes, so that a group's size doesn't depend on sources or order. Only a text over the block size is
    cut; its full pieces are blocks of their own and skip the packing. Texts without tokens (null, empty) have no block.
    Equal sizes go by key and piece. Settings without a positive block size are left out; an empty table gives no rows."""
    counts = materialize(token_counts(records, key, text, name, folder), "counts")
    groups = max(1, round(counts.count() / group_items))
    cut = pieces(counts, settings, key).withColumn("grp", F.pmod(F.xxhash64(F.lit(SEED), key, "piece"), F.lit(groups)).cast("int"))

    def fill(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([(key, "ascending"), ("piece", "ascending")])
        if not len(t):
            return
        n, cap = t.column("n_tokens").to_numpy(), t.column("block_size")[0].as_py()
        bins = first_fit_decreasing(n, cap)
        t = t.append_column("bin", pa.array(bins)).append_column("fill", pa.array(np.bincount(bins, weights=n).astype(np.int64)[bins]))
        yield from t.combine_chunks().to_batches()

    whole, part = cut.filter("n_tokens = block_size"), cut.filter("n_tokens < block_size")
    done = part.groupBy("profile", "grp").applyInArrow(fill, part.withColumn("bin", F.lit(0).cast("bigint")).withColumn("fill", F.lit(0).cast("bigint")).schema)
    cols = [key, "piece", "first_token", F.col("n_tokens").cast("bigint").alias("n_tokens"), "fill"]
    return done.select("profile", F.format_string("g%d-%d", "grp", "bin").alias("block_id"), *cols).unionByName(
        whole.withColumn("fill", F.col("n_tokens").cast("bigint")).select("profile", F.concat_ws("-", F.lit("w"), key, "piece").alias("block_id"), *cols)
    )


def block_fill(packed: DataFrame, settings: DataFrame) -> DataFrame:
    """(profile, n_blocks, n_items, n_tokens, fill_share): how full the blocks of each profile are."""
    blocks = packed.groupBy("profile", "block_id").agg(F.count("*").alias("items"), F.max("fill").alias("fill"))
    total = blocks.groupBy("profile").agg(F.count("*").alias("n_blocks"), F.sum("items").alias("n_items"), F.sum("fill").alias("n_tokens"))
    return total.join(small(settings.select("profile", "block_size")), "profile").select("profile", "n_blocks", "n_items", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_blocks") * F.col("block_size")), 6).alias("fill_share"))
