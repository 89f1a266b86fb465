"""Packing a token stream into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import let
from granary.functions.text import lexical_tokens, pieces
from granary.operators.ranges import running


def split_long(docs: DataFrame, size: int = 50_000, text: str = "text") -> DataFrame:
    """(other columns, piece_no, piece): texts in pieces of at most `size` characters. Null texts give no piece."""
    keep = [c for c in docs.columns if c != text]
    return docs.filter(F.col(text).isNotNull()).select(*keep, F.posexplode(pieces(F.col(text), size)).alias("piece_no", "piece"))


def stream(docs: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """(key, order, n_tokens, token_start): token_start is the place of a document's first token in the stream of all documents in `order`.

    A document is its lexical tokens between a start and an end mark, in the place of a subword tokenizer; a null text has
    none. Only keys and counts are ordered; texts stay where they are."""
    n = F.when(F.col(text).isNotNull(), F.size(lexical_tokens(F.col(text))) + 2).otherwise(0).cast("bigint")
    sized = docs.select(*dict.fromkeys([key, *order]), n.alias("n_tokens"))
    return running(sized, [F.col(o) for o in order], {"token_start": F.col("n_tokens")})


def blocks(docs: DataFrame, key: str, order: list[str], block: int, text: str = "text") -> DataFrame:
    """(block_id, tokens): the full blocks of the stream; the rest at its end is dropped. Marks are '<s>' and '</s>'.

    A text is cut into tokens once, and these into its parts of blocks within the row, so that the work is in proportion to
    its length. `key` must be unique."""
    placed = stream(docs, key, order, text).filter("n_tokens > 0").select(key, "token_start", "n_tokens")
    rows = docs.select(key, F.col(text).alias("_text")).join(placed, key)

    def parts(tokens: Column) -> Column:
        def part(b: Column) -> Column:
            start = F.greatest(b * block, F.col("token_start"))
            end = F.least((b + 1) * block, F.col("token_start") + F.col("n_tokens"))
            return F.struct(b.alias("block_id"), start.alias("at"), F.slice(tokens, (start - F.col("token_start") + 1).cast("int"), (end - start).cast("int")).alias("t"))

        return F.transform(F.sequence(F.expr(f"token_start div {block}"), F.expr(f"(token_start + n_tokens - 1) div {block}")), part)

    tokens = F.concat(F.array(F.lit("<s>")), lexical_tokens(F.col("_text")), F.array(F.lit("</s>")))
    cut = rows.select(F.explode(let(tokens, parts)).alias("p")).select("p.*")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]))
    return cut.groupBy("block_id").agg(joined.alias("tokens")).filter(F.size("tokens") == block)


def by_id(blocks: DataFrame, *ids: int) -> DataFrame:
    """Single blocks by their numbers."""
    return blocks.filter(F.col("block_id").isin(list(ids)))


def validation_head(blocks: DataFrame, train_blocks: int, most: int) -> DataFrame:
    """The fixed head of the validation blocks: the first `most` after those for training."""
    return blocks.filter((F.col("block_id") >= train_blocks) & (F.col("block_id") < train_blocks + most))


def meta(placed: DataFrame, block: int, val_blocks: int, vocab_size: int, dtype: str = "uint16") -> DataFrame:
    """One row: vocab_size, block_size, dtype, total_tokens, train_tokens, val_tokens, train_blocks, val_blocks.

    The last `val_blocks` full blocks are for validation, fewer if there are not as many."""
    total = F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint")
    m = placed.agg(total.alias("total_tokens")).withColumn("_blocks", F.expr(f"total_tokens div {block}"))
    m = m.withColumn("val_blocks", F.least(F.lit(val_blocks).cast("bigint"), F.col("_blocks"))).withColumn("train_blocks", F.col("_blocks") - F.col("val_blocks"))
    return m.select(F.lit(vocab_size).alias("vocab_size"), F.lit(block).alias("block_size"), F.lit(dtype).alias("dtype"), "total_tokens", (F.col("train_blocks") * block).alias("train_tokens"), (F.col("val_blocks") * block).alias("val_tokens"), "train_blocks", "val_blocks")
