"""Public tokenizers on the executors, and problem 2: tokens per source, language and domain."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import materialize, small

#: Folder of the vocabulary files, and the tokenizer used where none is named.
FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
#: How byte_bpe_50k cuts a text into words (fixed value of that public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of texts that a task remembers the counts of.
REMEMBERED = 1 << 24


def read_ranks(name: str = DEFAULT, folder: str = FOLDER) -> bytes:
    """The vocabulary file of a byte-level tokenizer: one base64 piece and its rank a line."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def tokenizer_hash(name: str = DEFAULT, folder: str = FOLDER) -> str:
    """Changes with the vocabulary or the pattern, so that counts of another tokenizer are never reused."""
    return hashlib.sha256(read_ranks(name, folder) + PATTERN.encode()).hexdigest()[:16]


class Encoder:
    """The tokenizer, built once per Python worker from the broadcast vocabulary (about 1 MB, whatever the corpus)."""

    _built: dict[str, object] = {}

    def __init__(self, spark: SparkSession, name: str = DEFAULT, folder: str = FOLDER):
        self.key, self.raw = tokenizer_hash(name, folder), spark.sparkContext.broadcast(read_ranks(name, folder))

    def encode(self, text: str) -> list[int]:
        if self.key not in self._built:
            import tiktoken

            self._built[self.key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parse_ranks(self.raw.value), special_tokens={})
        return self._built[self.key].encode_ordinary(text)


def token_counts(records: DataFrame, key: str, text: str = "text", name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """(key, n_tokens): tokens of each text, 0 for an empty or null one. No row leaves its partition; a text that comes again in
    the same task is not encoded again, while the texts remembered have at most REMEMBERED characters."""
    enc = Encoder(records.sparkSession, name, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        held = 0
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                n = seen.get(t)
                if n is None:
                    n = len(enc.encode(t)) if t else 0
                    held += len(t or "")
                    if held > REMEMBERED:
                        seen, held = {}, len(t or "")
                    seen[t] = n
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["k", "n_tokens"])

    kind = records.select(key).schema[0].dataType.simpleString()
    return records.select(F.col(key), F.col(text)).mapInArrow(count, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def language(c: Column) -> Column:
    """The language of mixed spellings: lower case, without region; null and blank are 'und'."""
    return F.coalesce(F.nullif(F.trim(F.lower(F.substring_index(F.substring_index(c, "-", 1), "_", 1))), F.lit("")), F.lit("und"))


CELL = ["source", "lang", "domain"]


@dataclass
class Ledger:
    """counts: (content, tokenizer, n_tokens), one row per text ever encoded. docs: (key, content, source, lang, domain, tokenizer)
    of the snapshot. cube: (source, lang, domain, n_docs, n_tokens, tokenizer). fresh: the counts that the last update added.
    All are written tables, so that they hold when the records' table is overwritten."""

    counts: DataFrame
    docs: DataFrame
    cube: DataFrame
    fresh: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def version(spark: SparkSession, path: str) -> int:
    """The number of the last complete version of a ledger in a folder, 0 if there is none."""
    return spark.read.parquet(f"{path}/done").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] if _exists(spark, f"{path}/done") else 0


def load(spark: SparkSession, path: str) -> Ledger | None:
    """The last complete version of a ledger; None if there is none. What an update that failed has left is not read."""
    n = version(spark, path)
    if not n:
        return None
    counts = spark.read.parquet(*(f"{path}/counts/{i}" for i in range(1, n + 1)))
    return Ledger(counts, spark.read.parquet(f"{path}/docs/{n}"), spark.read.parquet(f"{path}/cube/{n}"), spark.read.parquet(f"{path}/counts/{n}"))


def save(ledger: Ledger, path: str) -> None:
    """Writes a ledger as the next version of that in a folder: its fresh counts beside the older ones, its documents and its cube,
    and last the mark that the version is complete. `ledger` must come from an update of the folder's last version."""
    spark = ledger.cube.sparkSession
    n = version(spark, path) + 1
    for name, df in (("counts", ledger.fresh), ("docs", ledger.docs), ("cube", ledger.cube)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/{n}")
    spark.range(1).select(F.lit(n).cast("bigint").alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/done")


def update_at(path: str, records: DataFrame, targets: DataFrame, **conf: str) -> Ledger:
    """Brings the ledger in a folder up to a new snapshot of the records, or begins one there, and returns it as it is then."""
    save(update(records, targets, load(records.sparkSession, path), **conf), path)
    return load(records.sparkSession, path)


def update(records: DataFrame, targets: DataFrame, old: Ledger | None = None, key: str = "doc_ord", text: str = "text", name: str = DEFAULT, folder: str = FOLDER) -> Ledger:
    """The ledger after a new snapshot of the records.

    Only texts whose (content, tokenizer) is not in the count table are encoded. Documents that came count +1, those that
    went or changed -1 under their old content and cell; these signs are summed by content and cell before any join, so that
    a text with a third of all rows is a few rows there. Null and empty texts count as documents of no tokens; rows
    delivered twice count twice; sources without a target have a null domain; null sources are a cell of their own. Documents
    and cells of another tokenizer are left out of the old ledger, so that all documents come anew; its counts are kept. A
    delta whose content has no count, as when a part of the old ledger is lost, is an error."""
    spark, tok = records.sparkSession, tokenizer_hash(name, folder)
    of_source = small(targets.filter("source is not null").groupBy("source").agg(F.min("domain").alias("domain")))
    rows = records.select(F.col(key).alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("content"), "source", language(F.col("lang")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = materialize(rows.drop("text").join(of_source, "source", "left").select("key", "content", *CELL), "docs")
    one = docs.withColumn("sign", F.lit(1).cast("bigint"))
    if old is not None:
        gone = old.docs.filter(F.col("tokenizer") == tok).drop("tokenizer").withColumn("sign", F.lit(-1).cast("bigint"))
        one = one.unionByName(gone).groupBy("key", "content", *CELL).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    deltas = one.groupBy("content", *CELL).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    texts = rows.select("content", "text")
    if old is not None:
        deltas = materialize(deltas, "deltas")
        known = old.counts.filter(F.col("tokenizer") == tok).select("content")
        unseen = materialize(deltas.select("content").distinct().join(known, "content", "left_anti"), "unseen")
        texts = texts.join(small(unseen), "content", "left_semi")
    fresh = token_counts(texts, "content", "text", name, folder).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(tok)).select("content", "tokenizer", "n_tokens")
    fresh = materialize(fresh, "counts")
    counts = fresh if old is None else old.counts.unionByName(fresh)
    n = F.coalesce("n_tokens", F.raise_error(F.concat(F.lit("the ledger has no count of the content "), F.hex("content"))).cast("bigint"))
    change = deltas.join(counts.filter(F.col("tokenizer") == tok), "content", "left").groupBy(*CELL).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * n).alias("n_tokens"))
    if old is not None:
        change = old.cube.filter(F.col("tokenizer") == tok).drop("tokenizer").unionByName(change).groupBy(*CELL).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return Ledger(counts, docs.withColumn("tokenizer", F.lit(tok)), materialize(change.filter("n_docs <> 0").withColumn("tokenizer", F.lit(tok)), "cube"), fresh)


def with_totals(cube: DataFrame) -> DataFrame:
    """The cells of a cube and their totals: level 'cell', 'source', 'lang', 'domain' or 'all'; columns that a total sums over are null."""
    sums = [F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
    out = cube.select(F.lit("cell").alias("level"), *CELL, "n_docs", "n_tokens")
    for by in [*CELL, None]:
        total = (cube.groupBy(by) if by else cube.groupBy()).agg(*sums).filter("n_docs is not null")
        out = out.unionByName(total.select(F.lit(by or "all").alias("level"), *(F.col(c) if c == by else F.lit(None).cast("string").alias(c) for c in CELL), "n_docs", "n_tokens"))
    return out
