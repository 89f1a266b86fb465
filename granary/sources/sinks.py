"""Sinks: JSON lines per source, splits, token shards, results that are there already, status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import ingest
from granary.operators.monitor import not_done


def write_sources(docs: DataFrame, path: str, budget: int, order: str = "doc_ord", least: int = ingest.MIN_CHARS) -> None:
    """Documents of at least `least` characters, each source up to the budget in bytes, as JSON lines in one folder per source."""
    long = ingest.long_enough(docs.filter("source is not null"), least=least).withColumn("_n", F.octet_length("text").cast("bigint"))
    ingest.budget_per_source(long, "source", [order], F.col("_n"), budget).drop("_n", "before").write.mode("overwrite").partitionBy("source").json(path)


def write_records(docs: DataFrame, path: str) -> None:
    """text, source and id as JSON lines."""
    docs.select("text", "source", "id").write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One parquet folder per split, written in one pass."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def token_shards(blocks: DataFrame, ids: str = "tokens", vocab_size: int = 65_536) -> DataFrame:
    """(block_id, n_tokens, data): the ids of each block as little-endian unsigned 16-bit numbers. Ids beyond the vocabulary or 65,535 end the job."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for x in b.column(1).to_pylist():
                a = np.array(x, np.int64)
                if len(a) and (a.min() < 0 or a.max() >= min(vocab_size, 65_536)):
                    raise ValueError(f"token id {a.max()} does not fit")
                raw.append(a.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) // 2 for r in raw]), pa.array(raw, pa.binary())], names=["block_id", "n_tokens", "data"])

    return blocks.select(F.col("block_id").cast("bigint").alias("block_id"), ids).mapInArrow(pack, "block_id bigint, n_tokens bigint, data binary")


def append_missing(results: DataFrame, path: str, key: str = "step", force: bool = False) -> None:
    """Appends the results of keys that are not there yet; with `force` all."""
    spark = results.sparkSession
    if not force and _exists(spark, path):
        results = not_done(results, spark.read.schema(results.schema).parquet(path), key)
    results.write.mode("append").parquet(path)


def cache_vectors(vectors: DataFrame, path: str, batch: int, key: str, vector: str = "embedding", mark: bool = True) -> None:
    """Writes one batch of vectors in half precision to a folder of its own, which a batch that runs again replaces, and then the
    progress: the first key that isn't there yet. Batches come in order of their keys; `mark` False leaves the progress as it was."""

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(v, "<f2").tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=["k", "data"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), vector)
    rows.mapInArrow(half, "k bigint, data binary").withColumnRenamed("k", key).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if mark:
        spark = vectors.sparkSession
        done = spark.read.parquet(f"{path}/batch={batch}").agg(F.coalesce(F.max(key) + 1, F.lit(0)))
        write_text(spark, f"{path}.progress", str(done.first()[0]))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in any file system that the session knows; an older one is replaced."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def status(row: DataFrame, title: str = "Status") -> str:
    """A one-row table as Markdown."""
    r = row.first()
    return "\n".join([f"# {title}", "", "| what | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in (r.asDict() if r else {}).items())]) + "\n"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
