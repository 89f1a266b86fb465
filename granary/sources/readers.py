"""Sources: JSON lines (plain, gzip, xz), projected parquet, result files per step, logs."""

from __future__ import annotations

import json
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = "text string, source string, id string"
_BROKEN = "_corrupt_record"


def jsonl(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, broken): JSON lines of a known schema, plain or gzip by their ending, lines of any length; and the lines that
    can't be read, which are kept apart and never dropped unseen. Blank lines are neither."""
    wanted = StructType.fromDDL(schema)
    full = StructType([*wanted.fields, StructField(_BROKEN, StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    r = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    return r.filter(f"r.{_BROKEN} is null").select(*(F.col(f"r.{c}").alias(c) for c in wanted.names)), r.filter(f"r.{_BROKEN} is not null").select(F.col(f"r.{_BROKEN}").alias(_BROKEN))


def shards(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files under a path, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def within_budget(files: DataFrame, budget: int) -> list[str]:
    """Files in order of their names until their sizes reach the budget; the file that crosses it is in. The names of a listing fit the driver."""
    out, total = [], 0
    for r in files.orderBy("path").select("path", "length").collect():
        if total >= budget:
            break
        out.append(r["path"])
        total += r["length"]
    return out


def xz_jsonl(spark: SparkSession, path: str, subset: str = "", field: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records, skipped). records: (id, text, path), the texts of xz-compressed JSON lines, one file a task; `id` is
    subset:file:line, which is unique. skipped: (path, line, error), the lines that aren't UTF-8 or JSON or have no text, and
    files that can't be unpacked to their end, at the line where they break.

    Tasks get the files' names, open them and unpack them as a stream, so that neither size nor memory follows a file's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                i = -1
                system, at = fs.FileSystem.from_uri(name)
                try:
                    for i, line in enumerate(lzma.LZMAFile(system.open_input_stream(at, compression=None))):
                        try:
                            t = json.loads(line.decode()).get(field)
                            rows.append((i, t, None) if isinstance(t, str) else (i, None, "no text"))
                        except (ValueError, AttributeError):
                            rows.append((i, None, "not JSON"))
                        if len(rows) >= 1000:
                            yield batch(name, rows)
                            rows = []
                except (lzma.LZMAError, EOFError):
                    rows.append((i + 1, None, "broken file"))
                if rows:
                    yield batch(name, rows)

    def batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
        line, text, error = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(line, pa.int64()), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["path", "line", "text", "error"])

    files = shards(spark, path, "*.xz").select("path")
    n = files.count()
    all_ = files.repartition(max(1, min(n, 10_000)), "path").mapInArrow(read, "path string, line bigint, text string, error string")
    own = F.concat_ws(":", F.lit(subset), F.substring_index("path", "/", -1), "line")
    return all_.filter("error is null").select(own.alias("id"), "text", "path"), all_.filter("error is not null").select("path", "line", "error")


def parquet_field(spark: SparkSession, path: str | list[str], field: str = "text", config: str | None = None, split: str = "train") -> DataFrame:
    """One column of the parquet shards of a config and split, found by their names; all shards if none has such a name."""
    names = path if isinstance(path, list) else [r["path"] for r in shards(spark, path, "*.parquet").select("path").collect()]
    chosen = [n for n in names if (config is None or f"/{config}/" in n) and split in n.rsplit("/", 1)[-1]] or names
    return spark.read.parquet(*chosen).select(field)


def step_results(spark: SparkSession, path: str, glob: str = "*step*.json") -> DataFrame:
    """One row per result file with its step, read from the file's name, in order of steps."""
    r = spark.read.option("multiLine", "true").option("pathGlobFilter", glob).json(path).drop("step")
    return r.withColumn("step", F.regexp_extract(F.input_file_name(), r"step(\d+)", 1).cast("bigint")).orderBy("step")


def log_numbers(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(line, value): all numbers that a pattern's first group finds in a log."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("value")).withColumn("value", F.col("value").cast("double"))


def prefix_rows(vectors: DataFrame, key: str, *limits: int) -> DataFrame:
    """Rows below the least of some limits: what a cache that is still being written has for certain."""
    return vectors.filter(F.col(key) < min(limits))


def labelled(spark: SparkSession, path: str, split: str, column: str = "split") -> DataFrame:
    """The rows of one split of a table that is written by split; other splits' files are not read."""
    return spark.read.parquet(path).filter(F.col(column) == split)


def cached_vectors(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, data): the rows of a vector cache below its progress; what a batch that isn't marked yet has left is not read."""
    done = spark.read.text(f"{path}.progress").first()
    return prefix_rows(spark.read.parquet(path), key, int(done[0]) if done else 0)
