"""Sessions, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []

#: What a table may have at most to be broadcast: rows, and bytes as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def build_session(app: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and small Arrow batches; `conf` keys use `__` for a dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Where it is unset, a temporary folder is made, which only a local master may use."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder, deleted by `release`."""
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: lineage ends there, and the loss of an executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the folders of `scratch`, and so the tables of `materialize`. Runs by itself when the program ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(release)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with the hint to broadcast it if it has at most `rows` rows and BROADCAST_BYTES bytes, else as it is, for a shuffled join."""
    r = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= rows and r["b"] <= BROADCAST_BYTES else df


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than that, as a small table in one file does; else as it is.

    A large table has more splits than cores, so that it is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A table of texts, over all cores."""
    return spread(table(spark, where, name))
