import pandas as pd
import pytest

from granary.streaming import loops

SCHEMA = "step bigint, series string, value double"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_append_goes_on_where_it_stopped(spark, tmp_path):
    for n in (1, 2):
        _write(spark, f"{tmp_path}/in", [(n, "a", 1.0)])
        loops.append(loops.files(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert spark.read.json(f"{tmp_path}/out").count() == n


def test_publish_waits_for_the_threshold_and_retries(spark, tmp_path):
    pushed, fail = [], [True]

    def push(rows, batch):
        if fail[0]:
            fail[0] = False
            raise RuntimeError("no network")
        pushed.append(rows.count())

    run = lambda: loops.publish(loops.files(spark, f"{tmp_path}/in", SCHEMA), push, f"{tmp_path}/pending", f"{tmp_path}/state", 3).awaitTermination()
    _write(spark, f"{tmp_path}/in", [(1, "a", 1.0), (2, "a", 1.0)])
    run()
    assert pushed == []
    _write(spark, f"{tmp_path}/in", [(3, "a", 1.0)])
    with pytest.raises(Exception):
        run()
    run()
    assert pushed == [3]


def test_probe_computes_what_is_missing(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.extend(r["step"] for r in rows.collect())
        return rows

    for rows in ([(1, "a", 1.0), (1, "a", 1.0)], [(1, "a", 2.0), (2, "a", 1.0)]):
        _write(spark, f"{tmp_path}/in", rows)
        loops.probe(loops.files(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out", compute, f"{tmp_path}/state").awaitTermination()
    assert sorted((r["step"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1.0), (2, 1.0)]


def test_archive_keeps_targets_once(spark, tmp_path):
    targets = spark.createDataFrame([(2,)], "step bigint")
    _write(spark, f"{tmp_path}/in", [(1, "a", 1.0), (2, "a", 1.0), (2, "a", 1.0)])
    loops.archive(loops.files(spark, f"{tmp_path}/in", SCHEMA), targets, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r["step"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]


def test_alerts_keep_state_between_batches(spark, tmp_path):
    values = [(i, "m", 0.0 if 3 <= i <= 7 else 1.0) for i in range(1, 11)]
    for part in (values[:5], values[5:]):
        _write(spark, f"{tmp_path}/in", part)
        s = loops.alerts(loops.files(spark, f"{tmp_path}/in", SCHEMA), "series", "step", "value", 20, lambda rows: pd.Series(rows["value"] < 0.5), 4)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r["kind"], r["step"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("step", "kind").collect()]
    assert got == [("milestone", 2), ("milestone", 4), ("milestone", 6), ("outage", 6), ("milestone", 8), ("recovered", 8), ("milestone", 10)]


def test_stream_of_distinct_keys(spark, tmp_path):
    _write(spark, f"{tmp_path}/in", [(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0)])
    loops.append(loops.distinct(loops.files(spark, f"{tmp_path}/in", SCHEMA), "series"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 2
