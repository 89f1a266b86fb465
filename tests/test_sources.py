import gzip
import json
import lzma

import pytest
from pyspark.sql import functions as F

from granary.sources import readers, sinks


def test_jsonl_keeps_broken_lines_apart(spark, tmp_path):
    good = {"text": "x" * 200_000, "source": "s", "id": "1"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({"text": "last"}))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "zipped", "other": 1}) + "\n")
    records, broken = readers.jsonl(spark, str(tmp_path))
    assert sorted(len(r["text"]) for r in records.collect()) == [4, 6, 200_000] and [r[0] for r in broken.collect()] == ["{broken"]


def test_xz(spark, tmp_path):
    with lzma.open(tmp_path / "x.jsonl.xz", "wb") as f:
        f.write(b'{"text": "one"}\n\xff\xfe\n{"no": 1}\n{"text": "two"}\n')
    (tmp_path / "bad.jsonl.xz").write_bytes(b"not xz")
    rows, skipped = readers.xz_jsonl(spark, str(tmp_path), "sub")
    assert sorted((r["id"], r["text"]) for r in rows.collect()) == [("sub:x.jsonl.xz:0", "one"), ("sub:x.jsonl.xz:3", "two")]
    assert sorted((r["line"], r["error"]) for r in skipped.collect()) == [(0, "broken file"), (1, "not JSON"), (2, "no text")]


def test_budget_of_files_and_parquet_field(spark, tmp_path):
    for split in ("train", "test"):
        spark.createDataFrame([("a", 1)], "text string, n int").coalesce(1).write.parquet(f"{tmp_path}/{split}")
    import glob
    import shutil

    for split in ("train", "test"):
        shutil.move(glob.glob(f"{tmp_path}/{split}/*.parquet")[0], f"{tmp_path}/{split}-0.parquet")
        shutil.rmtree(f"{tmp_path}/{split}")
    df = readers.parquet_field(spark, str(tmp_path))
    assert df.columns == ["text"] and df.count() == 1
    files = readers.shards(spark, str(tmp_path), "*.parquet")
    assert len(readers.within_budget(files, 1)) == 1 and readers.within_budget(files, 0) == []


def test_step_results_logs_and_missing(spark, tmp_path):
    for s in (10, 2):
        (tmp_path / f"d_step{s}.json").write_text(json.dumps({"geometry": {"rank": s * 1.5}}, indent=1))
    got = readers.step_results(spark, str(tmp_path))
    assert [(r["step"], r["geometry"]["rank"]) for r in got.collect()] == [(2, 3.0), (10, 15.0)]
    (tmp_path / "log.txt").write_text("{'loss': 2.5}\nnothing\n{'loss': 1.5} {'loss': 1.25}\n")
    assert sorted(r["value"] for r in readers.log_numbers(spark, f"{tmp_path}/log.txt", r"'loss': ([\d.]+)").collect()) == [1.25, 1.5, 2.5]
    rows = lambda *s: spark.createDataFrame([(x, float(x)) for x in s], "step bigint, v double")
    for s in ((1, 2), (2, 3)):
        sinks.append_missing(rows(*s), f"{tmp_path}/out")
    assert sorted(r["step"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_sources_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 250, f"s{i % 2}", str(i)) for i in range(10)] + [(99, "short", "s0", "x"), (100, None, "s0", "y")], "doc_ord bigint, text string, source string, id string")
    sinks.write_sources(docs, f"{tmp_path}/out", 600)
    assert {r["source"]: r["count"] for r in spark.read.json(f"{tmp_path}/out").groupBy("source").count().collect()} == {"s0": 3, "s1": 3}


def test_token_shards(spark):
    b = spark.createDataFrame([(0, [1, 65_535]), (1, [])], "block_id bigint, tokens array<int>")
    assert {r["block_id"]: bytes(r["data"]) for r in sinks.token_shards(b).collect()} == {0: b"\x01\x00\xff\xff", 1: b""}
    with pytest.raises(Exception, match="does not fit"):
        sinks.token_shards(b, vocab_size=100).collect()
    assert "| a | 1 |" in sinks.status(spark.range(1).select(F.lit(1).alias("a")))
