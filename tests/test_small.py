"""Smaller functions: vectors, picks, regions, pools, corpora."""

import math

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vectors as V
from granary.operators import geometry, losses, monitor, probes, retrieval, sampling, synth
from granary.operators import ingest as I
from granary.operators import pairs as P


def one(spark, *columns, **values):
    return list(spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(*columns).first())


def test_vectors(spark, rows):
    d = rows("a array<float>, b array<float>", [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])])
    got = d.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.unit(F.col("a")), V.nested(F.col("a"), 1)).collect()
    assert got[0][0] == 24 and abs(got[0][1] - 0.96) < 1e-9 and got[0][2] == [0.6, 0.8] and got[0][3] == [1.0]
    assert got[1][1] == 0 and got[1][2] == [0.0, 0.0]
    assert V.ladder(768) == [768, 512, 256, 128, 64, 32, 16, 8] and V.ladder(48) == [48, 32, 16, 8]
    assert one(spark, V.sigmoid_margin(F.col("y"), F.col("n")), V.activation(F.col("n")), y=1.0, n=1.0) == [0.5, math.log(2)]


def test_picks_are_stable_and_in_range(spark):
    d = spark.range(200).select(T.pick(["a", "b", "c"], F.lit(1), F.col("id")).alias("p"), synth.draw(3, "x", 5, F.col("id")).alias("d"))
    assert {r["p"] for r in d.collect()} == {"a", "b", "c"} and {r["d"] for r in d.collect()} == set(range(5)) and d.collect() == d.collect()


def test_names_and_numbers(spark):
    assert one(spark, T.commas(F.col("n")), T.slug(F.col("s"), F.lit("B c")), T.model_name(F.lit("a/b")), synth.prompt("%s: %d", F.col("s"), F.col("n")), n=1234567, s="Loan Deed") == ["1,234,567", "synth-loan-b", "b", "Loan Deed: 1234567"]
    assert one(spark, T.head_key(F.repeat(F.lit("x"), 600)) == T.head_key(F.repeat(F.lit("x"), 700)))[0]


def test_terms_longest_first(spark):
    assert one(spark, T.term_hits(F.col("t"), ["rate", "rate reset", "lien"]), t="The Rate reset, rates and LIEN.")[0] == ["rate reset", "lien"]


def test_regions_and_quarters(spark):
    r = probes.region(F.col("o"), [("law", 0, 10), ("web", 10, 20)])
    assert [one(spark, r, o=o)[0] for o in (0, 9, 10, 20)] == ["law", "law", "web", None]
    assert [one(spark, probes.position_quarter(F.col("p"), F.lit(8)), p=p)[0] for p in (0, 1, 2, 7)] == [1, 1, 2, 4]
    assert [one(spark, probes.bucket(F.col("r")), r=r)[0] for r in (1, 100, 101, 10_001)] == ["top_100", "top_100", "100_1k", "10k_up"]


def test_ranks_and_means(spark, rows):
    d = rows("term string, label string, score double", [("a", "x", 3.0), ("a", "y", 3.0), ("a", "z", 1.0)])
    assert sorted(r["rank"] for r in probes.class_ranks(d, "term", "label").collect()) == [1, 1, 3]
    assert probes.unweighted_mean(rows("mean_loss double", [(1.0,), (3.0,)])).first()["mean_loss"] == 2
    assert probes.unmasked(rows("label int", [(-100,), (3,)])).count() == 1
    assert probes.without_tasks(rows("task string", [("a",), ("b",)]), rows("task string", [("b",), ("b",)])).collect()[0]["task"] == "a"


def test_stride(spark, rows):
    d = rows("i int", [(i,) for i in range(10)])
    assert sorted(r["i"] for r in sampling.stride(d, [F.col("i")], 3).collect()) == [0, 3, 6, 9]
    assert sorted(r["i"] for r in sampling.stride(d, [F.col("i")], 3, 2).collect()) == [0, 3]
    assert sampling.stride(d, [F.col("i")], 1).count() == 10


def test_round_robin_takes_turns(spark, rows):
    d = rows("s string, i int, n bigint", [("a", i, 10) for i in range(9)] + [("b", i, 10) for i in range(2)] + [(None, 1, 1)])
    got = sampling.round_robin(d, "s", ["i"], F.col("n"), 35, 50).orderBy("before").collect()
    assert [(r["s"], r["turn"]) for r in got] == [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)]


def test_pools(spark, rows):
    d = rows("doc int, is_on boolean, v array<double>", [(1, True, [1.0, -1.0]), (1, True, [3.0, -3.0]), (1, False, [100.0, 100.0])])
    assert {r["pos"]: r["mean"] for r in geometry.mean_pool(d, "doc", "is_on", "v").collect()} == {0: 2.0, 1: -2.0}
    x = geometry.coordinates(d, "doc", "is_on", vector="v")
    assert [(r["pos"], round(r["weight"], 9)) for r in geometry.sparse_pool(x, "doc", "pos", "x", "is_on").collect()] == [(0, round(math.log(4), 9))]


def test_corpus_and_rows_beside(spark, rows):
    pairs = rows("id bigint, positive string", [(1, "a"), (2, None), (3, "c")])
    mined = rows("id bigint, negatives array<bigint>", [(1, [3, 2, 9]), (3, None)])
    assert sorted(tuple(r) for r in P.corpus(pairs, mined).collect()) == [("n1-0", "c"), ("p1", "a"), ("p3", "c")]
    assert P.by_row(rows("row_id int, a int", [(1, 1), (2, 2)]), rows("row_id int, b int", [(2, 5), (3, 6)])).collect()[0]["b"] == 5


def test_unions_and_shares(spark, rows):
    u = I.union_all([rows("a int", [(1,)]), rows("a int, b int", [(2, 3)])])
    assert sorted(tuple(r) for r in u.collect()) == [(1, None), (2, 3)]
    m = rows("dim int, ndcg double", [(64, 0.5), (768, 0.8)])
    assert retrieval.retention(m, "ndcg", 64, 768).first()["retention"] == 0.625
    f = monitor.throughput(rows("seq int, tok_s double", [(1024, 8000.0), (2048, 4000.0)]), 100.0).orderBy("seq").collect()
    assert f[1]["vs_first"] == 0.5 and f[0]["mfu"] > 0
    assert monitor.error_lines(rows("t string", [("ok",), ("CUDA error: x",), (None,)]), "t").first()["n_errors"] == 1


def test_a_short_last_batch_is_dropped(spark, rows):
    d = losses.batches(rows("i int", [(i,) for i in range(7)]), [F.col("i")], 3)
    assert d.count() == 6 and losses.batches(rows("i int", []), [F.col("i")], 3).count() == 0


def test_relational_loss_over_nested_sizes(spark, rows):
    import numpy as np

    m = np.random.default_rng(2).normal(size=(6, 4))
    d = rows("batch_no bigint, slot int, v array<double>", [(0, i, x.tolist()) for i, x in enumerate(m)])
    one = {n: losses.relational(d, "v", "v", dims=[n]).first() for n in (2, 4)}
    both = losses.relational(d, "v", "v", dims=[2, 4]).first()
    assert abs(one[4]["loss"]) < 1e-9 and one[2]["loss"] > 0 and math.isclose(both["loss"], (one[2]["loss"] + one[4]["loss"]) / 2)


def test_guard_names_the_source(spark, rows):
    import pytest

    from granary.operators import dedup

    raw, read = rows("source string, doc_id int", [("a", 1), ("b", 2), (None, 3)]), rows("source string, doc_id int", [("a", 1), (None, 3)])
    assert {r["source"]: r["n_missing"] for r in dedup.guarded(dedup.count_guard(raw, raw)).collect()} == {"a": 0, "b": 0, "(none)": 0}
    with pytest.raises(Exception, match="missing of source b: 1"):
        dedup.guarded(dedup.count_guard(raw, read)).collect()


def test_negatives_are_filled_up_beyond_the_pool(spark, rows, monkeypatch):
    from granary.operators import bm25

    monkeypatch.setattr(bm25, "POOL", 1)
    data = [(0, "red fish", "own", "L", "s")] + [(i, "x", f"other{i}", "L" if i < 5 else "M", "s") for i in range(1, 9)]
    got = bm25.hard_negatives(rows("id bigint, anchor string, positive string, label string, source string", data), 3).filter("query = 0").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and {r["doc"] for r in got} < {5, 6, 7, 8} and {r["score"] for r in got} == {-1.0}
