"""Operators on hand-made rows: order, ties, nulls, empty tables, hot keys, clashing names."""

import random

import numpy as np
from pyspark.sql import functions as F

from granary.operators import batching, bm25, dedup, geometry, ingest, losses, monitor, pack, probes, ranges, retrieval, sampling, skew, synth
from granary.operators import pairs as P

LONG = "the quick brown fox jumps over the lazy dog and then it rests for a while near the old stone bridge over the calm river {} times"


def test_running_sums_equal_a_loop(spark, rows):
    data = [(i % 3, i, (i * 7) % 5 if i % 4 else None) for i in range(200)]
    random.Random(1).shuffle(data)
    got = ranges.running(rows("range int, row int, v int", data), [F.col("range"), F.col("row")], {"before": F.col("v").cast("bigint")}, 5).collect()
    total, want = 0, {}
    for g, i, v in sorted(data):
        want[i] = total
        total += v or 0
    assert {r["row"]: r["before"] for r in got} == want and set(got[0].asDict()) == {"range", "row", "v", "before"}


def test_running_of_nothing_and_replaced_names(spark, rows):
    assert ranges.ranked(rows("k int, rank int", []), [F.col("k")]).collect() == []
    assert sorted(tuple(r) for r in ranges.ranked(rows("k int, rank int", [(2, 9), (1, 9)]), [F.col("k")]).select("k", "rank").collect()) == [(1, 1), (2, 2)]


def test_rank_within_a_hot_group(spark, rows):
    r = ranges.rank_within(rows("g string, i int", [("hot", i) for i in range(300)] + [("cold", 1), (None, 5)]), "g", [F.col("i")], parts=7).collect()
    assert sorted(x["rank"] for x in r if x["g"] == "hot") == list(range(1, 301)) and len(r) == 301


def test_salted_join_of_a_hot_key(spark, rows):
    left = rows("k string, i int", [("hot", i) for i in range(1000)] + [("a", 1), (None, 2), ("lost", 3)])
    right = rows("k string, n bigint, v string", [("hot", 1000, "H"), ("a", 1, "A"), ("none", 1, "N")])
    got = skew.salted_join(left, right, ["k"], "n", "i", rows_per_salt=100).collect()
    assert len(got) == 1001 and {r["v"] for r in got} == {"H", "A"} and set(got[0].asDict()) == {"k", "i", "n", "v"}


ORDER = ["src_rank", "doc_id"]


def test_first_occurrence_wins_by_priority(spark, rows):
    t = LONG.format(3)
    docs = rows("src_rank int, doc_id bigint, text string, kept string", [(2, 1, t + "\n\nshort", "x"), (1, 9, "x\n\n" + t.upper(), "x"), (1, 5, "short", "x"), (3, 7, None, "x"), (3, 8, " \n\n ", "x")])
    m = dedup.marks(docs, ORDER)
    assert {(r["doc_id"], r["unit_pos"]): r["kept"] for r in m.collect()} == {(1, 0): False, (1, 1): True, (9, 0): True, (9, 1): True, (5, 0): True}
    out = dedup.documents(docs, m, ORDER, min_doc=0)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "short", 9: "x\n\n" + t.upper(), 5: "short"}
    assert dedup.documents(docs.limit(0), dedup.marks(docs.limit(0), ORDER), ORDER).count() == 0


def test_a_dropped_document_still_counts_as_seen(spark, rows):
    docs = rows("src_rank int, doc_id bigint, text string", [(1, 1, LONG.format(1)), (2, 2, LONG.format(1))])
    m = dedup.marks(docs, ORDER)
    assert dedup.documents(docs, m, ORDER, min_doc=10_000).count() == 0 and {r["doc_id"]: r["kept"] for r in m.collect()} == {1: True, 2: False}


def test_a_unit_that_all_documents_share(spark, rows):
    docs = rows("src_rank int, doc_id bigint, text string", [(1, i, LONG.format(7) + f"\n\nown {i}") for i in range(500)])
    m = dedup.marks(docs, ORDER).filter("not is_short").collect()
    assert [r["doc_id"] for r in m if r["kept"]] == [0] and len(m) == 500


def test_thresholds_of_length(spark, rows):
    docs = rows("src_rank int, doc_id bigint, text string", [(1, n, "é" * n) for n in (119, 120, 121)])
    assert {r["doc_id"]: r["is_short"] for r in dedup.marks(docs, ORDER).collect()} == {119: True, 120: False, 121: False}
    assert {r["i"] for r in ingest.long_enough(rows("i int, text string", [(n, "ü" * n) for n in (199, 200, 201)] + [(0, None)])).collect()} == {200, 201}


def test_budget_keeps_the_row_that_crosses(spark, rows):
    got = ingest.prefix_budget(rows("i int, n bigint", [(i, 10) for i in range(10)]), ["i"], F.col("n"), 25).collect()
    assert sorted(r["i"] for r in got) == [0, 1, 2]


def test_sections(spark, rows):
    f = rows("filename string, section_1 string, section_2 string, section_3 string", [("a", "x", " \n", "z"), ("b", None, None, None)])
    assert {r["filename"]: r["t"] for r in f.select("filename", ingest.sections_text(f).alias("t")).collect()} == {"a": "x\n\nz", "b": ""}


def test_splits_are_disjoint_and_complete(spark, rows):
    d = rows("k bigint", [(i,) for i in range(100)])
    h = sampling.holdout(d, 1, 7, "k").collect()
    assert len(h) == 100 and sum(r["split"] == "val" for r in h) == 7
    f = sampling.fraction(d, 1, 0.025, "k").collect()
    assert sum(r["split"] == "test" for r in f) == 3
    assert sampling.holdout(d.limit(0), 1, 7, "k").count() == 0


def test_quota_is_exact(spark, rows):
    d = rows("s string, k bigint", [("a", i) for i in range(500)] + [("b", i) for i in range(3)] + [("c", 1)])
    got = sampling.quota(d, "s", {"a": 40, "b": 5}, 1, "k").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 40, "b": 3}


def test_blocks_equal_the_stream(spark, rows):
    docs = rows("doc_id bigint, text string", [(i, " ".join(f"w{i}x{j}" for j in range(i * 3 % 17))) for i in range(40)] + [(99, None)])
    stream = []
    for r in sorted(docs.collect()):
        if r["text"] is not None:
            stream += ["<s>", *r["text"].split(), "</s>"]
    got = [t for r in sorted(pack.blocks(docs, "doc_id", ["doc_id"], 16).collect()) for t in r["tokens"]]
    assert got == stream[: len(stream) // 16 * 16]
    m = pack.meta(pack.stream(docs, "doc_id", ["doc_id"]), 16, 1000, 7).first()
    assert m["train_tokens"] == 0 and m["val_blocks"] == len(stream) // 16


def test_label_free_batches(spark, rows):
    d = rows("id bigint, label string", [(i, f"l{i % 5}") for i in range(100)] + [(200, None)])
    got = batching.label_free(d, "label", "id", 3, 1).collect()
    by = {}
    for r in got:
        by.setdefault((r["batch_round"], r["batch_no"]), []).append(r["label"])
    assert by and all(len(v) == 3 == len(set(v)) for v in by.values())
    for batch in batching.greedy([(i, f"l{i % 5}") for i in range(100)], 3, 1):
        assert len({i % 5 for i in batch}) == 3


def _bm25(texts, query):
    toks = [t.split() for t in texts]
    n, av = len(toks), sum(map(len, toks)) / len(toks)
    out = []
    for t in toks:
        s = 0
        for w in set(query.split()):
            df, tf = sum(w in x for x in toks), t.count(w)
            s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / av)) if tf else 0
        out.append(s)
    return out


def test_bm25_equals_a_loop(spark, rows):
    texts = ["red fish blue", "blue blue sky", "one two", "red red red", "fish"]
    pairs = rows("id bigint, anchor string, positive string, label string, source string", [(i * 100, "red fish" if i == 0 else "nothing shared", t, f"l{i}", "s") for i, t in enumerate(texts)])
    got = [(r["doc"] // 100, r["score"]) for r in bm25.top(pairs).filter("query = 0").orderBy("rank").collect()]
    want = sorted(((i, round(s, 9)) for i, s in enumerate(_bm25(texts, "red fish")) if s > 0), key=lambda x: (-x[1], x[0]))
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert bm25.top(pairs).filter("query = 100").count() == 0


def test_no_negative_is_a_known_positive(spark, rows):
    data = [(0, "red fish", "red fish a", "L", "s"), (1, "x", "red fish b", "L", "s"), (2, "x", "red fish a", "M", "s"), (3, "x", "red sky", "N", "s"), (4, "x", "red sky", "O", "s"), (5, "x", "far away", None, "s")]
    pairs = rows("id bigint, anchor string, positive string, label string, source string", data)
    got = bm25.hard_negatives(pairs, 2).filter("query = 0").orderBy("rank").collect()
    assert [r["doc"] for r in got] == [3, 4]  # equal scores by id; 2 has the text of a positive of L
    more = bm25.hard_negatives(pairs, 4).filter("query = 0").orderBy("rank").collect()
    assert [r["doc"] for r in more] == [3, 4, 5] and more[2]["score"] == -1


def test_negatives_columns(spark, rows):
    pairs = rows("id bigint, positive string", [(1, "a"), (2, "b"), (3, "c")])
    mined = rows("id bigint, negatives array<bigint>", [(1, [2, 3]), (2, [3]), (2, []), (3, None)])
    got = P.negatives(pairs, mined, 2)
    assert {r["id"]: (r["negative_0"], r["negative_1"]) for r in got.collect()} == {1: ("b", "c"), 2: ("c", None), 3: (None, None)}
    assert P.common_columns(got.filter("id < 3")) == ["negative_0"]


def _vectors(rows, n=120, d=8, labels=4):
    rng = np.random.default_rng(3)
    return rng.normal(size=(n, d)), [f"l{i % labels}" for i in range(n)]


def test_retrieval_equals_numpy(spark, rows):
    m, labels = _vectors(rows)
    df = rows("vec_id bigint, label string, embedding array<float>", [(i, labels[i], m[i].astype(np.float32).tolist()) for i in range(len(m))])
    m = m.astype(np.float32).astype(float)
    u = m[:, :4] / np.linalg.norm(m[:, :4], axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    ps, rrs = [], []
    for q in range(0, len(m), 10):
        order = sorted((i for i in range(len(m)) if i != q), key=lambda i: (-s[q, i], i))
        hits = [labels[i] == labels[q] for i in order]
        ps.append(sum(hits[:10]) / 10)
        rrs.append(1 / (hits.index(True) + 1))
    got = retrieval.metrics(df, [8, 4], 10, every=10).filter("dim = 4").first()
    assert abs(got["p"] - np.mean(ps)) < 1e-8 and abs(got["mrr"] - np.mean(rrs)) < 1e-8


def test_a_query_without_relevant_vectors(spark, rows):
    df = rows("vec_id bigint, label string, embedding array<float>", [(0, "only", [1.0, 0.0]), (1, "b", [1.0, 0.1]), (2, "b", [0.0, 0.0]), (3, "b", None)])
    got = retrieval.metrics(df, [2], 2).first()
    assert (got["n_queries"], got["n_without"], got["p"], got["ndcg"], got["mrr"]) == (1, 1, 0, 0, 0)


def test_closed_form_equals_all_pairs(spark, rows):
    m, labels = _vectors(rows)
    df = rows("vec_id bigint, label string, embedding array<double>", [(i, labels[i], m[i].tolist()) for i in range(len(m))])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    assert abs(geometry.mean_pairwise_cosine(df).first()["mean_cosine"] - s[~np.eye(len(m), dtype=bool)].mean()) < 1e-8
    p = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2
    p /= p.sum()
    assert abs(geometry.spectrum(df).first()["effective_rank"] - np.exp(-(p * np.log(p)).sum())) < 1e-6
    assert geometry.mean_pairwise_cosine(df.limit(0)).first()["mean_cosine"] is None
    assert geometry.mean_pairwise_cosine(rows("embedding array<double>", [([1.0, 2.0],), ([1.0, 2.0],)])).first()["mean_cosine"] == 1
    assert geometry.spectrum(df.limit(0)).first()["n"] == 0


def test_losses_equal_numpy(spark, rows):
    m, _ = _vectors(rows, 12, 6)
    df = losses.batches(rows("i bigint, a array<double>, b array<double>", [(i, m[i].tolist(), m[i, ::-1].tolist()) for i in range(12)]), [F.col("i")], 5)
    assert df.count() == 10
    got = {r["batch_no"]: r for r in losses.relational(df, "a", "b").collect()}
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (m[:5], m[:5, ::-1]))
    off = ~np.eye(5, dtype=bool)
    assert abs(got[0]["mse"] - (((u @ u.T) - (v @ v.T))[off] ** 2).mean()) < 1e-12
    assert losses.spearman(df, "a", "a").first()["rho"] == 1


def test_health_labels(spark, rows):
    series = {"diverges": [1.0, 0.5, 0.9], "plateau": [1.0] * 6, "improves": [5.0, 4.0, 3.0, 2.0, 1.0], "two": [1.0, 0.9], "watch": [1.0, 0.9, 0.95], "one": [1.0]}
    data = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)] + [("none", 0, None)]
    got = {r["s"]: r["health"] for r in monitor.health(rows("s string, step int, loss double", data), "s", "step", "loss").collect()}
    assert got == {"diverges": "DIVERGING", "plateau": "PLATEAU", "improves": "improving", "two": "improving", "watch": "watch", "one": "unknown"}


def test_steps_and_streaks(spark, rows):
    steps = [r["step"] for r in monitor.target_steps(spark, 20_000, 2000, 5, 6000).orderBy("step").collect()]
    assert steps == [2000, 4000, 6000, 8000, 12_000, 16_000, 20_000]
    assert monitor.not_done(rows("step bigint", [(1,), (2,)]), rows("step bigint", [(1,), (2,), (3,)])).count() == 0
    data = [("u", i, v) for i, v in enumerate([1, 0, 0, 0, 0, 1, 0, 0])] + [("v", i, 0) for i in range(4)]
    got = monitor.streaks(rows("u string, t int, v int", data), "u", ["t"], F.col("v") == 0, 4).collect()
    assert sorted((r["u"], r["length"], r["start"], r["end"]) for r in got) == [("u", 4, 1, 4), ("v", 4, 0, 3)]


def test_power_law_is_found_again(spark, rows):
    data = [("s", t, 20 * t**-0.3 + 1.5) for t in range(1, 200)]
    r = monitor.power_law(rows("s string, t bigint, y double", data), "s", "t", "y", 1000).first()
    assert abs(r["b"] - 0.3) < 1e-9 and abs(r["c"] - 1.5) < 1e-6 and abs(r["predicted"] - (20 * 1000**-0.3 + 1.5)) < 1e-6


def test_cluster_replies(spark, rows):
    p = "p" * 120
    good = '{"passage": " %s ", "queries": ["1234567", "12345678", "%s", "%s"], "hard_negative": "short"}' % (p, "q" * 300, "q" * 301)
    data = [(1, "Sure!\n```json\n" + good + "\n```"), (2, good), (3, good[:-1]), (4, '{"passage": "short", "queries": ["12345678"]}'), (5, '{"passage": "%s"}' % p), (6, ""), (7, None), (8, '{"passage": "%s", "queries": []}' % p)]
    got = {r["i"]: r["c"] for r in rows("i int, t string", data).select("i", synth.parse_cluster(F.col("t")).alias("c")).collect()}
    assert got[1]["passage"] == p and [len(q) for q in got[1]["queries"]] == [8, 300] and got[1]["hard_negative"] is None and got[2] == got[1]
    assert all(got[i] is None for i in (3, 4, 5, 6, 7, 8))


def test_snapshot_counts(spark, rows):
    kept, counts = synth.snapshot(rows("line string", [('{"a": 1}',), ("",), ("  ",), ('{"a": ',), (None,), ("[1]",)]))
    assert kept.count() == 1 and tuple(counts.first()) == (6, 3, 2, 1)


def test_entropy_and_buckets(spark, rows):
    c = probes.token_counts(rows("text string", [("a a b",), (None,), ("",)]))
    r = probes.entropy(c).first()
    assert (r["n_tokens"], r["n_types"]) == (3, 2) and abs(r["entropy"] - (np.log(3) - 2 * np.log(2) / 3)) < 1e-8
    assert probes.frequency_buckets(c).first()["bucket"] == "top_100"


def test_same_result_with_1_and_8_partitions(spark, rows):
    d = rows("g string, i int", [(f"g{i % 4}", i) for i in range(100)])
    a, b = (sorted(tuple(r) for r in batching.label_free(d.repartition(n), "g", "i", 2, 3).collect()) for n in (1, 8))
    assert a == b
