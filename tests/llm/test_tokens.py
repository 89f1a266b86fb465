import random

import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, mixture, packing, queries, tokens
from tests.oracle import DATA, actual, expected

ODD = [
    None, "", " ", "   ", "\n\n  x", "Don't  stop it's we'LL", "naïve façade œuvre", "合同双方同意。日本語テキスト", "🙂👍🏽 ok", "é decomposed", "a\u00a0b\u2003c\u3000 d", "tab\t\tnew\r\nline ", "x" * 150, "ab" * 400, " " * 600 + "end",
    "12345 6.78 ½ ²", "<|endoftext|> as text", "bell\x07 \x0b\x0c", "{\"k\": [1, 2]}", "Ünïcödé " * 300, "a" * 5000 + " tail", "\u0085x\u2028y",
]


def test_ids_equal_the_library(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    enc = tokens.Encoder(spark)
    for cached in (bpe.CACHED, 3):
        ids = bpe.encode(df, cached=cached)
        assert {r["doc_id"]: list(r["ids"]) for r in ids.collect()} == {i: enc.encode(t) if t else [] for i, t in enumerate(ODD)}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_ids_of_long_runs_equal_the_library(spark):
    """Runs that are folded in pieces, some of which meet by the first cut, some by the second, some not at all."""
    rng = random.Random(1)
    of = lambda lo, hi, n: "".join(chr(rng.randint(lo, hi)) for _ in range(n))
    texts = ["x" * 10_000, "-" * 10_000, "…" * 3_000, "abc" * 3_333, of(0x4E00, 0x9FA5, 10_000), of(0x0E01, 0x0E2E, 10_000), of(97, 122, 10_000), " " * 5_000 + "x", "合同双方同意" * 1_000]
    enc = tokens.Encoder(spark)
    for cached in (bpe.CACHED, 0):
        got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), cached=cached).collect()
        assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: enc.encode(t) for i, t in enumerate(texts)}


def test_each_distinct_word_is_folded_once(spark):
    counted = spark.createDataFrame([("one", 3), (" two", 1), ("z" * 700, 2)], "word string, n bigint")
    got = bpe.fold_words(counted).collect()
    enc = tokens.Encoder(spark)
    assert {r["word"]: list(r["ids"]) for r in got} == {w: enc.encode(w) for w in ("one", " two", "z" * 700)} and len(got) == 3


def test_most_frequent_words_are_never_more(spark):
    counted = spark.range(5000).selectExpr("concat('w', id) as word", "int(20000 / (id + 1)) + 1 as n").persist()
    for most in (0, 1, 10, 1000, 4000, 6000):
        top = counted.filter(bpe.most_frequent(counted, most))
        n = top.count()
        assert n <= most and (n >= 0.6 * min(most, 5000) - 60)
        if n:
            assert top.agg(F.min("n")).first()[0] * 1.2 + 2 >= counted.exceptAll(top).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def test_ids_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same words"), (1, "same words")], "doc_id bigint, text string")
    assert bpe.encode(df).count() == 2 and bpe.encode(df.limit(0)).count() == 0


def test_round_trip_of_the_tables(spark):
    assert actual(queries.p7_round_trip(spark, DATA)) == expected(queries.SQL["p7_round_trip"])


RAW = "doc_ord bigint, text string, source string, lang string, domain int"
TARGETS = "source string, domain string, src_rank int, target_share double, max_repeats int"


def _cube(ledger):
    return sorted((repr(tuple(r)) for r in ledger.cube.select("source", "lang", "domain", "n_docs", "n_tokens").collect()))


def test_updates_equal_a_new_ledger(spark, rows):
    targets = rows(TARGETS, [("a", "D", 1, 0.5, 1), ("b", "E", 2, 0.5, 2)])
    v1 = [(1, "one two", "a", "en", 0), (2, "one two", "b", "EN", 0), (3, None, None, None, 0), (4, "gone", "a", "en-US", 0), (5, "", "x", "und", 0), (5, "", "x", "und", 0)]
    v2 = [(1, "one two", "a", "en", 0), (2, "one two three", "b", "de", 0), (3, None, None, None, 0), (5, "", "x", "und", 0), (6, "new text", "a", "EN", 0)]
    old = tokens.update(rows(RAW, v1), targets)
    new = tokens.update(rows(RAW, v2), targets, old)
    assert _cube(new) == _cube(tokens.update(rows(RAW, v2), targets))
    # only what was not known is encoded: 'one two three' and 'new text'
    assert new.counts.count() - old.counts.count() == 2
    assert tokens.update(rows(RAW, []), targets, new).cube.count() == 0
    totals = {r["level"]: r for r in tokens.with_totals(old.cube).filter("level = 'all'").collect()}
    assert totals["all"]["n_docs"] == 6


def test_counts_equal_the_library(spark, rows):
    enc = tokens.Encoder(spark)
    got = tokens.token_counts(rows("k bigint, text string", list(enumerate(ODD))), "k").collect()
    assert {r["k"]: r["n_tokens"] for r in got} == {i: len(enc.encode(t)) if t else 0 for i, t in enumerate(ODD)}
    assert tokens.tokenizer_hash() != tokens.tokenizer_hash("byte_bpe_multi_50k")


def test_first_fit_decreasing_equals_a_loop():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 200):
        sizes = rng.integers(1, 40, n)
        bins, want = [], []
        place = {}
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, f in enumerate(bins) if f >= sizes[i]), len(bins))
            if at == len(bins):
                bins.append(40)
            bins[at] -= sizes[i]
            place[i] = at
        want = [place[i] for i in range(n)]
        assert packing.first_fit_decreasing(sizes, 40).tolist() == want


def test_blocks_hold_every_text_once(spark, rows):
    texts = [(i, "word " * (i * 7 % 90), "a", "en", 0) for i in range(300)] + [(1000, "long " * 5000, "a", "en", 0), (1001, None, "a", "en", 0), (1002, "", None, None, 0)]
    raw = rows(RAW, texts)
    settings = rows("profile string, vocab_size int, block_size int, dtype string", [("s", 1, 64, "x"), ("m", 1, 256, "x"), ("none", 1, None, "x"), ("zero", 1, 0, "x")])
    counts = {r["doc_ord"]: r["n_tokens"] for r in tokens.token_counts(raw, "doc_ord").collect()}
    got = packing.pack(raw, settings, group_items=100).collect()
    assert {r["profile"] for r in got} == {"s", "m"}
    for profile, cap in (("s", 64), ("m", 256)):
        own = [r for r in got if r["profile"] == profile]
        per, fill = {}, {}
        for r in own:
            per.setdefault(r["doc_ord"], []).append((r["first_token"], r["n_tokens"]))
            fill[r["block_id"]] = fill.get(r["block_id"], 0) + r["n_tokens"]
        assert all(fill[r["block_id"]] == r["fill"] <= cap for r in own)
        assert set(per) == {k for k, n in counts.items() if n}
        for k, parts in per.items():
            parts.sort()
            assert sum(n for _, n in parts) == counts[k] and len(parts) == -(-counts[k] // cap)
            assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert packing.pack(raw.limit(0), settings).count() == 0


def test_shortages_go_to_siblings_first():
    leaf = lambda d, s, share, tokens_, repeats=1: {"domain": d, "lang": "en", "source": s, "share": share, "repeats": repeats, "tokens": tokens_}
    got = {x["source"]: x["budget"] for x in mixture.plan([leaf("A", "a1", 0.25, 10), leaf("A", "a2", 0.25, 500), leaf("B", "b1", 0.5, 490)], 200)}
    assert got == {"a1": 10, "a2": 90, "b1": 100}
    got = {x["source"]: x["budget"] for x in mixture.plan([leaf("A", "a1", 0.25, 10), leaf("A", "a2", 0.25, 20), leaf("B", "b1", 0.5, 970)], 200)}
    assert got == {"a1": 10, "a2": 20, "b1": 170}
    got = {x["source"]: x["budget"] for x in mixture.plan([leaf("A", "a1", 0.5, 10, 3), leaf("B", "b1", 0.5, 30, 0), leaf("B", "b2", 0.0, 30, 9)])}
    assert got == {"a1": 30, "b1": 0, "b2": 0}


def test_mix_keeps_repeats_and_shares(spark, rows):
    raw = rows(RAW, [(i, "word " * 20, "big" if i % 3 else "small", "en", 0) for i in range(600)] + [(9000, "x", "nowhere", "en", 0), (9001, None, "big", "en", 0), (9002, "x", None, None, 0)])
    targets = rows(TARGETS, [("big", "D", 1, 0.3, 1), ("small", "D", 2, 0.6, 2), ("absent", "E", 3, 0.1, 4)])
    chosen, shares = mixture.mix(raw, targets, total=9000)
    s = {r["source"]: r for r in shares.collect()}
    assert s["absent"]["mix_tokens"] == 0 and s["small"]["most_times"] <= 2 and s["big"]["most_times"] == 1
    assert abs(s["big"]["actual_share"] - 1 / 3) < 0.01 and abs(sum(r["mix_tokens"] for r in s.values()) - 9000) <= 42
    assert {r["source"] for r in chosen.select("source").distinct().collect()} == {"big", "small"}
    again = mixture.mix(raw.repartition(7), targets, total=9000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    assert chosen.filter(F.col("times") > 2).count() == 0
    assert {r["largest_total"] for r in s.values()} == {min(int(s["big"]["own_tokens"] / 0.3), int(2 * s["small"]["own_tokens"] / 0.6))}
    empty_chosen, empty_shares = mixture.mix(raw.limit(0), targets)
    assert empty_chosen.count() == 0 and empty_shares.count() == 3


@pytest.mark.parametrize("name", ["p2_token_cube", "p4_pack", "p4_fill", "p6_mix", "p6_shares", "p7_ids"])
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_updates_with_another_tokenizer(spark, rows):
    targets = rows(TARGETS, [("a", "D", 1, 0.5, 1)])
    other = {"name": "byte_bpe_multi_50k"}
    v1 = rows(RAW, [(1, "naïve façade œuvre", "a", "en", 0), (2, "合同双方同意。", "a", "en", 0), (3, "gone", "b", "en", 0)])
    v2 = rows(RAW, [(1, "naïve façade œuvre", "a", "en", 0), (2, "合同双方", "a", "en", 0)])
    want = _cube(tokens.update(v2, targets, **other))
    assert want != _cube(tokens.update(v2, targets))
    old = tokens.update(v1, targets)
    assert _cube(tokens.update(v2, targets, old, **other)) == want
    assert _cube(tokens.update(v2, targets, tokens.update(v1, targets, old, **other))) == _cube(tokens.update(v2, targets))


def test_a_lost_count_is_an_error(spark, rows):
    targets = rows(TARGETS, [("a", "D", 1, 0.5, 1)])
    old = tokens.update(rows(RAW, [(1, "stays", "a", "en", 0), (2, "gone", "a", "en", 0)]), targets)
    lost = tokens.Ledger(old.counts.filter("n_tokens < 0"), old.docs, old.cube, old.fresh)
    with pytest.raises(Exception, match="no count of the content"):
        tokens.update(rows(RAW, [(1, "stays", "a", "en", 0)]), targets, lost).cube.collect()


def test_update_query_equals_a_new_ledger(spark):
    assert actual(queries.p2_delta(spark, DATA)) == expected(queries.SQL["p2_delta"])


def test_a_ledger_lasts(spark, rows, tmp_path):
    """It is kept in a folder, holds when the records' table is overwritten, and leaves out what a failed update has left."""
    path, source = f"file://{tmp_path}/ledger", f"file://{tmp_path}/records"
    targets = rows(TARGETS, [("a", "D", 1, 0.5, 1)])
    v1 = [(1, "one two", "a", "en", 0), (2, "gone", "b", "en", 0), (2, "gone", "b", "en", 0), (3, None, None, None, 0)]
    v2 = [(1, "one two three", "a", "en", 0), (4, "gone", "b", "de", 0), (3, None, None, None, 0)]
    assert tokens.load(spark, path) is None
    rows(RAW, v1).write.parquet(source)
    first = tokens.update_at(path, spark.read.parquet(source), targets)
    rows(RAW, v2).write.mode("overwrite").parquet(source)
    assert _cube(first) == _cube(tokens.update(rows(RAW, v1), targets))
    rows(RAW, v1).select("text").write.parquet(f"{path}/docs/2")  # a failed update
    second = tokens.update_at(path, spark.read.parquet(source), targets)
    assert _cube(second) == _cube(tokens.update(rows(RAW, v2), targets)) and tokens.version(spark, path) == 2
    assert [r["n_tokens"] for r in spark.read.parquet(f"{path}/counts/2").collect()] == [3]


@pytest.mark.parametrize("name", ["p4_checked", "p6_checked"])
def test_checks_hold(spark, name):
    assert actual(queries.QUERIES[name](spark, DATA)) == expected(queries.SQL[name])
