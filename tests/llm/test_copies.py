import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from granary.llm import copies, queries
from tests.oracle import DATA, actual, expected

SCHEMA = "doc_ord bigint, text string"


def found(spark, texts):
    return sorted(tuple(r) for r in copies.copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())


def test_dresses_of_prose(spark):
    assert found(spark, ["The fee is $5.", "  the FEE is 5 ", "The fee, is 5!", "The fee is 6.", "is 5 the fee"]) == [(0, 1), (0, 2)]
    assert found(spark, ["Straße A", "STRASSE a", "a Straße"]) == [(0, 1)]


def test_dresses_of_labelled_values(spark):
    a = {"Issuer": "A & B", "Coupon": "5 %", "Note": "x: y"}
    dressed = [
        json.dumps(a), json.dumps(dict(reversed(a.items())), indent=1), "Issuer: A & B\nCoupon: 5 %\nNote: x: y", "COUPON = 5% ; Note = x y; issuer = a b", "Note: x, y | Coupon: 5 | Issuer: AB",
        "Issuer: A & B\nCoupon: 6 %\nNote: x: y", "Issuer: A & B\nCoupon: 5 %", "Issuer: 5 %\nCoupon: A & B\nNote: x: y",
    ]
    assert found(spark, dressed) == [(0, i) for i in range(1, 5)]


def test_repeated_pairs_count(spark):
    assert found(spark, ["a: 1\na: 1\nb: 2", "b: 2\na: 1\na: 1", "a: 1\nb: 2\nb: 2", "a: 1\nb: 2"]) == [(0, 1)]


def test_nulls_empty_and_long_texts(spark):
    long = "word " * 200_000
    assert found(spark, [None, "", "  ", "--", "!?", None, "", long, long.upper(), "{}", "{}"]) == [(7, 8)]
    assert found(spark, []) == []


def test_a_hot_group_and_other_columns(spark, rows):
    df = rows("n int, first string, doc_ord bigint, text string, digests int", [(1, "x", i, "same text" if i % 3 else f"own {i}", 0) for i in range(999)])
    got = copies.copies(df).collect()
    assert len(got) == 665 and {r["kept_ord"] for r in got} == {1}
    counts = copies.distinct_records(df).collect()
    assert len(counts) == 334 and sum(r["n_copies"] for r in counts) == 999


def test_shared_fingerprints_are_told_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(copies, "PRIME", 1)  # all fingerprints are equal
    assert found(spark, ["a b", "c", "A-B", "C!", "c", "d"]) == [(0, 2), (1, 3), (1, 4)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAbB1 .,:;\n={}\"", max_size=8), max_size=12))
def test_equal_letters_are_found_in_prose(spark, texts):
    texts = [t.replace(":", "").replace("=", "") for t in texts]
    key = ["".join(c for c in t.upper() if c.isalnum()) for t in texts]
    assert found(spark, texts) == sorted((key.index(k), i) for i, k in enumerate(key) if k and key.index(k) < i)


@pytest.mark.parametrize("name", ["p1_found", "p1_distinct"])
def test_equals_sql(spark, name):
    assert actual(queries.QUERIES[name](spark, DATA)) == expected(queries.SQL[name])


def test_field_order_is_shuffled(spark):
    rng = random.Random(4)
    pairs = [f"Label {chr(97 + i)}: value {i}" for i in range(12)]
    assert len(found(spark, ["\n".join(rng.sample(pairs, 12)) for _ in range(20)])) == 19
