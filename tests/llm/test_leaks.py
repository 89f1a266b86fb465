import random
import re

import numpy as np
import pytest

from granary.llm import leaks, queries
from tests.oracle import DATA, actual, expected


def words(t):
    return re.findall(r"[^\W_]+", t.upper())


def brute(docs, items, window=12):
    out = set()
    for d, t in docs:
        w = words(t or "")
        have = {}
        for q, s in items:
            v = words(s or "")
            n = min(window, len(v))
            if n:
                have.setdefault(n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
                if any(tuple(v[i : i + n]) in have[n] for i in range(len(v) - n + 1)):
                    out.add((d, q))
    return out


def index(rows, **conf):
    return leaks.Index(np.concatenate([np.asarray(r, np.int64) for r in rows]), np.array([len(r) for r in rows]), **conf)


def _made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([3, 7, 11, 12, 13, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "?!")]
    docs = []
    for i in range(60):
        w = words(items[rng.randrange(25)][1])
        n = rng.choice([5, 11, 12, 13, 30])
        at = rng.randrange(max(1, len(w) - n + 1))
        part = ", ".join(w[at : at + n]).lower() if rng.random() < 0.7 else text(15)
        docs.append((i, f"{text(rng.randrange(30))} — {part}. {text(rng.randrange(30))}"))
    return docs + [(900, None), (901, ""), (902, text(20_000) + " " + items[5][1] + " x")], items


@pytest.mark.parametrize("seed, scan", [(1, leaks.SCAN_WINDOWS), (2, 40)])
def test_equals_brute_force(spark, rows, seed, scan, monkeypatch):
    monkeypatch.setattr(leaks, "SCAN_WINDOWS", scan)
    docs, items = _made(seed)
    got = leaks.leaks(rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items))
    assert {tuple(r) for r in got.select("doc_id", "item_id").collect()} == brute(docs, items) and got.count() == len(brute(docs, items))


def test_steps_of_the_scan_meet(spark, rows, monkeypatch):
    monkeypatch.setattr(leaks, "STEP", 7)
    docs, items = _made(3)
    hashed = lambda t: np.array([hash(w) for w in words(t or "")], np.int64)
    idx = index([hashed(t) for _, t in items])
    h, of = np.concatenate([hashed(t) for _, t in docs[:-1]]), np.repeat(np.arange(len(docs) - 1), [len(words(t or "")) for _, t in docs[:-1]])
    assert {(docs[d][0], items[i][0]) for part in idx.search(h, of, 1.0) for d, i in zip(*part[:2])} == brute(docs[:-1], items)


@pytest.mark.parametrize("radius, pairs", [(0, 1 << 22), (1, 1 << 22), (3, 1 << 22), (3, 50), (11, 1000)])
def test_no_pair_within_the_radius_is_missed(radius, pairs, monkeypatch):
    monkeypatch.setattr(leaks, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    idx = index(rng.integers(-(2**62), 2**62, (200, 12)), radius=radius)
    fp = idx.sizes[12]["fp"]
    asked = fp[rng.integers(0, 200, 500)] ^ np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) for _ in range(500)])
    d, i = (np.concatenate(x) for x in zip(*idx.near(asked, 12)))
    want = {(a, b) for a in range(500) for b in range(200) if int(np.bitwise_count(asked[a] ^ fp[b])) <= radius}
    assert set(zip(d.tolist(), i.tolist())) == want and len(d) == len(want)


def test_similarity_weighs_shared_shingles_less():
    a = np.arange(12, dtype=np.int64) + 100
    b = a.copy()
    b[11] = 5
    idx = index([a, b], shingle=1)
    s = idx.similarity(np.stack([a, a]), np.array([0, 1]), 12)
    assert s[0] == 1 and 0.5 < s[1] < 1
    assert index([a, b]).similarity(a[None, :], np.array([1]), 12)[0] < 1


def test_nothing_and_repeated_rows(spark, rows):
    docs, items = rows("item_id int, doc_id bigint, text string", [(1, 1, "a b c"), (1, 1, "a b c")]), rows("item_id bigint, text string", [(1, "b c")])
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(1, 1, 1.0)]
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p8_found", "p8_leaked_items"])
def test_equals_sql(spark, name):
    assert actual(queries.QUERIES[name](spark, DATA)) == expected(queries.SQL[name])


def test_one_changed_word_in_twelve(spark, rows):
    """At the lower setting at least 0.9 of the passages with a changed word in twelve are found, and hardly anything else."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([8, 9, 12, 12, 15, 20, 40] * 30)]
    docs, planted = [], set()
    for i, w in items:
        at = rng.randrange(max(1, len(w) - 11))
        part = w[at : at + 12]
        part[rng.randrange(len(part))] = "changed"
        docs.append((1000 + i, " ".join(text(30) + part + text(30))))
        planted.add((1000 + i, i))
    docs, items = rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", [(i, " ".join(w)) for i, w in items])
    exact = leaks.leaks(docs, items).count()
    got = {tuple(r) for r in leaks.leaks(docs, items, radius=13, similarity=0.7, shingle=1).select("doc_id", "item_id").collect()}
    assert exact < 0.1 * len(planted) and len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 0.01 * len(planted)
    assert not {tuple(r) for r in leaks.leaks(docs, items, radius=13, similarity=0.99, shingle=1).select("doc_id", "item_id").collect()} & planted


def test_windows_as_long_as_the_items(spark, rows):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 20, 33, 60, 300])]
    docs = [(i, text(40) + " " + t + " " + text(20)) for i, t in items] + [(9, " ".join(items[3][1].split()[:50]))]
    got = leaks.leaks(rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items), window=400).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(5)]
    with pytest.raises(ValueError):
        leaks.leaks(rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items), similarity=0.0)
