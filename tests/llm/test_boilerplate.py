import unicodedata
from collections import defaultdict

import pytest

from granary.llm import boilerplate, queries
from tests.oracle import DATA, actual, expected

SCHEMA = "a int, doc_ord bigint, text string, source string, line_no string"


def norm(line):
    """Normalisation P1 by a walk over the characters."""
    out = []
    for c in line.lower():
        if c.isspace():
            c = " "
        elif c.isdigit() and unicodedata.category(c) == "Nd":
            c = "#"
        elif not (c.isalnum() or c in "_#"):
            continue
        if not (out and c == out[-1] and c in " #"):
            out.append(c)
    return "".join(out).strip()


def brute(data, least):
    places = defaultdict(list)
    for _, o, t, s, _ in data:
        for i, line in enumerate([] if t is None or s is None else t.split("\n"), 1):
            places[s, norm(line)].append((o, i))
    return sorted(x for (_, line), at in places.items() if line and len({o for o, _ in at}) >= least for x in at)


def _data():
    data = [(0, i, f"Own line {chr(97 + i % 26) * 3}{i}\n\n  Share THIS  page: {i * 17}!\r\nEnd", "s" if i % 2 else "t", "x") for i in range(40)]
    data += [(0, 100 + i, "rare notice\nrare notice\n...\n \n", "s", "x") for i in range(9)] + [(0, 200, None, "s", "x"), (0, 201, "", "s", "x"), (0, 202, "End", None, "x")]
    return data + [(0, 300, ("Share this page 1\n" * 5000), "s", "x")]


@pytest.mark.parametrize("least, cells", [(10, boilerplate.CELLS), (10, 1 << 5), (2, 1 << 10)])
def test_equals_brute_force_with_any_cells(spark, rows, least, cells):
    got = boilerplate.repeated_lines(rows(SCHEMA, _data()), least=least, cells=cells).select("doc_ord", "line_no").collect()
    assert sorted(map(tuple, got)) == brute(_data(), least)


def test_large_sets_are_joined_with_salts(spark, rows, monkeypatch):
    monkeypatch.setattr(boilerplate, "SET_ROWS", 0)
    got = boilerplate.repeated_lines(rows(SCHEMA, _data())).select("doc_ord", "line_no").collect()
    assert sorted(map(tuple, got)) == brute(_data(), 10)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_texts_without_lines(spark, rows, most, monkeypatch):
    monkeypatch.setattr(boilerplate, "SET_ROWS", most)
    got = {r["doc_ord"]: (r["text"], r["n_removed"]) for r in boilerplate.without_lines(rows(SCHEMA, _data())).collect()}
    assert got[3] == ("Own line ddd3\n", 2) and got[200] == (None, 0) and got[201] == ("", 0) and got[300] == ("", 5000) and got[100][1] == 0


@pytest.mark.parametrize("size", [200, 2_000, 20_000])
def test_candidates_stay_few_at_any_size(spark, size):
    r = spark.range(size).selectExpr("id as doc_ord", "concat('own ', cast(sha2(cast(id as string), 256) as string), '\nshare ', char(97 + id % 2), '\nother ', sha2(cast(-id as string), 256)) as text", "if(id % 3 = 0, 's', 't') as source")
    found, heavy = boilerplate.confirmed(r)
    assert found.count() == size and heavy.count() <= 40  # of 3 * size lines


def test_texts_are_cut_where_they_lie(spark):
    plan = queries.p5_clean_texts(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("REPARTITION_BY_NUM", "").split("MapInArrow")[0] and "Join" not in plan


def test_nothing(spark, rows):
    assert boilerplate.repeated_lines(rows(SCHEMA, [])).count() == 0 and boilerplate.without_lines(rows(SCHEMA, [])).count() == 0


@pytest.mark.parametrize("name", ["p5_found", "p5_clean_texts"])
def test_equals_sql(spark, name):
    assert actual(queries.QUERIES[name](spark, DATA)) == expected(queries.SQL[name])
