"""Leximin against a direct computation."""

import random

from gristmill.llm.ranking import leximin, leximin_top, standings

SCHEMA = "g int, i string, a double, b double, standing string, __s0 int"
SCORES = {"a": "a", "b": "-b"}


def brute(rows):
    """{g: [i in order]}"""
    best = {}
    for g, i, a, b, *_ in rows:
        x = best.setdefault((g, i), [None, None])
        for k, v in ((0, a), (1, None if b is None else -b)):
            if v is not None and v == v and (x[k] is None or v > x[k]):
                x[k] = v
    out = {}
    for g in {g for g, _ in best}:
        items = {i: [float("-inf") if v is None else v for v in x] for (h, i), x in best.items() if h == g}
        n = len(items)

        def share(k, v):
            col = [x[k] for x in items.values()]
            return (sum(y < v for y in col) + col.count(v) / 2) / n

        vec = {i: sorted(share(k, x[k]) for k in range(2)) for i, x in items.items()}
        out[g] = [i for i, _ in sorted(vec.items(), key=lambda t: ([-v for v in t[1]], t[0]))]
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice([None, float("nan"), 1e12, -1e12, *map(float, range(6))])
    rows = [(rng.randint(1, 4), f"i{rng.randint(0, 60)}", pick(), pick(), "x", 1) for _ in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    got = {}
    for r in leximin(df, "g", "i", SCORES).collect():
        got.setdefault(r.g, {})[r.position] = r.i
    assert {g: [v[k] for k in sorted(v)] for g, v in got.items()} == want
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    top = {}
    for r in leximin_top(df, "g", "i", SCORES, 3).collect():
        top.setdefault(r.g, {})[r.position] = r.i
    assert {g: [v[k] for k in sorted(v)] for g, v in top.items()} == {g: v[:3] for g, v in want.items()}


def test_a_weak_score_is_not_masked(spark):
    rows = [(1, "balanced", 5.0, 5.0, "", 0), (1, "extreme", 1e9, 9.0, "", 0), (1, "other", 1.0, 1.0, "", 0), (1, "low", 0.0, 8.0, "", 0)]
    assert leximin_top(spark.createDataFrame(rows, SCHEMA), "g", "i", SCORES, 1).first().i == "balanced"


def test_one_large_group(spark):
    rows = [(1, f"{i:05d}", float(i), float(i), "", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.i: r.position for r in leximin(df, "g", "i", {"a": "a"}).collect()}
    assert all(got[f"{i:05d}"] == 3000 - i for i in range(3000))


def test_null_keys_one_item_and_nothing(spark):
    df = spark.createDataFrame([(None, "x", 1.0, None, None, None), (None, None, 2.0, 1.0, None, None), (7, "y", None, None, "", 0)], SCHEMA)
    got = {(r.g, r.i): r.position for r in leximin(df, "g", "i", SCORES).collect()}
    assert got == {(None, None): 1, (None, "x"): 2, (7, "y"): 1}
    assert standings(df.filter("g = 7"), "g", "i", SCORES).first().standing == [0.5, 0.5]
    assert leximin(df.limit(0), "g", "i", SCORES).count() == 0
