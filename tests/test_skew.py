"""Exact offset chunking against plain counting."""

import random
from collections import Counter
from datetime import datetime, timedelta

from arbora.operators.skew import chunk_states, heavy_keys, key_bursts, key_counts, number_within_keys
from pyspark.sql import functions as F


def test_ordinals_are_exact_and_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id int, v int").repartition(5)
    got = number_within_keys(df, ["k"], ["v", "id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.ordinal, r.v, r.id))
    assert len(got) == 2000
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and [x[1:] for x in v] == sorted(x[1:] for x in v)
    sizes = chunk_states(number_within_keys(df, ["k"], ["id"]), ["k"], [F.count(F.lit(1)).alias("n")], 100)
    assert max(r.n for r in sizes.collect()) <= 100
    assert {r.k: r.n for r in key_counts(df, ["k"], ["id"], 70).collect()} == Counter(r[0] for r in rows)


def test_heavy_keys(spark):
    rows = [(i, 1, "a") for i in range(50)] + [(100 + i, 2, None) for i in range(49)] + [(200, 3, "b")]
    df = spark.createDataFrame(rows, "id int, w int, d string")
    assert {(r.w, r.d, r.n) for r in heavy_keys(df, ["w", "d"], ["id"], 2).collect()} == {(1, "a", 50)}
    assert {r.d for r in heavy_keys(df, ["w", "d"], ["id"], 1).collect()} == {"a", "b"}
    assert heavy_keys(df.limit(0), ["w", "d"], ["id"]).count() == 0


def test_ties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([("k", 1, "n")] * 7 + [("k", 1, None)], "k string, o int, n string")
    got = sorted(r.ordinal for r in number_within_keys(df, ["k"], ["o"]).collect())
    assert got == list(range(8))
    assert [tuple(r) for r in key_counts(df, ["k"], ["o"]).collect()] == [("k", 8)]
    assert number_within_keys(df.limit(0), ["k"], ["o"]).count() == 0
    clash = df.selectExpr("k", "o", "n", "1 as pid", "2 as pos", "'x' as base", "7 as ordinal", "0 as _pid")
    out = number_within_keys(clash, ["k"], ["o"])
    assert sorted(r.ordinal for r in out.collect()) == list(range(8)) and out.columns.count("ordinal") == 1 and "base" in out.columns


def test_bursts_cross_chunks(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows, at = [], {}
    for i in range(600):
        k = rng.choice(["hot", "hot", "hot", "b"])
        at[k] = at.get(k, start) + timedelta(minutes=rng.choice([1, 5, 59, 61, 300]))
        rows.append((k, i, at[k]))
    rows.append(("b", 999, None))
    df = spark.createDataFrame(rows, "k string, id int, t timestamp")
    want = {}
    for k in ("hot", "b"):
        t = sorted(r[2] for r in rows if r[0] == k and r[2])
        want[k] = (len(t), 1 + sum((b - a) > timedelta(hours=1) for a, b in zip(t, t[1:])))
    got = {r.k: (r.n, r.bursts) for r in key_bursts(df, ["k"], "t", "id", chunk_rows=17).collect()}
    assert got == want
