"""Top-N by bands and mergeable percentiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quantiles, topn
from tessera.sources.tables import materialize

SCHEMA = "g string, item string, s double, extra int"


def brute(rows, n):
    best = {}
    for g, item, s, _ in rows:
        s = -math.inf if s is None or math.isnan(s) else s
        best[g, item] = max(best.get((g, item), -math.inf), s)
    out = set()
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, item) for (h, item), s in best.items() if h == g), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        out |= {(g, item, i + 1) for i, (_, item) in enumerate(ranked[:n])}
    return out


def rows_of(seed, size):
    r = random.Random(seed)
    score = lambda: r.choice([None, math.nan, 0.5, 0.5, round(r.random(), 2), r.random() * 9 - 4])
    return [(r.choice([None, "hot", "hot", "hot", *(f"g{i}" for i in range(40))]), r.choice([None, *(f"i{i:03d}" for i in range(200))]), score(), 1) for _ in range(size)]


@pytest.mark.parametrize(("seed", "size", "n", "bands", "small"), [(1, 1500, 3, 3, 1000), (1, 1500, 3, 3, 0), (2, 300, 1, 2, 0), (3, 60, 5, 1, 0), (4, 2, 3, 4, 1000)])
def test_top_n_equals_brute_force(spark, seed, size, n, bands, small):
    rows = rows_of(seed, size)
    df = spark.createDataFrame(rows, SCHEMA)
    rank = F.coalesce(F.nanvl("s", F.lit(None)), F.lit(-math.inf))
    got = topn.top_n(df, ["g"], "item", F.col("s"), [F.desc(rank), F.asc("item")], n, bands, small).collect()
    assert {(r.g, r.item, r.group_rank) for r in got} == brute(rows, n) and len(got) == len(brute(rows, n))


def test_top_n_of_ties_and_nothing(spark):
    df = spark.createDataFrame([("a", f"i{i}", 1.0, i) for i in range(500)], SCHEMA)
    got = topn.top_n(df, ["g"], "item", F.col("s"), [F.desc("s"), F.asc("item")], 3)
    assert sorted(r.item for r in got.collect()) == ["i0", "i1", "i10"]
    assert topn.top_n(df.limit(0), ["g"], "item", F.col("s"), [F.desc("s"), F.asc("item")], 3).count() == 0


def values(seed):
    r = np.random.default_rng(seed)
    big = np.concatenate([r.integers(0, 65536, 30_000), np.full(10_000, 777), r.exponential(300, 20_000).astype(int)]).clip(0, 65535)
    wide = np.concatenate([r.normal(0, 1e-3, 4000), -r.exponential(1e6, 4000), [0.0, -0.0, 1e300, -1e300, 5e-324, math.inf, -math.inf]])
    return [("big", i % 7, float(v)) for i, v in enumerate(big)] + [("wide", i % 2, float(v)) for i, v in enumerate(wide)] + [("small", 0, float(v)) for v in (5, 1, 9)] + [("small", 0, None), ("small", 0, math.nan), (None, 1, 65535.0)]


def test_cells_keep_the_order_of_numbers(spark):
    r = np.random.default_rng(3)
    v = np.unique(np.concatenate([r.normal(0, 1, 500), 2.0 ** r.integers(-1021, 1023, 200), -(2.0 ** r.integers(-1021, 1023, 200)), np.arange(-50, 2000), [0.0, math.inf, -math.inf, 2.0**20 - 1, 1e308, -1e308, 1e-310]]))
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", quantiles.cell_of(F.col("v")).alias("c"))
    rows = rows.select("v", "c", *[e.alias(n) for n, e in zip(("low", "high"), quantiles._edges(F.col("c")))]).orderBy("v").collect()
    assert all(a.c <= b.c for a, b in zip(rows, rows[1:])) and 0 <= rows[0].c and rows[-1].c < 1 << quantiles.BITS
    assert all(r.low <= r.v <= r.high or abs(r.v) < 2.0**-1022 for r in rows)
    whole = [r.c for r in rows if r.v == int(r.v if math.isfinite(r.v) else 0) and abs(r.v) < 2**20]
    assert len(set(whole)) == len(whole)


def test_percentiles_within_their_rank_error(spark):
    rows = values(5)
    df = spark.createDataFrame(rows, "k string, day int, v double")
    eps, shares = 0.01, {"p01": 0.01, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    leaves = materialize(quantiles.leaf_counts(df, ["k", "day"], "v"), "leaves")
    days = quantiles.compress(leaves, ["k", "day"], eps)
    assert days.where("k = 'big'").count() < leaves.where("k = 'big'").count() * 0.75
    assert days.where("k <> 'big'").count() <= leaves.where("k <> 'big'").count()
    assert quantiles.compress(leaves, ["k", "day"], 0.1).where("k = 'big'").count() < 7 * 3 * quantiles.BITS / 0.1
    for digest, keys in ((days, ["k", "day"]), (quantiles.merge(days, ["k"]), ["k"]), (quantiles.compress(quantiles.merge(days, ["k"]), ["k"], eps), ["k"])):
        times = 2 if keys == ["k"] and digest is not days else 1
        for r in quantiles.quantiles(digest, keys, shares).collect():
            have = np.sort([v for k, d, v in rows if k == r.k and (len(keys) == 1 or d == r.day) and v is not None and not math.isnan(v)])
            assert r["count"] == len(have)
            for name, q in shares.items():
                wide = abs(r[name]) * 2.0**-20
                low, high = np.searchsorted(have, r[name] - wide, "left"), np.searchsorted(have, r[name] + wide, "right")
                slack = times * eps * len(have) + 1
                assert low - slack <= q * len(have) <= high + slack, (keys, name, r)
        for r in quantiles.bounds(digest, keys, {"m": 0.5}).collect():
            have = [v for k, d, v in rows if k == r.k and (len(keys) == 1 or d == r.day) and v is not None and not math.isnan(v)]
            assert r.m_low <= np.median(have) <= r.m_high


def test_medians_within_their_brackets_are_exact(spark):
    rows = [x for x in values(7) if x[0]]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    digest = quantiles.compress(quantiles.leaf_counts(df, ["k", "day"], "v"), ["k", "day"], 0.05)
    brackets = materialize(quantiles.bounds(digest, ["k", "day"], {"m": 0.5}).select("k", "day", F.col("m_low").alias("low"), F.col("m_high").alias("high"), "count"), "brackets")
    got = {(r.k, r.day): r["median"] for r in quantiles.settled_medians(df, brackets, ["k", "day"], ["k", "day"], "v").collect()}
    want = {(k, d): np.median([v for a, b, v in rows if (a, b) == (k, d) and v is not None and not math.isnan(v)]) for k, d in {(k, d) for k, d, _ in rows}}
    assert got == want
    assert quantiles.settled_medians(df, brackets.limit(0), ["k", "day"], ["k", "day"], "v").count() == 0


def test_percentiles_of_small_groups_are_exact_and_empty_is_empty(spark):
    df = spark.createDataFrame(values(6), "k string, day int, v double").where("k = 'small'")
    digest = quantiles.compress(quantiles.leaf_counts(df, ["k"], "v"), ["k"], 0.01)
    assert [(r["count"], r.m) for r in quantiles.quantiles(digest, ["k"], {"m": 0.5}).collect()] == [(3, 5.0)]
    none = quantiles.compress(quantiles.leaf_counts(df.limit(0), ["k"], "v"), ["k"], 0.01)
    assert none.count() == 0 and quantiles.bounds(none, ["k"], {"m": 0.5}).count() == 0


def test_filled_groups_are_shuffled_beyond_their_limit(spark):
    band = materialize(spark.range(3000).selectExpr("id % 1500 AS g", "concat('i', id) AS item", "pmod(id, 16) AS __salt"), "band")
    filled = materialize(spark.range(0, 1500, 2).selectExpr("id AS g"), "filled")  # a few kB of file, copied for every salt
    left = topn._unfilled(band, filled, ["g"], 700)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 1  # the hot ones
    assert left.count() == 1500 and left.where("g % 2 = 0").count() == 0
    assert "SortMergeJoin" not in topn._unfilled(band, filled, ["g"], 750)._jdf.queryExecution().executedPlan().toString()
