"""Quantiles, densities and pairwise correlation against numpy and pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlab.operators import distribution as D
from basketlab.plans import stats

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def group_rows():
    """A group with most rows, one value over and over, values many orders of
    magnitude apart, ties at the wanted ranks, one row, and no value."""
    rng = random.Random(7)
    rows = [("huge", rng.gauss(0, 1) * 10 ** rng.randint(-3, 3)) for _ in range(9000)]
    rows += [("ties", float(rng.choice([1, 2, 2, 2, 3]))) for _ in range(500)]
    rows += [("same", 0.25)] * 300 + [("one", -7.5)]
    rows += [("far", x) for x in (1e300, -1e300, 1e-300, -1e-300, 0.0, 5e-324, 1.7e308, -1.7e308, 3.0)]
    rows += [(None, float(k)) for k in range(11)] + [("none", None)] * 3
    rows += [("huge", None), ("huge", float("nan")), ("two", 1.0), ("two", 2.0)]
    return rows


@pytest.mark.parametrize("buckets,small", [(1024, 4096), (16, 3), (4, 1)])
def test_quantiles_are_exact(spark, monkeypatch, buckets, small):
    monkeypatch.setattr(D, "BUCKETS", buckets)
    monkeypatch.setattr(D, "SMALL_PART", small)
    rows = group_rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.p): (r.n, r.quantile) for r in D.group_quantiles(df, ["g"], "v", PROBS).collect()}
    want = {}
    for g in {g for g, _ in rows} - {"none"}:
        x = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        for p in PROBS:
            at = (len(x) - 1) * p
            lo, hi, t = x[math.floor(at)], x[math.ceil(at)], at - math.floor(at)
            want[g, p] = (len(x), lo * (1 - t) + hi * t)
    assert got.keys() == want.keys()
    for k, (n, q) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(q, rel=1e-12, abs=0)


def test_quantiles_of_nothing_and_of_bad_probabilities(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert D.group_quantiles(df, ["g"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        D.group_quantiles(df, ["g"], "v", [1.5])


def test_no_group_is_sorted_or_gathered(spark, monkeypatch):
    """The rows a window sees are counts, or at most SMALL_PART rows."""
    monkeypatch.setattr(D, "SMALL_PART", 10)
    df = spark.range(20000).select(F.lit("g").alias("g"), (F.col("id") % 7919).cast("double").alias("v"))
    q = D.group_quantiles(df, ["g"], "v", [0.5]).first()
    assert q.quantile == float(np.median(np.arange(20000) % 7919))


def test_written_tables_belong_to_their_owner(spark):
    from basketlab.session import delete_paths, owned_by
    mine: list[str] = []
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    with owned_by(mine):
        assert D.group_quantiles(df, ["g"], "v", [0.5]).count() == 2
    assert mine
    import os
    paths = [p.replace("file:", "") for p in mine]
    assert all(map(os.path.exists, paths))
    delete_paths(spark, mine)
    assert not any(map(os.path.exists, paths)) and not mine


def test_density_is_the_sum_of_kernels(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(2, 1)) for _ in range(400)] + [("a", 2.0)] * 50 + [("b", rng.random()) for _ in range(60)]
    rows += [("one", 1.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = D.group_density(df, ["g"], "v", points=21, cut=3.0).collect()
    assert {r.g for r in got} == {"a", "b"} and len(got) == 42
    for g in "ab":
        x = np.array([v for k, v in rows if k == g])
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 21)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        mine = sorted((r.point, r.x, r.density) for r in got if r.g == g)
        assert np.allclose([m[1] for m in mine], grid) and np.allclose([m[2] for m in mine], want)
        step = grid[1] - grid[0]
        assert sum(m[2] for m in mine) * step == pytest.approx(1, abs=0.02)


def test_correlation_pair_by_pair_as_pandas(spark):
    rng = np.random.default_rng(5)
    n = 4000
    base = rng.normal(size=n)
    df = pd.DataFrame({"a": base, "b": base * 2 + rng.normal(size=n), "big": 1e9 + rng.normal(size=n),
                       "c": rng.normal(size=n), "flat": 3.3, "void": np.nan})
    df.loc[rng.random(n) < 0.3, "b"] = np.nan
    df.loc[rng.random(n) < 0.5, "c"] = np.nan
    df.loc[df["c"].isna(), "a"] = df["a"]
    cols = list(df.columns)
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in df.itertuples(index=False)]
    sdf = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in stats.corr_long(sdf, cols).collect()}
    want = df.corr()
    assert len(got) == len(cols) ** 2
    for (a, b), r in got.items():
        w = want.loc[a, b]
        if {a, b} & {"flat", "void"}:
            assert r is None
        else:
            assert r == pytest.approx(w, abs=1e-6)


def test_correlation_runs_nothing_while_built(spark):
    sc = spark.sparkContext
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (4.0, 1.0)], "a double, b double")
    group = "corr-build"
    sc.setJobGroup(group, "build")
    out = stats.corr_long(df, ["a", "b"])
    assert list(sc.statusTracker().getJobIdsForGroup(group)) == []
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.feature_a, r.feature_b): r["corr"] for r in out.collect()}["a", "b"] == pytest.approx(-1.0)
    empty = stats.corr_long(df.where("a > 9"), ["a", "b"])
    assert [r["corr"] for r in empty.collect()] == [None] * 4


def test_median_permutations_by_definition(spark):
    """Observed and permuted differences of medians over the same labels."""
    from basketlab.functions.columns import mix_hash
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 1), float(rng.randint(0, 30)) if rng.random() < 0.9 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, labels long, v double")
    size = 5
    got = {r.rep: r.stat for r in stats.permutation_statistics(df, ["id"], "labels", ["v"], size,
                                                               stats.diff_of_medians).collect()}
    n0 = sum(lab == 0 for _, lab, _ in rows)
    h = {(r.id, r.rep): r.h for r in df.select("id", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("rep"))
         .withColumn("h", mix_hash(["id"], "rep")).collect()}

    def diff(first):
        a, b = ([v for i, _, v in rows if (i in first) == side and v is not None] for side in (True, False))
        return float(np.median(a) - np.median(b))

    assert got[0] == diff({i for i, lab, _ in rows if lab == 0})
    for rep in range(1, size + 1):
        assert got[rep] == diff({i for i, _, _ in sorted(rows, key=lambda r: (h[r[0], rep], r[0]))[:n0]})
