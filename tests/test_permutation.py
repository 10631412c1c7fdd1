"""Block-wise permutation statistics against the replicated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlab.functions.columns import mix_lanes
from basketlab.operators import permutation
from basketlab.plans import stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), None if rng.random() < 0.05 else int(rng.random() < 0.3), float(rng.integers(0, 9)),
             None if rng.random() < 0.2 else float(rng.random() ** 9 * 1e6))
            for a, b in zip(rng.integers(-50, 1 << 40, 3000), rng.integers(0, 60, 3000))]
    return spark.createDataFrame(rows + rows[:40], "a long, b long, labels long, u double, v double").repartition(3)


def test_lanes_equal_the_column_expression(spark):
    keys = [(0, 0), (-7, 3), (2147483647, 2147483646), (1 << 62, 12345)]
    df = spark.createDataFrame(keys, "a long, b long").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(9))))
    want = {(r.a, r.b, r.rep): (r.x, r.y) for r in df.select("*", *[c.alias(n) for c, n in zip(mix_lanes(["a", "b"], "rep"), "xy")]).collect()}
    cols = [np.array(k, np.int64) for k in zip(*keys)]
    got = [permutation.lane(cols, np.arange(1, 10)[None, :], i) for i in range(2)]
    for i, k in enumerate(keys):
        for r in range(1, 10):
            assert (int(got[0][i, r - 1]), int(got[1][i, r - 1])) == want[(*k, r)]


@pytest.mark.parametrize("statistic", [stats.diff_of_means, stats.diff_of_medians, stats.QuantileDifference(0.9)])
def test_no_row_is_replicated_and_results_stay(spark, frame, monkeypatch, statistic):
    def run():
        out = stats.permutation_statistics(frame, ["a", "b"], "labels", ["u", "v"], 30, statistic)
        return {(r.rep, r.feature): r.stat for r in out.collect()}

    with monkeypatch.context() as m:
        m.setattr(permutation, "first_group", lambda *a: None)       # the general way
        want = run()
    if statistic is stats.diff_of_means:
        monkeypatch.setattr(stats, "replicated", None)
    else:
        monkeypatch.setattr(stats, "_cut_points", None)
    got = run()
    assert got.keys() == want.keys() and len(got) == 62
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


def test_values_that_are_not_finite_and_null_keys(spark):
    rows = [(k if k else None, k % 2, float("nan") if k == 3 else float(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, labels long, v double")
    got = stats.permutation_statistics(df, ["id"], "labels", ["v"], 4).collect()
    assert len(got) == 5 and all(np.isnan(r.stat) for r in got)
