"""Model path with few rounds: schema, probabilities, blend, repeatability,
validation F1 above a constant score, threshold sweep."""

import pytest
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.operators import evaluate as E
from basketlab.plans import models as M
from basketlab.plans.catalog import _pipe


@pytest.fixture(scope="module")
def scored(spark, sf_small):
    p = _pipe(spark, sf_small)
    split = M.split_users(p.train_frame)
    fit = split.where("split = 'train'").drop("split")
    settings = M.ModelSettings().with_rounds(2, trees=5)
    val = split.where("split = 'validation'").drop("split")
    return M.score(M.fit_models(fit, settings), val).cache(), M.score(M.fit_models(fit, settings), val), p


def test_probabilities_and_blend(scored):
    df, _, _ = scored
    names = [f"p_{n}" for n in K.BLEND_WEIGHTS]
    rows = df.select("order_id", "product_id", *names, "pred").collect()
    assert rows and len({(r.order_id, r.product_id) for r in rows}) == len(rows)
    for r in rows:
        assert all(0 <= r[n] <= 1 for n in names)
        assert r.pred == pytest.approx(sum(w * r[f"p_{n}"] for n, w in K.BLEND_WEIGHTS.items()))


def test_same_result_again(scored):
    a, b, _ = scored
    cols = ["order_id", "product_id", F.round("pred", 9).alias("pred")]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_validation_beats_a_constant_and_sweep_agrees(scored):
    df, _, p = scored
    truth = p.truth("train").join(df.select("order_id").distinct(), "order_id", "left_semi")
    cut = M.predictions_for_cut(df)
    sweep = {r.threshold: r for r in M.threshold_sweep(cut, truth, [0.0, 0.09, 0.3]).collect()}
    for t, r in sweep.items():
        per_order, kept = E.recommend(cut, truth, t)
        want = E.mean_f1(per_order).first()
        assert r.mean_f1 == pytest.approx(want.mean_f1) and r.n_orders == want.n_orders
    flat, _ = E.recommend(cut.withColumn("pred", F.lit(0.5)), truth, 0.09)
    assert max(r.mean_f1 for r in sweep.values()) >= E.mean_f1(flat).first().mean_f1
    assert kept.select("order_id").distinct().count() == per_order.count()


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    """No fit waits for another to end: each meets the other three."""
    import threading
    rows = [(i % 2, *[float((i * 7 + j) % 5) for j in range(len(K.ALL_FEATURES))]) for i in range(40)]
    df = spark.createDataFrame(rows, ["labels", *K.ALL_FEATURES])
    met = threading.Barrier(4)
    for cls in (M.LogisticRegression, M.GBTClassifier, M.RandomForestClassifier):
        def fit(self, data, plain=cls.fit):
            met.wait(60)
            return plain(self, data)
        monkeypatch.setattr(cls, "fit", fit)
    fitted = M.fit_models(df, M.ModelSettings().with_rounds(1, trees=2))
    assert list(fitted) == ["logistic", "gbt_leafwise", "gbt_depthwise", "forest"]
    assert fitted["forest"].getNumTrees == 2 and fitted["gbt_leafwise"].getNumTrees == 1


def test_many_rows_are_dealt_evenly_and_fitted_two_at_a_time(spark, monkeypatch):
    """One task a core with its share of the rows, whatever bytes a split may
    have; two fits at a time, boosted trees first; a forest of the same settings."""
    import threading
    monkeypatch.setattr(M, "MANY_ROWS", 100)
    rows = [(i % 2, i // 20, i % 20, *[float((i * 7 + j) % 5) for j in range(len(K.ALL_FEATURES))]) for i in range(400)]
    df = spark.createDataFrame(rows, ["labels", "user_id", "product_id", *K.ALL_FEATURES]).repartition(11)
    lock, now, most, seen = threading.Lock(), [0], [0], []
    for cls in (M.LogisticRegression, M.GBTClassifier, M.RandomForestClassifier):
        def fit(self, data, plain=cls.fit):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                seen.append((type(self).__name__, [len(p) for p in data.rdd.glom().collect()]))
            try:
                return plain(self, data)
            finally:
                with lock:
                    now[0] -= 1
        monkeypatch.setattr(cls, "fit", fit)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    fitted = M.fit_models(df, M.ModelSettings().with_rounds(1, trees=3))
    assert most == [2] and [n for n, _ in seen[:2]] == ["GBTClassifier"] * 2
    for _, sizes in seen:
        assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 400 and min(sizes) >= 50
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == was
    assert list(fitted) == ["logistic", "gbt_leafwise", "gbt_depthwise", "forest"]
    assert fitted["forest"].getNumTrees == 3 and fitted["forest"].getMaxDepth() == K.FOREST["maxDepth"]
    assert fitted["forest"].getOrDefault("maxMemoryInMB") == M.FOREST_GROUP_MB
    p = M.score(fitted, df).agg(F.count("pred").alias("n"), F.min("pred").alias("lo"), F.max("pred").alias("hi")).first()
    assert p.n == 400 and 0 <= p.lo <= p.hi <= 1
