"""Invariants of SURVEY section 5 on the sf0.001 tables, and order
independence of the whole chain."""

import math

from pyspark.sql import functions as F

from basketlab.plans.catalog import _pipe
from basketlab.plans.pipeline import RetailPipeline
from basketlab.operators import evaluate as E


def test_pipeline_invariants(spark, sf_small):
    p = _pipe(spark, sf_small)
    o = p.orders
    held = o.filter(F.col("eval_set") != "prior").groupBy("user_id").count()
    assert held.filter("count != 1").count() == 0
    n_users = o.select("user_id").distinct().count()
    assert held.count() == n_users
    assert o.filter(F.col("eval_set") == "train").count() == math.ceil(n_users * 0.8)
    gaps = o.groupBy("user_id").agg(F.max("order_number").alias("mx"), F.count("*").alias("n"),
                                    F.countDistinct("order_number").alias("d"))
    assert gaps.filter("mx != n OR d != n").count() == 0
    # consolidation keeps the total quantity of the customer-filtered lines
    lines = p.lines.join(p.clean.select("user_id").distinct(), "user_id", "left_semi")
    assert lines.agg(F.sum("quantity")).first()[0] == p.clean.agg(F.sum("quantity")).first()[0]
    # reorders = orders - first buys, per product
    pf = p.product_features
    assert pf.filter("reorders != orders - prod_first_buy").count() == 0
    # candidate rows = held-out orders x products their customer bought before
    for es in ("train", "test"):
        held = o.filter(F.col("eval_set") == es).select("order_id", "user_id")
        bought = p.priors.select("user_id", "product_id").distinct()
        assert p.feature_frame(es).count() == held.join(bought, "user_id").count()


def test_f1_bounds(spark, sf_small):
    p = _pipe(spark, sf_small)
    scores = p.test_frame.select("order_id", "product_id", F.col("UP_orders_ratio").alias("pred"),
                                 F.col("user_order_size_max").alias("prior_size_max"))
    per_order, kept = E.recommend(scores, p.truth("test"))
    assert per_order.filter("f1_score < 0 OR f1_score > 1").count() == 0
    assert kept.groupBy("order_id").agg(F.min("pred_rank").alias("m")).filter("m != 0").count() == 0


def test_order_independence(spark, sf_small):
    base = _pipe(spark, sf_small)
    shuffled_raw = base.raw.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))
    q = RetailPipeline(shuffled_raw, codes=base.deny_codes)
    for name in ("clean", "orders", "order_products", "product_features", "up_features"):
        a, b = getattr(base, name), getattr(q, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_attach_features_path_equals_feature_frame(spark, sf_small):
    """candidates -> label_candidates -> attach_features gives the same frame
    as the pipeline's feature_frame (which joins below the pair expansion)."""
    from basketlab.operators import candidates as C
    p = _pipe(spark, sf_small)
    for es, labelled in (("train", True), ("test", False)):
        cands = C.candidates(p.orders, p.up_features, es)
        if labelled:
            cands = C.label_candidates(cands, p.order_products, es)
        a = C.attach_features(cands, p.user_features, p.product_features, p.up_features, labelled)
        b = p.feature_frame(es)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
