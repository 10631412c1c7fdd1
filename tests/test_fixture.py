"""Hand-computed fixture (FIXTURES.md section 3): every expected value was
worked out by hand from the reference's rules."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from basketlab.operators import evaluate as E
from basketlab.operators.features import with_product_lists
from basketlab.plans.pipeline import RetailPipeline
from basketlab.sources.raw import lines_from_rows


def T(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M")


ROWS = [
    (100, "A", "alpha", 10, T("2020-01-01 23:00"), D("1.00"), 1, "UK", 1),
    (100, "B", "beta", 5, T("2020-01-01 23:00"), D("2.00"), 1, "UK", 2),
    (101, "A", "alpha v2", 4, T("2020-01-02 08:00"), D("1.50"), 1, "UK", 1),
    (900, "A", "alpha", -2, T("2020-01-03 09:00"), D("1.00"), 1, "UK", 1),
    (901, "A", "alpha", -3, T("2020-01-03 10:00"), D("1.00"), 1, "UK", 1),
    (102, "B", "beta", 1, T("2020-01-05 08:00"), D("2.00"), 1, "FR", 1),
    (102, "B", "beta", 2, T("2020-01-05 08:00"), D("2.50"), 1, "FR", 2),
    (102, "POST", "postage", 1, T("2020-01-05 08:00"), D("9.00"), 1, "FR", 3),
    (103, "C", "gamma", 7, T("2020-01-05 08:00"), D("3.00"), 1, "FR", 1),
    (104, "C", "gamma", 1, T("2020-01-09 12:00"), D("3.00"), 1, "FR", 1),
    (104, "B", "beta", 2, T("2020-01-09 12:00"), D("2.00"), 1, "FR", 2),
    (200, "A", "alpha", 1, T("2020-01-01 10:00"), D("1.00"), 2, "UK", 1),
    (201, "A", "alpha", 1, T("2020-01-02 10:00"), D("1.00"), 2, "UK", 1),
    (202, "A", "alpha", 1, T("2020-01-03 10:00"), D("1.00"), 2, "UK", 1),
    (300, "A", "alpha", 9, T("2020-01-01 10:00"), D("1.00"), None, "UK", 1),
]


@pytest.fixture(scope="module")
def pipe(spark):
    return RetailPipeline(lines_from_rows(spark, ROWS), codes=["POST"], share=1.0)


def test_clean_reference_mode(pipe):
    got = {(r.order_id, r.product_id_original, r.quantity, float(r.unit_price)) for r in pipe.clean.collect()}
    assert got == {(100, "A", 15, 1.0), (100, "B", 5, 2.0), (101, "A", 3, 1.5), (102, "B", 3, 2.0),
                   (103, "C", 7, 3.0), (104, "C", 1, 3.0), (104, "B", 2, 2.0)}


def test_clean_net_total_mode(spark):
    p = RetailPipeline(lines_from_rows(spark, ROWS), codes=["POST"], mode="net_total")
    got = {(r.order_id, r.product_id_original, r.quantity) for r in p.clean.collect()}
    assert got == {(100, "A", 5), (100, "B", 5), (102, "B", 3), (103, "C", 7), (104, "C", 1), (104, "B", 2)}


def test_clean_fifo_mode(spark):
    """Five cancelled units of A are the first five bought: 10 - 5 and 4."""
    p = RetailPipeline(lines_from_rows(spark, ROWS), codes=["POST"], mode="fifo")
    got = {(r.order_id, r.product_id_original, r.quantity) for r in p.clean.collect()}
    assert got == {(100, "A", 5), (100, "B", 5), (101, "A", 4), (102, "B", 3), (103, "C", 7), (104, "C", 1), (104, "B", 2)}


def test_product_codes_and_dimensions(pipe):
    assert {(r.stock, r.product_id) for r in pipe.product_codes.collect()} == {("A", 0), ("B", 1), ("C", 2)}
    assert {(r.product_id, r.description) for r in pipe.products.collect()} == {(0, "alpha"), (1, "beta"),
                                                                                 (2, "gamma")}
    assert [(r.user_id, r.country) for r in pipe.customers.collect()] == [(1, "UK")]


def test_orders(pipe):
    o = {r.order_id: r for r in pipe.orders.collect()}
    assert {k: v.order_number for k, v in o.items()} == {100: 1, 101: 2, 102: 3, 103: 4, 104: 5}
    assert [o[k].days_since_prior_order for k in (100, 101, 102, 103, 104)] == [None, 0, 3, 0, 4]
    assert (o[100].order_dow, o[100].order_hour_of_day) == (2, 23)
    assert o[104].eval_set == "train" and all(o[k].eval_set == "prior" for k in (100, 101, 102, 103))


def test_reordered(pipe):
    got = {(r.order_id, r.product_id): r.reordered for r in pipe.order_products.collect()}
    assert got == {(100, 0): 0, (100, 1): 0, (101, 0): 1, (102, 1): 1, (103, 2): 0, (104, 2): 1, (104, 1): 1}


def test_product_features(pipe):
    got = {r.product_id: r for r in pipe.product_features.collect()}
    a = got[0]
    assert (a.orders, a.reorders, a.reorder_rate, a.total_quantity, a.total_revenue) == (2, 1, 0.5, 18, 19.5)
    assert a.avg_price == pytest.approx(1.083333, abs=1e-6)
    assert (a.prod_first_buy, a.prod_second_buy) == (1, 1)
    c = got[2]
    assert (c.orders, c.reorders, c.reorder_rate, c.total_quantity, c.total_revenue, c.avg_price,
            c.prod_first_buy, c.prod_second_buy) == (1, 0, 0.0, 7, 21.0, 3.0, 1, 0)
    # reorders = orders - prod_first_buy
    assert all(r.reorders == r.orders - r.prod_first_buy for r in got.values())


def test_user_features(pipe):
    u = pipe.user_features.collect()[0]
    assert (u.total_items, u.total_distinct_items, u.total_item_quantity, u.total_money_spent) == (5, 3, 33, 56.5)
    assert u.avg_money_spent_per_item == pytest.approx(1.712121, abs=1e-6)
    assert u.user_reorder_ratio == pytest.approx(2 / 3)
    assert (u.average_days_between_orders, u.sum_days_between_orders, u.nb_orders) == (1.75, 7, 5)
    assert (u.order_size_mean, u.order_size_std, u.order_size_max) == (1.25, 0.5, 2)
    assert "all_products" not in pipe.user_features.columns
    assert list(with_product_lists(pipe.user_features, pipe.up_base).collect()[0].all_products) == [0, 1, 2]


def test_user_product_and_candidates(pipe):
    rows = {r.product_id: r for r in pipe.train_frame.collect()}
    assert {k: v.labels for k, v in rows.items()} == {0: 0, 1: 1, 2: 1}
    assert {k: (v.UP_orders, v.UP_orders_ratio, v.UP_total_quantity, v.UP_order_rate_since_first_order)
            for k, v in rows.items()} == {0: (2, 0.4, 18, 0.4), 1: (2, 0.4, 8, 0.4), 2: (1, 0.2, 7, 0.5)}
    assert rows[0].days_since_ratio == pytest.approx(4 / 1.76)


def test_recommendation_with_fixed_score(pipe):
    f = pipe.train_frame
    scores = f.select("order_id", "product_id", F.col("UP_orders_ratio").alias("pred"),
                      F.col("user_order_size_max").alias("prior_size_max"))
    per_order, kept = E.recommend(scores, pipe.truth("train"))
    rep = E.recommendation_report(per_order, kept, pipe.truth("train")).collect()[0]
    assert list(rep.recommendations) == [0, 1] and list(rep.ordered_products) == [2, 1]
    assert rep.f1_score == 0.5


def test_ranking_edge_cases(spark):
    scores = spark.createDataFrame(
        [(104, 0, .4, 2), (104, 1, .4, 2), (104, 2, .2, 2), (105, 0, .01, 3), (105, 1, .02, 3), (106, 0, .5, 0)],
        "order_id long, product_id long, pred double, prior_size_max long")
    truth = spark.createDataFrame([(104, 2, 1), (104, 1, 2), (105, 0, 1), (106, 0, 1)],
                                  "order_id long, product_id long, add_to_cart_order long")
    per_order, kept = E.recommend(scores, truth, 0.09)
    rep = {r.order_id: r for r in E.recommendation_report(per_order, kept, truth).collect()}
    assert set(rep) == {104, 105}
    assert list(rep[104].recommendations) == [0, 1] and rep[104].f1_score == 0.5
    assert list(rep[105].recommendations) == [1] and rep[105].f1_score == 0.0
    assert E.mean_f1(per_order).collect()[0].mean_f1 == 0.25
