"""Orders as they arrive, against the batch pipeline."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.plans.catalog import _pipe
from basketlab.sources import sinks
from basketlab.streaming import orders as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_three_batches_equal_the_batch_pipeline(spark, sf_small, tmp_path):
    p = _pipe(spark, sf_small)
    s = S.replay(spark, p.clean, str(tmp_path), batches=3)
    assert rows(s.orders(p.share, p.seed).select(*p.orders.columns)) == rows(p.orders)
    mine = s.order_products(p.share, p.seed)
    assert rows(mine) == rows(p.order_products.select(*mine.columns))
    assert s.table("late").count() == 0
    assert s._state()["batch"] == 2 and all(len(s._state()["parts"][t]) == 3 for t in ("orders", "order_lines", "late"))


def line(order, product, day, user, n=1, q=1):
    return (order, product, dt.datetime(2020, 1, 1) + dt.timedelta(days=day), D("1.00"), user, q, n)


def test_late_lines_repeated_batches_and_failures(spark, tmp_path, monkeypatch):
    s = S.OrderStream(spark, str(tmp_path))
    frame = lambda *r: spark.createDataFrame(list(r), S.LINES)
    assert s.table("orders").count() == 0
    s.process(frame(), 0)
    assert s._state()["batch"] == -1
    s.process(frame(line(10, 1, 5, 7), line(10, 2, 5, 7, 2), line(11, 1, 5, 7), line(20, 1, 3, 8)), 0)
    s.process(frame(line(99, 1, 9, 7)), 0)                      # a batch that was published is skipped
    second = frame(line(12, 1, 9, 7), line(12, 3, 9, 7, 2),     # on time
                   line(13, 1, 4, 7), line(9, 1, 5, 7),         # earlier; same time, smaller id
                   line(11, 5, 5, 7, 9),                        # a line of an order already seen
                   line(21, 2, 3, 8), line(30, 1, 0, 9))        # same time, larger id; a new customer

    def killed(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(S, "switch_manifest", killed)
    with pytest.raises(KeyboardInterrupt):
        s.process(second, 1)
    monkeypatch.undo()
    assert s.table("orders").count() == 3 and s.table("last").count() == 2      # nothing of it shows
    s.process(second, 1)
    got = {r.order_id: (r.user_id, r.order_number, r.days_since_prior_order) for r in s.table("orders").collect()}
    assert got == {10: (7, 1, None), 11: (7, 2, 0), 12: (7, 3, 4), 20: (8, 1, None), 21: (8, 2, 0), 30: (9, 1, None)}
    marks = {(r.order_id, r.product_id): (r.reordered, r.add_to_cart_order) for r in s.table("order_lines").collect()}
    assert marks == {(10, 1): (0, 1), (10, 2): (0, 2), (11, 1): (1, 1), (12, 1): (1, 1), (12, 3): (0, 2), (20, 1): (0, 1),
                     (21, 2): (0, 1), (30, 1): (0, 1)}
    assert {(r.order_id, r.product_id) for r in s.table("late").collect()} == {(13, 1), (9, 1), (11, 5)}
    assert {tuple(r) for r in s.table("last").select("user_id", "last_number", "last_id").collect()} == {(7, 3, 12), (8, 2, 21), (9, 1, 30)}


def test_state_is_replaced_and_its_former_parts_deleted(spark, tmp_path):
    import os
    s = S.OrderStream(spark, str(tmp_path))
    for k in range(3):
        s.process(spark.createDataFrame([line(k, k, k, 1)], S.LINES), k)
    parts = [os.listdir(f"{tmp_path}/parts/{d}") for d in sorted(os.listdir(f"{tmp_path}/parts"))]
    assert [sorted(x) for x in parts[:2]] == [["late", "order_lines", "orders"]] * 2 and sorted(parts[2]) == sorted(S._TABLES)
    assert s.orders(K.TRAIN_SHARE, K.SEED).where(F.col("eval_set") != "prior").count() == 1


def test_a_batch_adds_only_new_pairs_and_looks_up_few_late_orders(spark, tmp_path, monkeypatch):
    s = S.OrderStream(spark, str(tmp_path))
    frame = lambda *r: spark.createDataFrame(list(r), S.LINES)
    s.process(frame(line(10, 1, 5, 7), line(10, 2, 5, 7, 2), line(20, 1, 3, 8)), 0)

    def regroup(df):
        raise AssertionError("all pairs are grouped again")

    monkeypatch.setattr(type(spark.range(1)), "distinct", regroup)
    s.process(frame(line(11, 1, 6, 7), line(11, 3, 6, 7, 2), line(12, 3, 4, 7)), 1)
    assert rows(s.table("bought")) == [(7, 1), (7, 2), (7, 3), (8, 1)]
    assert [r.order_id for r in s.table("late").collect()] == [12]
