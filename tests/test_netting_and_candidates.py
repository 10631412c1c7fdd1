"""Cancellation netting against the literal many-to-many join on random
inputs, and the candidates."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from basketlab.operators import cleanse
from basketlab.operators.candidates import candidates
from basketlab.sources.raw import lines_from_rows


def _random_lines(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = rnd.choice([1, 2, 3, None])
        stock = rnd.choice(["A", "B", "C"])
        q = rnd.choice([-5, -3, -3, -2, -1, 0, 1, 2, 3, 3, 5, 8])
        rows.append((1000 + i // 3, stock, "d", q, dt.datetime(2020, 1, 1), Decimal("1.00"), user, "UK", i % 3 + 1))
    return rows


def _literal(lines):
    """The reference rule, pair by pair: every line x every cancellation of
    its (customer, code); copies with a positive sum survive."""
    canc = lines.filter("quantity < 0").select("user_id", "stock", F.col("quantity").alias("qc"))
    pairs = (lines.join(canc, ["user_id", "stock"], "left")
             .withColumn("nq", F.col("quantity") + F.coalesce("qc", F.lit(0))).filter("nq > 0"))
    return {(r.order_id, r.line_no): (r.q, r.c) for r in
            pairs.groupBy("order_id", "line_no").agg(F.sum("nq").alias("q"), F.count("*").alias("c")).collect()}


def test_reference_netting_equals_pairwise_join(spark):
    for seed in range(3):
        lines = cleanse.drop_anonymous(lines_from_rows(spark, _random_lines(seed)))
        got = {(r.order_id, r.line_no): (r.quantity, r.copies)
               for r in cleanse.net_cancellations(lines, "reference").collect()}
        assert got == _literal(lines)


def test_candidates_are_the_bought_products(spark):
    orders = spark.createDataFrame([(10, 1, "train", 0, 1, 3), (11, 2, "train", 0, 2, 4), (12, 3, "test", 0, 3, 5)],
                                   "order_id long, user_id long, eval_set string, order_hour_of_day long, "
                                   "order_dow long, days_since_prior_order long")
    bought = spark.createDataFrame([(1, 5), (1, 6), (3, 5), (4, 9)], "user_id long, product_id long")
    got = candidates(orders, bought, "train")
    assert sorted((r.order_id, r.product_id) for r in got.collect()) == [(10, 5), (10, 6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_active_lines_move_once(spark):
    """The lines of customers with more than three invoices; wide lines are
    dealt by invoice, and consolidating them needs no exchange of its own."""
    from pyspark.sql import functions as F
    from basketlab.operators import cleanse
    rows = [(u * 100 + o, p, f"s{p}", "d", 1, None, 1, u, "c", n) for u in range(1, 6) for o in range(u)
            for n, p in enumerate((1, 2, 1))] + [(401, 9, "s9", "d", 1, None, 1, 1, "c", 7)]      # an invoice of two customers
    df = spark.createDataFrame(rows, "order_id long, product_id long, stock string, description string, quantity long, "
                               "order_date timestamp_ntz, unit_price int, user_id long, country string, line_no long")
    got, want = cleanse.active_lines(df), cleanse.active_customers(df)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() == 27
    plan = cleanse.consolidate_lines(got)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "product_id" in line]
    assert not wide
    old, new = (sorted(cleanse.consolidate_lines(x).select(F.to_json(F.struct("*"))).collect()) for x in (want, got))
    assert old == new
