"""Stage tables stored by customer: the same rows, and no exchange on user_id
from the stored order lines to the feature frames."""

import re

import pytest

from basketlab.plans.catalog import _pipe, present
from basketlab.plans.pipeline import RetailPipeline

KEY = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture(scope="module")
def stored(spark, sf_small):
    before = {k: spark.conf.get(k, None) for k in (KEY, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set(KEY, "false")
    p = RetailPipeline.from_dir(spark, sf_small, customer_buckets=4)
    p.train_frame
    yield p
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    p.release()


def exchanges(df):
    """Keys of the hash exchanges of the plan, adaptive or not."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return re.findall(r"hashpartitioning\(([^)]*)\)", plan)


def test_same_rows(spark, sf_small, stored):
    base = _pipe(spark, sf_small)
    for name in ("orders", "order_products", "up_base", "user_features", "train_frame", "test_frame"):
        a, b = (present(getattr(p, name)) for p in (base, stored))       # a deviation summed in another order
        b = b.select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_no_exchange_on_the_customer(spark, stored):
    from basketlab.operators import features
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # joins by exchange unless stored so
    frames = {"up_base": features.user_product_base(stored.priors),
              "user_features": features.user_features(stored.up_base, stored.priors, stored.orders),
              "candidates": stored.candidates("train")}
    for name, df in frames.items():
        assert exchanges(df) == [], name
    for es in ("train", "test"):
        keys = exchanges(stored.feature_frame(es))
        assert keys and all("user_id" not in k.split("#")[0] for k in keys)       # only the join with the products


def test_release_drops_the_tables(spark, sf_small):
    p = RetailPipeline.from_dir(spark, sf_small, customer_buckets=2)
    p.orders
    names = [x[len("table:"):] for x in p.written if x.startswith("table:")]
    assert names and all(spark.catalog.tableExists(n) for n in names)
    p.release()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_labels_meet_the_narrow_candidates(spark, sf_small):
    """No exchange on (customer, product) carries customer or product features."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _pipe(spark, sf_small).feature_frame("train")._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pending, seen = [plan], 0
    while pending:
        node = pending.pop()
        kids = node.children()
        pending += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "Join" and "product_id" in node.condition().toString() and "user_id" in node.condition().toString():
            seen += 1
            out = [kids.apply(i).output().mkString(",") for i in range(kids.size())]
            assert not any("user_total" in o or "product_avg" in o for o in out)
    assert seen == 1


def test_stage_tables_are_compressed_well(spark, sf_small):
    p = _pipe(spark, sf_small)
    p.clean
    assert all(".zstd." in f for f in p.clean.inputFiles()) and p.clean.inputFiles()
