"""Candidate generation, labels and the feature join (Q15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.functions.columns import ratio

# Output column names of the feature frames.
ORDER_FEATURES = ["order_hour_of_day", "order_dow", "days_since_prior_order"]

USER_FEATURE_MAP = [
    ("nb_orders", "user_total_orders"),
    ("total_items", "user_total_items"),
    ("total_distinct_items", "user_total_distinct_items"),
    ("average_days_between_orders", "user_average_days_between_orders"),
    ("order_size_mean", "user_order_size_mean"),
    ("order_size_std", "user_order_size_std"),
    ("order_size_max", "user_order_size_max"),
    ("total_item_quantity", "user_total_item_quantity"),
    ("total_money_spent", "user_total_spent"),
    ("sum_days_between_orders", "user_sum_days_between_orders"),
    ("user_reorder_ratio", "user_reorder_ratio"),
]

PRODUCT_FEATURE_MAP = [
    ("orders", "product_orders"),
    ("reorders", "product_reorders"),
    ("reorder_rate", "product_reorder_rate"),
    ("total_quantity", "product_total_quantity_sold"),
    ("avg_price", "product_avg_price"),
    ("prod_first_buy", "prod_first_buy"),
    ("prod_second_buy", "prod_second_buy"),
    ("prod_1reorder_ratio", "prod_1reorder_ratio"),
    ("prod_nreorder_ratio", "prod_nreorder_ratio"),
]


def heldout_orders(orders: DataFrame, eval_set: str) -> DataFrame:
    return orders.filter(F.col("eval_set") == eval_set).select("order_id", "user_id", *ORDER_FEATURES)


def candidates(orders: DataFrame, up_features: DataFrame, eval_set: str) -> DataFrame:
    """(held-out order, product) pairs to score: each held-out order
    with the products its customer bought in prior orders. An equi-join on
    user_id, linear in the user x product table; the product dimension is
    never paired with all orders."""
    return heldout_orders(orders, eval_set).join(up_features.select("user_id", "product_id"), "user_id")


def label_candidates(cands: DataFrame, order_products: DataFrame, eval_set: str) -> DataFrame:
    """label = 1 when the product is in the held-out order."""
    truth = (order_products.filter(F.col("eval_set") == eval_set)
             .select("order_id", "product_id", F.lit(1).cast("long").alias("labels")))
    return cands.join(truth, ["order_id", "product_id"], "left").na.fill(0, ["labels"])


def attach_features(cands: DataFrame, users: DataFrame, products: DataFrame, up: DataFrame,
                    with_labels: bool) -> DataFrame:
    """C11: user, order, product and user x product features, with the
    reference's derived ratios and its null -> 0 fill."""
    u, p, x = _lookups(users, products, up)
    df = (cands.join(u, "user_id", "left")
          .join(p, "product_id", "left")
          .join(x, ["user_id", "product_id"], "left"))
    return _finish(df, with_labels)


def _lookups(users: DataFrame, product_features: DataFrame, up: DataFrame):
    u = users.select("user_id", *[F.col(a).alias(b) for a, b in USER_FEATURE_MAP])
    p = product_features.select("product_id", *[F.col(a).alias(b) for a, b in PRODUCT_FEATURE_MAP])
    x = up.select("user_id", "product_id", F.col("nb_orders").alias("UP_orders"),
                  F.col("up_total_quantity").alias("UP_total_quantity"),
                  F.col("up_first_order_number").alias("_up_first"))
    return u, p, x


def _finish(df: DataFrame, with_labels: bool) -> DataFrame:
    """The reference's derived ratios, its column order and its null -> 0 fill."""
    df = df.select(
        "*",
        ratio(F.col("days_since_prior_order"),
              F.col("user_average_days_between_orders") + K.DAYS_RATIO_SMOOTHING).alias("days_since_ratio"),
        ratio("UP_orders", "user_total_orders").alias("UP_orders_ratio"),
        ratio("UP_orders", "user_total_orders").alias("UP_reorder_rate"),
        ratio(F.col("UP_orders"), F.col("user_total_orders") - F.col("_up_first") + 1)
        .alias("UP_order_rate_since_first_order"),
    )
    keys = ["order_id", "product_id"] + (["labels"] if with_labels else []) + ["user_id"]
    return df.select(*keys, *K.ALL_FEATURES).na.fill(0, K.ALL_FEATURES)


def feature_frame(orders: DataFrame, users: DataFrame, product_features: DataFrame, up: DataFrame,
                  order_products: DataFrame, eval_set: str, with_labels: bool = False) -> DataFrame:
    """Q15: candidates of one held-out set with all features (and labels).

    Same result as candidates -> label_candidates -> attach_features. User
    features are joined to the held-out orders (one row per customer), and the
    user x product features are the candidates themselves. They meet the labels
    first, on (user_id, product_id), while they have few columns: each customer
    has one held-out order per set, so that key identifies a candidate. The
    wide pair table is then only joined with the product features.
    """
    u, p, x = _lookups(users, product_features, up)
    if with_labels:
        truth = (order_products.filter(F.col("eval_set") == eval_set)
                 .select("user_id", "product_id", F.lit(1).cast("long").alias("labels")))
        x = x.join(truth, ["user_id", "product_id"], "left").na.fill(0, ["labels"])
    held = heldout_orders(orders, eval_set).join(u, "user_id", "left")
    return _finish(held.join(x, "user_id").join(p, "product_id", "left"), with_labels)
