"""Orders, order lines and dimensions (Q19-Q22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.functions.columns import ordered_ids, whole_days_between
from basketlab.operators.indexing import hash_split
from basketlab.operators.sequence import number_within, window_within

EVAL_SETS = ("prior", "train", "test")


def orders_from_lines(clean: DataFrame) -> DataFrame:
    """One row per invoice: its customer and time (the smallest pair, as the
    reference sorts by customer and date and keeps the first row)."""
    first = F.min(F.struct("user_id", "order_date"))
    return (clean.groupBy("order_id").agg(first.alias("_f"))
            .select(F.col("_f.user_id").alias("user_id"), "order_id", F.col("_f.order_date").alias("order_date")))


def sequence_orders(orders: DataFrame) -> DataFrame:
    """Order number per customer (ties by order_id), calendar
    columns and whole days since the previous order (null for the first).

    Numbering goes through ``number_within``, so a customer with a huge
    number of orders is spread over many tasks.
    """
    seq = number_within(orders, ["user_id"], ["order_date", "order_id"], "order_number",
                        prev={"order_date": "_prev_date"})
    return seq.select(
        "user_id", "order_id", "order_date", "order_number",
        F.weekday("order_date").cast("long").alias("order_dow"),
        F.hour("order_date").cast("long").alias("order_hour_of_day"),
        whole_days_between(F.col("_prev_date"), F.col("order_date")).cast("long").alias("days_since_prior_order"),
    )


def last_orders(orders_seq: DataFrame) -> DataFrame:
    """The last order number of each customer."""
    return orders_seq.groupBy("user_id").agg(F.max("order_number").alias("last_order_number"))


def holdout_split(orders_seq: DataFrame, share: float = K.TRAIN_SHARE, seed: int = K.SEED) -> DataFrame:
    """G1: each customer's last order is 'train' for ceil(share·n) customers
    (hash-ranked, reproducible) and 'test' for the rest; other orders 'prior'."""
    users = hash_split(last_orders(orders_seq), ["user_id"], seed, share, "_held", "train", "test")
    return (orders_seq.join(users, "user_id", "left")
            .withColumn("eval_set", F.when(F.col("order_number") == F.col("last_order_number"), F.col("_held"))
                        .otherwise(F.lit("prior")))
            .drop("_held", "last_order_number"))


def build_orders(clean: DataFrame, share: float = K.TRAIN_SHARE, seed: int = K.SEED) -> DataFrame:
    """Q19: orders with number, calendar columns, gap and eval_set."""
    return holdout_split(sequence_orders(orders_from_lines(clean)), share, seed).select(
        "user_id", "order_id", "order_date", "order_number", "order_dow", "order_hour_of_day",
        "days_since_prior_order", "eval_set")


def cart_position(clean: DataFrame) -> DataFrame:
    """Position of each product in its order, following line order. An
    order holds the lines of one invoice, so a plain window does."""
    return window_within(clean, ["order_id"], ["line_no", "product_id"], "add_to_cart_order")


def mark_reordered(lines: DataFrame) -> DataFrame:
    """1 when the customer bought the product in an earlier order.

    The first order number per (customer, product) is an aggregate joined
    back, rather than a window: a heavy (customer, product) then meets a
    one-row side, which AQE's skew handling splits.
    """
    first = lines.groupBy("user_id", "product_id").agg(F.min("order_number").alias("_first"))
    return (lines.join(first, ["user_id", "product_id"])
            .withColumn("reordered", (F.col("order_number") > F.col("_first")).cast("long"))
            .drop("_first"))


def nth_purchase(lines: DataFrame) -> DataFrame:
    """N-th purchase of the product by the customer, in order-number order."""
    return number_within(lines, ["user_id", "product_id"], ["order_number", "order_id"],
                         "user_buy_product_times")


def build_order_products(clean: DataFrame, orders: DataFrame) -> DataFrame:
    """Q20: order lines with cart position, eval_set and reordered flag.

    Also carries user_id and order_number, which every feature step needs.
    """
    lines = cart_position(clean).select("order_id", "product_id", "quantity", "unit_price", "add_to_cart_order")
    lines = lines.join(orders.select("order_id", "user_id", "order_number", "eval_set"), "order_id", "left")
    return mark_reordered(lines).select(
        "order_id", "product_id", "quantity", "unit_price", "add_to_cart_order", "eval_set", "reordered",
        "user_id", "order_number")


def products_dimension(clean: DataFrame) -> DataFrame:
    """Q21: product id and description (the smallest non-null one)."""
    return clean.groupBy("product_id").agg(F.min("description").alias("description"))


def customers_dimension(clean: DataFrame) -> DataFrame:
    """Q21: customer and country (the country of the earliest order)."""
    return (clean.groupBy("user_id")
            .agg(F.min_by("country", F.struct("order_date", "order_id", "line_no")).alias("country")))


def baskets(order_products: DataFrame) -> DataFrame:
    """Q22: each order's products as an array in cart order, with eval_set."""
    return (order_products.groupBy("order_id")
            .agg(ordered_ids("add_to_cart_order", "product_id").alias("product_id"),
                 F.max("eval_set").alias("eval_set")))
