"""Exploratory aggregates (Q1-Q9): the queries under the reference's plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.operators.distribution import group_density, group_quantiles

HOURS = list(range(24))
REORDER_RATIO_BINS = 20
QUANTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def capped_histogram(df: DataFrame, value: str, cap: int, value_out: str, count_out: str,
                     max_out: str) -> DataFrame:
    """B13 + D16 + D7: histogram of ``value`` capped at ``cap``, with the
    uncapped global maximum on every row (taken over the <= cap+1 buckets)."""
    hist = (df.groupBy(F.least(F.col(value), F.lit(cap)).cast("long").alias(value_out))
            .agg(F.count(F.lit(1)).alias(count_out), F.max(value).alias("_bucket_max")))
    return (hist.withColumn(max_out, F.max("_bucket_max").over(Window.partitionBy()).cast("long"))
            .drop("_bucket_max"))


def orders_per_user(orders: DataFrame, cap: int = K.ORDERS_PER_USER_CAP) -> DataFrame:
    """Q1: users by number of orders (capped), and the maximum."""
    per_user = orders.groupBy("user_id").agg(F.max("order_number").alias("n_orders"))
    return capped_histogram(per_user, "n_orders", cap, "n_orders_capped", "n_users", "max_orders")


def products_per_order(order_products: DataFrame, cap: int = K.PRODUCTS_PER_ORDER_CAP) -> DataFrame:
    """Q2: orders by number of distinct products (capped), and the maximum."""
    per_order = order_products.groupBy("order_id").agg(F.max("add_to_cart_order").alias("n_products"))
    return capped_histogram(per_order, "n_products", cap, "n_products_capped", "n_orders", "max_products")


def basket_averages(clean: DataFrame) -> DataFrame:
    """Q3: mean distinct products and mean quantity per order."""
    per_order = clean.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("quantity").alias("_q"))
    return per_order.agg(F.avg("_n").alias("avg_distinct_products"), F.avg("_q").alias("avg_quantity"))


def spend_vs_quantity(user_features: DataFrame) -> DataFrame:
    """Q4: money per item against total quantity, per user."""
    return user_features.select("user_id", "avg_money_spent_per_item", "total_item_quantity")


def orders_by_dow(orders: DataFrame, ts: str = "order_date") -> DataFrame:
    """Q5: orders per day of week (Monday = 0), labelled from the data."""
    return (orders.groupBy(F.weekday(ts).cast("long").alias("order_dow"))
            .agg(F.count(F.lit(1)).alias("n_orders"), F.date_format(F.min(ts), "EEEE").alias("day_name")))


def orders_by_hour(orders: DataFrame, ts: str = "order_date") -> DataFrame:
    """Q6: orders per hour of day."""
    return (orders.groupBy(F.hour(ts).cast("long").alias("order_hour_of_day"))
            .agg(F.count(F.lit(1)).alias("n_orders")))


def dow_hour_pivot(df: DataFrame, ts: str) -> DataFrame:
    """Counts by day of week x hour; hours fixed to 0..23 so the
    pivot needs no extra pass to find them; empty cells are null."""
    p = (df.select(F.weekday(ts).cast("long").alias("order_dow"), F.hour(ts).alias("_h"))
         .groupBy("order_dow").pivot("_h", HOURS).agg(F.count(F.lit(1))))
    return p.select("order_dow", *[F.col(str(h)).alias(f"h{h:02d}") for h in HOURS])


def top_products(product_features: DataFrame, column: str = "orders", k: int = 10) -> DataFrame:
    """Top k products by ``column`` (ties by product_id), with the
    lower-cased description (K2)."""
    top = product_features.orderBy(F.desc(column), F.asc("product_id")).limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc(column), F.asc("product_id")))
                      .cast("long").alias("rank"),
                      "product_id", F.lower("description").alias("description"),
                      F.col(column).alias("value"))


def reorder_ratio_by_country(customers: DataFrame, user_features: DataFrame, countries: list[str]) -> DataFrame:
    """Distribution summary of user_reorder_ratio per country."""
    df = (customers.filter(F.col("country").isin(countries))
          .join(user_features.select("user_id", "user_reorder_ratio"), "user_id", "left"))
    r = F.col("user_reorder_ratio")
    return df.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_users"), F.count(r).alias("n_with_ratio"),
        F.avg(r).alias("mean_ratio"), F.stddev_samp(r).alias("std_ratio"),
        F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"))


def _ratios(customers: DataFrame, user_features: DataFrame, countries: list[str]) -> DataFrame:
    return (customers.filter(F.col("country").isin(countries))
            .join(user_features.select("user_id", "user_reorder_ratio"), "user_id"))


def reorder_ratio_quantiles(customers: DataFrame, user_features: DataFrame, countries: list[str],
                            probabilities: list[float] = QUANTILES) -> DataFrame:
    """Exact quantiles of user_reorder_ratio per country (the box
    of the violin)."""
    return group_quantiles(_ratios(customers, user_features, countries), ["country"], "user_reorder_ratio", probabilities)


def reorder_ratio_density(customers: DataFrame, user_features: DataFrame, countries: list[str]) -> DataFrame:
    """Kernel density of user_reorder_ratio per country (the curve
    of the violin)."""
    return group_density(_ratios(customers, user_features, countries), ["country"], "user_reorder_ratio")


def reorder_ratio_histogram(customers: DataFrame, user_features: DataFrame, countries: list[str],
                            bins: int = REORDER_RATIO_BINS) -> DataFrame:
    """The same distribution as fixed-width bins over [0, 1]
    (exact and mergeable, unlike exact percentiles)."""
    df = (customers.filter(F.col("country").isin(countries))
          .join(user_features.select("user_id", "user_reorder_ratio"), "user_id")
          .filter(F.col("user_reorder_ratio").isNotNull()))
    b = F.least(F.floor(F.col("user_reorder_ratio") * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy("country", b.alias("bin")).agg(F.count(F.lit(1)).alias("n_users"))
