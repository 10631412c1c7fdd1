"""Ranking, basket cut, blend and basket F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.functions.columns import ordered_ids, ratio


def blend(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of model scores."""
    weights = weights or K.BLEND_WEIGHTS
    total = None
    for name, w in weights.items():
        term = scores[name] * F.lit(w)
        total = term if total is None else total + term
    return total


def rank_predictions(scores: DataFrame, pred: str = "pred") -> DataFrame:
    """0-based rank per order, highest score first, ties by product_id.

    Each order's window holds its candidates only (one row per product).
    """
    w = Window.partitionBy("order_id").orderBy(F.desc(pred), F.asc("product_id"))
    return scores.withColumn("pred_rank", (F.row_number().over(w) - 1).cast("long"))


def cut_baskets(ranked: DataFrame, threshold: float = K.THRESHOLD, pred: str = "pred",
                size_col: str = "prior_size_max") -> DataFrame:
    """Keep ranks below the user's largest prior basket, and of
    those the best one plus any scoring above the threshold."""
    return ranked.filter((F.col("pred_rank") < F.col(size_col))
                         & ((F.col("pred_rank") == 0) | (F.col(pred) > F.lit(threshold))))


def true_baskets(order_products: DataFrame, eval_set: str | None = None) -> DataFrame:
    lines = order_products if eval_set is None else order_products.filter(F.col("eval_set") == eval_set)
    return lines.select("order_id", "product_id", "add_to_cart_order")


def f1_by_order(kept: DataFrame, truth: DataFrame) -> DataFrame:
    """Basket F1 per predicted order, from counts (no per-order list is
    built, and ``kept`` is read once). Orders with no true basket score 0.
    ``truth`` holds a product once per order."""
    hit = truth.select("order_id", "product_id", F.lit(1).alias("_hit"))
    counts = (kept.select("order_id", "product_id").join(hit, ["order_id", "product_id"], "left")
              .groupBy("order_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_hit").alias("tp")))
    n_true = truth.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_true"))
    f1 = F.coalesce(ratio(F.col("tp") * 2, F.col("n_pred") + F.col("n_true")), F.lit(0.0))
    return (counts.join(n_true, "order_id", "left")
            .select("order_id", "tp", "n_pred", F.coalesce("n_true", F.lit(0)).cast("long").alias("n_true"),
                    f1.alias("f1_score")))


def recommend(scores: DataFrame, truth: DataFrame, threshold: float = K.THRESHOLD,
              pred: str = "pred") -> tuple[DataFrame, DataFrame]:
    """Returns (per-order F1 frame, kept predictions)."""
    kept = cut_baskets(rank_predictions(scores, pred), threshold, pred)
    return f1_by_order(kept, truth), kept


def mean_f1(per_order: DataFrame) -> DataFrame:
    """Mean F1 over the scored orders."""
    return per_order.agg(F.avg("f1_score").alias("mean_f1"), F.count(F.lit(1)).alias("n_orders"))


def recommendation_report(per_order: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """order_id, recommendations, ordered_products, f1_score (list
    columns as arrays; recommendations in rank order, ordered products in
    cart order)."""
    rec = kept.groupBy("order_id").agg(ordered_ids("pred_rank", "product_id").alias("recommendations"))
    ordered = truth.groupBy("order_id").agg(ordered_ids("add_to_cart_order", "product_id")
                                            .alias("ordered_products"))
    return (rec.join(ordered, "order_id", "left").join(per_order.select("order_id", "f1_score"), "order_id")
            .select("order_id", "recommendations", "ordered_products", "f1_score"))
