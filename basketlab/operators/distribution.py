"""Exact quantiles and kernel densities by group (D20), for groups of any size.

``percentile`` keeps a group's distinct values in one buffer and a sorted
window puts a group in one task. ``group_quantiles`` does neither: it counts.
A group's value range is split into BUCKETS equal parts, one partial aggregate
counts the rows of each part (and their least and greatest value), and running
sums over the at most BUCKETS counts of a group tell in which parts the wanted
order statistics lie. Only these parts are split again, between their own
least and greatest value, until they hold one value or few enough rows to be
ranked. So each pass shuffles counts, not rows, and a group with a third of
all rows costs the same partial aggregate as a small one.

Defined results: null and NaN values take no part; infinite values count as
the largest finite ones; a group without values has no row; null group keys
form a group; probabilities outside 0..1 are refused.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.session import materialize

BUCKETS = 1024        # parts of a range, and the most counts of it in one place
SMALL_PART = 4096     # rows of a part that are ranked instead of split again
DENSITY_POINTS = 64   # points of a density's grid
DENSITY_CUT = 2.0     # bandwidths the grid reaches beyond the values


def _same(keys: list[str], other: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return out


def _finite(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    big = sys.float_info.max
    x = F.col(value).cast("double")
    return (df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
            .withColumn("_x", F.greatest(F.lit(-big), F.least(F.lit(big), F.col("_x")))))


def _part(low: str, high: str) -> Column:
    """Part of [low, high] that a value falls in; halves keep the width
    finite. Every step is monotone in the value, so parts are in order."""
    width = F.col(high) / 2 - F.col(low) / 2
    share = F.try_divide(F.col("_x") / 2 - F.col(low) / 2, width)
    at = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    return F.when(width > 0, at).otherwise((F.col("_x") > F.col(low)).cast("long") * (BUCKETS - 1)).cast("long")


def group_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, _low, _high, _n): range and count of each group's values."""
    return _finite(df, keys, value).groupBy(*keys).agg(
        F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("_n"))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, start: DataFrame | None = None,
                     written: list | None = None) -> DataFrame:
    """(*keys, rank, value): for each row of ``ranks`` (*keys, rank; 0-based,
    distinct) the value of that rank in its group. Rounds of counting
    run while the frame is built; each returns one number to the driver.
    ``start``: the ``group_ranges``, if at hand. ``keys``: at least one."""
    rows = _finite(df, keys, value)
    theirs = [F.col(k).alias(f"_k_{k}") for k in keys]
    start = group_ranges(df, keys, value) if start is None else start
    # parts that hold a wanted rank: their range, rows and the rows of the group below them
    parts = materialize(
        ranks.select(*theirs, F.col("rank").cast("long").alias("_rank"))
        .join(start, _same(keys, "_k_")).where(F.col("_rank") < F.col("_n"))
        .select(*keys, "_rank", "_low", "_high", "_n", F.lit(0).cast("long").alias("_below")), "order_statistics", written)
    done = parts.where("_low = _high")
    while True:
        open_ = parts.where("_low < _high")
        todo = open_.agg(F.max("_n")).first()[0]
        if todo is None:
            break
        ranges = open_.select(*theirs, "_low", "_high", "_below").distinct()
        inside = _same(keys, "_k_") & F.col("_x").between(F.col("_low"), F.col("_high"))
        if todo <= SMALL_PART:
            order = Window.partitionBy(*keys, "_low").orderBy("_x")
            ranked = rows.join(ranges, inside).select(
                *keys, "_x", (F.row_number().over(order) - 1 + F.col("_below")).cast("long").alias("_at"))
            want = open_.select(*theirs, F.col("_rank"))
            found = ranked.join(want, _same(keys, "_k_") & (F.col("_at") == F.col("_rank"))).select(*keys, "_rank", "_x")
            return (done.select(*keys, "_rank", F.col("_low").alias("_x")).unionByName(found)
                    .select(*keys, F.col("_rank").alias("rank"), F.col("_x").alias("value")))
        counts = (rows.join(ranges, inside).groupBy(*keys, F.col("_low").alias("_of"), "_below", _part("_low", "_high").alias("_p"))
                  .agg(F.min("_x").alias("_least"), F.max("_x").alias("_most"), F.count(F.lit(1)).alias("_c")))
        upto = Window.partitionBy(*keys, "_of").orderBy("_p")         # BUCKETS rows at most
        counts = counts.select(*theirs, "_of", "_least", "_most", "_c",
                               (F.sum("_c").over(upto) - F.col("_c") + F.col("_below")).alias("_before"))
        finer = open_.select(*keys, "_rank", "_low").join(
            counts, _same(keys, "_k_") & (F.col("_low") == F.col("_of")) & (F.col("_rank") >= F.col("_before"))
            & (F.col("_rank") < F.col("_before") + F.col("_c")))
        parts = materialize(finer.select(*keys, "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"),
                                         F.col("_c").alias("_n"), F.col("_before").alias("_below")), "order_statistics", written)
        done = done.unionByName(parts.where("_low = _high"))
    return done.select(*keys, F.col("_rank").alias("rank"), F.col("_low").alias("value"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float],
                    written: list | None = None) -> DataFrame:
    """(*keys, p, n, quantile): exact quantiles, interpolated between the two
    neighbouring order statistics at rank (n - 1) * p."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    start = materialize(group_ranges(df, keys, value), "group_ranges", written)
    at = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    wanted = start.select(*keys, F.col("_n").alias("n"), at).withColumn("_r", (F.col("n") - 1) * F.col("p"))
    wanted = wanted.select(*keys, "n", "p", F.floor("_r").alias("_lo"), F.ceil("_r").alias("_hi"),
                           (F.col("_r") - F.floor("_r")).alias("_t"))
    ranks = wanted.select(*keys, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    found = materialize(order_statistics(df, keys, value, ranks, start, written), "order_statistics", written)
    ends = wanted
    for name in ("lo", "hi"):
        side = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("rank").alias("_q"), F.col("value").alias(name))
        ends = ends.join(side, _same(keys, "_k_") & (F.col(f"_{name}") == F.col("_q"))).drop("_q", *[f"_k_{k}" for k in keys])
    return ends.select(*keys, "p", "n", (F.col("lo") * (1 - F.col("_t")) + F.col("hi") * F.col("_t")).alias("quantile"))


def group_density(df: DataFrame, keys: list[str], value: str, points: int = DENSITY_POINTS,
                  cut: float = DENSITY_CUT) -> DataFrame:
    """(*keys, point, x, density): Gaussian kernel density of each group on
    ``points`` places from ``cut`` bandwidths below its least value to as many
    above its greatest, the bandwidth being std * n ** (-1/5) (Scott).

    The group's moments and then the sums of kernels are partial aggregates;
    equal values are counted before the kernels are spread over the grid.
    Groups of fewer than two values or of one repeated value have no width,
    hence no row. Lazy: nothing runs while the frame is built."""
    rows = _finite(df, keys, value)
    theirs = [F.col(k).alias(f"_k_{k}") for k in keys]
    n = F.count(F.lit(1))
    moments = rows.groupBy(*keys).agg(n.alias("_n"), F.stddev_samp("_x").alias("_s"), F.min("_x").alias("_low"),
                                      F.max("_x").alias("_high")).where("_s > 0")
    width = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    moments = moments.select(*theirs, F.col("_n").alias("_all"), width.alias("_h"), (F.col("_low") - cut * width).alias("_from"),
                             (F.col("_high") + cut * width).alias("_to"))
    counted = rows.groupBy(*keys, "_x").agg(n.alias("_c"))
    spread = counted.join(moments, _same(keys, "_k_")).select(
        *keys, "_x", "_c", "_all", "_h", "_from", "_to", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("_from") + (F.col("_to") - F.col("_from")) * F.col("point") / (points - 1)
    z = (x - F.col("_x")) / F.col("_h")
    sums = spread.groupBy(*keys, "point", "_all", "_h", "_from", "_to").agg(F.sum(F.col("_c") * F.exp(-z * z / 2)).alias("_k"))
    scale = F.col("_all") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    return sums.select(*keys, F.col("point").cast("long").alias("point"), x.alias("x"), (F.col("_k") / scale).alias("density"))
