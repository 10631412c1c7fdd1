"""Positions in a global order without a single-task window.

``Window.orderBy(...)`` with no partition runs on one task. ``dense_index``
instead range-partitions the rows, numbers them inside each partition, and
adds the row count of all earlier partitions. Only the per-partition counts
(one row per partition, a bound fixed by configuration) meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the in-partition row number in the low 33 bits


def dense_index(df: DataFrame, order_cols: list[str], out: str = "idx",
                total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``out``: 0-based position of each row in the order of ``order_cols``.

    ``order_cols`` must be unique per row. With ``total`` set, that column
    holds the row count of ``df``. The range-partitioned frame is checkpointed
    to the shared checkpoint folder, so partition bounds and in-partition
    numbers stay fixed even if a task is re-run after a lost executor.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranked = materialize(ranked, "dense_index")
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    res = (ranked.join(F.broadcast(offsets), "_pid")
           .withColumn(out, (F.col("_off") + local).cast("long")))
    if total:
        res = res.withColumnRenamed("_total", total)
    return res.drop("_pid", "_mid", "_off", "_total")


def hash_split(df: DataFrame, key_cols: list[str], seed: int | str, share: float, out: str,
               first_label: str, rest_label: str, rounding: str = "ceil") -> DataFrame:
    """Exact random split of the rows of ``df`` (one row per key).

    Rows are ordered by md5(key ':' seed), ties by key; the first
    ceil(share·n) (or floor, with ``rounding='floor'``) get ``first_label``.
    The order is reproducible in any engine that has md5.
    """
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols],
                                                   F.lit(str(seed)))))
    idx = dense_index(keyed, ["_h", *key_cols], out="_i", total="_n")
    cut = F.ceil(F.col("_n") * F.lit(share)) if rounding == "ceil" else F.floor(F.col("_n") * F.lit(share))
    return (idx.withColumn(out, F.when(F.col("_i") < cut, F.lit(first_label)).otherwise(F.lit(rest_label)))
            .drop("_h", "_i", "_n"))
