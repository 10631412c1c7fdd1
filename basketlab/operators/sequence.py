"""Row numbers and previous-row values within groups of any size.

A window partitioned by a key puts each group in one task, which is wrong
for a key that may hold a large share of the rows (a reseller with millions
of invoices). ``number_within`` therefore never does that:

* the rows are range-partitioned on (group, order), so a large group spans
  several partitions, and written to the checkpoint folder with partition ids
  and in-partition positions (which must not change between the two reads);
* rows are numbered inside each (group, partition) block, and shifted by the
  row counts of the group's earlier blocks. The first row of a block takes its
  previous value from the last row of the block before; running sums carry the
  blocks' totals in the same way.

Nothing is collected and there is one path for every size. Where a group is
bounded by its meaning (the lines of one invoice), ``window_within`` is the
plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.session import materialize


def _total(c: str, window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def window_within(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str) -> DataFrame:
    """Row number per group, for groups that are small by their meaning."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.select("*", F.row_number().over(w).cast("long").alias(out))


def number_within(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str,
                  prev: dict[str, str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number per group in ``order_cols`` order
    (which must be a total order within the group), for each
    ``prev[src] = dst`` the value of ``src`` on the previous row (null on the
    first row of the group), and for each ``sums[src] = dst`` the sum of the
    whole-number column ``src`` over the rows before (0 on the first; nulls count as 0)."""
    prev, sums = prev or {}, sums or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    ranked = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    block = Window.partitionBy(*group_cols, "_pid").orderBy("_mid")
    local = ranked.select("*", F.row_number().over(block).alias("_local"),
                          *[F.lag(s).over(block).alias(f"_lp_{d}") for s, d in prev.items()],
                          *[_total(s, block.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_ls_{d}")
                            for s, d in sums.items()])
    last = F.max_by(F.struct(*[F.col(s).alias(d) for s, d in prev.items()]) if prev else F.lit(0), F.col("_mid"))
    blocks = ranked.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), last.alias("_last"),
                                                     *[F.sum(s).alias(f"_sum_{d}") for s, d in sums.items()])
    earlier = Window.partitionBy(*group_cols).orderBy("_pid")     # at most one row per partition
    blocks = blocks.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_pid").alias("_bp"),
                           _total("_cnt", earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
                           F.lag("_last").over(earlier).alias("_before"),
                           *[_total(f"_sum_{d}", earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_os_{d}")
                             for d in sums.values()])
    same = F.col("_pid") == F.col("_bp")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    extra = [(F.col("_off") + F.col("_local")).cast("long").alias(out)]
    for s, d in prev.items():
        extra.append(F.when(F.col("_local") == 1, F.col(f"_before.{d}")).otherwise(F.col(f"_lp_{d}")).alias(d))
    extra += [(F.col(f"_os_{d}") + F.col(f"_ls_{d}")).cast("long").alias(d) for d in sums.values()]
    return local.join(blocks, same).select(*df.columns, *extra)
