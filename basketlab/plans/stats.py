"""Correlation and permutation tests."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab import constants as K
from basketlab.functions.columns import HASH_BITS, replicated
from basketlab.operators import permutation
from basketlab.operators.distribution import BUCKETS, SMALL_PART, _part
from basketlab.session import materialize


@dataclass(frozen=True)
class QuantileDifference:
    """A rank statistic: the quantile ``p`` of the first group less that of
    the second."""
    p: float = 0.5


# An aggregate of (value, in the first group), or a rank statistic.
Statistic = Callable[[Column, Column], Column] | QuantileDifference


def _moments(x: np.ndarray):
    """(n, mean, co-moment, square) of each pair of columns over the rows in
    which both have a value: ``mean`` and ``square`` are those of the first."""
    here = ~np.isnan(x)
    first = np.array([c[m][0] if m.any() else 0.0 for c, m in zip(x.T, here.T)])
    z = np.where(here, x - first, 0.0)         # exactly 0 for a constant column
    inner = z.sum(0) / np.maximum(1, here.sum(0))
    z = np.where(here, z - inner, 0.0)
    p = here.astype(float)
    n = p.T @ p
    m = z.T @ p / np.maximum(1, n)
    raw = (z * z).T @ p
    square = raw - n * m * m
    square[square <= 1e-13 * raw] = 0.0        # what rounding leaves of a column constant on these rows
    return n, m + (first + inner)[:, None], z.T @ z - n * m * m.T, square


def _merged(a, b):
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    part = b[0] / np.maximum(1, n)
    return n, a[1] + d * part, a[2] + b[2] + d * d.T * a[0] * part, a[3] + b[3] + d * d * a[0] * part


def pair_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature_a, feature_b, n, c, va, vb) of every pair a <= b of columns,
    over the rows in which both have a value (NaN counts as none): their
    number, co-moment and sums of squares, centred.

    Each task folds its batches into k x k matrices and sends one row for
    each pair; these rows, tasks x pairs, are centred on the pair's common
    mean and summed. Lazy: nothing runs while the frame is built."""
    names = list(features)

    def fold(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
                held = _moments(x) if held is None else _merged(held, _moments(x))
        if held is not None:
            n, m, c, v = held
            i, j = np.triu_indices(len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in i]), pa.array([names[k] for k in j]), pa.array(n[i, j]), pa.array(m[i, j]),
                 pa.array(m[j, i]), pa.array(c[i, j]), pa.array(v[i, j]), pa.array(v[j, i])],
                ["feature_a", "feature_b", "n", "ma", "mb", "c", "va", "vb"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        fold, "feature_a string, feature_b string, n double, ma double, mb double, c double, va double, vb double")
    pair = Window.partitionBy("feature_a", "feature_b")          # one row for each task
    for c in ("ma", "mb"):       # from the least mean, so that equal means differ by exactly 0
        parts = parts.withColumn(c, F.col(c) - F.min(F.when(F.col("n") > 0, F.col(c))).over(pair))
        parts = parts.withColumn(f"_d{c}", F.col(c) - F.try_divide(F.sum(F.col("n") * F.col(c)).over(pair), F.sum("n").over(pair)))
    n, da, db = F.col("n"), F.col("_dma"), F.col("_dmb")
    return parts.groupBy("feature_a", "feature_b").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("c") + F.when(n > 0, n * da * db).otherwise(0.0)).alias("c"),
        F.sum(F.col("va") + F.when(n > 0, n * da * da).otherwise(0.0)).alias("va"),
        F.sum(F.col("vb") + F.when(n > 0, n * db * db).otherwise(0.0)).alias("vb"))


def corr_long(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every ordered feature pair, long form
    (feature_a, feature_b, corr), each pair over the rows in which both have a
    value. A column that is constant there gives null (pandas: NaN), also
    with itself."""
    return corr_sets(df, {None: features})


def corr_sets(df: DataFrame, sets: dict) -> DataFrame:
    """Correlations for several feature lists from one pass over their
    union (a pair's correlation does not depend on the other columns). With
    named sets the rows carry ``feature_set``."""
    union = list(dict.fromkeys(f for feats in sets.values() for f in feats))
    m = pair_moments(df, union)
    r = F.try_divide(F.col("c"), F.sqrt(F.col("va")) * F.sqrt(F.col("vb")))
    half = m.select("feature_a", "feature_b", r.alias("corr"))
    both = half.unionByName(half.where("feature_a <> feature_b").select(
        F.col("feature_a").alias("feature_b"), F.col("feature_b").alias("feature_a"), "corr"))
    rows = [(name, a, b) for name, feats in sets.items() for a in feats for b in feats]
    wanted = df.sparkSession.createDataFrame(rows, "feature_set string, feature_a string, feature_b string")
    out = wanted.join(both, ["feature_a", "feature_b"], "left")     # bounded by the feature lists
    return out.select("feature_a", "feature_b", "corr", *([] if list(sets) == [None] else ["feature_set"]))


def diff_of_means(value: Column, in_first: Column) -> Column:
    """M1: mean of the first group minus mean of the second (an aggregate)."""
    return F.avg(F.when(in_first, value)) - F.avg(F.when(~in_first, value))


diff_of_medians = QuantileDifference(0.5)


def _inside(rows: DataFrame, parts: DataFrame, *more: Column) -> DataFrame:
    """The rows whose value lies in one of ``parts``, with its ``_low``."""
    return rows.join(F.broadcast(parts), F.col("_x").between(F.col("_low"), F.col("_high"))).select(
        *rows.columns, "_low", *more)


def _holding(counts: DataFrame, by: str, wanted: DataFrame, where: list[str]) -> DataFrame:
    """The rows of ``wanted`` with the row of ``counts`` (in order of ``by``
    within ``where``) that holds their rank; ``_before`` rows lie below it."""
    upto = F.sum("_c").over(Window.partitionBy(*where).orderBy(by))       # BUCKETS parts at most, or SMALL_PART values
    held = wanted.join(counts.withColumn("_before", upto - F.col("_c")), where).withColumn(
        "_before", F.col("_before") + F.col("_below"))
    return held.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))


def _quantile_statistic(rows: DataFrame, replicate, feature: str, p: float, count=None) -> DataFrame:
    """(rep, stat): quantile ``p`` of ``feature`` in the first group less that
    in the second, for all replicates, exactly.

    The value range is cut into parts that all replicates share. One pass
    counts (replicate, group, part) and finds the parts in which the wanted
    order statistics lie; those of permuted labels lie close together, so only
    the few rows in these parts are replicated again, with the parts cut finer,
    until a part holds few enough values to count each. ``count`` (rows,
    ranges) does a pass without replicated rows; else ``replicate`` serves."""
    x = F.col(feature).cast("double")
    big = sys.float_info.max
    rows = rows.withColumn("_x", F.greatest(F.lit(-big), F.least(F.lit(big), x))).where(~F.isnan(x) & x.isNotNull())
    group, of = ["rep", "_first"], ["rep", "_first", "_low"]
    parts = rows.agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))      # one row
    at = (F.col("_n") - 1) * F.lit(float(p))
    wanted = done = sizes = None
    while True:
        if count is not None:      # one range, then two for each group and replicate at most
            ranges = [tuple(r) for r in parts.where("_low is not null").select("_low", "_high").collect()]
        if count is not None and ranges:
            counts = count(rows, ranges)
        else:
            counts = replicate(_inside(rows, parts, _part("_low", "_high").alias("_p"))).groupBy(*of, "_p").agg(
                F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        counts = materialize(counts, "part_counts")
        if wanted is None:
            sizes = counts.groupBy(*of).agg(F.sum("_c").alias("_n"))
            wanted = sizes.select(*of, F.explode(F.array(F.floor(at), F.ceil(at))).alias("_rank"),
                                  F.lit(0).cast("long").alias("_below")).distinct()
        # a part's range is that of its values in all replicates, the same for each of them
        ranges = counts.groupBy("_low", "_p").agg(F.min("_least").alias("_from"), F.max("_most").alias("_high"))
        found = _holding(counts, "_p", wanted, of).join(ranges, ["_low", "_p"]).select(
            *group, F.col("_from").alias("_low"), "_high", "_rank", F.col("_before").alias("_below"), "_c")
        found = materialize(found, "wanted_ranks")
        closed = found.where("_low = _high").select(*group, "_rank", F.col("_low").alias("_x"))
        done = closed if done is None else done.unionByName(closed)
        wanted = found.where("_low < _high")
        parts = wanted.select("_low", "_high").distinct()     # two for each group and replicate at most
        todo = wanted.agg(F.max("_c")).first()[0]
        wanted = wanted.select(*of, "_rank", "_below")
        if todo is None or todo <= SMALL_PART:
            break
    values = replicate(_inside(rows, parts)).groupBy(*of, "_x").agg(F.count(F.lit(1)).alias("_c"))
    values = done.unionByName(_holding(values, "_x", wanted, of).select(*group, "_rank", "_x"))
    ends = values.groupBy(*group).agg(F.min(F.struct("_rank", "_x")).alias("lo"), F.max(F.struct("_rank", "_x")).alias("hi"))
    t = at - F.floor(at)
    q = ends.join(sizes.select(*group, "_n"), group).select(
        *group, (F.col("lo._x") * (1 - t) + F.col("hi._x") * t).alias("q"))
    return q.groupBy("rep").agg((F.max(F.when(F.col("_first"), F.col("q")))
                                 - F.max(F.when(~F.col("_first"), F.col("q")))).alias("stat"))


LEVEL_BITS = 10        # 1,024 counts per replicate and level
SMALL_BUCKET = 16384   # rows of a replicate that are ranked to find its last row


def _cut_points(hashed: DataFrame, n0: int, keys: list[str]) -> DataFrame:
    """(rep, cut): the struct (_h, keys) of the n0-th row of each replicate.

    A histogram over LEVEL_BITS bits of the hash finds the bucket that holds
    it; the rows of that bucket are counted by the next bits, and so on until
    no boundary bucket holds more than SMALL_BUCKET rows. Each pass shuffles
    partial counts, at most 1,024 per replicate and task whatever the size of
    the data; one row per replicate comes back."""
    spark = hashed.sparkSession
    shift, left = HASH_BITS - LEVEL_BITS, None
    while True:
        rows = hashed.withColumn("_need", F.lit(n0).cast("long"))
        if left is not None:
            rows = hashed.join(F.broadcast(left), "rep").where(F.shiftright("_h", shift + LEVEL_BITS) == F.col("_prefix"))
        counts = rows.groupBy("rep", "_need", F.shiftright("_h", shift).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("rep").orderBy("_b")
        found = (counts.withColumn("_upto", F.sum("_n").over(w))
                 .where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
                 .select("rep", "_b", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), "_n").collect())
        left = spark.createDataFrame([(r["rep"], r["_b"], r["_need"]) for r in found],
                                     "rep int, _prefix long, _need long")
        if max((r["_n"] for r in found), default=0) <= SMALL_BUCKET or shift < LEVEL_BITS:
            break
        shift -= LEVEL_BITS
    inside = hashed.join(F.broadcast(left), "rep").where(F.shiftright("_h", shift) == F.col("_prefix"))
    order = Window.partitionBy("rep").orderBy("_h", *keys)
    return (inside.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("_need"))
            .select("rep", F.struct("_h", *keys).alias("_cut")))


def _mean_differences(sums: DataFrame, features: list[str]) -> DataFrame:
    """(rep, feature, stat) from the ``sums`` of ``permutation.first_group``;
    the second group of a permutation is all rows less the first."""
    names = [f"{c}{i}" for i in range(len(features)) for c in "sc"]
    every, second = (sums.where(F.col("rep") == r).select(*[F.col(c).alias(f"{p}{c}") for c in names])
                     for r, p in ((-1, "a"), (-2, "o")))
    wide = sums.where("rep >= 0").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(second))     # one row each
    stats = []
    for i, f in enumerate(features):
        s, c = (F.when(F.col("rep") == 0, F.col(f"o{x}{i}")).otherwise(F.col(f"a{x}{i}") - F.col(f"{x}{i}")) for x in "sc")
        stats.append((F.try_divide(F.col(f"s{i}"), F.col(f"c{i}")) - F.try_divide(s, c)).alias(f))
    body = ", ".join(f"'{f}', `{f}`" for f in features)
    return wide.select("rep", *stats).selectExpr("rep", f"stack({len(features)}, {body}) AS (feature, stat)")


def permutation_statistics(df: DataFrame, key_cols: list[str], label: str, features: list[str],
                           size: int = K.PERMUTATION_REPLICATES, statistic: Statistic = diff_of_means,
                           first_label: int = 0) -> DataFrame:
    """The statistic of each feature for replicate 0 (the observed
    labels) and ``size`` label permutations; long form (rep, feature, stat).

    Replicate r puts in the first group the n0 rows with the smallest
    mix_hash(key, r) (ties by key), n0 = rows with the first label: an exact
    permutation of the labels. For whole-number keys and the difference of
    means or quantiles, ``operators.permutation`` hashes and sums blocks of rows
    for all replicates at once. Otherwise (null keys, values that are not
    finite, other statistics) ``_cut_points`` finds the last of these rows from
    counts alone, without sorting a replicate; then one pass reduces the
    features of all replicates, grouped by replicate only. Either way only
    per-task partial results and the rows next to a cut are shuffled.
    """
    base = df.select(*key_cols, label, *features)
    is_first = F.col(label) == first_label
    odd = reduce(Column.__or__, [F.col(c).isNull() for c in key_cols])
    if statistic is diff_of_means:
        odd = reduce(Column.__or__, [F.isnan(x) | (F.abs(x) == float("inf")) for x in (F.col(f).cast("double") for f in features)], odd)
    n, n0, n_odd = base.agg(F.count(F.lit(1)), F.count_if(is_first), F.count_if(odd)).first()
    whole = all(base.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in key_cols)
    if whole and size and 0 < n0 and not n_odd and (statistic is diff_of_means or isinstance(statistic, QuantileDifference)):
        marked = base.withColumn("_group", is_first.cast("double"))
        means = statistic is diff_of_means
        found = permutation.first_group(marked, key_cols, "_group", features if means else [], size, n, n0)
        if found is not None and means:
            return _mean_differences(found[0], features)
    else:
        found = None
    cut = found[1] if found else materialize(
        _cut_points(replicated(base.select(*key_cols), key_cols, range(1, size + 1)), n0, key_cols), "cut_points")
    first = F.when(F.col("rep") == 0, is_first).otherwise(F.struct("_h", *key_cols) <= F.col("_cut"))

    def replicate(rows: DataFrame) -> DataFrame:
        return (replicated(rows, key_cols, range(size + 1)).join(F.broadcast(cut), "rep", "left")   # ``size`` rows
                .withColumn("_first", first))

    if isinstance(statistic, QuantileDifference):
        def count(rows: DataFrame, ranges: list) -> DataFrame:
            return permutation.part_counts(rows.withColumn("_group", is_first.cast("double")), key_cols, "_group", cut,
                                           ranges, BUCKETS, size)

        out = [_quantile_statistic(base.select(*key_cols, label, f), replicate, f, statistic.p, count if found else None)
               .select("rep", F.lit(f).alias("feature"), "stat") for f in features]
        return reduce(DataFrame.unionByName, out)
    wide = replicate(base).groupBy("rep").agg(
        *[statistic(F.col(f).cast("double"), F.col("_first")).alias(f) for f in features])
    body = ", ".join(f"'{f}', `{f}`" for f in features)
    return wide.selectExpr("rep", f"stack({len(features)}, {body}) AS (feature, stat)")


def permutation_pvalues(df: DataFrame, key_cols: list[str], label: str, features: list[str],
                        size: int = K.PERMUTATION_REPLICATES, two_sided: bool = True,
                        statistic: Statistic = diff_of_means) -> DataFrame:
    """M3 / M4 / M5: p = share of replicates whose statistic reaches the
    observed one (absolute values when two-sided); no +1 correction."""
    stats = permutation_statistics(df, key_cols, label, features, size, statistic)
    obs = F.max(F.when(F.col("rep") == 0, F.col("stat"))).over(Window.partitionBy("feature"))
    s, o = (F.abs(F.col("stat")), F.abs(F.col("_obs"))) if two_sided else (F.col("stat"), F.col("_obs"))
    return (stats.withColumn("_obs", obs).filter(F.col("rep") > 0)
            .groupBy("feature").agg(F.max("_obs").alias("observed"),
                                    F.avg((s >= o).cast("double")).alias("p_value")))
