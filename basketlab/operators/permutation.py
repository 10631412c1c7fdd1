"""Permuted labels without a row for every replicate.

A task takes the key columns of a block of rows and works out the hash of every
replicate for it as one numpy matrix (rows x replicates); sums of the first
group are then one matrix product. The first lane of ``mix_hash`` decides on
nearly every row: the n0-th smallest of N uniform numbers lies within a few
standard deviations of n0 / N, so the rows below that window are summed where
they are, and only those inside it, about sqrt(N) for each replicate, leave the
task with their whole hash, to be ranked exactly. ``first_group`` checks that
the wanted row is among them and says so if not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.columns import HASH_LANES, HASH_PRIME, HASH_REP_MULT, HASH_ROUNDS, _rounds_int
from basketlab.session import materialize

BLOCK = 2048          # rows whose hashes are in memory at once
DEVIATIONS = 7        # half the width of the window around n0 / N
FLUSH_CELLS = 1 << 14  # counted (part, value) cells that a task holds

_P, _BITS = np.uint64(HASH_PRIME), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1, in place, for x below 2^63."""
    for _ in range(2):
        high = x >> _BITS
        x &= _P
        x += high
    return np.minimum(x, x - _P, out=x)      # x - P wraps around where x < P


def lane(keys: list[np.ndarray], reps: np.ndarray, which: int) -> np.ndarray:
    """Lane ``which`` of ``mix_lanes`` for each row (of int64 keys) and
    replicate; ``reps`` is a row of replicates, or one for each row."""
    seeds = [np.array([_rounds_int((int(r) * HASH_REP_MULT + s) % HASH_PRIME) for r in reps.ravel()], np.uint64).reshape(reps.shape)
             for s in HASH_LANES[which]]
    mult, x = seeds[0] + np.uint64(1), seeds[1]
    for k in keys:
        x = _mod(x * mult + (k % HASH_PRIME).astype(np.uint64).reshape(-1, *[1] * (reps.ndim - 1)))
    for m, shift in HASH_ROUNDS:
        x = x * np.uint64(m)
        x = _mod(x)
        x ^= x >> np.uint64(shift)
    return _mod(x)


def _blocks(batches, n_keys: int):
    """(keys, the other columns) of every BLOCK rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            cols = batch.slice(at, BLOCK).columns
            yield [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols[:n_keys]], cols[n_keys:]


def _hashes(keys, rows, reps) -> np.ndarray:
    """``mix_hash`` of row ``rows[i]`` and replicate ``reps[i]``."""
    picked = [k[rows] for k in keys]
    one = [np.empty(len(rows), np.uint64) for _ in HASH_LANES]
    for r in np.unique(reps):
        m = reps == r
        for i, out in enumerate(one):
            out[m] = lane([k[m] for k in picked], np.array([[r]]), i)[:, 0]
    return (one[0] * np.uint64(1 << 31) + one[1]).astype(np.int64)


def first_group(base: DataFrame, keys: list[str], label_first: str, features: list[str], size: int, n: int, n0: int):
    """(sums, cut). ``sums``: (rep, _n, and for each i-th feature s<i>, c<i>, the sum
    and number of its values) of the first group of every replicate, of all
    rows (rep -1) and of the observed second group (rep -2). ``cut``: (rep,
    _cut), the struct (_h, keys) of the n0-th row. None if the window missed a
    row. ``keys`` are whole numbers and not null; null values take no part."""
    share, k = n0 / n, len(features)
    width = int(HASH_PRIME * (DEVIATIONS * np.sqrt(share * (1 - share) / n) + 4 / n)) + 1
    low, high = np.uint64(max(0, int(HASH_PRIME * share) - width)), np.uint64(int(HASH_PRIME * share) + width)
    reps = np.arange(1, size + 1)[None, :]
    key_names, values = [f"_k{i}" for i in range(len(keys))], [f"{c}{i}" for i in range(k) for c in "sc"]
    names = ["rep", "_n", "_h", *key_names, *values]

    def table(rep, count, h, ks, xs):
        null = pa.nulls(len(rep), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(rep, pa.int32()), pa.array(count, pa.int64()), null if h is None else pa.array(h),
             *([null] * len(keys) if h is None else [pa.array(x) for x in ks]), *[pa.array(x) for x in xs]], names)

    def fold(batches):
        sums, counts = np.zeros((size + 3, 2 * k)), np.zeros(size + 3, np.int64)
        for ks, (group, *cols) in _blocks(batches, len(keys)):
            x = np.empty((len(ks[0]), 2 * k))
            for i, c in enumerate(cols):
                v = c.to_numpy(zero_copy_only=False).astype(float)
                x[:, 2 * i + 1] = ~np.isnan(v)
                x[:, 2 * i] = np.nan_to_num(v)
            g = group.to_numpy(zero_copy_only=False)
            h = lane(ks, reps, 0)
            below = h < low
            first = np.hstack([np.ones((len(g), 1)), (g == 0)[:, None], (g == 1)[:, None], below])
            sums += first.T @ x
            counts += first.sum(0).astype(np.int64)
            row, at = np.nonzero(~below & (h <= high))
            if len(row):
                yield table(at + 1, np.ones(len(row), np.int64), _hashes(ks, row, at + 1), [c[row] for c in ks], x[row].T)
        yield table(np.r_[-1, -2, np.arange(size + 1)], counts, None, None, sums.T)

    schema = ", ".join(["rep int", "_n long", "_h long", *[f"{c} long" for c in key_names], *[f"{c} double" for c in values]])
    rows = base.select(*[F.col(c).cast("long").alias(c) for c in keys], label_first, *[F.col(c).cast("double") for c in features])
    parts = materialize(rows.mapInArrow(fold, schema), "permuted_sums")
    edge, sure = F.col("_h").isNotNull(), F.sum(F.when(F.col("_h").isNull(), F.col("_n")))
    sides = parts.where("rep > 0").groupBy("rep").agg(sure.alias("_below"), F.count("_h").alias("_inside"))
    if sides.where((F.col("_below") >= n0) | (F.col("_below") + F.col("_inside") < n0)).count():
        return None
    order = Window.partitionBy("rep").orderBy("_h", *key_names)                 # the window's rows, about sqrt(n)
    struct = F.struct("_h", *[F.col(a).alias(b) for a, b in zip(key_names, keys)])
    ranked = parts.where(edge).withColumn("_rn", F.row_number().over(order)).join(F.broadcast(sides), "rep")
    cut = materialize(ranked.where(F.col("_rn") + F.col("_below") == n0).select("rep", struct.alias("_cut")), "cut_points")
    inside = parts.join(F.broadcast(cut), "rep", "left").where(~edge | (struct <= F.col("_cut")))   # ``size`` rows
    return inside.groupBy("rep").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in values]), cut


def part_counts(rows: DataFrame, keys: list[str], label_first: str, cut: DataFrame, ranges: list, buckets: int, size: int) -> DataFrame:
    """(rep, _first, _low, _p, _c, _least, _most): how many rows of each group
    of each replicate have their value ``_x`` in part ``_p`` of each of the
    disjoint ``ranges`` (_low, _high), and the range of the part's values in this
    task. ``cut`` as of ``first_group``."""
    got = {r["rep"]: r["_cut"] for r in cut.collect()}                                # ``size`` rows
    at_cut = [tuple(got[r]) for r in range(1, size + 1)]
    top = np.array([c[0] >> 31 for c in at_cut], np.uint64)[None, :]
    lows, highs = (np.array(x, float) for x in zip(*sorted(ranges)))
    reps, names = np.arange(1, size + 1)[None, :], ["rep", "_first", "_low", "_p", "_c", "_least", "_most"]

    def emit(held):
        cells = np.array(list(held))
        counts = np.stack([v[0] for v in held.values()])              # cell x (both groups of every replicate)
        ends = np.array([v[1:] for v in held.values()])
        cell, col = np.nonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(col // 2, pa.int32()), pa.array(col % 2 == 0), pa.array(lows[cells[cell] // buckets]),
             pa.array(cells[cell] % buckets), pa.array(counts[cell, col]), pa.array(ends[cell, 0]), pa.array(ends[cell, 1])], names)

    def fold(batches):
        held: dict = {}
        for ks, (group, value) in _blocks(batches, len(keys)):
            x, g = value.to_numpy(zero_copy_only=False), group.to_numpy(zero_copy_only=False)
            part = np.searchsorted(lows, x, "right") - 1
            keep = np.flatnonzero((part >= 0) & (x <= highs[part]))
            if not len(keep):
                continue
            width = highs[part] / 2 - lows[part] / 2
            share = np.divide(x / 2 - lows[part] / 2, width, out=np.zeros(len(x)), where=width > 0)
            p = np.minimum(np.floor(share * buckets), buckets - 1)
            cell = (part * buckets + np.where(width > 0, p, (x > lows[part]) * (buckets - 1))).astype(np.int64)
            keep = keep[np.argsort(cell[keep], kind="stable")]
            ks, x, g, cell = [k[keep] for k in ks], x[keep], g[keep], cell[keep]
            h = lane(ks, reps, 0)
            first = h < top
            for i, r in zip(*np.nonzero(h == top)):
                mine = (int(_hashes(ks, [i], np.array([r + 1]))[0]), *[int(k[i]) for k in ks])
                first[i, r] = mine <= at_cut[r]
            both = np.empty((len(x), 2 * size + 2), np.int64)
            both[:, 0], both[:, 1], both[:, 2::2], both[:, 3::2] = g == 1, g == 0, first, ~first
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sums, least, most = np.add.reduceat(both, starts), np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            for j, c in enumerate(cell[starts]):
                old = held.get(c)
                held[c] = (sums[j], least[j], most[j]) if old is None else (old[0] + sums[j], min(old[1], least[j]), max(old[2], most[j]))
            if len(held) > FLUSH_CELLS:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    picked = rows.select(*[F.col(c).cast("long").alias(c) for c in keys], label_first, "_x")
    counted = picked.mapInArrow(fold, "rep int, _first boolean, _low double, _p long, _c long, _least double, _most double")
    return counted.groupBy("rep", "_first", "_low", "_p").agg(
        F.sum("_c").alias("_c"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
