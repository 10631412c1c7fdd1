"""Column-level helpers. All are built-in expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed 24-hour periods from start to end (not calendar days)."""
    return F.timestamp_diff("DAY", col(start), col(end))


def day_name(ts: str | Column) -> Column:
    return F.date_format(col(ts), "EEEE")


def ordered_ids(pos: str, item: str) -> Column:
    """Aggregate: items of a group as an array ordered by ``pos``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(item)))), lambda e: e[item])


def basket_f1(pred: str | Column, true: str | Column) -> Column:
    """F1 of two baskets as sets; 0 when they share nothing.

    2·tp / (|pred| + |true|) equals 2pr / (p + r).
    """
    p = F.array_distinct(col(pred))
    t = F.array_distinct(col(true))
    tp = F.size(F.array_intersect(p, t))
    return F.when(tp == 0, F.lit(0.0)).otherwise(ratio(tp * 2, F.size(p) + F.size(t)))


# Integer mixing hash for permutations (all below 2^31, so
# every product of two of them fits in a signed 64-bit integer).
HASH_PRIME = 2147483647
HASH_REP_MULT = 40503
HASH_ROUNDS = [(1103515245, 13), (1181783497, 17), (1597334677, 11)]
HASH_LANES = [(12345, 67890123), (918273645, 546372819)]
HASH_BITS = 62


def _rounds(x: Column) -> Column:
    p = F.lit(HASH_PRIME)
    for mult, shift in HASH_ROUNDS:
        x = F.pmod(x * mult, p)
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return F.pmod(x, p)


def mix_lanes(keys: list[str | Column], rep: str | Column) -> list[Column]:
    """Two pseudo-random integers in [0, 2^31 - 1) from non-negative integer
    keys and a replicate number.

    In each lane the replicate is mixed into a multiplier and a start, the
    keys are packed by that polynomial, and the result is mixed again. So the
    replicates are not shifts of one stream, keys that collide in one
    replicate part in the next, and the lanes collide independently. Pure
    64-bit integer arithmetic, and the same value in any SQL engine with %,
    >> and xor."""
    p, out = F.lit(HASH_PRIME), []
    for seeds in HASH_LANES:
        mult, start = (_rounds(F.pmod(col(rep).cast("long") * HASH_REP_MULT + s, p)) for s in seeds)
        acc = start
        for k in keys:
            acc = F.pmod(acc * (mult + 1) + F.pmod(col(k).cast("long"), p), p)
        out.append(_rounds(acc))
    return out


def mix_hash(keys: list[str | Column], rep: str | Column) -> Column:
    """Both lanes as one integer of HASH_BITS bits."""
    first, second = mix_lanes(keys, rep)
    return first * F.lit(1 << 31).cast("long") + second


def _rounds_int(x: int) -> int:
    for mult, shift in HASH_ROUNDS:
        x = x * mult % HASH_PRIME
        x ^= x >> shift
    return x % HASH_PRIME


def replicated(df: DataFrame, keys: list[str], reps: range) -> DataFrame:
    """Each row once for every number of ``reps``, with ``rep`` and
    ``_h`` = ``mix_hash(keys, rep)``.

    What depends on the replicate alone is worked out here, a few numbers for
    each; a round that reads its input twice is a projection of its own, so that
    no expression is written out twice inside another."""
    p = F.lit(HASH_PRIME)
    lanes = [(r, *[v for seeds in HASH_LANES for v in (_rounds_int((r * HASH_REP_MULT + s) % HASH_PRIME) for s in seeds)])
             for r in reps]
    values = ", ".join("(" + ", ".join([str(r), *[f"{v}L" for v in vs]]) + ")" for r, *vs in lanes)
    numbers = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(rep, {', '.join(f'_l{i}' for i in range(len(lanes[0]) - 1))})")
    out = df.select("*", F.explode(F.sequence(F.lit(reps.start), F.lit(reps.stop - 1))).alias("rep"))
    out = out.join(F.broadcast(numbers), "rep")                  # one row for each replicate
    xs = []
    for lane in range(len(HASH_LANES)):
        mult, acc = F.col(f"_l{2 * lane}"), F.col(f"_l{2 * lane + 1}")
        for k in keys:
            acc = F.pmod(acc * (mult + 1) + F.pmod(col(k).cast("long"), p), p)
        xs.append(acc.alias(f"_x{lane}"))
    names = [f"_x{lane}" for lane in range(len(HASH_LANES))]
    out = out.select(*df.columns, "rep", *xs)
    for mult, shift in HASH_ROUNDS:
        out = out.withColumns({x: F.pmod(F.col(x) * mult, p) for x in names})
        out = out.withColumns({x: F.col(x).bitwiseXOR(F.shiftright(x, shift)) for x in names})
    first, second = (F.pmod(F.col(x), p) for x in names)
    return out.select(*df.columns, "rep", (first * F.lit(1 << 31).cast("long") + second).alias("_h"))


def _rounds_sql(x: str) -> str:
    for mult, shift in HASH_ROUNDS:
        x = f"(({x}) * {mult}) % {HASH_PRIME}"
        x = f"xor({x}, ({x}) >> {shift})"
    return f"(({x}) % {HASH_PRIME})"


def mix_hash_sql(keys: list[str], rep: str) -> str:
    """The lanes of ``mix_lanes`` as SQL text (DuckDB dialect), to order by."""
    out = []
    for seeds in HASH_LANES:
        mult, start = (_rounds_sql(f"(CAST({rep} AS BIGINT) * {HASH_REP_MULT} + {s}) % {HASH_PRIME}") for s in seeds)
        acc = start
        for k in keys:
            acc = f"(({acc}) * ({mult} + 1) + (CAST({k} AS BIGINT) % {HASH_PRIME})) % {HASH_PRIME}"
        out.append(_rounds_sql(acc))
    return ", ".join(out)
