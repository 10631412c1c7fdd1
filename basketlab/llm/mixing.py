"""Mixing sources to target weights: capped water-filling.

Every source wants a share of the budget in proportion to its weight. A
source whose share exceeds ``max_epochs`` times its own size is clamped there
and the excess goes to the others, again by weight, until no share is above
its clamp. A source's target then is ``whole`` passes over all its documents
plus a fraction of one pass; the fraction is filled with whole documents in
the order of a seeded hash, up to the document that brings the sum nearest to
the target.

Only DataFrame functions are used. The order within a source is never
sorted: two histograms over leading bits of the hash find the small range in
which the last document lies (one row per source and bucket), and only the
documents of that range are ordered. So a source that holds a third of all
rows costs partial sums, no large window.

Defined results: a null text has size 0; a null source is a source of its
own, last in the weight order; a null id is hashed as the word null; rows
equal in id and text have the same hash and are taken or left together; with
no words at all every target is 0; an empty table gives an empty result.
Columns of the input travel inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.store import read
from basketlab.operators.indexing import dense_index
from basketlab.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL_RATIO = 1.5
MAX_EPOCHS = 2
SEED = 42
BITS, LEVEL_BITS, LEVELS = 60, 12, 2


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(id_col: str, text_col: str, seed: int) -> F.Column:
    """The first 60 bits of an md5 as a long."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"),
                   F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[F.Column]:
    return [F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
            seeded_hash(id_col, text_col, seed).alias("h")]


def source_targets(sized: DataFrame, total_ratio: float = TOTAL_RATIO, max_epochs: float = MAX_EPOCHS,
                   weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target, whole, need): one row per source. Each
    round of the water-filling brings two sums and a count to the driver."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = dense_index(sizes.where("source is not null").select("source"), ["source"], "at")
    low = known.agg(F.min("at").alias("a"), F.count(F.lit(1)).alias("n")).first()
    start, n = (low.a or 0), low.n
    place = F.when(F.col("source").isNull(), F.lit(n)).otherwise(F.col("at") - F.lit(start))
    turn = F.pmod(place, F.lit(len(weights)))
    w = F.lit(None).cast("double")
    for i, x in enumerate(weights):
        w = F.when(turn == i, F.lit(float(x))).otherwise(w)
    s = materialize(sizes.join(known, "source", "left").select(
        "source", "source_size", w.alias("w"), (F.col("source_size") * float(max_epochs)).alias("cap")), "sources")
    row = s.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total = float(row.t or 0) * total_ratio
    rate, clamped = (total / row.w if row.w else 0.0), 0
    while True:
        over = F.col("w") * F.lit(rate) > F.col("cap")
        x = s.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("c"),
                  F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if x.n == clamped or not x.w:
            break
        rate, clamped = (total - x.c) / x.w, x.n
    target = F.round(F.least(F.col("w") * F.lit(rate), F.col("cap")), 6)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (s.withColumn("target", target).withColumn("whole", whole.cast("long"))
            .select("source", "source_size", "target", "whole",
                    (F.col("target") - F.col("whole") * F.col("source_size")).alias("need")))


def cut_points(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, ..., cut): documents whose hash is at most ``cut`` get one
    repetition more than ``whole``."""
    same = F.col("source").eqNullSafe(F.col("s"))
    left = targets.select(F.col("source").alias("s"), "need", F.lit(0).cast("long").alias("prefix"))
    shift = BITS
    for _ in range(LEVELS):
        shift -= LEVEL_BITS
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")
        hist = (sized.join(left, same & inside).groupBy("source", "need", F.shiftright("h", shift).alias("b"))
                .agg(F.sum("size").alias("n")))
        w = Window.partitionBy("source").orderBy("b")
        hist = hist.select("*", F.sum("n").over(w).alias("upto"))
        over = hist.where("upto > need").groupBy("source").agg(
            F.min(F.struct("b", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))).alias("x"))
        left = materialize(over.select(F.col("source").alias("s"), F.col("x.need").alias("need"),
                                       F.col("x.b").alias("prefix")), "cuts")
    last = sized.join(left, same & (F.shiftright("h", shift) == F.col("prefix")))
    w = Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole_h = Window.partitionBy("source", "h")
    last = last.select("source", "h", "need", F.sum("size").over(w).alias("upto"),
                       F.sum("size").over(whole_h).alias("n"))
    taken = last.where("upto - n / 2 <= need").groupBy("source").agg(F.max("h").alias("top"))
    edge = left.join(taken, same, "left").select(
        "s", F.coalesce("top", F.shiftleft("prefix", shift) - 1).alias("cut"))
    full = F.lit((1 << BITS) - 1)  # no bucket lies above the need: all documents
    none = F.lit(-1).cast("long")
    return materialize(targets.join(edge, same, "left").select(
        targets["*"], F.when(F.col("need") <= 0, none).otherwise(F.coalesce("cut", full)).alias("cut")), "cuts")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             total_ratio: float = TOTAL_RATIO, max_epochs: float = MAX_EPOCHS, weights: tuple = WEIGHTS,
             seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized documents, cut points): ``sized`` holds id, source, size and
    hash of every document (no text) as a written table."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), *_sized(docs, id_col, text_col, source_col, seed)),
                        "sized")
    return sized, cut_points(sized, source_targets(sized, total_ratio, max_epochs, weights))


def _repeats() -> F.Column:
    return F.col("whole") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)


def mix_counts(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats."""
    sized, cuts = mix_plan(docs, **kw)
    c = cuts.withColumnRenamed("source", "s")
    return (sized.join(c, F.col("source").eqNullSafe(F.col("s")))
            .select("id", "source", "size", "source_size", "target", _repeats().cast("long").alias("repeats")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  seed: int = SEED, **kw) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns."""
    _, cuts = mix_plan(docs, id_col, text_col, source_col, seed=seed, **kw)
    c = cuts.select(F.col("source").alias("s"), "whole", "cut")
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
                       *_sized(docs, id_col, text_col, source_col, seed)[::2])
    taken = rows.join(c, F.col("source").eqNullSafe(F.col("s"))).select("row", _repeats().cast("int").alias("n"))
    return (taken.where("n > 0").select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix_counts(read(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * F.col("repeats")).alias("taken"))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM sized GROUP BY source),
fill AS (
  SELECT *, source_size * 2.0 AS cap,
         ((SELECT sum(source_size) FROM src) * 1.5 - sum(source_size * 2.0) OVER o + source_size * 2.0)
           / ((SELECT sum(w) FROM src) - sum(w) OVER o + w) AS rate,
         row_number() OVER o AS k
  FROM src WINDOW o AS (ORDER BY source_size * 2.0 / w, source)),
lam AS (SELECT coalesce(arg_min(rate, k) FILTER (WHERE rate * w <= cap), 0) AS r FROM fill),
tgt AS (
  SELECT source, source_size, round(least(w * r, cap), 6) AS target FROM fill, lam),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS need FROM tgt),
ord AS (
  SELECT s.*, n.source_size, n.target, n.whole, n.need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS n
  FROM sized s JOIN need n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN need > 0 AND upto - n / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ord
"""
