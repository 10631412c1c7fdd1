"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, units after a number, and
names (title-case words inside a sentence) are typed placeholders; other
words are lower-cased. Windows of ``WINDOW`` template tokens of every
document are hash-joined with the windows of the benchmark items; a shorter
item is one window. A window needs MIN_LITERAL tokens that are no
placeholders. Matches of one document and item on one diagonal (document
position minus item position) are an alignment. Where the item has slots, the
values that fill them in the document must agree: within an alignment one
item value must always be replaced by the same document value. So a question
with other numbers and names is caught, and a text that merely has the same
shape in places is not.

Only DataFrame functions are used. Canonicalising costs far more than finding
words, so documents are first reduced to those that can match: MIN_LITERAL of
WINDOW tokens always hold two neighbouring literal tokens, and the longest
such pair is the window's anchor. One pass over all texts joins their pairs of
neighbouring words with the anchors (a small table, broadcast by its size), and
only the documents found are canonicalised.

Defined results: null texts count as empty and match nothing; items that
cannot fill one window with MIN_LITERAL literal tokens match nothing; rows
with a null id take no part; rows of equal id belong together; repeated rows
and items that repeat a text count once each per id; empty tables give an
empty result; extra columns are ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.store import read
from basketlab.session import materialize

WINDOW = 8
MIN_LITERAL = 5

# Words that count as units after a number.
UNITS = ["km", "m", "cm", "mm", "mi", "ft", "in", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "ms", "min", "h",
         "hr", "hrs", "hours", "minutes", "seconds", "days", "years", "percent", "usd", "eur", "dollars", "euros",
         "mph", "kmh", "kb", "mb", "gb"]
WORD = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+"
TOKEN = WORD + r"|[.!?\n]"
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


def template(text) -> F.Column:
    """array<struct<t, v>>: template token and original token, sentence marks
    removed."""
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))

    def is_number(t):
        return F.substring(t, 1, 1).rlike(r"\p{N}")

    def is_mark(t):
        return t.isin(".", "!", "?", "\n")

    def token(raws):
        def one(t, i):
            low, before = F.lower(t), F.get(raws, i - 1)
            first = F.substring(t, 1, 1)
            plain = (F.when(first.between("0", "9") | (first.between("²", "￿") & is_number(t)), F.lit(NUM))
                     .when(is_mark(t), F.lit(""))
                     .when(low.isin(UNITS) & before.isNotNull() & is_number(before), F.lit(UNIT))
                     .otherwise(t))
            inner = before.isNotNull() & ~is_mark(before)
            rest = F.substring(t, 2, 1 << 30)
            name = inner & (F.length(t) > 1) & (first != F.lower(first)) & (rest == F.lower(rest))
            kind = F.when(t == low, plain).otherwise(
                F.when(low.isin(UNITS) & inner & is_number(before), F.lit(UNIT)).when(name, F.lit(NAME)).otherwise(low))
            return F.struct(kind.alias("t"), t.alias("v"))
        return one

    # ``raw`` is used twice inside the lambda; naming it once as an array of
    # one element keeps it evaluated once per row.
    return F.flatten(F.transform(F.array(raw), lambda r: F.filter(F.transform(r, token(r)), lambda x: x["t"] != "")))


def _windows(tokens: F.Column, size: int) -> F.Column:
    """xxhash64 of each window of ``size`` template tokens."""
    t = F.transform(tokens, lambda x: x["t"])
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    both = F.array(F.struct(t.alias("t"), starts.alias("s")))
    return F.flatten(F.transform(both, lambda x: F.transform(x["s"], lambda i: F.xxhash64(F.slice(x["t"], i, size)))))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, at, h, slots, a1, a2): the windows of the benchmark with
    their slots and their anchor (two neighbouring literal tokens)."""
    t = (items.select(F.col(id_col).cast("long").alias("item"), template(text_col).alias("tokens"))
         .where("item is not null"))
    size = F.least(F.size("tokens"), F.lit(WINDOW))
    rows = t.withColumn("size", size).where(F.col("size") >= MIN_LITERAL)
    rows = rows.withColumn("h", F.expr("null").cast("array<bigint>"))
    for n in range(MIN_LITERAL, WINDOW + 1):
        rows = rows.withColumn("h", F.when(F.col("size") == n, _windows(F.col("tokens"), n)).otherwise(F.col("h")))
    rows = rows.select("item", "size", "tokens", F.posexplode_outer("h").alias("at", "h")).where("h is not null")
    part = F.slice("tokens", F.col("at") + 1, F.col("size"))
    literal = F.filter(part, lambda x: ~x["t"].isin(NUM, UNIT, NAME))
    rows = rows.where(F.size(literal) >= MIN_LITERAL)
    pairs = F.zip_with(part, F.slice(part, 2, WINDOW), lambda x, y: F.struct(
        (-F.length(x["t"]) - F.length(y["t"])).alias("n"), x["t"].alias("a"), y["t"].alias("b")))
    pairs = F.filter(pairs, lambda p: p["b"].isNotNull() & ~p["a"].isin(NUM, UNIT, NAME) & ~p["b"].isin(NUM, UNIT, NAME))
    anchor = F.array_min(pairs)
    slots = F.filter(F.transform(part, lambda x, i: F.struct((i + F.col("at")).alias("p"), x["t"].alias("t"),
                                                             x["v"].alias("v"))),
                     lambda x: x["t"].isin(NUM, UNIT, NAME))
    return rows.select("item", "size", "at", "h", slots.alias("slots"), anchor["a"].alias("a1"), anchor["b"].alias("a2"))


def candidates(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ids of the documents that hold the anchor of a window."""
    anchors = materialize(bench.select("a1", "a2").distinct(), "anchors")
    words = (docs.select(F.col(id_col).cast("long").alias("id"),
                         F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("w")).where("id is not null")
             .select("id", F.inline_outer(F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, 1 << 30).alias("y")))))
    found = words.join(anchors, (F.lower("x") == F.col("a1")) & (F.lower("y") == F.col("a2")), "left_semi")
    return materialize(found.select("id").distinct(), "candidates")


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, windows, item_windows, changed_slots): one row per document
    and item with a consistent alignment; ``windows`` counts the item's
    windows found, ``changed_slots`` those slot values that differ."""
    bench = materialize(item_windows(items, item_id, item_text).distinct(), "bench")
    sizes = sorted(r.size for r in bench.select("size").distinct().collect())   # at most WINDOW values
    keys = bench.select("item", F.col("size").alias("isize"), "at", F.col("h").alias("ih"),
                        (F.size("slots") > 0).alias("slotted"))
    ids = candidates(docs, bench, id_col, text_col)
    tokens = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
              .join(ids, "id", "left_semi").select("id", template("_text").alias("tokens")))
    hashed = tokens.select("id", F.array(*[F.struct(F.lit(n).alias("size"), _windows(F.col("tokens"), n).alias("h"))
                                           for n in sizes or [WINDOW]]).alias("w"))
    # the outer forms: for the others the optimizer adds filters that evaluate the arrays again; the window array
    # is named alone before it is exploded, so that no row of the result carries it
    spread = (hashed.select("id", F.explode_outer("w").alias("w"))
              .select("id", F.col("w.size").alias("size"), F.col("w.h").alias("hs"))
              .select("id", "size", F.posexplode_outer("hs").alias("pos", "h")))
    hits = materialize(spread.join(keys, (F.col("h") == F.col("ih")) & (F.col("size") == F.col("isize")))
                       .select("id", "pos", "item", "at", "slotted",
                               (F.col("pos") - F.col("at")).alias("diagonal")).distinct(), "hits")

    # slot values of the documents that match a window with slots
    slotted = hits.where("slotted")
    wanted = materialize(slotted.select("id").distinct(), "slotted")
    texts = (tokens.join(wanted, "id", "left_semi")
             .select("id", F.posexplode_outer("tokens").alias("dpos", "token")).select("id", "dpos", F.col("token.v").alias("dv")))
    slots = (slotted.join(bench.select("item", "at", "slots"), ["item", "at"])
             .select("id", "item", "diagonal", F.explode("slots").alias("slot"))
             .select("id", "item", "diagonal", F.col("slot.p").alias("p"), F.col("slot.v").alias("iv")).distinct()
             .withColumn("dpos", (F.col("p") + F.col("diagonal")).cast("int")))
    filled = slots.join(texts, ["id", "dpos"])
    value = filled.groupBy("id", "item", "diagonal", "iv").agg(
        F.min("dv").alias("low"), F.max("dv").alias("high"),
        F.countDistinct(F.when(F.col("dv") != F.col("iv"), F.col("p"))).alias("changed"))
    agreed = value.groupBy("id", "item", "diagonal").agg(
        F.max((F.col("low") != F.col("high")).cast("int")).alias("clash"), F.sum("changed").alias("changed"))

    aligned = hits.join(agreed, ["id", "item", "diagonal"], "left").where("clash is null or clash = 0 or not slotted")
    per_alignment = aligned.groupBy("id", "item", "diagonal").agg(F.max("changed").alias("changed"))
    changed = per_alignment.groupBy("id", "item").agg(F.sum(F.coalesce("changed", F.lit(0))).alias("changed_slots"))
    found = aligned.select("id", "item", "at").distinct().groupBy("id", "item").agg(F.count("at").alias("windows"))
    totals = bench.groupBy("item").agg(F.countDistinct("at").alias("item_windows"))
    return (found.join(changed, ["id", "item"]).join(totals, "item")
            .select("id", "item", "windows", "item_windows", F.col("changed_slots").cast("long").alias("changed_slots")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **kw) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    pairs = contaminated_pairs(docs, items, id_col, text_col, **kw)
    gone = materialize(pairs.select(F.col("id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    pairs = contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows",
                        "changed_slots")


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)


def _tokens_sql(table: str, key: str) -> str:
    return f"""
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS pos, t, v, lit FROM (
    SELECT key, i, v, CASE WHEN mark THEN '' WHEN num THEN '<num>'
        WHEN before IS NOT NULL AND NOT bmark AND lower(v) IN ({_UNIT_LIST}) AND bnum THEN '<unit>'
        WHEN before IS NOT NULL AND NOT bmark AND v[1] <> lower(v[1]) AND len(v) > 1 AND v[2:] = lower(v[2:])
          THEN '<name>' ELSE lower(v) END AS t,
        CASE WHEN t IN ('<num>', '<unit>', '<name>') THEN 0 ELSE 1 END AS lit
    FROM (SELECT *, v IN ('.', '!', '?', chr(10)) AS mark, regexp_matches(v[1], '\\p{{N}}') AS num,
            before IN ('.', '!', '?', chr(10)) AS bmark, regexp_matches(before[1], '\\p{{N}}') AS bnum
      FROM (SELECT *, lag(v) OVER (PARTITION BY key ORDER BY i) AS before
        FROM (SELECT key, unnest(l) AS v, generate_subscripts(l, 1) AS i
          FROM (SELECT {key} AS key, regexp_extract_all(text, '\\p{{N}}+(?:[.,]\\p{{N}}+)*|\\p{{L}}+|[.!?\\n]') AS l
            FROM {table} WHERE {key} IS NOT NULL)))))
  WHERE t <> ''"""


def _sizes_sql(source: str) -> str:
    """Windows of all sizes of one token table."""
    return " UNION ALL ".join(f"""
  SELECT key, {n} AS size, pos, w FROM (
    SELECT key, pos, string_agg(t, ' ') OVER o AS w, count(*) OVER o AS c, sum(lit) OVER o AS l FROM {source}
    WINDOW o AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))
  WHERE c = {n} AND l >= {MIN_LITERAL}""" for n in range(MIN_LITERAL, WINDOW + 1))


ORACLE_SQL = f"""
WITH d AS ({_tokens_sql('documents', 'doc_id')}),
b AS ({_tokens_sql('benchmark', 'item_id')}),
len AS (SELECT key, least(count(*), {WINDOW}) AS size FROM b GROUP BY key),
bw AS (SELECT w.* FROM ({_sizes_sql('b')}) w JOIN len USING (key, size)),
dw AS ({_sizes_sql('d')}),
hits AS (SELECT DISTINCT dw.key AS id, dw.pos, bw.key AS item, bw.pos AS ipos, bw.size, dw.pos - bw.pos AS diagonal,
    contains(bw.w, '<') AS slotted
  FROM dw JOIN bw ON dw.w = bw.w AND dw.size = bw.size),
slots AS (SELECT DISTINCT h.id, h.item, h.diagonal, b.pos AS p, b.v AS iv
  FROM hits h JOIN b ON b.key = h.item AND b.pos BETWEEN h.ipos AND h.ipos + h.size - 1 WHERE b.lit = 0),
filled AS (SELECT s.*, d.v AS dv FROM slots s JOIN d ON d.key = s.id AND d.pos = s.p + s.diagonal),
value AS (SELECT id, item, diagonal, iv, min(dv) <> max(dv) AS clash, count(DISTINCT p) FILTER (WHERE dv <> iv) AS changed
  FROM filled GROUP BY ALL),
agreed AS (SELECT id, item, diagonal, max(clash::INT) AS clash, sum(changed) AS changed FROM value GROUP BY ALL),
aligned AS (SELECT h.*, a.changed FROM hits h LEFT JOIN agreed a USING (id, item, diagonal)
  WHERE coalesce(a.clash, 0) = 0 OR NOT h.slotted),
moved AS (SELECT id, item, sum(c) AS changed_slots FROM (
  SELECT id, item, diagonal, coalesce(max(changed), 0) AS c FROM aligned GROUP BY ALL) GROUP BY ALL),
found AS (SELECT id, item, count(DISTINCT ipos) AS windows FROM aligned GROUP BY ALL),
totals AS (SELECT key AS item, count(*) AS item_windows FROM bw GROUP BY ALL)
SELECT id AS doc_id, item AS item_id, windows, item_windows, changed_slots::BIGINT AS changed_slots
FROM found JOIN moved USING (id, item) JOIN totals USING (item)
"""
