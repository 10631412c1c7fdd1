"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line of a text with at least ``min_words`` words (by default
every line that has a word; a line under five words is one shingle, so only
the same words repeat it). Paragraphs with the same word sequence are one node. Nodes get
MinHash signatures over five-word shingles, cut into bands; the number of
bands is tuned from the wanted recall: with r rows a band meets a pair of
similarity s with probability s^r, so ln(1 - recall) / ln(1 - s^r) bands miss
a pair at the threshold with probability 1 - recall only.

Nodes that collide in a band are joined to the bucket's smallest node, the
components of these joins are families, and within families all pairs are
verified exactly (Jaccard similarity of the shingle counts) in blocks of
bounded size; see ``neardup`` for why that loses no link and emits no pair
lists. Components of verified links are classes. Of every class the first
occurrence in order of (id, position) stays, all others are removed.

A passage that repeats inside longer, otherwise different lines goes as well:
a word goes when it lies in a run of PASSAGE words (case and white space
apart, line ends do not interrupt) that also starts earlier, judged on the
input. Every run of PASSAGE words is assigned to the smallest hash of the
GRAM-word strings inside it, so equal runs have equal anchors; consecutive
runs with one anchor make a context. Equal contexts go but for the first;
contexts that share an anchor and differ are compared run by run.

Defined results: null text counts as empty (one empty line); rows with a null
id keep everything and give no row; rows of equal id and text are one
document; rows of equal id and different texts are told apart by text, but
share the removals of equal positions; an empty table gives an empty result;
extra columns are ignored (``drop_repeats`` keeps them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.arrays import SPACE, U, _power, as_long, flat, mix, row_blocks, words
from basketlab.llm.components import connected_components
from basketlab.llm.neardup import SIMILARITY, TEXT_BYTES, blocks_of, family_links
from basketlab.llm.shingles import WIDTH, _elements, _sequence_keys, _words
from basketlab.llm.store import join_counted, read
from basketlab.llm.substring import _window_min
from basketlab.session import materialize

MIN_WORDS = 1
PASSAGE, GRAM = 50, 26
RECALL = 0.999
BAND_ROWS = 3


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Fewest bands of ``rows`` rows that meet a pair of ``similarity`` with
    probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all lines, line offsets per text)."""
    parts = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    return parts.flatten(), np.append(0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False)))


def minhash_bands(e: np.ndarray, offs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) 64-bit band keys; every paragraph has elements."""
    n = len(offs) - 1
    out = np.zeros((n, bands), U)
    if not n:
        return out
    salts = mix(np.arange(1, 2 * bands * rows + 1).astype(U)).reshape(-1, 2)
    for b in range(bands):
        key = np.full(n, b + 1, U)
        for j in range(rows):
            x, y = salts[b * rows + j]
            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat((e ^ x) * (y | U(1)), offs[:-1]))
        out[:, b] = key
    return out


def paragraph_table(docs: DataFrame, id_col: str, text_col: str, min_words: int, bands: int, rows: int) -> DataFrame:
    """(id, at, node, n, bands) of every paragraph with enough words, as a
    written table; ``at`` is its line number, ``node`` names its words."""
    def cut(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", TEXT_BYTES):
                part, offs = lines(b.column("text"))
                h, row, n = _words(part)
                _, node, count = _sequence_keys(h, row, n)
                e, eo = _elements(h, row, n, WIDTH)
                long_ = np.flatnonzero(count >= min_words)
                of = np.searchsorted(offs, long_, side="right") - 1
                keep = np.repeat(count >= min_words, np.diff(eo))
                size = np.diff(eo)[long_]
                keys = as_long(minhash_bands(e[keep], np.append(0, np.cumsum(size)), bands, rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(of)), pa.array((long_ - offs[of]).astype(np.int32)),
                     pa.array(as_long(node)[long_]), pa.array(size.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(long_) + 1, dtype=np.int32) * bands),
                                              pa.array(keys.ravel()))], ["id", "at", "node", "n", "bands"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(plain.where("id is not null").mapInArrow(
        cut, "id long, at int, node long, n int, bands array<long>"), "paragraphs")


def paragraph_elements(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``members`` (id, at, node, family, block, blocks) with the elements of
    each: their documents are read again."""
    schema = "id long, family long, block int, blocks int, elements array<long>"

    def cut(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", TEXT_BYTES):
                part, offs = lines(b.column("text"))
                wanted = b.column("wanted")
                w = wanted.flatten()
                doc = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                at = offs[doc] + w.field("at").to_numpy()
                ok = at < offs[doc + 1]
                h, row, n = _words(part.take(pa.array(at[ok])))
                _, node, _ = _sequence_keys(h, row, n)
                e, eo = _elements(h, row, n, WIDTH)
                w = w.filter(pa.array(ok))
                same = as_long(node) == w.field("node").to_numpy()    # rows of equal id may differ in text
                lists = pa.ListArray.from_arrays(pa.array(eo.astype(np.int32)), pa.array(as_long(e)))
                out = pa.RecordBatch.from_arrays(
                    [w.field("node"), w.field("family"), w.field("block"), w.field("blocks"), lists],
                    ["id", "family", "block", "blocks", "elements"])
                yield out.filter(pa.array(same))

    wanted = members.groupBy("id").agg(F.collect_list(F.struct("at", "node", "family", "block", "blocks")).alias("wanted"))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.join(wanted, "id").select("id", "wanted", "text").mapInArrow(cut, schema)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
                        recall: float = RECALL, rows: int = BAND_ROWS) -> DataFrame:
    """(id, at, class, first_id, first_at) of every paragraph to remove."""
    bands = tuned_bands(similarity, recall, rows)
    table = paragraph_table(docs, id_col, text_col, min_words, bands, rows)
    nodes = table.groupBy("node").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("m"))
    nodes = materialize(nodes.select("node", "first.id", "first.at", "m"), "nodes")
    cells = (table.join(nodes, ["node", "id", "at"], "left_semi")
             .select("node", F.explode("bands").alias("band")))     # repeated rows repeat cells, which changes nothing
    hubs = cells.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    near = cells.join(hubs.select("band", "hub"), "band").where("node <> hub").select("node", "hub").distinct()
    family = materialize(connected_components(near, "node", "hub").select(
        F.col("node").alias("id"), F.col("component").alias("family")), "families")
    sizes = table.select(F.col("node").alias("id"), "n").distinct()
    members = (blocks_of(family, sizes).withColumnRenamed("id", "node").join(nodes.drop("m"), "node"))
    members = materialize(members, "members")
    links = materialize(family_links(paragraph_elements(docs, members, id_col, text_col), similarity), "links")
    classes = connected_components(links).select("node", F.col("component").alias("class"))
    named = materialize(nodes.join(classes, "node", "left").select(
        "node", F.col("m").alias("copies"), "id", "at", F.coalesce("class", "node").alias("class")), "named")
    first = named.groupBy("class").agg(F.min(F.struct("id", "at")).alias("f"), F.sum("copies").alias("n"),
                                       F.count(F.lit(1)).alias("m")).where("n > 1")
    first = materialize(first.select("class", F.col("f.id").alias("first_id"), F.col("f.at").alias("first_at"), "m"), "classes")
    again = materialize(join_counted(named.select("node", "copies", "class"), first, ["class"])
                        .withColumnRenamed("copies", "m"), "repeated")
    return (join_counted(table.select("id", "at", "node"), again, ["node"]).where("id <> first_id or at <> first_at")
            .select("id", "at", "class", "first_id", "first_at").distinct())


def _run_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, from ``_word_sums``."""
    return mix((sums[width:] - sums[:-width]) * _power("down", len(sums))[:len(sums) - width])


def _word_sums(h: np.ndarray) -> np.ndarray:
    return np.append(U(0), np.cumsum(mix(h) * _power("up", len(h)), dtype=U))


def passage_contexts(h: np.ndarray, row: np.ndarray, width: int = PASSAGE, gram: int = GRAM):
    """Contexts of a block of texts given as word hashes: (anchor hash,
    context hash, row, first word in the text, number of runs)."""
    if len(h) < width:
        return tuple(np.zeros(0, d) for d in (U, U, np.int64, np.int64, np.int64))
    sums = _word_sums(h)
    g = _run_hashes(sums, gram)
    bits = max(24, len(h).bit_length())
    low = _window_min((g >> U(bits)) << U(bits) | np.arange(len(g)).astype(U), width - gram + 1)
    s = np.flatnonzero(row[:len(low)] == row[width - 1:])
    p = (low[s] & U((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1))[:len(s)])
    n = np.diff(np.append(new, len(s)))
    start = s[new]
    end = start + n + width - 1
    content = mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + n.astype(U) * U(0xD6E8FEB86659FD93))
    return g[p[new]], content, row[start], start - np.searchsorted(row, row[start]), n


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, lo, hi): words lo to hi - 1 of the text whose xxhash64 is ``t``
    are to be removed. The ranges of a text do not touch."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"),
                        F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def contexts(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", TEXT_BYTES):
                h, row, _ = _words(b.column("text"))
                a, c, of, at, n = passage_contexts(h, row)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(of), b.column("t").take(of), pa.array(as_long(a)), pa.array(as_long(c)),
                     pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "t", "a", "c", "p", "n"])

    def runs(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", TEXT_BYTES):
                h, row, _ = _words(b.column("text"))
                wanted = b.column("wanted")
                w = wanted.flatten()
                of = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                n = w.field("n").to_numpy().astype(np.int64)
                each = np.repeat(np.arange(len(n)), n)
                at = w.field("p").to_numpy()[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                of = of[each]
                g = _run_hashes(_word_sums(h), PASSAGE)[np.searchsorted(row, of) + at]
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([b.column("id").take(of), b.column("t").take(of), pa.array(as_long(g)),
                                                  pa.array(at.astype(np.int32))], ["id", "t", "h", "p"])

    found = materialize(plain.mapInArrow(contexts, "id long, t long, a long, c long, p int, n int"), "contexts")
    shared = (found.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"))
              .where("m > 1").select("a", (F.col("low") < F.col("high")).alias("differ"), "m"))
    shared = materialize(join_counted(found, materialize(shared, "anchors"), ["a"]), "shared")
    place = F.struct("id", "t", "p")
    first = materialize(shared.groupBy("a", "c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")), "firsts")
    shared = materialize(join_counted(shared, first, ["a", "c"]).select(
        "id", "t", "p", "n", "differ", (place == F.col("first")).alias("kept")).distinct(), "compared")
    equal = shared.where("not kept").select("id", "t", F.col("p").alias("lo"), (F.col("p") + F.col("n") + PASSAGE - 1).alias("hi"))
    wanted = shared.where("kept and differ").groupBy("id", "t").agg(F.collect_list(F.struct("p", "n")).alias("wanted"))
    strings = materialize(plain.join(wanted, ["id", "t"]).select("id", "t", "wanted", "text").mapInArrow(
        runs, "id long, t long, h long, p int"), "strings")
    again = strings.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("m"))
    again = materialize(again.where("first < last").drop("last"), "again")
    later = join_counted(strings, again, ["h"]).where(place > F.col("first")).select(
        "id", "t", F.col("p").alias("lo"), (F.col("p") + PASSAGE).alias("hi"))
    text = Window.partitionBy("id", "t").orderBy("lo", "hi")        # one document
    spans = equal.unionByName(later).distinct().withColumn(
        "reach", F.max("hi").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("span", F.sum((F.col("reach").isNull() | (F.col("reach") < F.col("lo"))).cast("int")).over(
        text.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("id", "t", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("span")


def _cut_passages(batches):
    """(id, t, text) without the words of ``spans``; line ends stay."""
    for batch in batches:
        for b in row_blocks(batch, "text", TEXT_BYTES):
            raw, offs = flat(b.column("text"))
            s, _, row = words(raw, offs, SPACE)
            spans = b.column("spans")
            w = spans.flatten()
            of = np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            to = first[of] + w.field("hi").to_numpy()
            end = np.where(to < first[of + 1], np.append(s, 0)[np.minimum(to, len(s))], offs[of + 1])
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, s[first[of] + w.field("lo").to_numpy()], 1)
            np.add.at(edge, end, -1)
            kept = (np.cumsum(edge[:-1]) == 0) | (raw == 10)
            at = np.append(0, np.cumsum(kept))[offs]
            data = raw[kept].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("t"), pa.array([data[x:y].decode() for x, y in zip(at[:-1], at[1:])], pa.string())],
                ["id", "t", "text"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the removed paragraphs and passages cut out of the texts."""
    key = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t")]
    spans = repeated_passages(docs, id_col, text_col).groupBy("id", "t").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = (docs.select(*key, F.col(text_col).cast("string").alias("text")).join(spans, ["id", "t"])
           .dropDuplicates(["id", "t"]).mapInArrow(_cut_passages, "id long, t long, text string")
           .select(F.col("id").alias("_cut_id"), F.col("t").alias("_cut_t"), F.col("text").alias("_cut")))
    gone = repeated_paragraphs(docs, id_col, text_col, **kw).groupBy(F.col("id").alias("_id")).agg(
        F.collect_set("at").alias("_gone"))
    rows = docs.join(gone, F.col(id_col).cast("long") == F.col("_id"), "left")
    rows = rows.join(cut, (key[0] == F.col("_cut_id")) & (key[1] == F.col("_cut_t")), "left")
    text = F.coalesce("_cut", F.col(text_col))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return rows.withColumn(text_col, F.when(F.col("_gone").isNull(), text).otherwise(kept)).select(docs.columns)


def op5_paragraphs(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    gone = repeated_paragraphs(docs).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_removed"), F.array_join(F.array_sort(F.collect_list("at")).cast("array<string>"), ",")
        .alias("removed"))
    spans = repeated_passages(docs).groupBy(F.col("id").alias("doc_id"), "t").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum(F.col("hi") - F.col("lo")).alias("passage_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))),
                                 lambda x: F.concat_ws("-", x["lo"], x["hi"])), ",").alias("passages"))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    rows = docs.select("doc_id", F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_paragraphs"),
                       F.xxhash64("text").alias("t"))
    return (rows.join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(spans, ["doc_id", "t"], "left")
            .select("doc_id", "n_paragraphs", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("removed", F.lit("")).alias("removed"),
                    F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
                    F.coalesce("passage_words", F.lit(0)).alias("passage_words"),
                    F.coalesce("passages", F.lit("")).alias("passages")))
