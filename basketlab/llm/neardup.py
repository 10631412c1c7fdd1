"""Near-duplicate documents by DartMinHash.

Every element of a document (a five-word shingle and its occurrence number, a
unit region of weight) throws darts: the points of a Poisson process of rate
one, generated from hashes of the element, in order of their rank. Equal
elements throw equal darts in every document. A dart hits one of ``size``
coordinates by hash, and each coordinate keeps its dart of lowest rank, which
makes two signatures agree in a coordinate with probability equal to the
weighted Jaccard similarity. A document with n elements only needs the darts
of rank below about (ln size + 2) size / n, so the work per document is
about size (ln size + 2) darts however long it is; where a coordinate stays
empty, the bound is doubled for that document.

Documents are joined in these steps:

1. Documents with the same word sequence form one class, represented by the
   smallest id; only representatives go on.
2. Signatures are cut into bands; equal bands make a bucket. Each member is
   paired with the bucket's smallest id only, so no pair lists are made.
   Components of these pairs are families: all candidates of a document lie
   in its family.
3. Within a family every pair is compared exactly on its elements, in blocks
   of bounded elements and rows: a family is cut into blocks by hash and each pair of
   blocks is one small group, compared by sparse counts. Only a spanning set
   of the links found there leaves the group. So a family may have any size
   and no link between different texts is lost.
4. Components of the links are the classes of near duplicates.

Defined results: null text counts as empty; documents without words are
classes of their own; rows with a null id take no part (class null, kept);
rows of equal id belong together; an empty table gives an empty result.
Extra columns are ignored (``drop_near_duplicates`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import U, as_long, lean, mix, row_blocks, uniform
from basketlab.llm.components import connected_components
from basketlab.llm.shingles import WIDTH, _elements, _sequence_keys, _words, elements
from basketlab.llm.store import read
from basketlab.session import materialize

BANDS, ROWS = 24, 5
SIMILARITY = 0.8
TEXT_BYTES = 1 << 20
SIGN_BYTES, SIGN_ROWS = 1 << 18, 256      # a document throws about 815 darts however short it is
BLOCK_ELEMENTS = 1 << 17
BLOCK_ROWS = 2048
TILE_ROWS = 1024
_GOLD = U(0x9E3779B97F4A7C15)


def _lowest(e: np.ndarray, of: np.ndarray, bound: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) rank codes of the darts of rank below ``bound[document]``;
    0 where a coordinate has none."""
    codes, slots = [], []
    rank = np.zeros(len(e))
    k = 0
    while len(e):
        k += 1
        u = mix(e ^ mix(np.full(1, k, U) * _GOLD)[0])
        rank = rank - np.log1p(-uniform(u))
        live = rank < bound[of]
        e, of, rank, u = e[live], of[live], rank[live], u[live]
        slots.append(of * size + (mix(u + _GOLD) % U(size)).astype(np.int64))
        codes.append(rank.view(np.int64) >> 20)
    out = np.zeros(n * size, np.int64)
    if slots:
        slot, code = np.concatenate(slots), np.concatenate(codes)
        if n * size < 1 << 20:                     # codes have 43 bits
            both = np.sort(slot << 43 | code)
            slot, code = both >> 43, both & ((1 << 43) - 1)
        else:
            order = np.lexsort((code, slot))
            slot, code = slot[order], code[order]
        first = np.append(True, slot[1:] != slot[:-1])[:len(slot)]
        out[slot[first]] = code[first]
    return out.reshape(n, size)


def signatures(e: np.ndarray, offs: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """(documents, size) signature codes; rows of documents without elements
    are 0."""
    n = len(offs) - 1
    count = np.diff(offs)
    out = np.zeros((n, size), np.int64)
    todo = np.flatnonzero(count)
    bound = size * (np.log(size) + 2) / np.maximum(1, count)
    while len(todo):
        of = np.repeat(np.arange(len(todo)), count[todo])
        at = np.arange(len(of)) + np.repeat(offs[todo] - np.append(0, np.cumsum(count[todo])[:-1]), count[todo])
        out[todo] = _lowest(e[at], of, bound[todo], len(todo), size)
        todo = todo[(out[todo] == 0).any(1)]
        bound = bound * 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) 64-bit keys."""
    h = np.repeat(mix(np.arange(1, bands + 1).astype(U) * _GOLD)[None], len(sig), 0)
    for j in range(rows):
        h = mix(h * U(0xD6E8FEB86659FD93) + sig[:, j::rows][:, :bands].astype(U))
    return h


def signature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, k1, k2, bands) of every row with an id, as a written table."""
    def sign(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", SIGN_BYTES, SIGN_ROWS):
                h, row, n = _words(b.column("text"))
                e, offs = _elements(h, row, n, WIDTH)
                k1, k2, _ = _sequence_keys(h, row, n)
                keys = as_long(band_keys(signatures(e, offs, bands * rows), bands, rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands),
                                                 pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(np.diff(offs)), pa.array(as_long(k1)), pa.array(as_long(k2)), lists],
                    ["id", "n", "k1", "k2", "bands"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(plain.where("id is not null").mapInArrow(
        lean(sign), "id long, n long, k1 long, k2 long, bands array<long>"), "signatures")


def element_table(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``members`` (id, family, block, blocks) with the elements of each."""
    def cut(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", TEXT_BYTES):
                e, offs = elements(b.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(as_long(e)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "elements"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.join(members, "id").select("id", "family", "block", "blocks", "text").mapInArrow(
        lean(cut), "id long, family long, block int, blocks int, elements array<long>")


def links_within(ids: np.ndarray, sides: np.ndarray, e: np.ndarray, offs: np.ndarray,
                 similarity: float = SIMILARITY, columns: int = 1024, tile: int = TILE_ROWS) -> list[tuple[int, int]]:
    """A spanning set of the links of one group of documents: pairs of equal
    ``similarity`` or more. ``sides``: with two blocks in the group (0 and
    1), pairs within a block are left to that block's own group. Compared
    are ``tile`` rows at a time with all rows after them."""
    n = len(ids)
    size = np.diff(offs)
    of = np.repeat(np.arange(n), size)
    order = np.argsort(e, kind="stable")
    value, owner = e[order], of[order]
    new = np.append(True, value[1:] != value[:-1])
    col = np.cumsum(new) - 1
    df = np.bincount(col)
    shared = df[col] > 1
    number = np.cumsum(df > 1) - 1
    col, owner = number[col[shared]], owner[shared]
    total = int(col[-1]) + 1 if len(col) else 0
    by_owner = np.argsort(owner, kind="stable")     # for one tile: its shared elements, still in order of columns
    bound = np.searchsorted(owner[by_owner], np.arange(n + 1))
    two = len(set(sides.tolist())) > 1
    label = np.arange(n)                            # smallest member of each component found so far
    out = []
    for t in range(0, n, tile):
        rows = np.arange(t, min(t + tile, n))
        mine = by_owner[bound[rows[0]]:bound[rows[-1] + 1]]
        mine = mine[np.argsort(col[mine], kind="stable")]
        common = np.zeros((len(rows), n - t), np.float32)
        for c in range(0, total, columns):
            wide = min(columns, total - c)
            x, y = np.searchsorted(col[mine], (c, c + columns))
            if x == y:
                continue
            left = np.zeros((len(rows), wide), np.float32)
            left[owner[mine[x:y]] - t, col[mine[x:y]] - c] = 1
            x, y = np.searchsorted(col, (c, c + columns))
            after = np.flatnonzero(owner[x:y] >= t) + x
            right = np.zeros((n - t, wide), np.float32)
            right[owner[after] - t, col[after] - c] = 1
            common += left @ right.T
        for k, i in enumerate(rows):
            union = size[i] + size[i + 1:] - common[k, i + 1 - t:]
            link = common[k, i + 1 - t:] >= similarity * union - 1e-6
            if two:
                link &= sides[i + 1:] != sides[i]
            near = np.flatnonzero(link) + i + 1
            near = near[label[near] != label[i]]
            if len(near):
                found, at = np.unique(label[near], return_index=True)
                out += [(int(ids[i]), int(ids[j])) for j in near[at]]
                joined = np.append(found, label[i])
                label[np.isin(label, joined)] = joined.min()
    return out


def _grouped(batches, key_cols):
    """Groups of the sorted rows of one partition, as Arrow tables."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy() for c in key_cols], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for s, e in zip(np.append(0, cuts)[:-1], cuts):
            yield t.slice(s, e - s)
        held = t.slice(int(cuts[-1]) if len(cuts) else 0)
    if held is not None and held.num_rows:
        yield held


def blocks_of(family: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, family, block, blocks): families of more than BLOCK_ELEMENTS
    elements or BLOCK_ROWS rows are cut into several blocks by hash."""
    rows = family.join(sizes, "id")
    total = rows.groupBy("family").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_ELEMENTS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    return rows.join(total, "family").select("id", "family", blocks.alias("blocks")).select(
        "id", "family", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks")


def family_links(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (u, v) within families, from every pair of blocks."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.select("family", "id", "block", other.alias("other"), "elements").select(
        "family", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "elements")

    def compare(batches):
        for g in _grouped(batches, ["family", "a", "b"]):
            ids = g.column("id").to_numpy()
            lists = g.column("elements").combine_chunks()
            e = lists.flatten().to_numpy().view(np.uint64)
            offs = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            found = links_within(ids, g.column("side").to_numpy(), e, offs, similarity)
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    keys = ["family", "a", "b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(compare), "u long, v long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, copy_of): one row per row of ``docs`` with an id;
    ``copy_of`` is the smallest id with the same word sequence, ``class_id``
    the smallest id of the near-duplicate class."""
    sig = signature_table(docs, id_col, text_col, bands, rows)
    worded = sig.where("n > 0")
    # written before it is joined, so that a large group of copies meets one row and its partition can be split
    same = materialize(worded.groupBy("k1", "k2").agg(F.min("id").alias("copy_of")), "same")
    copies = materialize(worded.select("id", "k1", "k2").join(same, ["k1", "k2"]).select("id", "copy_of"), "copies")
    heads = same.select(F.col("copy_of").alias("id"), "k1", "k2")
    reps = worded.join(heads, ["id", "k1", "k2"], "left_semi")
    cells = reps.select("id", F.explode("bands").alias("band"))     # repeated rows repeat cells, which changes nothing
    hubs = materialize(cells.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
                       .where("hub < last"), "hubs")
    near = cells.join(hubs.select("band", "hub"), "band").where("id <> hub").select("id", "hub").distinct()
    family = materialize(connected_components(near, "id", "hub").select(
        F.col("node").alias("id"), F.col("component").alias("family")), "families")
    members = materialize(blocks_of(family, reps.select("id", "n").distinct()), "members")
    links = materialize(family_links(element_table(docs, members, id_col, text_col), similarity), "links")
    classes = connected_components(links).select(F.col("node").alias("copy_of"), "component")
    ids = sig.select("id").join(copies.groupBy("id").agg(F.min("copy_of").alias("copy_of")), "id", "left")
    return (ids.withColumn("copy_of", F.coalesce("copy_of", "id")).join(classes, "copy_of", "left")
            .select("id", F.coalesce("component", "copy_of").alias("class_id"), "copy_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each class: the smallest id, one row of
    it where rows repeat. Rows with a null id all stay."""
    classes = materialize(near_duplicate_classes(docs, id_col, text_col, **kw), "classes")
    gone = materialize(classes.where("id <> class_id").select(F.col("id").alias("_id")).distinct(), "gone")
    again = materialize(classes.groupBy(F.col("id").alias("_id")).count().where("count > 1").select("_id"), "again")
    same = F.col(id_col).cast("long") == F.col("_id")
    kept = docs.join(gone, same, "left_anti")
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates([id_col]))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    c = near_duplicate_classes(read(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), "class_id", "copy_of", (F.col("id") == F.col("class_id")).alias("kept"))
