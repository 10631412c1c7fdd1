"""Suffix-array deduplication of repeated byte strings.

A byte goes when it lies in a string of WIDTH bytes that also starts earlier
(in a document of smaller id, or further left in the same document), judged
on the input. Matches never cross documents.

1. Anchors. Every string of WIDTH bytes is assigned to the smallest hash of
   the GRAM-byte strings inside it (leftmost of equals), so equal strings have
   equal anchors. Consecutive strings with one anchor make a context: the
   bytes from the first string's start to the last one's end.
2. Shards by anchor. Each chunk of texts sends its contexts as hashes, equal
   ones once (its other copies are already known to repeat). A shard finds
   contexts that are equal across chunks (all but the earliest go) and those
   that share an anchor and differ: only these can still hold equal strings.
3. Suffix arrays. The bytes of the differing contexts meet in shards by
   anchor. A shard sorts all their suffixes by induced sorting, computes the
   permuted common prefixes, and among suffixes whose common prefix is WIDTH
   or more all but the earliest go. An anchor with more than HOT_CONTEXTS
   different contexts is sent string by string instead, equal strings of a
   chunk once, dealt by a hash of the whole string, so no anchor makes an
   unbounded shard.
4. The found ranges return to their chunks, which cut the texts.

Chunks, shards and contexts are bounded, and their numbers grow with the
input. Hashes only bring strings together or name equal contexts (128 bits);
strings in suffix shards are compared byte by byte.

Defined results: null text counts as empty; a null id orders after all
others; rows of equal id are not earlier than one another (so repeated rows
have equal results); texts under WIDTH bytes lose nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import U, by_shard, flat, mix, prefix_sums, range_hashes
from basketlab.llm.store import binary_arrays, chunk_table, read, to_arrays, unpack
from basketlab.llm.suffix import permuted_prefixes, suffix_array
from basketlab.session import materialize

WIDTH, GRAM = 100, 32
CHUNK_BYTES = 4 << 20
PART_BYTES = 1 << 20
SHARD_BYTES = 24 << 20        # input bytes for each shard of anchors
SUFFIX_BYTES = 1 << 20        # context bytes for each suffix array
HOT_CONTEXTS = 5000
LAST = np.iinfo(np.int64).max
_BYTE = mix(np.arange(1, 257).astype(U))
_BASE = 0x9E3779B97F4A7C15 | 1


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes (a power of two)."""
    h, m = _BYTE[raw], 1
    while m < gram:
        h = h[:-m] * U(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    return mix(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[:len(x) - (width - m)], x[width - m:]) if width > m else x


def anchors(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Contexts of a block of texts: (anchor hash, context hash, row, start in
    the text, number of strings)."""
    empty = tuple(np.zeros(0, d) for d in (U, U, np.int64, np.int64, np.int64))
    if len(raw) < width:
        return empty
    h = _gram_hashes(raw, gram)
    bits = max(24, int(len(raw)).bit_length())
    key = (h >> U(bits)) << U(bits) | np.arange(len(h)).astype(U)
    low = _window_min(key, width - gram + 1)
    closed = np.zeros(len(raw) + 1, np.int32)
    np.add.at(closed, np.maximum(offs[1:] - width + 1, offs[:-1]), 1)
    np.add.at(closed, offs[1:], -1)
    s = np.flatnonzero(np.cumsum(closed[:len(low)]) == 0)
    if not len(s):
        return empty
    p = (low[s] & U((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)))
    n = np.diff(np.append(new, len(s)))
    start = s[new]
    content = range_hashes(prefix_sums(raw), start, start + n + width - 1)
    row = np.searchsorted(offs, start, side="right") - 1
    return h[p[new]], content, row, start - offs[row], n


def _parts(offs: np.ndarray, size: int):
    """Consecutive ranges of rows of about ``size`` bytes."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield at, to
        at = to


def later(group: np.ndarray, ids: np.ndarray, doc: tuple, at: np.ndarray) -> np.ndarray:
    """Which entries repeat an earlier one of their group: an id larger than
    the group's smallest, or not the first of their own document."""
    order = np.lexsort((at, *doc[::-1], ids, group))
    g, i = group[order], ids[order]
    start = np.append(True, g[1:] != g[:-1])
    low = i[np.flatnonzero(start)][np.cumsum(start) - 1]
    same = ~start
    for d in doc:
        same[1:] &= d[order][1:] == d[order][:-1]
    same[1:] &= i[1:] == i[:-1]
    out = np.empty(len(group), bool)
    out[order] = (i > low) | same
    return out


def _order_ids(column) -> np.ndarray:
    return np.array([LAST if x is None else x for x in column.to_pylist()], np.int64)


def chunk_contexts(table: pa.Table):
    """(contexts kept, contexts that go) of one chunk, each as arrays: a, c
    (hashes), row, lo, n, id."""
    raw, offs = flat(table.column("text"))
    found = []
    for a, b in _parts(offs, PART_BYTES):
        x = anchors(raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
        found.append((x[0], x[1], x[2] + a, x[3], x[4]))
    a, c, row, lo, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5))
    ids = _order_ids(table.column("id"))[row]
    both = mix(a.astype(U) + mix(c.astype(U)))
    s = np.sort(both)
    many = np.unique(s[1:][s[1:] == s[:-1]])
    gone = np.zeros(len(a), bool)
    if len(many):
        at = np.minimum(np.searchsorted(many, both), len(many) - 1)
        sub = np.flatnonzero(many[at] == both)
        gone[sub] = later(both[sub], ids[sub], (row[sub],), lo[sub])
    every = {"a": a, "c": c, "row": row, "lo": lo, "n": n, "id": ids}
    return {k: v[~gone] for k, v in every.items()}, {k: v[gone] for k, v in every.items()}


FOUND = "kind string, chunk long, row int, lo int, n int, a long, id long, hot boolean"
_FOUND = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("row", pa.int32()), ("lo", pa.int32()),
                    ("n", pa.int32()), ("a", pa.int64()), ("id", pa.int64()), ("hot", pa.bool_())])


def _found(kind, chunk, row, lo, n, a=None, ids=None, hot=None) -> pa.Table:
    z = np.zeros(len(row), np.int64)
    cols = [pa.array([kind] * len(row), pa.string()), chunk, row.astype(np.int32), lo.astype(np.int32),
            n.astype(np.int32), z if a is None else a, z if ids is None else ids, z > 0 if hot is None else hot]
    return pa.table([pa.array(c) for c in cols], schema=_FOUND)


def resolve(messages: pa.Table) -> pa.Table:
    """One shard of anchors: contexts that go, and contexts whose bytes must
    be compared because they share an anchor and differ."""
    kept, out = [], []
    for kind, chunk, body in zip(*(messages.column(x).to_pylist() for x in ("kind", "chunk", "body"))):
        x = to_arrays(body)
        x["chunk"] = np.full(len(x["row"]), chunk, np.int64)
        if kind == "gone":
            out.append(_found("gone", x["chunk"], x["row"], x["lo"], x["n"]))
        else:
            kept.append(x)
    if kept:
        x = {k: np.concatenate([y[k] for y in kept]) for k in kept[0]}
        s = np.sort(x["a"])
        shared = np.unique(s[1:][s[1:] == s[:-1]])
        if len(shared):
            at = np.minimum(np.searchsorted(shared, x["a"]), len(shared) - 1)
            x = {k: v[shared[at] == x["a"]] for k, v in x.items()}
            order = np.lexsort((x["c"], x["a"]))
            x = {k: v[order] for k, v in x.items()}
            new_a = np.append(True, x["a"][1:] != x["a"][:-1])
            new = new_a | np.append(True, x["c"][1:] != x["c"][:-1])
            gone = later(np.cumsum(new), x["id"], (x["chunk"], x["row"]), x["lo"])
            kinds = np.bincount(np.cumsum(new_a) - 1, new)[np.cumsum(new_a) - 1]   # different contexts of the anchor
            out.append(_found("gone", x["chunk"][gone], x["row"][gone], x["lo"][gone], x["n"][gone]))
            w = ~gone & (kinds > 1)
            out.append(_found("want", x["chunk"][w], x["row"][w], x["lo"][w], x["n"][w], x["a"][w].view(np.int64),
                              x["id"][w], kinds[w] > HOT_CONTEXTS))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


CONTEXT = "kind string, shard int, chunk long, row int, lo int, n int, id long, body binary"
_CONTEXT = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("chunk", pa.int64()), ("row", pa.int32()),
                      ("lo", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("body", pa.binary())])


def _slices(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offs = np.append(0, np.cumsum(length))
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], length)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(raw[at])]).cast(pa.binary())


def context_bytes(table: pa.Table, chunk: int, want: dict, shards: int) -> list[pa.Table]:
    """The wanted contexts of one chunk with their bytes, dealt to shards."""
    raw, offs = flat(table.column("text"))
    out = []

    def rows(kind, shard, row, lo, n, ids, body):
        m = len(row)
        out.append(pa.table([pa.array([kind] * m, pa.string()), pa.array(shard.astype(np.int32)),
                             pa.array(np.full(m, chunk, np.int64)), pa.array(row.astype(np.int32)),
                             pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ids), body],
                            schema=_CONTEXT))

    hot = want["hot"]
    x = {k: v[~hot] for k, v in want.items()}
    size = x["n"].astype(np.int64) + WIDTH - 1
    rows("context", mix(x["a"].view(U)) % U(shards), x["row"], x["lo"], x["n"], x["id"],
         _slices(raw, offs[x["row"]] + x["lo"], size))
    x = {k: v[hot] for k, v in want.items()}
    if len(x["n"]):
        n = x["n"].astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)
        lo = x["lo"][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        row, ids = x["row"][of].astype(np.int64), x["id"][of]
        at = offs[row] + lo
        h = np.empty(len(at), U)
        order = np.argsort(at, kind="stable")
        for a in range(0, len(at), 1 << 16):
            o = order[a:a + (1 << 16)]
            base, end = at[o[0]], at[o[-1]] + WIDTH
            h[o] = range_hashes(prefix_sums(raw[base:end]), at[o] - base, at[o] - base + WIDTH)
        gone = later(h, ids, (row,), lo)
        one = np.ones(int(gone.sum()), np.int64)
        rows("gone", one * (chunk % shards), row[gone], lo[gone], one, ids[gone], pa.nulls(len(one), pa.binary()))
        k = ~gone
        rows("context", h[k] % U(shards), row[k], lo[k], np.ones(int(k.sum()), np.int64), ids[k],
             _slices(raw, at[k], np.full(int(k.sum()), WIDTH)))
    return out


def repeated_strings(bodies: list[bytes], strings: np.ndarray, ids: np.ndarray, doc: tuple, lo: np.ndarray):
    """Strings that go in one shard: (context, offset in it) by suffix array
    and permuted common prefixes."""
    size = np.array([len(b) for b in bodies])
    start = np.cumsum(size + 1) - size - 1
    t = np.ones(int((size + 1).sum()) + 1, np.int64)
    t[-1] = 0
    inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    t[inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 2
    sa = suffix_array(t)
    forced = np.zeros(len(t), bool)
    forced[start] = True
    phi, plcp = permuted_prefixes(t, sa, int(size.max()) + 1, forced)
    joined = plcp[sa] >= WIDTH
    group = np.cumsum(~joined)
    of = np.searchsorted(start, sa, side="right") - 1
    offset = sa - start[of]
    m = (offset < strings[of]) & (joined | np.append(joined[1:], False))
    of, offset, group = of[m], offset[m], group[m]
    gone = later(group, ids[of], tuple(d[of] for d in doc), lo[of] + offset)
    return of[gone], offset[gone]


RANGE = "chunk long, row int, lo int, hi int"
_RANGE = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def suffix_shard(t: pa.Table) -> pa.Table:
    """Byte ranges that go, of one shard of contexts."""
    kinds = np.array(t.column("kind").to_pylist())
    x = {c: t.column(c).to_numpy() for c in ("chunk", "row", "lo", "n", "id")}
    out = [{k: v[kinds == "gone"] for k, v in x.items()}]
    c = np.flatnonzero(kinds == "context")
    if len(c):
        bodies = t.column("body").take(pa.array(c)).to_pylist()
        y = {k: v[c].astype(np.int64) for k, v in x.items()}
        of, offset = repeated_strings(bodies, y["n"], y["id"], (y["chunk"], y["row"]), y["lo"])
        order = np.lexsort((offset, of))
        of, offset = of[order], offset[order]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1))[:len(of)])
        n = np.diff(np.append(new, len(of)))
        of, offset = of[new], offset[new]
        out.append({"chunk": y["chunk"][of], "row": y["row"][of], "lo": y["lo"][of] + offset, "n": n})
    z = {k: np.concatenate([o[k] for o in out]) for k in ("chunk", "row", "lo", "n")}
    return pa.table([pa.array(z["chunk"].astype(np.int64)), pa.array(z["row"].astype(np.int32)),
                     pa.array(z["lo"].astype(np.int32)), pa.array((z["lo"] + z["n"] + WIDTH - 1).astype(np.int32))],
                    schema=_RANGE)


def repeated_ranges(table: DataFrame) -> DataFrame:
    """(chunk, row, lo, hi): byte ranges that go, of the chunks of ``table``
    (``store.chunk_table``). Ranges may overlap."""
    total = table.agg(F.sum("bytes").alias("b")).first().b or 0
    shards = max(1, -(-total // SHARD_BYTES))
    message = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])

    def send(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                keep, gone = chunk_contexts(unpack(body.as_py()))
                order = np.argsort(keep["a"], kind="stable")
                keep = {k: v[order] for k, v in keep.items()}
                to = (mix(keep["a"].astype(U)) % U(shards)).astype(np.int64)
                rows = [("anchor", s, m, keep) for s, m in by_shard(to)]
                rows.append(("gone", chunk % shards, slice(None), {k: gone[k] for k in ("row", "lo", "n")}))
                for kind, s, m, x in rows:
                    x = {k: v[m] for k, v in x.items()}
                    if len(x["row"]):
                        x = x | {k: x[k].astype(np.int32) for k in ("row", "lo", "n")}
                        yield pa.RecordBatch.from_pylist(
                            [{"kind": kind, "shard": s, "chunk": chunk, "body": binary_arrays(**x)}], message)

    sent = table.select("chunk", "body").mapInArrow(send, "kind string, shard int, chunk long, body binary")
    found = materialize(sent.groupBy("shard").applyInArrow(resolve, FOUND), "contexts")
    want = found.where("kind = 'want'")
    size = want.agg(F.sum(F.when(F.col("hot"), F.col("n") * WIDTH).otherwise(F.col("n") + WIDTH)).alias("b")).first().b or 0
    parts = max(1, -(-size // SUFFIX_BYTES))

    def extract(key, chunks: pa.Table, wanted: pa.Table) -> pa.Table:
        if not chunks.num_rows or not wanted.num_rows:
            return _CONTEXT.empty_table()
        x = {c: wanted.column(c).to_numpy() for c in ("row", "lo", "n", "a", "id", "hot")}
        return pa.concat_tables(context_bytes(unpack(chunks.column("body")[0].as_py()), key[0].as_py(), x, parts))

    contexts = (table.select("chunk", "body").groupBy("chunk").cogroup(
        want.select("chunk", "row", "lo", "n", "a", "id", "hot").groupBy("chunk")).applyInArrow(extract, CONTEXT))
    compared = materialize(contexts.groupBy("shard").applyInArrow(suffix_shard, RANGE), "ranges")
    gone = found.where("kind = 'gone'").select("chunk", "row", "lo", (F.col("lo") + F.col("n") + WIDTH - 1).alias("hi"))
    return gone.unionByName(compared)


def _running(flags: np.ndarray) -> np.ndarray:
    """Number of flags set before each position."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=out[1:], dtype=out.dtype)
    return out


def cut_texts(table: DataFrame, ranges: DataFrame, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if with_text else [])
    schema = pa.schema(fields)

    def cut(key, chunks: pa.Table, gone: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return schema.empty_table()
        t = unpack(chunks.column("body")[0].as_py())
        raw, offs = flat(t.column("text"))
        edge = np.zeros(len(raw) + 1, np.int32)
        row = gone.column("row").to_numpy()
        np.add.at(edge, offs[row] + gone.column("lo").to_numpy(), 1)
        np.add.at(edge, offs[row] + gone.column("hi").to_numpy(), -1)
        off = np.cumsum(edge[:-1], dtype=np.int32) > 0
        begin = off.copy()
        begin[1:] &= ~off[:-1]
        first = offs[:-1][np.diff(offs) > 0]
        begin[first] = off[first]
        removed = _running(off)
        spans = _running(begin)
        kept = raw[~off].tobytes()
        at = offs - removed[offs].astype(np.int64)
        parts = [kept[a:b] for a, b in zip(at[:-1], at[1:])]
        cols = [t.column("id"), np.diff(offs), np.diff(removed[offs]).astype(np.int64), np.diff(spans[offs]).astype(np.int64),
                [hashlib.sha256(p).hexdigest() for p in parts]] + ([parts] if with_text else [])
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f[1]) for c, f in zip(cols, fields)],
                        schema=schema)

    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return table.select("chunk", "body").groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(cut, ddl)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with what is kept of its text."""
    table = chunk_table(docs, id_col, text_col, CHUNK_BYTES)
    return cut_texts(table, repeated_ranges(table), with_text)


def op4_suffix_array(spark, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("id", "doc_id")
