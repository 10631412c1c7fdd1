"""Phrase collocation mining with weighted acyclic automata.

Texts are lower-cased (A-Z), split at sentence marks into pieces and those into
words. All contiguous word sequences of up to ``max_words`` words inside a
piece are counted for each language; candidates are the phrases of two words
or more that occur ``min_count`` times. A candidate is scored by its weakest
cut into two parts, 1,000,000 * a * a / (l * r), rounded down (a, l, r:
occurrences of the phrase and of both parts). Candidates that lie inside a longer
candidate at least half as frequent are dropped, and each language keeps its
``top`` best.

How it runs. A sequence is a path (language, word, word, ...), in the order of
its words' bytes, a path before its continuations.

1. Shards. Every SHARD_BYTES of text become one automaton: the sorted
   distinct sequences, level by level, each state found from the one before
   and the next word. The sum of the outputs along a path is the sequence's
   count. States that end in one and the same single arc, most of the
   deepest ones, are shared (``pack_automaton``).
2. Prefix ranges. Every SAMPLE-th path of each shard is numbered by
   ``dense_index``, and every few of these is a cut point: one short key for
   each RANGE_ENTRIES paths of the data (40 bytes for about 5 MB of text), so
   each range holds bounded work however frequent a word or a pair of words
   is; a hot prefix is cut inside. The cut points are broadcast.
3. Union. Shards are cut at these points, and the pieces of one range are united,
   summing outputs, in levels where there are many. Only counts from ``min_count`` on are kept: a part occurs
   at least as often as its phrase.
4. Composition. The parts that candidates ask for, each once, are
   an acceptor, cut into the same ranges and composed with the range's
   automaton, which gives l and r.

Scores use decimals of 38 digits and integer division, exact up to counts of
10^15. The best of each language are found in SALTS parts by hash first, and
ranked among the at most SALTS x ``top`` that are left.

Defined results: null texts count as empty, a null language is ``und``; words
of any script or length are kept as they are; repeated rows count each time;
ids are not read; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.arrays import ROW_BYTES, flat, lean, release, row_blocks, words
from basketlab.llm.store import read
from basketlab.operators.indexing import dense_index
from basketlab.session import delete_paths, materialize

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
COVERED_PERCENT = 50           # a longer candidate with this share of the occurrences replaces a shorter one
SHARD_BYTES = 4 << 20
SAMPLE = 1 << 13
RANGE_ENTRIES = 1 << 20
FAN = 256                      # runs of ranges that an automaton is cut into at a time
SALTS = 64                     # parts in which each language's best are found first

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Automaton:
    """Level d holds the paths of d labels (language first) in order: the
    position of the path without its last label in the level above, the last
    label's position in ``labels`` (sorted, distinct), and the count. Arrays
    are of 32 bits where their values allow it (``narrow``)."""
    labels: pa.Array
    parent: list[np.ndarray]
    label: list[np.ndarray]
    count: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.label)

    def entries(self) -> int:
        return sum(len(x) for x in self.label)

    def keys(self, d: int) -> np.ndarray:
        return arc_keys(self.parent[d], len(self.labels), self.label[d])

    def column(self, d: int, rows: np.ndarray, e: int) -> pa.Array:
        """Label ``e`` of the paths ``rows`` of level ``d``."""
        for x in range(d, e, -1):
            rows = self.parent[x][rows]
        return self.labels.take(pa.array(self.label[e][rows]))


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in 32 bits if its values fit."""
    return x.astype(np.int32, copy=False) if len(x) == 0 or -2**31 <= x.min() and x.max() < 2**31 else x


def arc_keys(state: np.ndarray, n_labels: int, label: np.ndarray) -> np.ndarray:
    """One number for each arc, in the order of states, then labels."""
    key = state.astype(np.int64)
    key *= n_labels
    key += label
    return key


def coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, in fewer temporary arrays."""
    order = np.argsort(key)
    value = key[order]
    first = np.ones(len(key), bool)
    np.not_equal(value[1:], value[:-1], out=first[1:])
    value = value[first]
    size = np.int32 if len(key) < 2**31 else np.int64
    rank = np.cumsum(first, dtype=size)
    rank -= 1
    where = np.empty(len(key), size)
    where[order] = rank
    return value, where


def ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(sorted distinct values, position of each value among them)."""
    encoded = values.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return encoded.dictionary.take(pa.array(order)), rank[encoded.indices.to_numpy()]


def grown(columns: list[np.ndarray], labels: pa.Array, states: list[np.ndarray] | None = None) -> Automaton:
    """The automaton of label sequences: ``columns[d]`` holds the label at
    level d of each row, -1 where the sequence is shorter. A path's count is
    the number of rows that begin with it. The state of each row at each
    level is appended to ``states``, if given."""
    out = Automaton(labels, [], [], [])
    state = np.zeros(len(columns[0]), np.int32)
    for c in columns:
        here = c >= 0
        found, where = coded(arc_keys(state[here], len(labels), c[here]))
        out.count.append(narrow(np.bincount(where, minlength=len(found))))
        out.parent.append(narrow(found // max(1, len(labels))))
        found %= max(1, len(labels))
        out.label.append(narrow(found))
        state = np.full(len(c), -1, where.dtype)
        state[here] = where
        if states is not None:
            states.append(state)
    return out


def count_texts(texts: pa.Array, langs: pa.Array, max_words: int = MAX_WORDS) -> Automaton:
    """The automaton of all sequences of the texts."""
    raw, offsets = flat(texts)
    raw = _LOWER[raw]
    s, e, row = words(raw, offsets, _GAP)
    data = raw[~_GAP[raw]]
    ends = np.append(0, np.cumsum(e - s))
    found = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    langs = pc.fill_null(langs.cast(pa.large_string()), "und")
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    labels, at = ranked(pa.concat_arrays([langs.take(pa.array(row)), found]))
    lang, word = at[:len(s)], at[len(s):]
    marks = np.cumsum(_PIECE[raw], dtype=np.int32)[s]      # a word begins with no mark
    del raw, data, found, ends, e
    joined = np.append((marks[1:] == marks[:-1]) & (row[1:] == row[:-1]), False)[:len(s)]
    columns, on, ahead, n = [lang, word], np.ones(len(s), bool), word, len(s)
    del marks, row, s
    for _ in range(max_words - 1):
        on = on & joined                       # the next word belongs to the same piece
        joined, ahead = np.append(joined[1:], False)[:n], np.append(ahead[1:], np.int32(-1))[:n]
        columns.append(np.where(on, ahead, np.int32(-1)))
    return grown(columns, labels)


def pack_automaton(a: Automaton) -> bytes:
    """Compressed bytes: labels; for each level the arcs of every state, their
    labels and outputs (count less the count of the path before). Deepest
    states with one arc are stored once for all states with that label and
    output."""
    arrays = []
    for d in range(a.depth):
        above = a.count[d - 1] if d else np.zeros(1, np.int32)
        arcs = narrow(np.bincount(a.parent[d], minlength=len(above)))
        out = a.count[d] - above[a.parent[d]]
        if d < a.depth - 1 or d == 0:
            arrays += [arcs, a.label[d], out]
            continue
        single, several = arcs == 1, arcs > 1
        lone = (np.cumsum(arcs) - arcs)[single]
        least = int(out.min(initial=0))
        span = int(out.max(initial=0)) - least + 1
        shared, which = coded(arc_keys(a.label[d][lone], span, out[lone].astype(np.int64) - least))
        state = np.zeros(len(arcs), np.int64)
        state[single] = 1 + which
        state[several] = 1 + len(shared) + np.arange(several.sum())
        rest = np.repeat(several, arcs)
        arrays += [state, np.concatenate([[0], np.ones(len(shared), np.int64), arcs[several]]),
                   np.append(shared // span, a.label[d][rest]), np.append(shared % span + least, out[rest])]
        arrays[-4:] = map(narrow, arrays[-4:])
    text = a.labels.cast(pa.large_binary())
    raw, offsets = flat(text.cast(pa.large_string()))
    arrays = [np.ascontiguousarray(narrow(x)) for x in (*arrays, np.diff(offsets))]
    head = np.array([a.depth, len(raw), *[v for x in arrays for v in (len(x), x.itemsize)]], np.int64)
    body = b"".join([len(head).to_bytes(4, "little"), head, *arrays, raw])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack_automaton(packed: bytes) -> Automaton:
    body = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(body[:4], "little")
    head = np.frombuffer(body, np.int64, n, 4)
    depth, size, at, arrays = int(head[0]), int(head[1]), 4 + 8 * n, []
    for length, item in zip(head[2::2].tolist(), head[3::2].tolist()):
        arrays.append(np.frombuffer(body, np.int32 if item == 4 else np.int64, length, at))
        at += length * item
    ends = np.append(0, np.cumsum(arrays.pop(), dtype=np.int64))
    labels = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [
        None, pa.py_buffer(ends), pa.py_buffer(body[at:at + size])])
    a, above, k = Automaton(labels, [], [], []), np.zeros(1, np.int32), 0
    for d in range(depth):
        if d < depth - 1 or d == 0:
            arcs, label, out = arrays[k:k + 3]
            k += 3
        else:
            state, of, label, out = arrays[k:k + 4]
            first, arcs = (np.cumsum(of) - of)[state], of[state]
            place = np.repeat(narrow(first - (np.cumsum(arcs) - arcs)), arcs)
            place += np.arange(len(place), dtype=place.dtype)
            label, out = label[place], out[place]
        parent = np.repeat(narrow(np.arange(len(above))), arcs)
        a.parent.append(parent)
        a.label.append(label)
        a.count.append(out + above[parent])
        above = a.count[-1]
    return a


def positions(a: Automaton, cuts: list[tuple[str, ...]]) -> np.ndarray:
    """(cuts, levels): paths of each level before each cut."""
    index = {}                                  # label of a cut: place in the labels, whether it is there
    for v in {v for cut in cuts for v in cut}:
        i = bisect_left(range(len(a.labels)), v, key=lambda i: a.labels[i].as_py())
        index[v] = i, i < len(a.labels) and a.labels[i].as_py() == v
    keys = [a.keys(d) for d in range(a.depth)]
    out = np.zeros((len(cuts), a.depth), np.int64)
    for i, cut in enumerate(cuts):
        state, same = 0, True                   # place of the cut's beginning in the level above; whether it is there
        for d in range(a.depth):
            target = state * len(a.labels)
            have = same and d < len(cut)
            if have:
                here, have = index[cut[d]]
                target += here
            state = int(np.searchsorted(keys[d], target))
            same = have and state < len(keys[d]) and int(keys[d][state]) == target
            out[i, d] = state + (1 if same and d + 1 < len(cut) else 0)
    return out


def piece(a: Automaton, low: np.ndarray, high: np.ndarray) -> Automaton | None:
    """The paths from ``low`` up to ``high`` (positions by level). Paths that
    lead there but lie before stay with count 0."""
    start, parents, at = [0] * a.depth, None, None
    for d in range(a.depth - 1, -1, -1):
        start[d] = int(low[d]) if parents is None else min(int(low[d]), parents)
        parents = int(a.parent[d][start[d]]) if start[d] < high[d] else None
    if all(s >= h for s, h in zip(start, high)):
        return None
    used, label = coded(np.concatenate([a.label[d][start[d]:high[d]] for d in range(a.depth)]))
    out, at = Automaton(a.labels.take(pa.array(used)), [], [], []), 0
    for d in range(a.depth):
        n = max(0, int(high[d]) - start[d])
        count = a.count[d][start[d]:start[d] + n].copy()
        count[:max(0, int(low[d]) - start[d])] = 0
        out.parent.append(a.parent[d][start[d]:start[d] + n] - (start[d - 1] if d else 0))
        out.label.append(label[at:at + n])
        out.count.append(count)
        at += n
    return out


def pieces(a: Automaton, cuts: list[tuple[str, ...]]):
    """(range, piece) of every range that ``a`` has paths in; range i lies
    between cut i - 1 and cut i."""
    at = positions(a, cuts)
    ends = np.array([len(x) for x in a.label])
    edges = np.concatenate([np.zeros((1, a.depth), np.int64), at, ends[None]])
    for i in range(len(cuts) + 1):
        if (edges[i + 1] > edges[i]).any():
            p = piece(a, edges[i], edges[i + 1])
            if p is not None:
                yield i, p


def union(parts: list[Automaton]) -> Automaton:
    """Counts summed over all automata."""
    labels, at = ranked(pa.concat_arrays([p.labels for p in parts]))
    first = np.cumsum([0] + [len(p.labels) for p in parts])
    out = Automaton(labels, [], [], [])
    states = [np.zeros(1, np.int32) for _ in parts]
    for d in range(max(p.depth for p in parts)):
        edge = np.cumsum([0] + [len(p.label[d]) for p in parts])
        keys = np.empty(edge[-1], np.int64)
        for i, p in enumerate(parts):
            keys[edge[i]:edge[i + 1]] = arc_keys(states[i][p.parent[d]], len(labels), at[first[i] + p.label[d]])
        found, where = coded(keys)
        del keys
        total = np.zeros(len(found), np.int64)
        for i, p in enumerate(parts):
            states[i] = where[edge[i]:edge[i + 1]]
            total[states[i]] += p.count[d]      # distinct states within one automaton
        out.count.append(narrow(total))
        out.parent.append(narrow(found // len(labels)))
        found %= len(labels)
        out.label.append(narrow(found))
    return out


def pruned(a: Automaton, least: int) -> Automaton:
    """The paths counted ``least`` times and what leads to them."""
    keep = [c >= least for c in a.count]
    for d in range(a.depth - 1, 0, -1):
        keep[d - 1][a.parent[d][keep[d]]] = True
    used, label = coded(np.concatenate([a.label[d][keep[d]] for d in range(a.depth)]))
    out, at, number = Automaton(a.labels.take(pa.array(used)), [], [], []), 0, np.zeros(1, np.int32)
    for d in range(a.depth):
        n = int(keep[d].sum())
        out.parent.append(number[a.parent[d][keep[d]]])
        out.label.append(label[at:at + n])
        out.count.append(a.count[d][keep[d]])
        number, at = narrow(np.cumsum(keep[d]) - 1), at + n
    return out


def acceptor(langs: pa.Array, phrases: pa.Array) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """(automaton, level, state) of the rows' sequences."""
    split = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    size = pc.list_value_length(split).to_numpy()
    labels, at = ranked(pa.concat_arrays([langs.cast(pa.large_string()), split.flatten()]))
    lang, word = at[:len(langs)], at[len(langs):]
    first = np.cumsum(size) - size
    columns = [lang]
    for d in range(int(size.max(initial=0))):
        columns.append(np.where(size > d, word[np.minimum(first + d, len(word) - 1)], -1))
    states: list[np.ndarray] = []
    a = grown(columns, labels, states)
    return a, size, np.stack(states)[size, np.arange(len(size))]


def compose(asked: Automaton, counts: Automaton) -> list[np.ndarray]:
    """For each path of ``asked`` its count in ``counts``, 0 where absent:
    both automata are followed together, level by level."""
    label = pc.fill_null(pc.index_in(asked.labels, counts.labels), -1).to_numpy().astype(np.int64)
    state, out = np.zeros(1, np.int64), []
    for d in range(asked.depth):
        if d >= counts.depth or not len(counts.label[d]):
            state = np.full(len(asked.label[d]), -1, np.int64)
            out.append(np.zeros(len(state), np.int64))
            continue
        before, mine = state[asked.parent[d]].astype(np.int64), label[asked.label[d]]
        keys = counts.keys(d)
        target = np.where((before < 0) | (mine < 0), -1, before * len(counts.labels) + mine)
        at = np.minimum(np.searchsorted(keys, target), len(keys) - 1)
        state = np.where(keys[at] == target, at, -1)
        out.append(np.where(state >= 0, counts.count[d][state], 0))
    return out


def shard_table(docs: DataFrame, text_col: str, lang_col: str, max_words: int) -> DataFrame:
    """(body): one automaton for each SHARD_BYTES of text, a written table.
    Bodies are compressed already, so Parquet's codec, which holds whole
    pages of them outside the heap, is left out."""
    def build(batches):
        held, size = [], 0

        def emit():
            t = pa.Table.from_batches(held)
            a = count_texts(t.column("text"), t.column("lang"), max_words)
            return pa.RecordBatch.from_arrays([pa.array([pack_automaton(a)], pa.binary())], ["body"])

        for batch in batches:
            for b in row_blocks(batch, "text", SHARD_BYTES):
                n = (pc.sum(pc.binary_length(b.column("text"))).as_py() or 0) + ROW_BYTES * b.num_rows
                if held and size + n > SHARD_BYTES:
                    yield emit()
                    held, size = [], 0
                    release()                   # what one shard took, before the next one
                held.append(b)
                size += n
        if held:
            yield emit()

    plain = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return materialize(plain.mapInArrow(lean(build), "body binary"), "shards", codec="uncompressed")


def _path_columns(a: Automaton, d: int, rows: np.ndarray, width: int) -> list[pa.Array]:
    return [a.column(d, rows, e) if e <= d else pa.nulls(len(rows), pa.large_string()) for e in range(width)]


def cut_points(shards: DataFrame, max_words: int, range_entries: int, sample: int) -> list[tuple[str, ...]]:
    """Paths that part all shards' paths into ranges of about
    ``range_entries``."""
    names = [f"p{d}" for d in range(max_words + 1)]

    def probe(batches):
        for batch in batches:
            for body in batch.column("body"):
                a = unpack_automaton(body.as_py())
                for d in range(a.depth):
                    # a phase of its own, so that small shards are sampled in proportion too
                    rows = np.arange((zlib.crc32(body.as_py()) + d * 7919) % sample, len(a.label[d]), sample)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [x.cast(pa.string()) for x in _path_columns(a, d, rows, max_words + 1)], names)

    probes = shards.mapInArrow(lean(probe), ", ".join(f"{c} string" for c in names))
    numbered = dense_index(probes, names, out="at")
    each = max(1, range_entries // sample)
    picked = numbered.where(F.col("at") % each == each - 1).select(*names).distinct().collect()
    return sorted({tuple(v for v in r if v is not None) for r in picked})


def count_ranges(shards: DataFrame, cuts: list[tuple[str, ...]], min_count: int, fan: int = FAN) -> DataFrame:
    """(range, body): the united automaton of each prefix range, pruned to
    ``min_count``, as a written table.

    With more than ``fan`` ranges the union goes in levels: automata are first
    cut into at most ``fan`` runs of neighbouring ranges, the pieces of one run
    are united in as many groups as it has ranges, and the results are cut
    again. So a piece stays large, and their number grows with the
    data and not with shards x ranges."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast(cuts)
    width = 1                                   # ranges in one run
    while width * fan < len(cuts) + 1:
        width *= fan
    rows, before, written = shards.select(F.lit(0).alias("range"), "body"), len(cuts) + 1, []
    while True:
        last, span, run = width == 1, before, width

        def deal(batches):
            for batch in batches:
                for at, body in zip(batch.column("range").to_pylist(), batch.column("body")):
                    mine = shared.value[at * span:(at + 1) * span - 1][run - 1::run]
                    group = zlib.crc32(body.as_py()) % run
                    for i, p in pieces(unpack_automaton(body.as_py()), mine):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([at * (span // run) + i], pa.int32()), pa.array([group], pa.int32()),
                             pa.array([pack_automaton(p)], pa.binary())], ["range", "part", "body"])
                    release()                   # what one shard took, before the next one

        def unite(table: pa.Table) -> pa.Table:
            a = union([unpack_automaton(x.as_py()) for x in table.column("body")])
            body = pack_automaton(pruned(a, min_count) if last else a)
            del a
            release()
            return pa.table({"range": table.column("range").slice(0, 1), "body": pa.array([body], pa.binary())})

        here: list[str] = []
        dealt = rows.mapInArrow(lean(deal), "range int, part int, body binary")
        rows = materialize(dealt.groupBy("range", "part").applyInArrow(unite, "range int, body binary"), "ranges", here,
                           codec="uncompressed")
        delete_paths(spark, written)
        if last:
            return rows
        before, width, written = width, width // fan, here


def frequent(ranges: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, words, f): the counted phrases of all ranges; the
    phrase of no words counts the language's words."""
    def spell(batches):
        for batch in batches:
            for body in batch.column("body"):
                a = unpack_automaton(body.as_py())
                for d in range(a.depth):
                    rows = np.flatnonzero(a.count[d] >= min_count)
                    if not len(rows):
                        continue
                    path = _path_columns(a, d, rows, d + 1)
                    phrase = (pc.binary_join_element_wise(*path[1:], pa.scalar(" ", pa.large_string())) if d
                              else pa.array([""] * len(rows), pa.large_string()))
                    yield pa.RecordBatch.from_arrays(
                        [path[0].cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(rows), d, np.int32)),
                         pa.array(a.count[d][rows], pa.int64())], ["lang", "phrase", "words", "f"])

    return ranges.mapInArrow(lean(spell), "lang string, phrase string, words int, f long")


def look_up(asked: DataFrame, ranges: DataFrame, cuts: list[tuple[str, ...]]) -> DataFrame:
    """(lang, phrase, f) of the distinct rows of ``asked`` (lang, phrase):
    composition with the counts, range by range."""
    shared = asked.sparkSession.sparkContext.broadcast(cuts)

    def place(batches):
        for batch in batches:
            at = [bisect_right(shared.value, (l, *p.split(" "))) for l, p in zip(batch.column("lang").to_pylist(),
                                                                        batch.column("phrase").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    def answer(rows: pa.Table, counts: pa.Table) -> pa.Table:
        f = np.zeros(rows.num_rows, np.int64)
        if rows.num_rows and counts.num_rows:
            a, level, state = acceptor(rows.column("lang").combine_chunks(), rows.column("phrase").combine_chunks())
            found = compose(a, unpack_automaton(counts.column("body")[0].as_py()))
            for d in range(a.depth):
                here = level == d
                f[here] = found[d][state[here]]
        return pa.table({"lang": rows.column("lang"), "phrase": rows.column("phrase"), "f": pa.array(f)})

    placed = asked.select("lang", "phrase").distinct().mapInArrow(place, "range int, lang string, phrase string")
    return placed.groupBy("range").cogroup(ranges.groupBy("range")).applyInArrow(
        answer, "lang string, phrase string, f long")


def _subphrase(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT,
                 range_entries: int = RANGE_ENTRIES, sample: int = SAMPLE, fan: int = FAN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each
    language."""
    shards = shard_table(docs, text_col, lang_col, max_words)
    cuts = cut_points(shards, max_words, range_entries, sample)
    ranges = count_ranges(shards, cuts, min_count, fan)
    counted = materialize(frequent(ranges, min_count), "phrases")
    found = counted.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"),
                                               F.split("phrase", " ").alias("w"))

    halves = found.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    halves = halves.select("lang", "phrase", "a", "k", _subphrase("w", F.lit(1), F.col("k")).alias("left"),
                           _subphrase("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    asked = halves.select("lang", F.col("left").alias("phrase")).union(halves.select("lang", F.col("right").alias("phrase")))
    parts = materialize(look_up(asked, ranges, cuts), "parts")
    whole = halves.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) "
                   "DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    weakest = whole.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("x"))

    longer = found.where("words > 2").select("a", "lang", "w", "words", F.explode(
        F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("a", "lang", "w", "size", F.explode(
        F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    longer = longer.groupBy("lang", _subphrase("w", F.col("start"), F.col("size")).alias("phrase")).agg(
        F.max("a").alias("longest"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("x.a") * covered_percent))

    n = counted.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = (kept.select("lang", "phrase", "x.*").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
            .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                        'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, k, count(*)::BIGINT AS f FROM (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w)
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * u.a * u.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.x JOIN f r ON r.lang = u.lang AND r.phrase = u.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.m IS NULL OR 100 * g.m < {COVERED_PERCENT} * b.a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN n USING (lang)) WHERE rank <= {TOP}
"""
