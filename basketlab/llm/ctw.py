"""Language-model scoring by context-tree weighting.

Texts are read as bytes: words (lower-cased A-Z) joined by one space, then
one end byte. Each byte is eight binary decisions, and each decision has a
context tree over the preceding bytes, up to ``DEPTH`` of them. A node counts
zeros and ones (Krichevsky-Trofimov estimate); its weighted probability mixes
its own estimate with the product of its children, half and half, at every
depth. After training, the share of a node's own estimate in that mixture
says how likely the tree stops there, so the probability of a next bit is
the mixture of the estimates along its context path. The counts are those of
all training texts; scoring changes nothing.

How it runs. The texts are written once as chunks (``store.chunk_table``).
Every chunk sends its distinct (context, byte) grams and distinct words, with
their training counts, to shards: grams by their two nearest context bytes,
words by hash. The messages are sums per chunk, so a frequent word or
context is one entry per chunk. A shard adds up the counts, weighs its
subtrees and answers each chunk, gram by gram, in the order it was asked; the
chunk then adds up the answers for its documents. The number of shards grows
with the input; only the two top levels of the trees (at most 256 x 255
nodes, whatever the input) pass through the driver.

Defined results: null text counts as empty (just the end); a null id counts
as the empty text in the split; rows repeat as given; an empty table gives an
empty result; without training rows every bit has probability 1/2 and the
base score is that of an empty vocabulary. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import SPACE, U, block_hashes, by_shard, flat, words
from basketlab.llm.store import binary_arrays, chunk_table, read, to_arrays, unpack
from basketlab.session import materialize

DEPTH = 5
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 2 << 20
END, BLANK = 10, 32
HALF = np.log(0.5)
MESSAGE = "kind string, shard int, chunk long, body binary"


def byte_sequences(texts: pa.Array):
    """(bytes, offsets, word hashes, word offsets): the normalised texts and
    their words."""
    raw, offs = flat(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    s, e, row = words(raw, offs, SPACE)
    n = len(offs) - 1
    h = block_hashes(raw, s, e) >> U(1)
    first = np.searchsorted(row, np.arange(n + 1))
    empty = np.flatnonzero(np.diff(first) == 0)          # one word of no bytes holds the end
    order = np.argsort(np.append(row, empty), kind="stable")
    row2, length = np.append(row, empty)[order], np.append(e - s, np.zeros(len(empty), np.int64))[order]
    out = np.full(int(length.sum()) + len(length), BLANK, np.uint8)
    out[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = raw[~SPACE[raw]]
    stops = np.cumsum(length + 1)
    last = np.append(row2[1:] != row2[:-1], True)[:len(row2)]
    out[stops[last] - 1] = END
    return out, np.append(0, stops[last]), h, first


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Per byte: context bytes, nearest first, then the byte itself, as one
    integer. Before the text stand end bytes."""
    code = np.zeros(len(data), U)
    size = np.diff(offsets)
    for j in range(1, depth + 1):
        prev = np.empty(len(data), np.uint8)
        prev[j:] = data[:-j] if j <= len(data) else data[:0]
        for i in range(j):
            prev[offsets[:-1][size > i] + i] = END
        code = code << U(8) | prev
    return code << U(8) | data


def shard_of(gram: np.ndarray, shards: int, depth: int = DEPTH) -> np.ndarray:
    near = (gram >> U(8 * (depth - 1))).astype(np.int64)
    return (near * 2654435761 >> 8) % shards


def _trained(ids: pa.Array, modulus: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % modulus != held for x in ids.to_pylist()], bool)


def _gram_blocks(data, offs, depth):
    """Blocks of documents of a chunk: (first document, sorted grams and
    documents packed in one integer, where each gram begins, the distinct
    grams, bits of the document). Blocks are bounded in bytes (unless one
    document is longer) and by the bits that the gram leaves free."""
    bits = 64 - 8 * (depth + 1)
    n, at = len(offs) - 1, 0
    while at < n:
        to = min(at + (1 << bits), max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK_BYTES, side="right")) - 1))
        part = offs[at:to + 1] - offs[at]
        doc = np.repeat(np.arange(to - at), np.diff(part)).astype(U)
        packed = np.sort(grams(data[offs[at]:offs[to]], part, depth) << U(bits) | doc)
        gram = packed >> U(bits)
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[:len(gram)])
        yield at, packed, starts, gram[starts], bits
        at = to


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0)
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts), minlength=len(u))


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys.astype(np.int64), prepend=0)


def ask(chunk: int, texts: pa.Array, trained: np.ndarray, shards: int, depth: int = DEPTH):
    """Messages of one chunk: its distinct grams and words with training
    counts, by shard."""
    data, offs, h, first = byte_sequences(texts)
    keys, counts = [], []
    for at, packed, starts, found, bits in _gram_blocks(data, offs, depth):
        keys.append(found)
        counts.append(np.add.reduceat(trained[at + (packed & U((1 << bits) - 1)).astype(np.int64)].astype(float), starts))
    gram, n = _merged(keys, counts)
    to = shard_of(gram, shards, depth)
    word_train = np.repeat(trained, np.diff(first)).astype(U)
    both = np.sort(h << U(1) | word_train)
    w = both >> U(1)
    ws = np.flatnonzero(np.append(True, w[1:] != w[:-1])[:len(w)])
    wn = np.add.reduceat((both & U(1)).astype(np.int64), ws) if len(ws) else np.zeros(0, np.int64)
    w = w[ws]
    wto = (w % U(shards)).astype(np.int64)
    for kind, keys, count, where in (("gram", gram, n, to), ("word", w, wn, wto)):
        for s, m in by_shard(where):
            yield kind, s, chunk, binary_arrays(key=_deltas(keys[m]), n=count[m].astype(np.int32))


def _lgamma(x: np.ndarray) -> np.ndarray:
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        low += np.log(y)
        y = y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) - low


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth and one bit position: keys (context, bits so far),
    counts and weighted log probability."""

    def __init__(self, key, n, bit: int):
        node = (key >> U(8)) << U(8) | U(1 << bit) | ((key & U(255)) >> U(8 - bit))
        one = ((key >> U(7 - bit)) & U(1)).astype(bool)
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1])[:len(node)])
        self.key = node[start]
        add = (lambda v: np.add.reduceat(v, start)) if len(start) else (lambda v: np.zeros(0))
        self.ones, self.zeros = add(np.where(one, n, 0.0)), add(np.where(one, 0.0, n))
        self.own = kt_log(self.zeros, self.ones)
        self.weighted, self.stop = self.own, np.ones(len(start))

    def mix(self, children: "Level") -> None:
        parent = (children.key >> U(16)) << U(8) | (children.key & U(255))
        below = np.bincount(np.searchsorted(self.key, parent), children.weighted, minlength=len(self.key))
        self.weighted = HALF + np.logaddexp(self.own, below)
        self.stop = np.exp(HALF + self.own - self.weighted)


def subtrees(gram: np.ndarray, n: np.ndarray, top: int, depth: int = DEPTH) -> list[list[Level]]:
    """[bit][depth - top] levels from depth ``top`` to the leaves, weighted
    bottom-up, of the sorted distinct grams with counts."""
    tables = {}
    for d in range(depth, top - 1, -1):
        key = (gram >> U(8 * (depth - d + 1))) << U(8) | (gram & U(255))
        u, at = np.unique(key, return_inverse=True)
        tables[d] = (u, np.bincount(at, n, minlength=len(u)))
    out = []
    for bit in range(8):
        levels = [Level(*tables[d], bit) for d in range(top, depth + 1)]
        for upper, lower in list(zip(levels[:-1], levels[1:]))[::-1]:
            upper.mix(lower)
        out.append(levels)
    return out


class Top:
    """The nodes of depth 0 and 1, dense."""

    def __init__(self, rows):
        """``rows``: (nearest byte, node, zeros, ones, sum of the children's
        weighted log probabilities)."""
        z, o, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for c, node, a, b, w in rows:
            z[c, node], o[c, node], below[c, node] = a, b, w
        own = kt_log(z, o)
        weighted = HALF + np.logaddexp(own, below)
        self.zeros, self.ones, self.stop = z, o, np.exp(HALF + own - weighted)
        z0, o0 = z.sum(0), o.sum(0)
        own0 = kt_log(z0, o0)
        self.zeros0, self.ones0 = z0, o0
        self.stop0 = np.exp(HALF + own0 - (HALF + np.logaddexp(own0, weighted.sum(0))))


def log10_probability(gram: np.ndarray, levels: list[list[Level]], top: Top, first: int = 2,
                      depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context."""
    out = np.zeros(len(gram))
    sym = (gram & U(255)).astype(np.int64)
    near = (gram >> U(8 * depth)).astype(np.int64)
    for bit in range(8):
        node = 1 << bit | sym >> (8 - bit)
        one = (sym >> (7 - bit) & 1).astype(bool)

        def estimate(zeros, ones):
            return (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)

        left = 1 - top.stop0[node]
        p = top.stop0[node] * estimate(top.zeros0[node], top.ones0[node])
        stop = top.stop[near, node]
        p += left * stop * estimate(top.zeros[near, node], top.ones[near, node])
        left *= 1 - stop
        for d in range(first, depth + 1):
            lv = levels[bit][d - first]
            key = (gram >> U(8 * (depth - d + 1))) << U(8) | node.astype(U)
            at = np.minimum(np.searchsorted(lv.key, key), max(0, len(lv.key) - 1))
            hit = lv.key[at] == key if len(lv.key) else np.zeros(len(key), bool)
            if len(lv.key):
                stop = np.where(hit, lv.stop[at], 0.0)
                p += left * stop * estimate(np.where(hit, lv.zeros[at], 0), np.where(hit, lv.ones[at], 0))
                left *= 1 - stop
        out += np.log10(p + left * 0.5)     # below an unseen node every estimate is 1/2
    return out


def _keys(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = to_arrays(body)
    return np.cumsum(a["key"]).astype(U), a["n"]


def _summed(bodies) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all bodies and their summed counts."""
    pairs = [_keys(b) for b in bodies]
    return _merged([k for k, _ in pairs], [n for _, n in pairs])


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score,
    score) of every row; the code length per byte is
    -score / log10(2) / n_bytes."""
    table = chunk_table(docs, id_col, text_col, CHUNK_BYTES)
    size = table.agg(F.sum("bytes").alias("b")).first().b or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def send(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                t = unpack(body.as_py())
                for m in ask(chunk, t.column("text").combine_chunks(), _trained(t.column("id"), modulus, held), shards):
                    yield pa.RecordBatch.from_pylist([dict(zip(("kind", "shard", "chunk", "body"), m))], _schema)

    _schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
    sent = materialize(table.select("chunk", "body").mapInArrow(send, MESSAGE), "messages")

    def count(t: pa.Table) -> pa.Table:
        gram, n = _summed(t.column("body").to_pylist())
        gram, n = gram[n > 0], n[n > 0]
        parts = []
        for bit, levels in enumerate(subtrees(gram, n, 2)):
            lv = levels[0]
            up = (lv.key >> U(16)) << U(8) | (lv.key & U(255))
            u, at = np.unique(up, return_inverse=True)
            parts.append((u, *(np.bincount(at, v, minlength=len(u)) for v in (lv.zeros, lv.ones, lv.weighted))))
        u, z, o, w = (np.concatenate([p[i] for p in parts]) for i in range(4))
        shard = t.column("shard")[0].as_py()
        body = binary_arrays(key=_deltas(gram), n=n.astype(np.int64))
        return pa.table({"shard": pa.array([shard] * (len(u) + 1), pa.int32()),
                         "near": pa.array(np.append((u >> U(8)).astype(np.int32), -1), pa.int32()),
                         "node": pa.array(np.append((u & U(255)).astype(np.int32), -1), pa.int32()),
                         "zeros": np.append(z, 0.0), "ones": np.append(o, 0.0), "weighted": np.append(w, 0.0),
                         "body": pa.array([None] * len(u) + [body], pa.binary())})

    counted = materialize(sent.where("kind = 'gram'").groupBy("shard").applyInArrow(
        count, "shard int, near int, node int, zeros double, ones double, weighted double, body binary"), "counts")
    rows = (counted.where("near >= 0").groupBy("near", "node")
            .agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("near", "node").collect())  # 256 x 255 at most
    top = docs.sparkSession.sparkContext.broadcast(Top(rows))

    def answer_grams(key, asked: pa.Table, model: pa.Table) -> pa.Table:
        gram, n = _summed(model.column("body").to_pylist()) if model.num_rows else (np.zeros(0, U), np.zeros(0))
        levels = subtrees(gram, n, 2)
        lists = [_keys(b)[0] for b in asked.column("body").to_pylist()]
        every = np.unique(np.concatenate(lists)) if lists else np.zeros(0, U)
        p = log10_probability(every, levels, top.value).astype(np.float32)
        return pa.table({"kind": asked.column("kind"), "shard": asked.column("shard"), "chunk": asked.column("chunk"),
                         "body": pa.array([binary_arrays(x=p[np.searchsorted(every, g)]) for g in lists], pa.binary()),
                         "known": pa.array([0] * len(lists), pa.int64())})

    def answer_words(t: pa.Table) -> pa.Table:
        word, n = _summed(t.column("body").to_pylist())
        lists = [_keys(b)[0] for b in t.column("body").to_pylist()]
        known = np.append(int((n > 0).sum()), np.zeros(len(lists) - 1, np.int64))
        return pa.table({"kind": t.column("kind"), "shard": t.column("shard"), "chunk": t.column("chunk"),
                         "body": pa.array([binary_arrays(x=n[np.searchsorted(word, w)].astype(np.int64)) for w in lists],
                                          pa.binary()),
                         "known": pa.array(known, pa.int64())})

    reply = MESSAGE + ", known long"
    grams_back = (sent.where("kind = 'gram'").groupBy("shard").cogroup(
        counted.where("near = -1").select("shard", "body").groupBy("shard")).applyInArrow(answer_grams, reply))
    words_back = sent.where("kind = 'word'").groupBy("shard").applyInArrow(answer_words, reply)
    back = materialize(grams_back.unionByName(words_back), "answers")

    def score(key, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return _result.empty_table()
        t = unpack(chunks.column("body")[0].as_py())
        data, offs, h, first = byte_sequences(t.column("text").combine_chunks())
        gram = np.unique(np.concatenate([b[3] for b in _gram_blocks(data, offs, DEPTH)]))
        word, at = np.unique(h, return_inverse=True)
        p, c = np.zeros(len(gram)), np.zeros(len(word), np.int64)
        to, wto = shard_of(gram, shards), (word % U(shards)).astype(np.int64)
        of = {"gram": (p, dict(by_shard(to))), "word": (c, dict(by_shard(wto)))}
        for kind, s, body in zip(*(answers.column(x).to_pylist() for x in ("kind", "shard", "body"))):
            out, places = of[kind]
            out[places[s]] = to_arrays(body)["x"]
        n = len(offs) - 1
        total = np.zeros(n)
        for at_doc, packed, starts, found, bits in _gram_blocks(data, offs, DEPTH):
            value = np.repeat(p[np.searchsorted(gram, found)], np.diff(np.append(starts, len(packed))))
            part = np.bincount((packed & U((1 << bits) - 1)).astype(np.int64), value)
            total[at_doc:at_doc + len(part)] = part
        row = np.repeat(np.arange(n), np.diff(first))
        c = c[at] if len(at) else np.zeros(0, np.int64)
        trained = _trained(t.column("id"), modulus, held)
        return pa.table({
            "id": t.column("id"), "held_out": ~trained, "n_bytes": np.diff(offs), "n_words": np.diff(first),
            "known_words": np.bincount(row[c > 0], minlength=n).astype(np.int64),
            "word_sum": np.bincount(row, np.log10(c + 1.0), minlength=n),
            "score": total}, schema=_result)

    _result = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_words", pa.int64()),
                         ("known_words", pa.int64()), ("word_sum", pa.float64()), ("score", pa.float64())])
    scored = materialize(table.select("chunk", "body").groupBy("chunk").cogroup(
        back.select("chunk", "kind", "shard", "body").groupBy("chunk")).applyInArrow(
        score, "id long, held_out boolean, n_bytes long, n_words long, known_words long, word_sum double, score double"),
        "scored")

    ends, seen = scored.where("not held_out").agg(F.count(F.lit(1)), F.sum("n_words")).first()
    total = ends + (seen or 0)                                                  # N: words and ends
    distinct = (back.agg(F.sum("known")).first()[0] or 0) + (1 if ends else 0)  # V, the end included
    end_log, known_end = float(np.log10(ends + 1.0)), 1 if ends else 0
    n_tokens = F.col("n_words") + 1
    return scored.select(
        "id", "held_out", "n_bytes", n_tokens.alias("n_tokens"), (F.col("known_words") + known_end).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("word_sum") + end_log - n_tokens * float(np.log10(total + distinct + 1.0))).alias("base_score"), "score")


def op7_context_tree(spark, sf_dir: str) -> DataFrame:
    s = score_texts(read(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                    (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
