"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of ``passage_words`` words; the last
may be shorter). Each passage is encoded from what it looks like (case,
punctuation, symbols, digits, word lengths, repetition) and from counts of
neighbouring character classes. A gated attention layer, learned from
document labels alone, weighs the passages of a document; the weighted sum of
their representations is scored by a logistic layer. One bad passage can so
decide about a long document, and the weights say which one it was.

The network is trained in numpy on a bounded sample of labelled rows
(``max_fit_rows``, half per label) and broadcast; its size is fixed by its
parameters. Whole texts are encoded, passage by passage.

Defined results: null and empty texts, and texts without any word, are one
empty passage (all features 0); repeated rows get equal scores; an empty
table gives an empty result; without usable labels of both kinds every score
is the share of good labels (0 when there is none). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import flat, prefix_sums, range_hashes, row_blocks, words
from basketlab.llm.labelled import fit_sample, remainder
from basketlab.llm.store import read

PASSAGE_WORDS = 64
MAX_FIT_ROWS = 6000
BLOCK_BYTES = 1 << 20
GOOD = 0.7

# Classes of a byte: 0 other symbol, 1 lower, 2 upper, 3 digit, 4 part of a
# non-ASCII character, 5 sentence punctuation, 6 space, 7 line end.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[9, 11, 12, 32]] = 6
_CLASS[[10, 13]] = 7
_N_CLASS = 8


def passages(texts: pa.Array, passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passage offsets per text)."""
    raw, offsets = flat(texts)
    n = len(offsets) - 1
    s, e, row = words(raw, offsets)
    first = np.searchsorted(row, np.arange(n + 1))           # first word of each text
    count = np.maximum(1, -(-np.diff(first) // passage_words))
    bag = np.append(0, np.cumsum(count))
    place = bag[row] + (np.arange(len(s)) - first[row]) // passage_words  # passage of each word
    m = int(bag[-1])
    new = np.flatnonzero(np.diff(place, prepend=-1))
    live = place[new]
    byte_from = np.zeros(m, np.int64)
    byte_to = np.zeros(m, np.int64)
    byte_from[live] = s[new]
    byte_to[live] = np.append(e[new[1:] - 1], e[-1]) if len(new) else 0
    n_words = np.bincount(place, minlength=m)
    length = byte_to - byte_from

    cls = _CLASS[raw]
    inside = np.repeat(np.arange(m), length)
    at = np.arange(len(inside)) + np.repeat(byte_from - np.append(0, np.cumsum(length)[:-1]), length)
    c = cls[at]
    classes = np.bincount(inside * _N_CLASS + c, minlength=m * _N_CLASS).reshape(m, _N_CLASS)
    pair = c[1:] * _N_CLASS + c[:-1]
    same = inside[1:] == inside[:-1]
    pairs = np.bincount(inside[1:][same] * 64 + pair[same], minlength=m * 64).reshape(m, 64)
    repeat = np.bincount(inside[1:][same & (raw[at][1:] == raw[at][:-1])], minlength=m)

    h = range_hashes(prefix_sums(raw), s, e)
    per = (place.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    per.sort()
    distinct = np.bincount((per[np.append(True, per[1:] != per[:-1])] >> np.uint64(40)).astype(np.int64)
                           if len(per) else np.zeros(0, np.int64), minlength=m)
    wl = e - s
    mean_len = np.bincount(place, wl, minlength=m) / np.maximum(1, n_words)
    var_len = np.bincount(place, wl * wl, minlength=m) / np.maximum(1, n_words) - mean_len ** 2
    one = np.bincount(place[wl == 1], minlength=m) / np.maximum(1, n_words)
    cap = np.bincount(place[cls[s] == 2], minlength=m) / np.maximum(1, n_words) if len(s) else np.zeros(m)

    size = np.maximum(1, length)[:, None]
    x = np.hstack([classes / size, pairs / size, (repeat / size[:, 0])[:, None],
                   (distinct / np.maximum(1, n_words))[:, None], mean_len[:, None] / 8,
                   np.sqrt(np.maximum(0, var_len))[:, None] / 8, one[:, None], cap[:, None],
                   np.log1p(n_words)[:, None] / 4])
    return x, bag


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class GatedAttention:
    hidden: int = 24
    gate: int = 12
    epochs: int = 12
    batch: int = 64
    rate: float = 0.005
    decay: float = 1e-4
    seed: int = 11
    prior: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    p: dict | None = None

    def _forward(self, x, bag):
        p = self.p
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"] + p["ub"])
        a = (t * g) @ p["w"]
        starts = bag[:-1]
        rep = np.repeat(np.arange(len(starts)), np.diff(bag))
        a = np.exp(a - np.maximum.reduceat(a, starts)[rep])
        a /= np.add.reduceat(a, starts)[rep]
        z = np.add.reduceat(h * a[:, None], starts)
        return h, t, g, a, rep, z, sigmoid(z @ p["o"] + p["ob"])

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> "GatedAttention":
        """Adam on the logistic loss, both labels weighing the same."""
        self.prior = float(y.mean()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        D, H, G = x.shape[1], self.hidden, self.gate
        self.p = {"W": rng.normal(0, (2 / D) ** 0.5, (D, H)), "b": np.zeros(H),
                  "V": rng.normal(0, H ** -0.5, (H, G)), "U": rng.normal(0, H ** -0.5, (H, G)), "ub": np.zeros(G),
                  "w": rng.normal(0, G ** -0.5, G), "o": rng.normal(0, H ** -0.5, H), "ob": np.zeros(1)}
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        n, step = len(y), 0
        for _ in range(self.epochs):
            order = rng.permutation(n)
            for s in range(0, n, self.batch):
                pick = order[s:s + self.batch]
                sizes = bag[pick + 1] - bag[pick]
                b = np.append(0, np.cumsum(sizes))
                rows = np.arange(b[-1]) + np.repeat(bag[pick] - b[:-1], sizes)
                xb = x[rows]
                h, t, g, a, rep, z, out = self._forward(xb, b)
                p = self.p
                d = (out - y[pick]) * weight[pick] / len(pick)
                gz = np.outer(d, p["o"])
                along = (h * gz[rep]).sum(1)
                da = a * (along - np.add.reduceat(a * along, b[:-1])[rep])
                tg = np.outer(da, p["w"])
                dt, dg = tg * g * (1 - t * t), tg * t * g * (1 - g)
                dh = (a[:, None] * gz[rep] + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
                grad = {"W": xb.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "ub": dg.sum(0),
                        "w": (t * g).T @ da, "o": z.T @ d, "ob": np.array([d.sum()])}
                step += 1
                for k, v in grad.items():
                    v = v + self.decay * p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    p[k] = p[k] - self.rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention weight of each passage)."""
        n = len(bag) - 1
        if self.p is None or not n:
            return np.full(n, self.prior), np.repeat(1.0 / np.maximum(1, np.diff(bag)), np.diff(bag))
        out = self._forward(np.clip((x - self.mean) / self.scale, -6, 6), bag)
        return out[-1], out[3]


def fit_quality(docs: DataFrame, labels: DataFrame, train, max_fit_rows: int = MAX_FIT_ROWS,
                id_col: str = "doc_id", text_col: str = "text", **kw) -> GatedAttention:
    """The network, from a bounded sample; only passage features of the
    sample reach the driver."""
    def encode(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", BLOCK_BYTES):
                x, bag = passages(b.column("text"))
                x = x.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id"), b.column("label"),
                     pa.array([x[i:j].tobytes() for i, j in zip(bag[:-1], bag[1:])], pa.binary())],
                    ["id", "label", "x"])

    rows = fit_sample(docs, labels, "quality", train, max_fit_rows, id_col, text_col)
    got = rows.select("_id", "label", "text").mapInArrow(encode, "id long, label int, x binary").toArrow()
    got = got.sort_by([("id", "ascending")])
    width = passages(pa.array([""]))[0].shape[1]
    bags = [np.frombuffer(v, np.float32).reshape(-1, width) for v in got.column("x").to_pylist()]
    x = np.concatenate(bags).astype(float) if bags else np.zeros((0, width))
    return GatedAttention(**kw).fit(x, np.cumsum([0] + [len(v) for v in bags]),
                                    np.array(got.column("label").to_pylist(), float))


def quality_scores(docs: DataFrame, net: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages, focus, focus_weight) of every row; ``focus`` is
    the 0-based passage with the largest attention weight."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        net = shared.value
        for batch in batches:
            for b in row_blocks(batch, "text", BLOCK_BYTES):
                x, bag = passages(b.column("text"))
                s, a = net.scores(x, bag)
                top = np.maximum.reduceat(a, bag[:-1])
                hit = np.flatnonzero(a == np.repeat(top, np.diff(bag)))
                focus = hit[np.searchsorted(hit, bag[:-1])] - bag[:-1]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(s), pa.array(np.diff(bag)), pa.array(focus), pa.array(top)],
                    ["id", "score", "passages", "focus", "focus_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "id long, score double, passages long, focus long, focus_weight double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = fit_quality(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    s = quality_scores(docs, net)
    return s.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= GOOD).cast("int").alias("predicted"), "passages", "focus", "focus_weight")
