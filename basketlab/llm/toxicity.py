"""Toxicity: a convolutional text classifier.

Words (lower-cased runs of letters and digits) are hashed into an embedding
table. Filters of several widths slide over the word sequence, each filter
keeps its maximum over the whole text, and a logistic layer reads the maxima.
Because a filter of width w is a sum of w per-word projections, the fitted
network is one table per (width, offset), and a text is scored by looking its
words up: whole texts of any length, no padding or truncation.

The network is trained on all labelled training rows. They are dealt to shards
of about SHARD_WORDS words. In each round every shard goes on from the
common network through its own rows in small batches (numpy, one task), and
the changes are averaged by Spark: an embedding over the shards that hold its
word, all else over all shards. Changes travel as whole numbers, so sums, and
with them reruns, do not depend on the order of tasks. Only the network, which
is bounded by its parameters, reaches the driver.

One labelled row in four, by a hash of its id, does not train but calibrates.
There a threshold is chosen for each language, the one with the best F1 (the
middle of the best range) at the share of toxic texts among all labelled
ones, by running counts over all scores; languages with fewer than
``min_calibration`` rows of either label use the threshold of all, which is
0.5 when the whole calibration part has fewer. The score itself never sees
the language.

Defined results: null and empty texts, and texts without any word, get the
score of an all-padding text; words beyond the hash table's size share
embeddings; repeated rows get equal scores; an empty table gives an empty
result; without usable labels of both kinds every score is the share of
toxic labels (0 when there is none). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.arrays import NOT_ALNUM, flat, lean, release, row_blocks, word_hashes
from basketlab.llm.labelled import labelled_ids, remainder
from basketlab.llm.store import pack, read, unpack
from basketlab.operators.sequence import number_within
from basketlab.session import delete_paths, materialize, owned_by

BUCKET_BITS = 16
WIDTHS = (1, 2, 3)
SHARD_WORDS = 4 << 20
BLOCK_BYTES = 1 << 18
UNIT = float(1 << 32)          # changes are summed in whole multiples of 1 / UNIT


def word_ids(texts: pa.Array, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row of each word, word offsets per text)."""
    raw, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    h, row = word_hashes(raw, offsets, NOT_ALNUM)
    ids = (h >> np.uint64(64 - bits)).astype(np.int32)
    return ids, np.searchsorted(row, np.arange(len(offsets)))


def padded(ids: np.ndarray, offsets: np.ndarray, pad: int, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text followed by ``pad`` (at least one) empty words."""
    n = np.diff(offsets)
    out = np.full(len(ids) + pad * len(n), empty, np.int32)
    starts = offsets[:-1] + pad * np.arange(len(n))
    out[np.arange(len(ids)) + np.repeat(pad * np.arange(len(n)), n)] = ids
    return out, np.append(starts, len(out))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def evidence(df: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Start of the first embedding dimension: each word's log odds between
    the labels, less two standard errors (0 for words without evidence).
    ``df[y]``: texts of label y that hold the word, ``rows[y]``: all of them."""
    odds = np.subtract(*np.log((df + 0.5) / (rows[:, None] + 1))[::-1])
    error = np.sqrt((1 / (df + 0.5)).sum(0))
    return np.sign(odds) * np.maximum(np.abs(odds) - 2 * error, 0)


@dataclass
class TextCnn:
    """All parameters lie in one matrix of ``dim`` columns (``point``; its
    AdaGrad sums in ``speed``): a row for each word, then the filters, their
    biases and the logistic layer (``parts``)."""
    bits: int = BUCKET_BITS
    dim: int = 12
    filters: int = 12
    widths: tuple = WIDTHS
    epochs: int = 4
    batch: int = 64
    rate: float = 0.05
    seed: int = 7
    prior: float = 0.0
    point: np.ndarray | None = None
    speed: np.ndarray | None = None
    tables: list = field(default_factory=list)   # per width: (2^bits + 1, width, filters)
    bias: list = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0

    @property
    def words(self) -> int:
        return (1 << self.bits) + 1

    def parts(self, matrix: np.ndarray):
        """(embeddings, filters, biases, logistic weights, its bias): views."""
        V, D, K = self.words, self.dim, self.filters
        rest, at = matrix[V:].reshape(-1), 0
        shapes = [(w, D, K) for w in self.widths] + [(K,)] * len(self.widths) + [(K * len(self.widths),), (1,)]
        views = []
        for shape in shapes:
            n = int(np.prod(shape))
            views.append(rest[at:at + n].reshape(shape))
            at += n
        n = len(self.widths)
        return matrix[:V], views[:n], views[n:2 * n], views[-2], views[-1]

    def start(self, df: np.ndarray, rows: np.ndarray) -> "TextCnn":
        rng = np.random.default_rng(self.seed)
        V, D, K, n = self.words, self.dim, self.filters, len(self.widths)
        size = sum(self.widths) * D * K + 2 * K * n + 1
        self.point = np.zeros((V + -(-size // D), D))
        self.speed = np.full(self.point.shape, 1e-6)
        E, W, _, o, _ = self.parts(self.point)
        E[:] = rng.normal(0, 0.01, (V, D))
        E[:, 0] = evidence(df, rows)
        E[-1] = 0
        for x, w in zip(W, self.widths):
            x[:] = rng.normal(0, 1 / np.sqrt(D * w), x.shape)
        o[:] = rng.normal(0, 0.3, o.shape)
        return self

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, seed) -> None:
        """One pass over the texts, AdaGrad on the logistic loss; ``weight`` of
        each label, such that both weigh the same over all training rows."""
        rng = np.random.default_rng(seed)
        K, V, pad = self.filters, self.words, max(self.widths)
        (E, W, b, o, ob), (aE, aW, ab, ao, aob) = self.parts(self.point), self.parts(self.speed)

        def step(x, a, g):
            a += g * g
            x -= self.rate * g / np.sqrt(a)

        order = rng.permutation(len(texts))
        for s in range(0, len(order), self.batch):
            pick = order[s:s + self.batch]
            docs = [texts[i] for i in pick]
            ids, offs = padded(np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs]), pad, V - 1)
            uniq, inv = np.unique(ids, return_inverse=True)
            B, Eu = len(pick), E[uniq]
            pool, where = np.zeros((B, 0)), []
            for w, Ww, bw in zip(self.widths, W, b):
                conv = (Eu @ Ww[0])[inv]
                for j in range(1, w):
                    conv[:-j] += (Eu @ Ww[j])[inv[j:]]
                ends = offs[1:] - pad + 1   # positions that begin inside the text, or its first pad
                best = np.stack([offs[i] + conv[offs[i]:ends[i]].argmax(0) for i in range(B)])
                where.append(best)
                pool = np.hstack([pool, np.maximum(conv[best, np.arange(K)] + bw, 0)])
            g = (sigmoid(pool @ o + ob) - labels[pick]) * weight[labels[pick]] / B
            gp = np.outer(g, o) * (pool > 0)
            gE = np.zeros_like(Eu)
            grads = []
            for k, (w, Ww, best) in enumerate(zip(self.widths, W, where)):
                gk = gp[:, k * K:(k + 1) * K]
                gW = np.zeros_like(Ww)
                for j in range(w):
                    at = inv[best + j]
                    gW[j] = np.einsum("bkd,bk->dk", Eu[at], gk)
                    np.add.at(gE, at.ravel(), (gk[:, :, None] * Ww[j].T[None]).reshape(-1, self.dim))
                grads.append((gW, gk.sum(0)))
            gE[uniq == V - 1] = 0
            a = aE[uniq] + gE * gE
            aE[uniq] = a
            E[uniq] -= self.rate * gE / np.sqrt(a)
            for k, (gW, gb) in enumerate(grads):
                step(W[k], aW[k], gW)
                step(b[k], ab[k], gb)
            step(o, ao, pool.T @ g)
            step(ob, aob, g.sum())

    def finish(self) -> "TextCnn":
        """The tables that score texts; the parameters are dropped."""
        E, W, b, o, ob = self.parts(self.point)
        self.tables = [np.einsum("vd,wdk->vwk", E, Ww).astype(np.float32) for Ww in W]
        # equal weights put a text without evidence at 1/2; the share of toxic texts puts it back
        self.bias, self.out = [x.copy() for x in b], o.copy()
        self.out_bias = float(ob[0] + np.log(self.prior / (1 - self.prior)))
        self.point = self.speed = None
        return self

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.out is None:
            return np.full(n, self.prior)
        if not n:
            return np.zeros(0)
        ids, offs = padded(ids, offsets, max(self.widths), 1 << self.bits)
        keep = np.ones(len(ids), bool)
        for j in range(max(self.widths) - 1):
            keep[offs[1:] - 1 - j] = False     # only the first pad of a text may begin a window
        starts = np.searchsorted(np.flatnonzero(keep), offs[:-1])
        logit = np.full(n, self.out_bias)
        K = self.filters
        for k, (w, table, bw) in enumerate(zip(self.widths, self.tables, self.bias)):
            conv = table[ids, 0]
            for j in range(1, w):
                conv[:-j] += table[ids[j:], j]
            top = np.maximum.reduceat(conv[keep], starts, axis=0)
            logit += np.maximum(top + bw, 0) @ self.out[k * K:(k + 1) * K]
        return sigmoid(logit)


def thresholds(scored: DataFrame, share: float, min_calibration: int = 20) -> tuple[dict, float]:
    """({language: threshold}, threshold of all) from the calibration rows
    (lang, score, label): the middle of the score gap whose cut has the best F1
    (the highest such) where ``share`` of the texts are toxic. Running counts
    over the distinct scores, however many there are."""
    both = scored.select("score", "label", F.explode(F.array(
        F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")),
        F.struct(F.lit(False).alias("every"), "lang"))).alias("g")).select("g.every", "g.lang", "score", "label")
    of = ["every", "lang"]
    by_score = both.where("lang is not null").groupBy(*of, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("y"))
    running = number_within(by_score, of, ["score"], "_nth", prev={"score": "_below"}, sums={"n": "_n0", "y": "_y0"})
    totals = (by_score.groupBy(*of).agg(F.sum("n").alias("_n"), F.sum("y").alias("_y"))
              .where((F.col("_y") >= min_calibration) & (F.col("_n") - F.col("_y") >= min_calibration)))
    toxic = share / (F.col("_y") / F.col("_n"))                   # weights of a toxic and of another row
    other = (1 - share) / (1 - F.col("_y") / F.col("_n"))
    tp = toxic * (F.col("_y") - F.col("_y0"))
    kept = tp + other * (F.col("_n") - F.col("_n0") - F.col("_y") + F.col("_y0"))
    f1 = 2 * tp / (kept + toxic * F.col("_y"))
    cut = (F.col("score") + F.coalesce(F.col("_below"), F.lit(0.0))) / 2
    best = (running.join(totals, of).select(*of, F.struct(f1.alias("f1"), "score", cut.alias("cut")).alias("at"))
            .groupBy(*of).agg(F.max("at").alias("at")).select(*of, "at.cut").collect())
    overall = [r.cut for r in best if r.every]
    return ({r.lang: r.cut for r in best if not r.every}, overall[0]) if overall else ({}, 0.5)


def training_rows(docs: DataFrame, labels: DataFrame, train, bits: int, id_col: str, text_col: str,
                  lang_col: str) -> DataFrame:
    """(id, label, lang, hashed words, hash of the id modulo 4) of every
    labelled training row. Texts are hashed before the join, two bytes a word;
    labels grow with the texts, so both are dealt by id at any size."""
    def hashed(batches):
        for batch in batches:
            for b in row_blocks(batch, "text", BLOCK_BYTES):
                ids, offs = word_ids(b.column("text"), bits)
                ids = ids.astype(np.uint16 if bits <= 16 else np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("lang"),
                     pa.array([ids[s:e].tobytes() for s, e in zip(offs[:-1], offs[1:])], pa.binary())],
                    ["id", "lang", "words"])

    texts = (docs.where(F.col(id_col).isNotNull()).where(train)
             .select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                     F.col(text_col).cast("string").alias("text"))
             .mapInArrow(lean(hashed), "id long, lang string, words binary"))
    known = labelled_ids(labels, "toxic", train, id_col).withColumnRenamed(id_col, "id")
    return texts.join(known.hint("merge"), "id").select("id", "label", "lang", "words",
                                          F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("rest"))


def shard_table(rows: DataFrame, bits: int, shard_words: int) -> DataFrame:
    """``rows`` as (part, place, body): about ``shard_words`` words each, one
    compressed Arrow stream with the columns label and words."""
    size = 2 if bits <= 16 else 4
    total = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, -(-total // (size * shard_words)))

    def build(batches):
        from pyspark import TaskContext
        part, place, held, have = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for b in row_blocks(batch, "words", BLOCK_BYTES):
                held.append(b)
                have += pc.sum(pc.binary_length(b.column("words"))).as_py() or 0
                if have >= 2 * size * shard_words:               # a part with many rows of one id
                    yield body(part, place, held)
                    place, held, have = place + 1, [], 0
        if held:
            yield body(part, place, held)

    def body(part, place, held):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([place], pa.int64()),
                                           pa.array([pack(pa.Table.from_batches(held))], pa.binary())],
                                          ["part", "place", "body"])

    dealt = rows.repartition(n, "id").sortWithinPartitions(F.xxhash64("id"), "id", "words", "label")
    return dealt.select("label", "words").mapInArrow(lean(build), "part long, place long, body binary")


def shards(batches, bits: int):
    """(part, place, texts, labels) of each row of ``shard_table``."""
    for b in batches:
        for part, place, body in zip(*[c.to_pylist() for c in b.columns]):
            t = unpack(body)
            kind = np.uint16 if bits <= 16 else np.int32
            yield (part, place, [np.frombuffer(x, kind).astype(np.int32) for x in t.column("words").to_pylist()],
                   t.column("label").to_numpy().astype(np.int64))


def word_counts(packed: DataFrame, net: TextCnn) -> tuple[np.ndarray, np.ndarray]:
    """(texts of each label that hold each word, texts of each label)."""
    V, bits = net.words, net.bits

    def count(batches):
        for _, _, texts, labels in shards(batches, bits):
            df = np.zeros((2, V), np.int64)
            for t, y in zip(texts, labels):
                df[y, np.unique(t)] += 1
            df[:, -1] = np.bincount(labels, minlength=2)          # the pad is in no text: its place holds all
            at = np.flatnonzero(df.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[0, at]), pa.array(df[1, at])], ["word", "n0", "n1"])

    got = packed.mapInArrow(lean(count), "word long, n0 long, n1 long").groupBy("word").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    df = np.zeros((2, V))
    df[:, got.column("word").to_numpy()] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    rows = df[:, -1].copy()
    df[:, -1] = 0
    return df, rows


def train_round(packed: DataFrame, net: TextCnn, weight: np.ndarray, epoch: int) -> None:
    """One pass over all shards; ``net`` moves by the mean of their changes."""
    shared = packed.sparkSession.sparkContext.broadcast(net)
    V, D = net.words, net.dim
    names = ["row", "shards", *[f"{k}{i}" for k in "ps" for i in range(D)]]

    def train(batches):
        base = shared.value
        for part, place, texts, labels in shards(batches, base.bits):
            mine = replace(base, point=base.point.copy(), speed=base.speed.copy())
            mine.epoch(texts, labels, weight, (base.seed, epoch, part, place))
            moved = np.concatenate([mine.point - base.point, mine.speed - base.speed], 1)
            held = np.zeros(len(moved), bool)
            held[V:] = True
            held[np.concatenate(texts)] = True
            at = np.flatnonzero(held)
            whole = np.rint(np.clip(moved[at], -2.0 ** 20, 2.0 ** 20) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.ones(len(at), np.int64)), *[pa.array(whole[:, i].copy()) for i in range(2 * D)]],
                names)

    got = packed.mapInArrow(lean(train), ", ".join(f"{c} long" for c in names)).groupBy("row").agg(
        *[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    at, n = got.column("row").to_numpy(), got.column("shards").to_numpy()
    for i in range(D):
        net.point[at, i] += got.column(f"p{i}").to_numpy() / UNIT / n
        net.speed[at, i] += got.column(f"s{i}").to_numpy() / UNIT / n
    shared.destroy()


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, shard_words: int = SHARD_WORDS,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw):
    """(network, thresholds by language, threshold of all) from all labelled
    training rows. Only sums of the network's size reach the driver."""
    counts = dict(labels.where(train).where("toxic in (0, 1)").groupBy(F.col("toxic").cast("int")).count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    net = TextCnn(prior=share, **kw)
    on_the_way: list[str] = []
    with owned_by(on_the_way):
        rows = materialize(training_rows(docs, labels, train, net.bits, id_col, text_col, lang_col), "toxicity_rows")
        packed = materialize(shard_table(rows.where("rest <> 3"), net.bits, shard_words), "toxicity_shards")
        df, n = word_counts(packed, net)
        if n.min() > 0:
            net.start(df, n)
            for k in range(net.epochs):
                train_round(packed, net, n.sum() / (2 * n), k)
            net.finish()
        scored = materialize(calibration_scores(rows.where("rest = 3"), net), "toxicity_scores")
        by_lang, overall = thresholds(scored, share)
    delete_paths(docs.sparkSession, on_the_way)
    release()                                                    # the driver lives on
    return net, by_lang, overall


def calibration_scores(rows: DataFrame, net: TextCnn) -> DataFrame:
    """(lang, score, label) of hashed rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        net = shared.value
        kind = np.uint16 if net.bits <= 16 else np.int32
        for batch in batches:
            for b in row_blocks(batch, "words", BLOCK_BYTES):
                texts = [np.frombuffer(x, kind).astype(np.int32) for x in b.column("words").to_pylist()]
                s = net.scores(np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(s, pa.float64()), b.column("label")],
                                                 ["lang", "score", "label"])

    return rows.select("lang", "label", "words").mapInArrow(lean(score), "lang string, score double, label int")


def toxicity_scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """(id, score, threshold, toxic) of every row; ``threshold`` is that of
    the row's language. The network is bounded by its parameters (about 20 MB)
    and is broadcast once."""
    net, by_lang, overall = model
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        net = shared.value
        for batch in batches:
            for b in row_blocks(batch, "text", BLOCK_BYTES):
                s = net.scores(*word_ids(b.column("text"), net.bits))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())],
                                                 [*b.schema.names[:-1], "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(lean(score), "id long, lang string, score double")
    at = F.lit(overall)
    for lang, t in by_lang.items():
        at = F.when(F.col("lang") == lang, t).otherwise(at)
    return scored.select("id", "score", at.alias("threshold"), (F.col("score") >= at).alias("toxic"))


def keep_clean(docs: DataFrame, model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are below their language's threshold, with
    all columns; the decision is made in the same pass, with no join."""
    net, by_lang, overall = model
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.schema

    def clean(batches):
        net = shared.value
        for batch in batches:
            for b in row_blocks(batch, text_col, BLOCK_BYTES):
                s = net.scores(*word_ids(b.column(text_col), net.bits))
                at = np.array([by_lang.get(x, overall) for x in b.column(lang_col).to_pylist()])
                yield b.filter(pa.array(s < at))

    return docs.mapInArrow(lean(clean), schema)


def train_rows(id_col: str = "doc_id") -> F.Column:
    return remainder(id_col, 5) != 0


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), train_rows())
    s = toxicity_scores(docs, model)
    return s.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")
