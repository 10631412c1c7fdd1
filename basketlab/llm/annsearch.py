"""Nearest neighbours by inner product with an adaptive dimension scan.

Largest inner product becomes smallest distance by one more coordinate
(sqrt(M^2 - |x|^2), 0 for queries). Vectors are turned by a random rotation
and kept in column blocks inside inverted lists (k-means centres fitted on a
bounded sample). A query probes a share of the lists. Within a list the
columns are read block by block: after t of D dimensions, a candidate whose
partial distance exceeds (1 + epsilon / sqrt t)^2 t / D times the current
bound is abandoned (a hypothesis test on its full distance: rotated
coordinates make the partial distance an unbiased estimate). The bound starts
as the k-th distance to those sample rows that lie in probed lists, which are
among the candidates (they also go to the final ranking, so that a wrong
abandonment never leaves a query short), and tightens within the list. Candidates that survive all blocks are scored
exactly in double precision on the original vectors.

Scale: a list is cut into blocks of about BLOCK_ROWS rows by hash of the id,
and the queries of a list into parts of about PART_QUERIES, so one very
common vector or a very popular list never makes one large group; a task
holds one block and streams its queries. Every row is indexed. Driver and
broadcasts hold the sample, the centres and the rotation, whose sizes are
parameters, and one row per list.

The default share of probed lists (0.8) gives recall above 0.9 on vectors
without any cluster structure, where no index can skip much; lower it for
clustered data.

Defined results: vectors that are null, zero, of another length than the most
common one, or that hold null or non-finite components take no part, nor do
rows with a null id; rows of equal id count once; ties go to the smaller id;
fewer than ``k`` candidates give fewer rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.store import read
from basketlab.session import materialize

K = 20
SAMPLE_ROWS = 8192
MAX_LISTS = 1024
PROBE_SHARE = 0.8
EPSILON = 2.1
COLUMN_BLOCK = 16
BLOCK_ROWS = 16384
PART_QUERIES = 4096
SEED = 5


@dataclass
class Index:
    """What every task needs; bounded by SAMPLE_ROWS, MAX_LISTS and the
    dimension."""
    norm: float
    rotation: np.ndarray
    centres: np.ndarray
    sample: np.ndarray        # original vectors
    sample_ids: np.ndarray
    sample_lists: np.ndarray
    probes: int

    def turned(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm ** 2 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def turned_queries(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def lists_of(self, r: np.ndarray) -> np.ndarray:
        """Lists of each rotated row, nearest centre first."""
        return ((self.centres ** 2).sum(1)[None] - 2 * r @ self.centres.T).argsort(1, kind="stable")

    def distances(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Squared distances that belong to inner products of ``q``."""
        return (q * q).sum(1)[:, None] + self.norm ** 2 - 2 * scores


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed alike for equal rows wherever they stand."""
    return (v * q).sum(-1)


def _centres(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], c)
    return c


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, v an array of doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_index(rows: DataFrame) -> tuple[Index, DataFrame] | None:
    """(shared part, index table (list, id, v, r)): every row of ``rows``
    with its list and its rotated form. None without rows."""
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return None
    d, n = dims.d, dims["count"]
    rows = rows.where(F.size("v") == d)
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first().m ** 0.5
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    sample, ids = matrix(picked.column("v")), picked.column("id").to_numpy()
    lists = int(min(MAX_LISTS, max(16, round(n ** 0.5 / 4)), max(1, len(sample) // 8)))
    rng = np.random.default_rng(SEED)
    rotation, _ = np.linalg.qr(rng.normal(size=(d + 1, d + 1)))
    index = Index(norm, rotation, np.zeros((0, 0)), sample, ids, np.zeros(0), 0)
    index.centres = _centres(index.turned(sample), lists)
    index.sample_lists = index.lists_of(index.turned(sample))[:, 0]
    index.probes = int(np.ceil(PROBE_SHARE * len(index.centres)))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches):
        ix = shared.value
        for b in batches:
            if b.num_rows:
                r = ix.turned(matrix(b.column("v")))
                near = ix.lists_of(r)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near), b.column("id"), b.column("v"), _lists(r.astype(np.float32))],
                    ["list", "id", "v", "r"])

    return index, materialize(rows.mapInArrow(assign, "list int, id long, v array<double>, r array<float>"), "index")


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


class Block:
    """One block of a list in column-block form."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, r: np.ndarray):
        ids, first = np.unique(ids, return_index=True)
        self.ids, self.v, r = ids, v[first], r[first].astype(np.float64)
        self.dims = r.shape[1]
        self.columns = [np.ascontiguousarray(r[:, c:c + COLUMN_BLOCK]) for c in range(0, self.dims, COLUMN_BLOCK)]
        self.squares = [(c * c).sum(1) for c in self.columns]

    def _add(self, part, alive, c, q):
        x = self.columns[c][alive]
        return part + self.squares[c][alive] - 2 * (x @ q) + q @ q

    def search(self, qid: int, q: np.ndarray, r: np.ndarray, bound: float, k: int):
        """(ids, scores) of at most ``k`` rows within the bound, best first."""
        cuts = [r[c:c + COLUMN_BLOCK] for c in range(0, self.dims, COLUMN_BLOCK)]
        alive = np.flatnonzero(self.ids != qid)
        part = self._add(0.0, alive, 0, cuts[0])
        if len(alive) > 4 * k:      # tighten the bound with the most promising rows
            lead = np.argpartition(part, k - 1)[:k]
            full = part[lead]
            for c in range(1, len(cuts)):
                full = self._add(full, alive[lead], c, cuts[c])
            bound = min(bound, float(full.max()))
        slack = 1e-5 * (1 + abs(bound))
        t = len(cuts[0])
        for c in range(1, len(cuts)):
            keep = part <= (1 + EPSILON / t ** 0.5) ** 2 * t / self.dims * bound + slack
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
            part = self._add(part, alive, c, cuts[c])
            t += len(cuts[c])
        alive = alive[part <= bound + slack]
        scores = inner(self.v[alive], q)
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for every row for which ``is_query`` (a
    condition on ``id``) holds, the ``k`` nearest other rows found."""
    spark = vectors.sparkSession
    built = build_index(usable(vectors, id_col, vector_col))
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    index, table = built
    shared = spark.sparkContext.broadcast(index)

    def probe(batches):
        ix = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                q, ids = matrix(b.column("v")), b.column("id").to_numpy()
                r = ix.turned_queries(q)
                lists = ix.lists_of(r)[:, :ix.probes]
                far = ix.distances(q, q @ ix.sample.T)
                open_ = np.zeros((len(q), len(ix.centres)), bool)
                np.put_along_axis(open_, lists, True, 1)
                far[~open_[:, ix.sample_lists] | (ids[:, None] == ix.sample_ids[None])] = np.inf
                lead = np.argsort(far, 1, kind="stable")[:, :k]
                near = np.take_along_axis(far, lead, 1)
                bound = near[:, -1] if near.shape[1] == k else np.full(len(q), np.inf)
                seeds = [ix.sample_ids[x[np.isfinite(d)]] for x, d in zip(lead, near)]
                scores = [inner(ix.sample[x[np.isfinite(d)]], v) for x, d, v in zip(lead, near, q)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), _lists(r.astype(np.float32)), pa.array(bound),
                     _lists(lists.astype(np.int32)), pa.array(seeds, pa.list_(pa.int64())),
                     pa.array(scores, pa.list_(pa.float64()))],
                    ["id", "v", "r", "bound", "lists", "seeds", "scores"])

    asked = materialize(table.where(is_query).select("id", "v").dropDuplicates(["id"]).mapInArrow(
        probe, "id long, v array<double>, r array<float>, bound double, lists array<int>, seeds array<long>, "
               "scores array<double>"), "asked")
    queries = asked.select(F.explode("lists").alias("list"), "id", "v", "r", "bound")
    sizes = table.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    parts = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("parts"))
    shape = F.broadcast(materialize(sizes.join(parts, "list"), "shape"))   # one row per list, MAX_LISTS at most

    def spread(df, own: str, n: str, other: str, m: str, kind: int, bound):
        salt = F.pmod(F.xxhash64("id", F.lit(own)), F.col(n)).cast("int")
        return df.join(shape, "list").select(
            "list", salt.alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other),
            F.lit(kind).alias("kind"), "id", "v", "r", bound.alias("bound"))

    keys = ["list", "block", "part"]
    rows = spread(table, "block", "blocks", "part", "parts", 0, F.lit(0.0)).unionByName(
        spread(queries, "part", "parts", "block", "blocks", 1, F.col("bound")))

    def scan(batches):
        at, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            group = np.stack([b.column(c).to_numpy() for c in [*keys, "kind"]], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for s, e in zip(np.append(0, cuts), np.append(cuts, b.num_rows)):
                x, key = b.slice(s, e - s), tuple(group[s])
                if key[:3] != at:
                    at, held, block = key[:3], [], None
                if key[3] == 0:
                    held.append(x)
                    continue
                if block is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    block, held = Block(t.column("id").to_numpy(), matrix(t.column("v")), matrix(t.column("r"))), []
                out = [(i, *block.search(i, q, r.astype(np.float64), z, k)) for i, q, r, z in zip(
                    x.column("id").to_numpy(), matrix(x.column("v")), matrix(x.column("r")), x.column("bound").to_numpy())]
                n = [len(o[1]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([o[0] for o in out], n)), pa.array(np.concatenate([o[1] for o in out])),
                     pa.array(np.concatenate([o[2] for o in out]))], ["query_id", "id", "score"])

    found = rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(
        scan, "query_id long, id long, score double")
    seeds = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("seeds", "scores")).alias("s")).select(
        "query_id", F.col("s.seeds").alias("id"), F.col("s.scores").alias("score"))
    found = found.unionByName(seeds).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    found = nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
