import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlab.llm import annsearch as A

VECTORS = "vec_id long, embedding array<float>, label int, list int, id string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[100:400] = x[100]                       # one very common vector
    rows = [(i, [float(v) for v in x[i]], 1, 0, "x") for i in range(1200)]
    rows += [(5000, None, 1, 0, "x"), (5020, [0.0] * 16, 1, 0, "x"), (5040, [None] + [1.0] * 15, 1, 0, "x"),
             (5060, [float("nan")] * 16, 1, 0, "x"), (5080, [float("inf")] * 16, 1, 0, "x"),
             (5100, [1.0] * 3, 1, 0, "x"), (None, [1.0] * 16, 1, 0, "x"), rows[7], rows[20]]
    return rows


def brute(rows, k=20):
    keep = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            keep[i] = np.array(v)
    ids = np.array(sorted(keep))
    x = np.stack([keep[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = (x * keep[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours_against_brute_force(spark, vectors):
    got = A.nearest(spark.createDataFrame(vectors, VECTORS), F.col("id") % 20 == 0).toPandas()
    want = brute(vectors)
    assert set(got.query_id) == set(want)
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        assert [(-s, i) for s, i in zip(g.score, g.id)] == sorted((-s, i) for s, i in zip(g.score, g.id))
        exact = {i: s for i, s in brute_scores(vectors, q).items()}
        assert all(exact[i] == s for i, s in zip(g.id, g.score))
        hit += len(set(g.id) & {i for i, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def brute_scores(rows, q):
    v = {i: np.array(x) for i, x, *_ in rows if i is not None and i < 5000}
    return {i: (x * v[q]).sum() for i, x in v.items()}


def test_few_rows_and_none(spark, vectors):
    got = A.nearest(spark.createDataFrame(vectors[:6], VECTORS), F.col("id") % 20 == 0).toPandas()
    assert list(got["rank"]) == [1, 2, 3, 4, 5] and set(got.query_id) == {0}
    assert A.nearest(spark.createDataFrame([], VECTORS), F.col("id") % 20 == 0).count() == 0


def test_abandoning_keeps_the_best():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    ix = A.Index(np.linalg.norm(x, axis=1).max(), np.linalg.qr(rng.normal(size=(65, 65)))[0], None, None, None, None, 0)
    block = A.Block(np.arange(3000), x, ix.turned(x))
    found = 0
    for q in range(30):
        ids, scores = block.search(q, x[q], ix.turned_queries(x[q:q + 1])[0], np.inf, 20)
        s = A.inner(x, x[q])
        want = [j for j in np.argsort(-s, kind="stable") if j != q][:20]
        found += len(set(ids) & set(want))
    assert found >= 590
