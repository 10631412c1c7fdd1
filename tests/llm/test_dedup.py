import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from basketlab.llm import neardup as N, paragraphs as P, substring as S
from basketlab.llm.components import connected_components
from basketlab.llm.shingles import elements
from basketlab.llm.suffix import permuted_prefixes, suffix_array


class Union(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def similar_pairs(texts, threshold=0.8):
    e, offs = elements(pa.array(texts, pa.string()))
    sets = [set(e[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:])]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
            and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def test_elements_count_occurrences():
    e, offs = elements(pa.array(["a b c d e a b c d e", "x", "", None, "A b  c\td e"]))
    assert list(np.diff(offs)) == [6, 1, 0, 0, 1] and len(set(e.tolist())) == 7
    assert e[offs[4]] == e[0]


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(300)]
    other = words[:240] + [f"v{i}" for i in range(60)]
    e, offs = elements(pa.array([" ".join(words), " ".join(other)]))
    a, b = set(e[:offs[1]].tolist()), set(e[offs[1]:].tolist())
    s = N.signatures(e, offs, 2000)
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.04
    assert (s > 0).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (None, 4)] + [(100, k) for k in range(101, 160)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got[9] == got[1] == 1 and got[21] == 20 and got[30] == 30 and {got[k] for k in range(100, 160)} == {100}
    assert 4 not in got


def test_near_duplicates_against_brute_force(docs, rows, nothing):
    got = {r.id: r for r in N.near_duplicate_classes(docs).collect()}
    texts = {i: t or "" for i, t, *_ in rows if i is not None}
    ids = list(texts)
    u = Union()
    for a, b in similar_pairs([texts[i] for i in ids]):
        u.join(ids[a], ids[b])
    assert {i: r.class_id for i, r in got.items()} == {i: u.root(i) for i in ids}
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(
        {u.root(i) for i in ids})
    assert kept.where("doc_id is null").count() == 1
    assert N.near_duplicate_classes(nothing).count() == 0 and N.drop_near_duplicates(nothing).count() == 0


def test_family_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(0)
    e = [sorted(set(rng.integers(0, 60, 50).tolist())) for _ in range(40)]
    ids = np.arange(40)
    want, got = Union(), Union()
    for i in range(40):
        for j in range(i):
            a, b = set(e[i]), set(e[j])
            if len(a & b) >= 0.6 * len(a | b):
                want.join(i, j)
    block = ids % 3
    for a in range(3):
        for b in range(a, 3):
            m = (block == a) | (block == b)
            arr = np.concatenate([np.array(e[i], np.uint64) for i in ids[m]])
            offs = np.append(0, np.cumsum([len(e[i]) for i in ids[m]]))
            for x, y in N.links_within(ids[m], (block[m] == b).astype(int) if a != b else np.zeros(m.sum(), int),
                                       arr, offs, 0.6, columns=16):
                got.join(x, y)
    assert [want.root(i) for i in range(40)] == [got.root(i) for i in range(40)]


def test_blocks_of_short_rows_are_bounded(spark):
    """A family of many short lines: blocks bounded by rows, every row in one block."""
    rows = spark.range(9000).select("id")
    family = rows.selectExpr("id", "1L as family")
    blocks = N.blocks_of(family, rows.selectExpr("id", "6 as n")).groupBy("block").count().collect()
    assert sum(r["count"] for r in blocks) == 9000
    assert max(r["count"] for r in blocks) < 1.2 * N.BLOCK_ROWS


def test_many_short_rows_within_memory():
    """Near-equal lines compared in tiles: all links, without a matrix of all pairs."""
    import tracemalloc
    n = 4000
    e = np.concatenate([np.append(np.arange(9), 100 + k % 1000) for k in range(n)]).astype(np.uint64)
    tracemalloc.start()
    got = N.links_within(np.arange(n), np.zeros(n, int), e, np.arange(n + 1) * 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = Union()
    for a, b in got:
        u.join(a, b)
    assert len(got) == n - 1 and {u.root(k) for k in range(n)} == {0}
    assert peak < 150 << 20


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_tiles_lose_no_link(tile):
    rng = np.random.default_rng(1)
    e = [sorted(set(rng.integers(0, 60, 50).tolist())) for _ in range(40)]
    sides = np.arange(40) % 2
    for s in (np.zeros(40, int), sides):
        want, got = Union(), Union()
        for i in range(40):
            for j in range(i):
                a, b = set(e[i]), set(e[j])
                if len(a & b) >= 0.6 * len(a | b) and (s is not sides or s[i] != s[j]):
                    want.join(i, j)
        for x, y in N.links_within(np.arange(40), s, np.concatenate(e).astype(np.uint64),
                                   np.append(0, np.cumsum([len(x) for x in e])), 0.6, columns=16, tile=tile):
            got.join(x, y)
        assert [want.root(i) for i in range(40)] == [got.root(i) for i in range(40)]


def test_paragraphs_against_brute_force(docs, rows, nothing):
    got = {(r.id, r.at) for r in P.repeated_paragraphs(docs).collect()}
    every = sorted({(i, k, x) for i, t, *_ in rows if i is not None for k, x in enumerate((t or "").split("\n"))
                    if len(x.split()) >= P.MIN_WORDS})
    u = Union()
    for a, b in similar_pairs([x for _, _, x in every]):
        u.join(a, b)
    assert got == {every[k][:2] for k in range(len(every)) if u.root(k) != k}
    cut = P.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert P.repeated_paragraphs(nothing).count() == 0


def test_passages_inside_longer_lines(spark, rows):
    """Planted passages in lines that otherwise differ, against every run of words."""
    from tests.llm.conftest import prose
    rng = random.Random(5)
    passage = prose(rng, 60)
    made = [(100 + k, f"{prose(rng, 200 + k)} {passage.upper() if k == 2 else passage} {prose(rng, 300)}", "x") for k in range(4)]
    made.append((104, f"{prose(rng, 20)}\n{prose(rng, 30)} " + passage.replace(" ", "\n", 30) + f" {prose(rng, 9)}", "x"))
    made.append((105, f"{prose(rng, 200)} {' '.join(passage.split()[:49])} {prose(rng, 200)}", "x"))
    made += [(i, t, "x") for i, t, *_ in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, t string").repartition(3)
    order = sorted({(i, t) for i, t, _ in made if i is not None and t is not None})
    first, want = {}, collections.defaultdict(set)
    for i, t in order:
        w = t.lower().split()
        for p in range(len(w) - P.PASSAGE + 1):
            x = tuple(w[p:p + P.PASSAGE])
            if first.setdefault(x, (i, p)) != (i, p):
                want[i].update(range(p, p + P.PASSAGE))
    got = collections.defaultdict(set)
    for r in P.repeated_passages(docs).collect():
        assert not got[r.id] & set(range(r.lo, r.hi + 1))
        got[r.id].update(range(r.lo, r.hi))
    assert got == want and len(want[101]) >= 60 and len(want[104]) >= 60 and 105 not in want
    lines = {(r.id, r.at) for r in P.repeated_paragraphs(docs, min_words=10).collect()}
    assert not any(i in range(100, 106) for i, _ in lines)
    kept = {r.doc_id: r.text for r in P.drop_repeats(docs, min_words=10).collect()}
    for i in range(100, 106):
        w = dict(order)[i].split()
        assert kept[i].split() == [x for k, x in enumerate(w) if k not in want[i]]
        assert kept[i].count("\n") == dict(order)[i].count("\n")
    assert P.repeated_passages(docs.limit(0)).count() == 0


def test_a_short_footer_line_stays_once(spark):
    rng = random.Random(9)
    from tests.llm.conftest import prose
    footer = "All rights reserved by the  Author"
    rows = [(k, f"{prose(rng, 30)}\n{footer.upper() if k % 2 else footer}\n\n \n", None) for k in range(30)]
    rows += [(29, rows[29][1], None), (40, "Read more\nRead less\nread MORE", None), (41, "Read more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").repartition(4)
    got = {(r.id, r.at): (r.first_id, r.first_at) for r in P.repeated_paragraphs(docs).collect()}
    assert got == {(k, 1): (0, 1) for k in range(1, 30)} | {(40, 2): (40, 0), (41, 0): (40, 0)}
    kept = {r.doc_id: r.text for r in P.drop_repeats(docs).collect()}
    assert kept[40] == "Read more\nRead less" and kept[41] == "" and footer in kept[0] and footer not in kept[2]


@pytest.mark.parametrize("share", [1, 3, 10_000])
def test_counted_join_is_a_join(spark, share):
    from basketlab.llm.store import join_counted
    rows = spark.range(200).selectExpr("id", "if(id % 3 = 0, 7, id % 40) as k")
    keys = rows.groupBy("k").count().where("k <> 5").selectExpr("k", "count as m", "k * 10 as x")
    got = join_counted(rows, keys, ["k"], share)
    assert got.columns == ["k", "id", "x"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.join(keys.drop("m"), "k").collect())
    assert join_counted(rows, keys.limit(0), ["k"]).count() == 0


def test_by_shard():
    from basketlab.llm.arrays import by_shard
    to = np.random.default_rng(3).integers(0, 1000, 500)
    assert {s: m.tolist() for s, m in by_shard(to)} == {int(s): np.flatnonzero(to == s).tolist() for s in np.unique(to)}
    assert list(by_shard(to[:0])) == []


def test_band_count_follows_recall():
    b = P.tuned_bands(0.8, 0.999, 3)
    assert 1 - (1 - 0.8 ** 3) ** b >= 0.999 > 1 - (1 - 0.8 ** 3) ** (b - 1)


@pytest.mark.parametrize("small", [0, 512])
def test_suffix_array(monkeypatch, small):
    from basketlab.llm import suffix
    monkeypatch.setattr(suffix, "SMALL_ALPHABET", small)
    rng = np.random.default_rng(2)
    for k in range(150):
        a = rng.integers(1, rng.choice([2, 3, 6, 40]) + 1, rng.integers(1, 50))
        a = np.tile(a[:5], 6) if k % 3 == 0 else np.repeat(a, 4) if k % 3 == 1 else a
        t = np.append(a, 0)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_array(t)
        assert sa.tolist() == want
        _, p = permuted_prefixes(t, sa, 1000, np.zeros(len(t), bool))
        for x, y in zip(want[1:], want[:-1]):
            n = 0
            while max(x, y) + n < len(t) and t[x + n] == t[y + n]:
                n += 1
            assert p[x] == n


def brute_cut(rows):
    """{(id, text): (removed, spans, kept)} by looking up every string."""
    first = {}
    order = sorted(((S.LAST if i is None else i), (t or "").encode()) for i, t, *_ in rows)
    for i, b in order:
        for s in range(len(b) - S.WIDTH + 1):
            x = b[s:s + S.WIDTH]
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, b in order:
        off, seen = bytearray(len(b)), set()
        for s in range(len(b) - S.WIDTH + 1):
            x = b[s:s + S.WIDTH]
            if first[x] < i or x in seen:
                off[s:s + S.WIDTH] = b"\1" * S.WIDTH
            seen.add(x)
        kept = bytes(c for c, o in zip(b, off) if not o)
        spans = sum(1 for k in range(len(b)) if off[k] and (k == 0 or not off[k - 1]))
        out[i, b] = (len(b), sum(off), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_against_brute_force(docs, rows, nothing):
    want = collections.Counter()
    cut = brute_cut(rows)
    for i, t, *_ in rows:
        want[(i, *cut[S.LAST if i is None else i, (t or "").encode()])] += 1
    got = S.deduplicate(docs).collect()
    assert collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert S.deduplicate(nothing).count() == 0


def test_a_line_in_most_documents_over_many_chunks_and_shards(spark, monkeypatch):
    from tests.llm.conftest import prose
    rng = random.Random(11)
    line = prose(rng, 60)
    rows = [(k, f"{prose(rng, 40)}\n{line if k % 5 else line[:90]}\n{prose(rng, 40)}") for k in range(60)]
    rows.append((60, rows[3][1] + rows[3][1]))
    monkeypatch.setattr(S, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(S, "SHARD_BYTES", 1000)
    want = brute_cut(rows)
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        (i, *want[i, t.encode()]) for i, t in rows}
    assert sum(r.n_removed >= len(line) for r in got) >= 45


@pytest.mark.parametrize("hot", [0, 10 ** 9])
def test_frequent_anchors_take_the_string_path(monkeypatch, rows, hot):
    """The whole method without Spark: chunks, shards, suffix shards."""
    monkeypatch.setattr(S, "HOT_CONTEXTS", hot)
    texts = [(i, t) for i, t, *_ in rows][:55]
    chunks = [pa.table({"id": pa.array([i for i, _ in c], pa.int64()), "text": pa.array([t for _, t in c])})
              for c in (texts[::2], texts[1::2])]
    from basketlab.llm.store import binary_arrays
    sent = {"kind": [], "chunk": [], "body": []}
    for k, c in enumerate(chunks):
        for kind, x in zip(("anchor", "gone"), S.chunk_contexts(c)):
            if len(x["row"]):
                sent["kind"].append(kind)
                sent["chunk"].append(k)
                sent["body"].append(binary_arrays(**x))
    found = S.resolve(pa.table(sent)).to_pydict()
    found = {k: np.array(v) for k, v in found.items()}
    ranges = [(c, r, lo, lo + n + S.WIDTH - 1) for kind, c, r, lo, n in
              zip(*(found[k] for k in ("kind", "chunk", "row", "lo", "n"))) if kind == "gone"]
    assert (found["hot"].any()) == (hot == 0)
    parts = []
    for k, c in enumerate(chunks):
        m = (found["kind"] == "want") & (found["chunk"] == k)
        parts += S.context_bytes(c, k, {x: found[x][m] for x in ("row", "lo", "n", "a", "id", "hot")}, 3)
    every = pa.concat_tables(parts)
    for shard in range(3):
        t = every.filter(pa.compute.equal(every.column("shard"), shard))
        if t.num_rows:
            ranges += [tuple(x.values()) for x in S.suffix_shard(t).to_pylist()]
    off = collections.defaultdict(set)
    for c, r, lo, hi in ranges:
        off[c, r].update(range(lo, hi))
    want = brute_cut(texts)
    for k, c in enumerate(chunks):
        for r, (i, t) in enumerate(zip(*c.to_pydict().values())):
            assert len(off[k, r]) == want[S.LAST if i is None else i, (t or "").encode()][1]
