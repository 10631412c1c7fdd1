import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketlab.llm import fim, phrases, voronoi
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases -------------------------------------------------------------------

def counts_of(rows):
    """{lang: Counter of word tuples} and {lang: words}, by definition."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def best_phrases(rows, least=10, top=2000):
    f, n = counts_of(rows)
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in found.items()):
                continue
            score, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    vocab = ["the", "of", "New", "york", "City", "a", "b", "é", "straße", "x y", "\U0001F600", "zeta-1"]
    rows = []
    for _ in range(150):
        t = []
        for _ in range(rng.randint(0, 40)):
            t.append(rng.choice(["New York City", "of the", *vocab]))
            if rng.random() < 0.2:
                t.append(rng.choice([".", ",", "\n", "?\t", " ; "]))
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(t)))
    return rows + [("en", None), ("fr", ""), ("fr", "One two. one two"), (None, "  . , "), ("en", "of the " * 400)]


@pytest.mark.parametrize("sample,entries,fan", [(1 << 14, 1 << 21, 256), (7, 20, 256), (7, 100, 3)])
def test_phrases_against_their_definition(spark, monkeypatch, sample, entries, fan):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, l, 1, "x") for l, t in rows], "text string, lang string, f long, phrase string")
    got = phrases.collocations(docs.repartition(3), top=15, sample=sample, range_entries=entries, fan=fan)
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, top=15)


def test_a_shard_takes_little_beside_its_text():
    texts = pa.array([("w" * 99 + " ") * 10000] * 4)              # 4 MB of few words
    phrases.count_texts(texts[:1], pa.array(["en"]))
    tracemalloc.start()
    a = phrases.count_texts(texts, pa.array(["en"] * 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert a.count[1].tolist() == [40000] and peak < 13 * 4 * 10 ** 6


def wide_rows(n=200_000, vocabulary=60_000):
    """Texts whose automaton has many labels and paths."""
    rng = np.random.default_rng(1)
    return pa.array([" ".join(f"w{x}" for x in rng.integers(0, vocabulary, n // 4)) for _ in range(4)])


def traced_peak(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_automata_take_little_beside_their_paths():
    texts, langs = wide_rows(), pa.array(["en"] * 4)
    a, built = traced_peak(lambda: phrases.count_texts(texts, langs))
    n = a.entries()
    body, packed = traced_peak(lambda: phrases.pack_automaton(a))
    back, unpacked = traced_peak(lambda: phrases.unpack_automaton(body))
    _, dealt = traced_peak(lambda: [i for i, _ in phrases.pieces(back, [("en", "w3"), ("en", "w5", "w9", "w1")])])
    _, united = traced_peak(lambda: phrases.union([back, back]))
    # bytes for each path; 90, 62, 61, 28 and 79 with arrays of 64 bits
    assert built < 70 * n and packed < 51 * n and unpacked < 46 * n and dealt < 20 * n and united < 61 * n
    assert all(x.dtype == np.int32 for x in (*a.parent, *a.label, *a.count, *back.parent, *back.label, *back.count))


def test_counts_beyond_32_bits_stay_exact():
    a = phrases.count_texts(pa.array(["a b. a b c. a"]), pa.array(["en"]))
    a.count[:] = [x.astype(np.int64) * 2 ** 31 for x in a.count]
    back = phrases.unpack_automaton(phrases.pack_automaton(a))
    twice = phrases.pruned(phrases.union([back, a]), 1)
    for d in range(a.depth):
        assert back.count[d].tolist() == a.count[d].tolist()
        assert twice.count[d].tolist() == (2 * a.count[d]).tolist()
    i, p = next(phrases.pieces(twice, []))
    assert i == 0 and [x.tolist() for x in p.count] == [x.tolist() for x in twice.count]


def test_phrases_of_nothing(spark, nothing):
    assert phrases.collocations(nothing).count() == 0
    one = spark.createDataFrame([(None, None)], "text string, lang string")
    assert phrases.collocations(one).count() == 0


def test_automata_round_trip_cut_and_union():
    rows = phrase_rows()
    whole = phrases.count_texts(pa.array([t for _, t in rows]), pa.array([l for l, _ in rows]))
    f, n = counts_of(rows)

    def listed(a):
        out = Counter()
        for d in range(a.depth):
            at = np.arange(len(a.label[d]))
            names = [a.column(d, at, e).to_pylist() for e in range(d + 1)]
            for path, c in zip(zip(*names), a.count[d]):
                if c:
                    out[path] += int(c)
        return out

    expected = Counter({(lang,): c for lang, c in n.items() if c})
    for lang, c in f.items():
        expected.update({(lang, *p): v for p, v in c.items()})
    assert listed(whole) == expected
    back = phrases.unpack_automaton(phrases.pack_automaton(whole))
    assert listed(back) == expected and back.entries() == whole.entries()

    shards = [phrases.count_texts(pa.array([t for _, t in rows[i::4]]), pa.array([l for l, _ in rows[i::4]])) for i in range(4)]
    paths = sorted(expected)
    rng = random.Random(1)
    cuts = sorted({*rng.sample(paths, 12), ("en",), ("en", "zz", "q"), ("en", "of", "the"), ("zz",)})
    ranges = {}
    for s in shards:
        for i, p in phrases.pieces(s, cuts):
            ranges.setdefault(i, []).append(phrases.unpack_automaton(phrases.pack_automaton(p)))
    total = Counter()
    for i, parts in ranges.items():
        here = listed(phrases.union(parts))
        low, high = (cuts[i - 1] if i else ()), (cuts[i] if i < len(cuts) else None)
        assert all(p >= low and (high is None or p < high) for p in here)
        total.update(here)
    assert total == expected
    few = phrases.pruned(phrases.union(shards), 10)
    assert {p: c for p, c in listed(few).items() if c >= 10} == {p: c for p, c in expected.items() if c >= 10}


# --- fill in the middle ----------------------------------------------------------

def fim_by_definition(doc_id, text, seed=7, rate=100, share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(11)
    shared = "\n".join(prose(rng, 12) for _ in range(400))
    texts = [None, "", "\n", "\n\n\n", "no end", "one\n", "a\nb", "a <P> b", "<S", "<", "ends <\nS>", "é\n\U0001F600ü\nx",
             "q" * 200_000, "q\n" * 3000, "x" * 300 + "<M>" + "y" * 300, shared, shared + "tail", "head\n" + shared + "\nmore"]
    texts += ["\n".join(prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += ["z" * k + "<S>" + "w" * 900 for k in range(250, 262)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no\nid\n"), (5, "one\n")]


@pytest.mark.parametrize("rate", [100, 40])
def test_fim_against_its_definition_and_back(spark, rate):
    rows = fim_rows()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, output string").repartition(3)
    made = fim.fim_transform(docs, rate=rate).withColumn("back", fim.restore()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == sorted(
        ((i, *fim_by_definition(i, t, rate=rate)) for i, t in rows), key=key)
    texts = Counter((i, t or "") for i, t in rows)
    assert Counter((r.id, r.back) for r in made) == texts


def test_fim_of_nothing(nothing):
    assert fim.fim_transform(nothing).count() == 0


def test_fim_memo_holds_shared_chunks_by_content():
    rng = random.Random(2)
    shared = "\n".join(prose(rng, 15) for _ in range(500))
    texts = [prose(rng, rng.randint(5, 60)) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(20)]
    from basketlab.llm.arrays import flat
    raw, offs = flat(pa.array(texts))
    memo, body = fim.Memo(), raw.tobytes()
    cuts = fim.content_cuts(raw, offs)
    for k, c in enumerate(cuts):
        chunks = [body[x:y] for x, y in zip([int(offs[k]), *c[:-1]], c)]
        assert b"".join(chunks) == texts[k].encode() and all(len(x) <= fim.MAX_CHUNK for x in chunks)
        fim.arrange(f"7:{k}", chunks, memo)
    assert memo.hits > 0.8 * sum(map(len, cuts)) * 0.9       # all but the ends of each text
    small = fim.Memo(limit=5000)
    for k in range(100):
        small.of(bytes([65 + k % 26]) * 1000 + str(k).encode())
        assert small.size <= 5000


def test_fim_mark_over_a_chunk_border():
    memo = fim.Memo()
    for chunks in ([b"ab<", b"P>cd"], [b"ab<S", b">"], [b"<", b"M", b">"]):
        assert fim.arrange("7:1", chunks, memo)[1] == "plain"
    assert fim.arrange("7:1", [b"ab<", b"Q>cd"], memo)[1] != "plain"


# --- Jaccard join ----------------------------------------------------------------

def set_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_by_definition(rows, percent=80):
    sets = [(i, set_of(t)) for i, t in rows if i is not None]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = {}
    for i, s in sets:
        if s:
            distinct[s] = min(i, distinct.get(s, i))
    points = list(distinct.items())
    for a in range(len(points)):
        for b in range(a):
            (x, i), (y, j) = points[a], points[b]
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                i, j = root(i), root(j)
                parent[max(i, j)] = min(i, j)
    return sorted((i, len(s), root(distinct[s]) if s else i) for i, s in sets)


def near_copies(rng, base, copies, changes):
    out = []
    for k in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(t))
    return out


def joined(df):
    return sorted((r.id, r.n_shingles, r.component) for r in df.collect() if r.id is not None)


def test_join_against_all_pairs(spark, docs, rows):
    got = voronoi.jaccard_components(docs)
    assert joined(got) == components_by_definition([(r[0], r[1]) for r in rows])
    nameless = [r for r in got.collect() if r.id is None]
    assert len(nameless) == 1 and nameless[0].component is None


def test_join_of_nothing(nothing):
    assert voronoi.jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("size", [6, 40, 1024])
def test_join_regions_cut_again_and_again(spark, monkeypatch, size):
    monkeypatch.setattr(voronoi, "REGION_ROWS", size)
    rng = random.Random(size)
    texts = []
    crowd = prose(rng, 120).split()
    texts += near_copies(rng, crowd, 90, 5)                       # a dense crowd and its rim
    for _ in range(12):                                           # several clusters with a common passage
        base = crowd[:60] + prose(rng, 70).split()
        texts += near_copies(rng, base, 8, 4)
    chain = prose(rng, 100).split()
    for k in range(30):                                           # a chain: ends far apart, neighbours linked
        chain[3 * k] = f"c{k}"
        texts.append(" ".join(chain))
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ["a b c", "A b c", "a b c d"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, region long").repartition(4)
    got = joined(voronoi.jaccard_components(docs))
    assert got == components_by_definition(rows)
    assert max(Counter(c for _, _, c in got).values()) >= 30


def test_join_lists_bound_is_safe():
    """Any linked pair has the promised number of its lowest shingles in
    common."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        e = rng.choice(10 ** 6, n + 20, replace=False)
        x = np.sort(e[:n])
        drop = int(rng.integers(0, n // 4 + 1))
        y = np.sort(np.append(e[drop:n], e[n:n + int(rng.integers(0, n // 4 + 1))]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            low = [z[:int(voronoi.lowest(np.array([len(z)]))[0])] for z in (x, y)]
            least = [max(1, -(-len(z) * 1600 // 20000)) for z in (x, y)]
            assert len(np.intersect1d(*low)) >= max(least)


def test_each_way_of_cutting_a_region(spark, monkeypatch):
    """Far clusters are cut by cells, a crowd by the ball of a pivot, points
    that are all equally far apart into blocks; the links span the same
    components as all pairs."""
    monkeypatch.setattr(voronoi, "REGION_ROWS", 30)
    seen, write = [], voronoi.materialize

    def spy(df, label, *a):
        out = write(df, label, *a)
        if label == "plan":
            seen.extend((r.region, r.way) for r in out.select("region", "way").collect())
        return out

    monkeypatch.setattr(voronoi, "materialize", spy)
    rng = random.Random(9)

    def sets_near(base, n, changed):
        return [set(rng.sample(sorted(base), len(base) - rng.randint(0, changed))) | {rng.getrandbits(60) for _ in range(2)}
                for _ in range(n)]

    def fresh(n):
        return {rng.getrandbits(60) for _ in range(n)}

    regions = {1: [x for _ in range(6) for x in sets_near(fresh(60), 15, 4)], 2: sets_near(fresh(80), 100, 14)}
    half = fresh(40)
    regions[3] = [half | fresh(45) for _ in range(80)] + [half | {1, 2, 3}, half | {1, 2, 4}]
    rows = [(r, 1000 * r + k, sorted(x)) for r, xs in regions.items() for k, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "region long, id long, set array<long>").repartition(5)
    found = [(r.u, r.v) for r in voronoi.region_links(write(df, "rows")).collect()]
    ways = {r: {w for q, w in seen if q == r} for r in regions}
    assert ways == {1: {"cells"}, 2: {"ball"}, 3: {"blocks"}}

    def partition(links):
        parent = {i: i for _, i, _ in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
        return {i: root(i) for i in parent}

    sets = {i: set(x) for _, i, x in rows}
    pairs = [(u, v) for r, u, _ in rows for q, v, _ in rows if r == q and u < v
             and 100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v])]
    assert set(map(tuple, map(sorted, found))) <= set(pairs)
    assert partition(found) == partition(pairs)
