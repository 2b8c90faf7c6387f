"""SimHash near-dedup, benchmark containment and their parts against plain readings."""

import random

import numpy as np
import pytest

from weftlink.llm.components import components
from weftlink.llm.decontaminate import Sketches, contained_items
from weftlink.llm.fm_index import FMIndex, WaveletMatrix
from weftlink.llm.simhash import Router, fingerprint, near_duplicates, shard_links
from weftlink.llm.substring_dedup import earliest_windows

from . import brute as B
from .test_text_operators import rows


def copies(seed):
    r = random.Random(seed)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + str(r.randint(0, 30)) for _ in range(r.randint(1, 120))) for _ in range(25)]
    out = []
    for i in range(120):
        w = r.choice(base).split()
        if r.random() < 0.5:
            w[r.randrange(len(w))] = "changed"
        out.append((r.randint(0, 200), " ".join(w)))
    return out


@pytest.mark.parametrize("docs", [[d for d in B.EDGES if d[0] != 10], copies(3), [], [(1, None)]], ids=["edges", "copies", "empty", "null"])
def test_near_duplicates(spark, docs):
    got = near_duplicates(B.frame(spark, docs, clash=True), shard_points=0.5)
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted(B.near(docs), key=str)


def test_long_text_fingerprint():
    assert fingerprint(B.LONG) == B.fingerprint(B.LONG)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_tree_finds_all_links(shards):
    """Every pair within two bits meets in a shard, whatever the cuts; clusters, chains and far points."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 30, 3), dtype=np.uint64)).astype(np.uint64)
    points = np.unique(np.concatenate([(centres[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel(), rng.integers(0, 1 << 63, 800, dtype=np.uint64)]))
    router = Router(rng.permutation(points)[:600], shards, 2)
    at, shard, home = router.route(points)
    assert home.sum() == len(points)
    edges = []
    for s in np.unique(shard):
        a, b = shard_links(points[at[shard == s]], home[shard == s], 2, leaf=16)
        edges += list(zip(a.tolist(), b.tolist(), strict=True))

    def classes(links):
        label = {p: p for p in points.tolist()}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
        return [find(p) for p in points.tolist()]

    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert classes(edges) == classes(zip(points[i].tolist(), points[j].tolist(), strict=True))


def test_visits_are_dealt_evenly():
    """No shard receives far more visits than the mean, and each pair of shards is visited from one side only."""
    points = np.random.default_rng(3).integers(0, 1 << 64, 200_000, dtype=np.uint64)
    router = Router(np.sort(points[:20_000]), 150, 2)
    at, shard, home = router.route(points)
    counts = np.bincount(shard, minlength=router.leaves)
    assert counts.max() < 4 * counts.mean() and home.sum() == len(points)
    own = np.zeros(len(points), int)
    own[at[home]] = shard[home]
    pairs = {(a, b) for a, b in zip(own[at].tolist(), shard.tolist(), strict=True) if a != b}
    assert not any((b, a) in pairs for a, b in pairs)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90} | {200 + k: 200 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fm_index_against_search():
    """Matching statistics of any query, words outside the index included."""
    r = random.Random(2)
    seqs = [[r.randint(1, 4) for _ in range(r.randint(1, 30))] for _ in range(40)]
    text = np.array([x for s in seqs for x in (*s, 0)])
    value = np.repeat(np.arange(len(seqs)), [len(s) + 1 for s in seqs])
    index = FMIndex(text, 5, value, 6)
    query = np.array([r.choice([0, 1, 2, 3, 4]) for _ in range(300)])
    length, low, high = index.matching_statistics(query, np.arange(300))
    where = lambda run: [i for i, s in enumerate(seqs) for j in range(len(s) - len(run) + 1) if s[j : j + len(run)] == run]
    for end in range(300):
        best = 0
        while best < 6 and end - best >= 0 and query[end - best] > 0 and where(query[end - best : end + 1].tolist()):
            best += 1
        assert length[end] == best
        if best:
            found = where(query[end - best + 1 : end + 1].tolist())
            assert high[end] - low[end] == len(found)
    full = length == 6
    assert index.least(low[full], high[full]).tolist() == [min(where(query[e - 5 : e + 1].tolist())) for e in np.flatnonzero(full)]


def test_wavelet_rank_over_superblocks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 5, 200_000)
    matrix = WaveletMatrix(symbols, 5)
    assert all(c.dtype == np.uint16 for c in matrix.counts)
    at = np.concatenate([[0, 1, 63, 64, 65_535, 65_536, 65_537, 131_072, 200_000], rng.integers(0, 200_001, 300)])
    for c in range(5):
        assert matrix.rank(np.full(len(at), c), at).tolist() == np.concatenate([[0], np.cumsum(symbols == c)])[at].tolist()


def test_earliest_windows_against_search():
    """Many variants under one key, beside keys of one segment: each window's least id is that of a plain search."""
    r = random.Random(3)
    base = [str(r.randint(0, 9)) for _ in range(30)]
    seen, segments, keys, ids = set(), [], [], []
    for key, n in ((5, 60), (7, 1), (8, 2), (9, 13)):
        own = []
        for _ in range(n):
            a = r.randint(0, 10)
            w = [f"{key}k{x}" for x in base[a : a + r.randint(5, 12)]]
            w[r.randrange(len(w))] += r.choice(["", "x"])
            if " ".join(w) not in seen:
                seen.add(" ".join(w))
                own.append((r.randint(0, 99), " ".join(w)))
        own.sort()
        segments, keys, ids = segments + [t for _, t in own], keys + [key] * len(own), ids + [i for i, _ in own]
    got, windows = earliest_windows(segments, np.array(keys), np.array(ids), 5)
    first = {}
    for i, t in zip(ids, segments, strict=True):
        w = t.split()
        for k in range(len(w) - 4):
            g = tuple(w[k : k + 5])
            first[g] = min(i, first.get(g, i))
    want = [first[tuple(w[k : k + 5])] for w in map(str.split, segments) for k in range(len(w) - 4)]
    assert got.tolist() == want and windows.tolist() == [len(t.split()) - 4 for t in segments]
    assert sum(w < i for w, i in zip(want, np.repeat(ids, windows), strict=True)) > 50


ITEMS = [
    (1, "a b c d e f g h i j"),
    (2, "Other WORDS stand in this line of text and then some"),
    (3, "the same line"),
    (4, ""),
    (5, None),
    (6, "one"),
    (7, "x y z " * 40 + "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6"),
    (None, "other words stand in this"),
    (9, " ".join(B.LONG.split()[500:560] + ["changed"] + B.LONG.split()[561:600])),
]


def test_contained_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(B.contained(B.EDGES, ITEMS), key=str)
    for chars in (4_000_000, 300):
        got = contained_items(B.frame(spark, B.EDGES, clash=True), items, block_chars=chars)
        assert rows(got, "doc_id", "item_id", "n_shared", "n_shingles") == want
    assert contained_items(B.frame(spark, []), items).count() == 0
    assert contained_items(B.frame(spark, B.EDGES), items.limit(0)).count() == 0


def test_size_classes():
    """Items fall in classes of powers of two; larger classes ask for more hits, and no class loses an item at the limit."""
    r = random.Random(7)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((3, 9, 20, 36, 68, 260))]
    sketches = Sketches(items, 5, 80)
    needs = [own.need.tolist() for _, own in sorted(sketches.classes.items())]
    assert len(sketches.classes) == len(items) and needs[1:] == sorted(needs[1:]) and needs[-1] > needs[0]
    for k, text in items:
        words = text.split()
        n = min(5, len(words))
        whole = len(words) - n + 1
        lacking = whole - -(-80 * whole // 100)  # as many shingles as may lack
        cut = words[: len(words) - lacking]
        for shift in (0, lacking):
            doc = " ".join([*(f"x{r.random()}" for _ in range(50)), *words[shift : shift + len(cut)], "tail"])
            assert [f[0] for f in sketches.find(doc)] == [k]
        assert sketches.find(" ".join(words[: len(words) - lacking - 1])) == []


def test_contained_random(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 80)))) for i in range(40)]
    docs = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.randint(0, 300))]
        item = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            item[r.randrange(len(item))] = "changed"
        w[len(w) // 2 : len(w) // 2] = item
        docs.append((i, " ".join(w)))
    got = contained_items(B.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "n_shared", "n_shingles") == sorted(B.contained(docs, items), key=str)
