"""The language model's vocabulary grows with the texts; its scores against plain readings of its probabilities."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftlink.llm import language_model as M

from . import brute as B


def test_clusters_sum_to_one():
    model = M.LogBilinear(np.full(37, 1 / 37))
    model.params = [np.random.default_rng(1).normal(0, 1, p.shape).astype(np.float32) for p in model.params]
    for a, b in ((0, 1), (37, 37), (5, 37)):
        logs = model.log_probs(np.arange(37), np.full(37, a), np.full(37, b), chunk=10)
        assert np.isclose(np.exp(logs).sum(), 1)


def test_vocabulary_grows(spark, monkeypatch):
    seen = []
    train = M.train
    monkeypatch.setattr(M, "train", lambda docs, vocabulary, *a, **k: seen.append(vocabulary) or train(docs, vocabulary, *a, **k))
    r = random.Random(1)
    docs = [(i, " ".join(f"w{r.randrange(90_000)}" for _ in range(400))) for i in range(500)]
    got = M.lm_scores(B.frame(spark, docs)).collect()
    assert len(seen[0].hashes) > 1500 and seen[0].classes > 32
    assert all(np.isfinite(x["score"]) and x["score"] < 0 for x in got)


def plain_scores(docs, model, vocabulary):
    """Each text's score word by word: a cluster's softmax, one within it, and a class's add-one share."""
    toks = {i: [xxhash.xxh64_intdigest(w.lower()) for w in B.words(t)] + [xxhash.xxh64_intdigest(b"\n")] for i, t in docs}
    counts = Counter(h for i, hs in toks.items() if not B.held_out(i) for h in hs)
    listed = {int(h): int(s) for h, s in zip(vocabulary.hashes, vocabulary.symbol, strict=True)}
    n, classes = len(listed), vocabulary.classes
    symbol = lambda h: listed.get(h, n + (h >> 32) % classes)
    other = {h: c for h, c in counts.items() if h not in listed}
    mass = Counter()
    for h, c in other.items():
        mass[symbol(h)] += c + 1
    r, q, bias, c, cq, cbias = (p.astype(float) for p in model.params)
    k = model.clusters

    def softmax(scores, at):
        top = max(scores)
        return scores[at] - top - math.log(sum(math.exp(x - top) for x in scores))

    out = {}
    for i, hs in toks.items():
        a = b = model.start
        total = 0.0
        for h in hs:
            w = symbol(h)
            hidden = c[0] * r[a] + c[1] * r[b]
            total += softmax([float(hidden @ cq[j] + cbias[j]) for j in range(k)], w % k) / math.log(10)
            members = list(range(w % k, n + classes, k))
            total += softmax([float(hidden @ q[j] + bias[j]) for j in members], members.index(w)) / math.log(10)
            if h not in listed:
                total += math.log10((counts[h] + 1) / (mass[w] + 1))
            a, b = w, a
        out[i] = total
    return out


@pytest.fixture
def trained(monkeypatch):
    """The vocabulary and model of each call."""
    seen, train = [], M.train

    def kept(docs, vocabulary, *a, **k):
        seen.append((vocabulary, train(docs, vocabulary, *a, **k)))
        return seen[-1][1]

    monkeypatch.setattr(M, "train", kept)
    return seen


def test_scores_against_plain(spark, trained):
    r = random.Random(2)
    docs = [(i, " ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randint(0, 40)))) for i in range(60)]
    got = {x["doc_id"]: x["score"] for x in M.lm_scores(B.frame(spark, docs), words=20, classes=5, head=30).collect()}
    want = plain_scores(docs, trained[0][1], trained[0][0])
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Several rounds and replicas give one model, however the texts are dealt to partitions."""
    train, models = M.train, []

    def rounds(docs, vocabulary, total):
        models.append(train(docs, vocabulary, total * 400, least=1 << 18))
        return models[-1]

    monkeypatch.setattr(M, "train", rounds)
    r = random.Random(3)
    docs = [(i, " ".join(f"w{r.randrange(200)}" for _ in range(60))) for i in range(300)]
    df = B.frame(spark, docs)
    one, two = ({x["doc_id"]: x["score"] for x in M.lm_scores(d).collect()} for d in (df, df.repartition(9, F.rand(1))))
    assert all(np.array_equal(p, q) for p, q in zip(models[0].params, models[1].params, strict=True))
    assert not np.allclose(models[0].params[1], M.LogBilinear(models[0].noise).params[1])
    assert one == pytest.approx(two, rel=1e-7)


def test_sums_out_of_range():
    """Scores too large or too small for plain sums still give the logarithms of a softmax."""
    model = M.LogBilinear(np.full(40, 1 / 40))
    for shift in (-200.0, 0.0, 200.0):
        model.params[2] = np.linspace(-3, 3, 40, dtype=np.float32) + np.float32(shift)
        model.params[5] = np.linspace(-3, 3, model.clusters, dtype=np.float32) + np.float32(shift)
        logs = model.log_probs(np.arange(40), np.full(40, 2), np.full(40, 3))
        assert np.isclose(np.exp(logs).sum(), 1, rtol=1e-4)


def test_words_that_a_polynomial_confuses(spark):
    """Two words of 1,024 letters that agree under any polynomial modulo 2^64 are two words."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(set(M.tokens(f"{a} {b}").tolist())) == 3
