"""The pipeline against the composition of plain readings, and its stages on edge cases."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from weftlink.llm.pieces import PieceCoder, read_model

from . import brute as B
from .test_text_operators import rows


def corpus(seed=1):
    """Texts with furniture, shared lines, junk, near copies and test items."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, say(r.randint(8, 30))) for k in range(6)]
    shared = [say(25) for _ in range(4)]
    docs, base = [], []
    for i in range(150):
        host = "big" if i % 3 == 0 else f"h{i % 4}"
        kind = r.random()
        if kind < 0.15 and base:
            w = r.choice(base).split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.25:
            text = (say(4) + " ") * 12
        elif kind < 0.32:
            text = say(r.randint(0, 9))
        else:
            text = "\n".join(say(r.randint(20, 60)) for _ in range(r.randint(1, 4)))
            base.append(text)
            if r.random() < 0.3:
                text += "\n" + r.choice(shared)
            if r.random() < 0.2:
                text = say(9) + " " + r.choice(items)[1] + " " + text
        if host == "big":
            text = "home about contact imprint login\n" + text
        docs.append((i, text, host))
    return docs, items


@pytest.fixture
def folder(spark, tmp_path):
    docs, items = corpus()
    B.frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, items


def test_pipeline(spark, folder):
    sf_dir, docs, items = folder
    want = B.pipeline(docs, items, PieceCoder(read_model()))
    assert 20 < len(want) < len(docs)
    assert rows(P.run(spark, sf_dir), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=str)


@pytest.mark.parametrize("docs", [[d for d in B.EDGES if d[0] != 10], []], ids=["edges", "empty"])
def test_stages_keep_columns(spark, folder, docs):
    """Clashing columns pass through every stage; nulls, repeated rows and empty tables do not stop one."""
    df = B.frame(spark, docs, clash=True)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, folder[0])
        assert out.dtypes == df.dtypes, name
        assert out.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).count() == 0 or name in ("near-duplicates", "decontamination")
    assert P.STAGES[-1][1](spark, df, folder[0]).count() == len(docs)


def test_decisions_take_effect(spark, folder):
    sf_dir, _, items = folder
    text = " ".join(f"clean{k} words{k}" for k in range(30))
    docs = [(1, text, "a"), (2, text, "b"), (3, f"{items[0][1]} {text[::-1]}", "c"), (4, "short", "d")]
    df = B.frame(spark, docs)
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    stages = dict(P.STAGES)
    assert ids(stages["quality rules"](spark, df, sf_dir)) == [1, 2, 3]
    assert ids(stages["near-duplicates"](spark, df, sf_dir)) == [1, 3, 4]
    assert ids(stages["decontamination"](spark, df, sf_dir)) == [1, 2, 4]


def clashing(seed=4):
    """Rows with null ids, ids that repeat with other texts or hosts, and rows that repeat whole; items in some texts."""
    docs, items = corpus(seed)
    r = random.Random(seed)
    rows_ = [(r.choice([None, None, i % 40, i % 40, i]), t, h) for i, t, h in docs]
    rows_ += [r.choice(rows_) for _ in range(15)] + [(None, items[0][1], "h1"), (None, "clean " + items[0][1][::-1], "h1"), (7, items[1][1] + " tail", "h2"), (7, None, "h2"), (None, None, None), (None, "", None)]
    return rows_, items


def kept_near(docs):
    """One (id, text) of each class: the least id, null ids last, then the least text hash (signed)."""
    classes, fps = {}, [B.fingerprint(t) for _, t, _ in docs]
    label = list(range(len(docs)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    rank = lambda d: (d[0] is None, d[0] or 0, (xxhash.xxh64_intdigest((d[1] or "").encode(), 42) + (1 << 63)) % (1 << 64))
    for k, d in enumerate(docs):
        classes.setdefault(find(k), []).append(d)
    return [min(c, key=rank)[:2] for c in classes.values()]


@pytest.mark.parametrize("seed", [4, 5])
def test_stages_decide_on_rows(spark, tmp_path, seed):
    """Which rows each stage leaves, against a plain reading: no decision passes to another row of the same or of no id."""
    docs, items = clashing(seed)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = B.frame(spark, docs, clash=True)
    held = lambda t: bool(B.contained([(0, t)], items))
    want = {
        "quality rules": [(i, t) for i, kept, t in B.quality(docs) if kept],
        "line dedup": [(i, t) for i, _, _, t in B.line_dedup([d[:2] for d in docs])],
        "near-duplicates": [(i, t or "") for i, t in kept_near(docs)],
        "decontamination": [(i, t) for i, t, _ in docs if not held(t)],
    }
    for name, stage in P.STAGES[:-1]:
        got = [(x["doc_id"], (x["text"] or "") if name == "near-duplicates" else x["text"]) for x in stage(spark, df, str(tmp_path)).select("doc_id", "text").collect()]
        assert sorted(got, key=str) == sorted(want[name], key=str), name
        assert len(want[name]) < len(docs) or name == "line dedup"
    assert P.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(docs)


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    """Clean rows stay beside contaminated ones of the same id or of none; copies without an id go all the same."""
    item = " ".join(f"secret{k}" for k in range(20))
    clean = [" ".join(f"c{n}x{k}" for k in range(30)) for n in range(4)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(None, item), (None, clean[0]), (None, clean[1]), (5, "x " + item), (5, clean[2]), (1, clean[3]), (None, clean[3])]
    df = B.frame(spark, docs)
    stages = dict(P.STAGES)
    left = lambda name: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, df, str(tmp_path)).collect()), key=str)
    assert left("decontamination") == sorted([d for d in docs if item not in d[1]], key=str)
    assert left("near-duplicates") == sorted([d for d in docs if d != (None, clean[3])], key=str)
