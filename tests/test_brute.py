"""Queries that SQL cannot express, against plain loops over a small world."""

import random

import pytest

from weftlink.functions.phonetics import metaphone
from weftlink.operators import decide as D
from weftlink.operators import evaluate as E
from weftlink.plans.queries import QUERIES
from weftlink.plans.records import World

from . import plain_scores as P

L, R = "source1_entity_id", "entity_id"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts whose first words repeat, with swapped, misspelt and lost words, so that blocking and decisions have work."""
    r = random.Random(9)
    words = "harbor night music light forge river stone garden silver copper maple street thomas catherine philip wright".split()
    names = [" ".join(r.sample(words, 4)) for _ in range(40)]
    rows = []
    for i in range(400):
        w = r.choice(names).split()
        if r.random() < 0.3:
            w[r.randrange(4)] = r.choice(words)
        if r.random() < 0.2:
            k = r.randrange(4)
            w[k] = w[k][:-1] + "e"
        tail = [r.choice(words) for _ in range(r.randint(0, 9))]
        text = " ".join(w + tail) if r.random() < 0.8 else " ".join(w + words[:8])
        rows.append((i, text, r.choice(["en", "en", "fr"]), "src", r.choice([103, 204, 205, 1204])))
    path = tmp_path_factory.mktemp("world")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def world(spark, folder):
    w = World(spark, folder)
    records = {r["entity_id"]: r for r in w.records.collect()}
    scored = {(r[L], r[R]): r["prob"] for r in w.scored.collect()}
    assert len(scored) > 150
    return w, records, scored


def close(got, want):
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=1.1e-6)), k


def both(fn, a, b):
    return fn(a, b) if a and b else None


def fuzzy(a, b):
    n, m, c, d = a["name_norm"], b["name_norm"], a["name_core"], b["name_core"]
    x, y, f, g = a["addr_norm"], b["addr_norm"], a["name_core_nofill"], b["name_core_nofill"]
    words, mine = set(x.split()), set(y.split())
    return {
        "nm_ratio": P.indel(n, m),
        "nm_partial": P.partial(n, m),
        "nm_token_sort": P.token_sort(n, m),
        "nm_token_set": P.token_set(n, m) if n != m else 1.0,
        "nm_jw": P.jaro_winkler(n, m),
        "core_ratio": P.indel(c, d),
        "core_token_set": P.token_set(c, d) if c != d else 1.0,
        "core_jw": P.jaro_winkler(c, d),
        "squash_ratio": P.indel(a["name_squash"], b["name_squash"]),
        "ad_token_set": both(lambda s, t: 1.0 if s == t else P.token_set(s, t), x, y),
        "ad_partial": both(P.partial, x, y),
        "ad_ratio": both(P.indel, x, y),
        "nofill_ratio": P.indel(f, g),
        "nofill_token_set": P.token_set(f, g) if f != g else 1.0,
        "ad_jaccard": len(words & mine) / len(words | mine) if words and mine else None,
    }


def test_fuzzy_features(spark, folder, world):
    _, records, scored = world
    rows = QUERIES["feat_fuzzy_rest"](spark, folder).collect()
    assert {(r[L], r[R]) for r in rows} == set(scored)
    for r in rows:
        close(r, fuzzy(records[r[L]], records[r[R]]))


def test_interactions(spark, folder, world):
    _, records, _ = world
    seen = set()
    for r in QUERIES["feat_interactions_fuzzy"](spark, folder).collect():
        f = fuzzy(records[r[L]], records[r[R]])
        n, a, o = f["core_token_set"], f["ad_token_set"] or 0, f["ad_jaccard"]
        want = (int(n >= 0.9 and o is not None and o < 0.2), int(a >= 0.9 and n < 0.5), int(n >= 0.9 and a >= 0.9))
        assert (r["name_strong_addr_weak"], r["addr_strong_name_weak"], r["both_strong"]) == want
        seen.add(want)
    assert len(seen) > 1


def soundex(word):
    codes = {c: str(k) for k, group in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in group}
    out, last = word[0].upper(), codes.get(word[0], "")
    for c in word[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "hw":
            last = code
    return (out + "000")[:4]


def test_phonetic_features(spark, folder, world):
    _, records, _ = world
    seen = set()
    for r in QUERIES["feat_phonetic"](spark, folder).collect():
        a, b = records[r[L]], records[r[R]]
        for column, prefix, flag in (("name_core", "", "non_latin"), ("addr_norm", "addr_", "addr_non_latin")):
            u, v = ([t for t in x[column].split() if t[0].isalpha()] for x in (a, b))
            s, m = [[soundex(t) for t in w] for w in (u, v)], [[k for t in w if (k := metaphone(t))] for w in (u, v)]
            x, y = ({"s" + t for t in s[k]} | {"m" + t for t in m[k]} for k in (0, 1))
            known = not (a[flag] or b[flag]) and x and y
            close(
                r,
                {
                    f"{prefix}phonetic_exact_match": int(s[0] == s[1] and m[0] == m[1]) if known else None,
                    f"{prefix}phonetic_jaccard": len(x & y) / len(x | y) if known else None,
                    f"{prefix}phonetic_token_overlap_ratio": len(x & y) / len(x) if known else None,
                },
            )
            seen.add((r["phonetic_exact_match"], bool(known)))
    assert len(seen) >= 3


def test_stacking_scores(spark, folder, world):
    """Anchors, rivals and cohesion of the whole world with the real scorers."""
    _, records, scored = world
    like = lambda a, b, c: both(lambda x, y: 1.0 if x == y else P.token_set(x, y), records[a][c], records[b][c])
    by_s, by_e = {}, {}
    for (s, e), p in scored.items():
        by_s.setdefault(s, []).append((-p, e))
        by_e.setdefault(e, []).append((-p, s))
    first = lambda group, own: next((x for x in sorted(group) if x[1] != own), None)
    got = {(r[L], r[R]): r for r in QUERIES["anchor_scores"](spark, folder).collect()}
    assert set(got) == set(scored)
    for (s, e), r in got.items():
        o = first(by_s[s], e)
        close(r, {"anc_p1": o and -o[0], "anc_addr_ts": o and like(e, o[1], "addr_norm"), "anc_name_ts": o and like(e, o[1], "name_norm")})
        close(r, {"anc_addr_ratio": o and both(P.indel, records[e]["addr_norm"], records[o[1]]["addr_norm"])})
    for r in QUERIES["rival_scores"](spark, folder).collect():
        s, e = r[L], r[R]
        o = first(by_e[e], s)
        addr, own = o and like(e, o[1], "addr_norm"), like(e, s, "addr_norm")
        close(r, {"riv_addr_ts": addr, "riv_name_ts": o and like(e, o[1], "name_norm"), "riv_addr_gap": None if addr is None or own is None else own - addr})
    for r in QUERIES["cohesion_scores"](spark, folder).collect():
        others = [(-p, x) for p, x in by_s[r[L]] if x != r[R]]
        for column, name in (("addr_norm", "coh_addr"), ("name_norm", "coh_name")):
            sims = [(p, v) for p, x in others if (v := like(r[R], x, column)) is not None]
            weight = sum(p for p, _ in sims)
            close(r, {name: sum(p * v for p, v in sims) / weight if weight > 0 else None})
        assert r["coh_support"] == sum(p >= 0.5 and (like(r[R], x, "addr_norm") or 0) >= 0.8 for p, x in others)


def test_error_tags(spark, folder, world):
    """Tags of all errors, from the conditions read in plain words."""
    w, records, scored = world
    truth = {(r[L], r[R]) for r in w.truth.collect()}
    errors = {(r[L], r[R]): r["kind"] for r in E.error_pairs(D.decide(w.scored), w.truth).collect()}
    assert set(errors.values()) & {"false_merge", "single_merge"} and truth
    got = {(r[L], r[R]): r["tag"] for r in QUERIES["error_tags"](spark, folder).collect()}
    assert set(got) == set(errors)
    for (s, e), kind in errors.items():
        a, b = records[s], records[e]
        f = fuzzy(a, b)
        if kind in ("missed", "false_single"):
            x, y = set(a["name_core"].split()), set(b["name_core"].split())
            u, v = set(a["addr_norm"].split()), set(b["addr_norm"].split())
            n, m = len(a["addr_norm"].split()), len(b["addr_norm"].split())
            contain = max(len(u & v) / len(u), len(u & v) / len(v))
            tests = [
                (s, e) not in scored,
                0.6 <= f["core_ratio"] < 0.95 and len(x) == len(y),
                a["name_sorted"] == b["name_sorted"] and f["core_ratio"] < 1,
                not x & y and not b["non_latin"],
                contain >= 0.9 and min(n, m) / max(n, m) < 0.8,
                bool(a["postcode"] and b["postcode"]) and a["postcode"] != b["postcode"],
            ]
            names = list(E.MISSED_TAGS)
        else:
            tests = [f["core_token_set"] >= 0.9 and f["ad_jaccard"] < 0.2, (f["ad_token_set"] or 0) >= 0.9 and f["core_token_set"] < 0.5]
            names = list(E.FALSE_TAGS)
        assert got[s, e] == next((t for t, holds in zip(names, tests, strict=True) if holds), "other")
