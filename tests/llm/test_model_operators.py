"""SentencePiece, language model, PII and URL filters."""

import datetime
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.llm.language_model import lm_scores
from weftlink.llm.pieces import PieceCoder, encode_decode, read_model
from weftlink.llm.pii import Pseudonyms, iban_rest, luhn, pseudonymise
from weftlink.llm.url_filters import mine_rules, url_filter, url_tokens

from . import brute as B
from .test_text_operators import rows


@pytest.fixture(scope="module")
def coder():
    return PieceCoder(read_model())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet=" \n\t▁abtheéñ0123,.'<>😀\r", max_size=60))
def test_pieces_match_library(coder, text):
    ids = coder.encode(text)
    assert ids == coder.library.encode(text)
    assert coder.decode(ids) == coder.library.decode(ids)
    coder.check()


def test_encode_decode(spark, coder):
    got = encode_decode(B.frame(spark, B.EDGES, clash=True), read_model())
    want = [(i, coder.library.encode(t or ""), coder.library.decode(coder.library.encode(t or ""))) for i, t in B.EDGES]
    assert rows(got, "doc_id", "ids", "decoded") == sorted(want, key=str)
    assert encode_decode(B.frame(spark, []), read_model()).count() == 0


def test_check_raises(coder):
    own = PieceCoder(read_model())
    own.encode("hello world")
    own.marked["world"] = (1, 2)
    with pytest.raises(ValueError, match="unlike"):
        own.check()


def base_scores(docs):
    toks = [[w.lower() for w in B.words(t)] + [b"\n"] for _, t in docs]
    c = Counter(x for (i, _), ts in zip(docs, toks, strict=True) if not B.held_out(i) for x in ts)
    n, v = sum(c.values()), len(c)
    return [(i, B.held_out(i), len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for (i, _), ts in zip(docs, toks, strict=True)]


@pytest.mark.parametrize("docs", [B.EDGES, [(1, None)], [(next(i for i in range(99) if B.held_out(i)), "only held out")], []], ids=["edges", "null", "held-out", "empty"])
def test_lm_base(spark, docs):
    key = lambda r: (str(r[:5]), r[5])
    got = sorted([tuple(r[n] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in lm_scores(B.frame(spark, docs, clash=True), head=50, words=20).collect()], key=key)
    want = sorted(base_scores(docs), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_lm_learns_context(spark):
    """Words that follow each other in a fixed order are likelier under the model than alone, on held-out texts too."""
    cycle = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(cycle[(i + k) % 12] for k in range(200))) for i in range(400)]
    got = [r for r in lm_scores(B.frame(spark, docs)).collect() if r["held_out"]]
    assert len(got) > 30
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)  # nearer to zero
    assert sum(r["score"] for r in got) < 0


PII = "call +1 (988) 555-2485 or bo.bt42@mail8.example.com, ip 70.123.182.155, card 4111111111111111 or 4111-1111-1111-1111, on 2024-02-29, 12/31/1999, 31.12.1999, GB82 WEST 1234 5698 7654 32, 123-45-6789"


def test_pii_replaces_and_restores():
    p = Pseudonyms(b"key")
    new, spans = p.replace(PII)
    assert [s[2] for s in spans] == ["phone", "email", "ip", "card", "card", "date", "date", "date", "iban", "ssn"]
    values = [new[a:b] for a, b, _, _ in p.spans(new)]
    assert len(values) == len(spans) and all(v not in PII for v in values)
    assert p.replace(new, back=True)[0] == PII
    assert re.split("/", values[6])[::-1][0] == values[7].split(".")[2] and sorted(re.split("[/.]", values[6])) == sorted(values[7].split("."))
    cards = ["".join(c for c in v if c.isdigit()) for v in values[3:5]]
    assert cards[0] == cards[1] and luhn(cards[0])  # one value, written in two ways, stays one value
    assert iban_rest(values[8].replace(" ", "")) == 1
    assert Pseudonyms(b"other").replace(PII)[0] != new


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_feistel_permutes(size, data):
    f = Pseudonyms(b"k").feistel
    x = data.draw(st.integers(0, size - 1))
    assert f.permute(f.permute(x, size, "t"), size, "t", back=True) == x
    if size <= 60:
        assert sorted(f.permute(i, size, "t") for i in range(size)) == list(range(size))


def test_pii_leaves_invalid():
    text = "4111111111111112 2024-02-30 300.1.1.1 v1.2.3 12345 000-12-3456 GB00WEST12345698765432"
    assert Pseudonyms(b"k").replace(text) == (text, [])


def test_pseudonymise(spark):
    docs = [*B.EDGES, (20, PII), (21, "again +1 (988) 555-2485"), (None, "70.123.182.155")]
    got = pseudonymise(B.frame(spark, docs, clash=True), b"key")
    p = Pseudonyms(b"key")
    assert rows(got, "doc_id", "text", "n_found") == sorted([(i, p.replace(t)[0], len(p.replace(t)[1])) for i, t in docs], key=str)
    assert pseudonymise(B.frame(spark, []), b"key").count() == 0
    with pytest.raises(ValueError, match="key"):
        pseudonymise(B.frame(spark, []), b"")


def planted(r):
    """(kind, value, ways to write it) of random personal values; plain arithmetic, nothing of the operator's."""
    kind = r.choice(["date", "phone", "card", "ssn", "ip"])
    if kind == "date":
        d = datetime.date(r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28))
        ways = [d.isoformat(), f"{d.day:02d}.{d.month:02d}.{d.year}", f"{d.day:02d}/{d.month:02d}/{d.year}"] + ([f"{d.month:02d}/{d.day:02d}/{d.year}"] if d.day > 12 else [])
        return kind, d.isoformat(), ways
    if kind == "phone":
        a, b, c = r.randint(200, 999), r.randint(200, 999), r.randint(0, 9999)
        return kind, f"1{a}{b}{c:04d}", [f"+1{a}{b}{c:04d}", f"+1 {a} {b} {c:04d}", f"({a}) {b}-{c:04d}", f"{a}-{b}-{c:04d}", f"+1-{a}-{b}-{c:04d}"]
    if kind == "card":
        body = [4, *(r.randint(0, 9) for _ in range(14))]
        check = -sum(sum(divmod(2 * x, 10)) if k % 2 == 0 else x for k, x in enumerate(body)) % 10
        n = "".join(map(str, [*body, check]))
        return kind, n, [n, "-".join(n[i : i + 4] for i in (0, 4, 8, 12)), " ".join(n[i : i + 4] for i in (0, 4, 8, 12))]
    if kind == "ssn":
        a = r.choice([r.randint(1, 665), r.randint(667, 899)])
        s = f"{a:03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        return kind, s, [s]
    ip = f"{r.randint(11, 99)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}"
    return kind, ip, [ip]


def reading(kind, text):
    """The value that a written form stands for."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "date":
        x, y, z = re.split("[-/.]", text)
        return text if len(x) == 4 else f"{z}-{y}-{x}" if int(y) <= 12 else f"{z}-{x}-{y}"
    if kind == "phone":
        return digits if text[0] == "+" else "1" + digits
    return digits if kind == "card" else text


def test_pseudonyms_of_planted_values(spark):
    """One value has one pseudonym in all texts and formats, no two share one, all else in a text stays, and all is restored."""
    r = random.Random(6)
    values = [planted(r) for _ in range(150)]
    docs, own = [], []
    for i in range(300):
        some = [(k, v, r.choice(ways)) for k, v, ways in r.choices(values, k=r.randint(0, 4))]
        docs.append((i, "; ".join(["text here", *(w for _, _, w in some), "end"])))
        own.append(some)
    seen: dict[tuple, set] = {}
    for x in pseudonymise(B.frame(spark, docs), b"key").collect():
        some = own[x["doc_id"]]
        first, *new, last = x["text"].split("; ")
        assert (first, last, len(new), x["n_found"]) == ("text here", "end", len(some), len(some))
        for (kind, value, way), text in zip(some, new, strict=True):
            assert re.sub("[0-9]+" if kind == "ip" else "[0-9]", "0", text) == re.sub("[0-9]+" if kind == "ip" else "[0-9]", "0", way)
            seen.setdefault((kind, value), set()).add(reading(kind, text))
        assert Pseudonyms(b"key").replace(x["text"], back=True)[0] == docs[x["doc_id"]][1]
    assert len(seen) > 100 and all(len(v) == 1 for v in seen.values())
    news = [(k[0], *v) for k, v in seen.items()]
    assert len(set(news)) == len(news) and sum(k == n[:2] for k, n in zip(seen, news, strict=True)) <= 2


def test_dates_are_permuted_whole():
    """Over all days from 1900 to 2099 no two share a pseudonym, and days past the 12th stay among each other."""
    p, days = Pseudonyms(b"key"), [datetime.date(1900, 1, 1) + datetime.timedelta(d) for d in range(73_049)]
    new = [p._date(d.isoformat(), False) for d in days]
    assert len(set(new)) == len(days) and all((int(n[8:]) > 12) == (d.day > 12) for d, n in zip(days, new, strict=True))


def plain_feistel(key, tag, size, x):
    """The permutation in plain words: two numbers of about the root's size take turns in adding a keyed hash of the other."""
    key = hashlib.blake2b(key, digest_size=32).digest()
    a = next(k for k in itertools.count(math.isqrt(size)) if k * k >= size)
    b = math.ceil(size / a)
    f = lambda k, v: int.from_bytes(hashlib.blake2b(f"{tag}:{size}|{k}|{v}".encode(), key=key, digest_size=32).digest(), "big")
    while True:
        left, right = x // b, x % b
        for k in (0, 2, 4, 6):
            right = (right + f(k, left)) % b
            left = (left + f(k + 1, right)) % a
        x = left * b + right
        if x < size:
            yield x


def test_feistel_against_plain():
    p = Pseudonyms(b"key")
    for text in ("123-45-6789", "899-01-0001"):
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        want = next(s for s in (f"{x:09d}" for x in plain_feistel(b"key", "ssn", 10**9, int(text.replace("-", "")))) if valid(s))
        assert p.value("ssn", text).replace("-", "") == want


URLS = [
    (1, "http://a.Example.COM/en/7x?q=1#f", ("a.example.com", "/en/7x", "example.com/en/7", "allow")),
    (2, "https://x.net/de/81", ("x.net", "/de/81", "net/de/", "block")),
    (3, "https://b.example.net/de/81", ("b.example.net", "/de/81", "example.net/de/8", "allow")),
    (4, "https://notexample.net/de/81", ("notexample.net", "/de/81", "net/de/", "block")),
    (5, "x://org/es/?a://b", ("org", "/es/", "org/es/", "block")),
    (6, "http://h?x=/en/", ("h", "", None, "allow")),
    (7, "no scheme.com/en/", ("", "", None, "allow")),
    (8, None, ("", "", None, "allow")),
    (8, None, ("", "", None, "allow")),
    (9, "", ("", "", None, "allow")),
    (None, "http://q.com/en/1\nx", ("q.com", "/en/1\nx", "com/en/", "block")),
    (10, "http://é.com/EN/", ("é.com", "/EN/", None, "allow")),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "html", "x", 1) for i, u, _ in URLS], "page_id long, url string, html string, host string, n int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter(pages, labels)
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted([(i, *w) for i, _, w in URLS], key=str)
    assert url_filter(pages.limit(0), labels).count() == 0


def test_url_mined(spark):
    """Tokens that labelled bad pages share block unlabelled pages; a pair that is bad only together needs both."""
    r = random.Random(1)
    rows_, labels = [], []
    for i in range(400):
        kind = i % 4
        host = ("spam-farm", "news", "shop", "shop")[kind]
        path = ("a", "win", "win", "c")[kind]
        rows_.append((i, f"http://{host}.example.io/{path}/{r.randint(0, 999)}"))
        if i < 300:
            labels.append((i, 0 if kind in (0, 2) else 1, 0))
    pages = spark.createDataFrame(rows_, "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in url_filter(pages, spark.createDataFrame([*labels, (None, 0, 1), (0, None, None)], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == ("block" if i % 4 in (0, 2) else "allow") for i in range(400))


def expanded(rules, classes):
    """Mined rules as (confidence, sets of alternative tokens)."""
    members = {}
    for c in classes.collect():
        members.setdefault(c["item"], set()).add(c["token"])
    return [(r["confidence"], [members[i] for i in r["items"]]) for r in rules.collect()]


def brute_rules(data, min_support, min_confidence, min_rows, max_share):
    """All token sets by counting: (confidence, set) of those that reach the limits."""
    least = max(min_support, min_rows / len(data)) * len(data)
    count = Counter(t for tokens, _ in data for t in set(tokens))
    tokens = sorted(t for t, n in count.items() if n >= least and n <= max_share * len(data))
    out = []
    for n in range(1, len(tokens) + 1):
        for some in itertools.combinations(tokens, n):
            held = [bad for own, bad in data if set(some) <= set(own)]
            if sum(held) >= least and sum(held) / len(held) >= min_confidence:
                out.append((sum(held) / len(held), set(some)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mining_against_counting(spark, seed):
    """Every set of tokens gets the surest confidence that counting all token sets gives."""
    r = random.Random(seed)
    tokens = list("abcdefg")
    data = []
    for _ in range(120):
        own = [t for t in tokens if r.random() < 0.4]
        own += ["x", "y"] if "a" in own else []
        own += ["all"]
        data.append((own, r.random() < (0.9 if {"a", "b"} <= set(own) or "g" in own else 0.2)))
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(data)], "row long, tokens array<string>, bad boolean")
    mined = expanded(*mine_rules(df, 0.05, 0.7))
    plain = brute_rules(data, 0.05, 0.7, 5, 0.95)
    assert plain
    for n in range(4):
        for some in itertools.combinations([*tokens, "x", "all"], n):
            got = max((c for c, sets in mined if all(s & set(some) for s in sets)), default=None)
            want = max((c for c, own in plain if own <= set(some)), default=None)
            assert got == pytest.approx(want) if want is not None else got is None, some


def test_joint_tokens_do_not_explode(spark):
    joint = [f"t{k}" for k in range(25)]
    df = spark.createDataFrame([(i, [*joint, f"o{i % 3}"], i % 10 > 0) for i in range(60)] + [(100 + i, ["c"], False) for i in range(60)], "row long, tokens array<string>, bad boolean")
    found = expanded(*mine_rules(df))
    assert (pytest.approx(0.9), [set(joint)]) in found


def test_url_filter_after_repartition(spark):
    """The same verdicts however the pages are dealt, and from a plan whose partitions change."""
    urls = [(i, f"http://{('spam', 'news')[i % 2]}.example.io/{'win' if i % 4 == 0 else 'a'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    want = rows(url_filter(pages, labels), "page_id", "verdict", "confidence")
    assert {v for _, v, _ in want} == {"allow", "block"}
    assert rows(url_filter(pages.repartition(7, F.rand()), labels), "page_id", "verdict", "confidence") == want


def test_mined_rules_are_minimal(spark):
    df = spark.createDataFrame([(i, ["a", "b"], True) for i in range(20)] + [(i, ["c"], False) for i in range(20, 40)], "row long, tokens array<string>, bad boolean")
    rules, classes = mine_rules(df)
    assert [tuple(r["items"]) for r in rules.collect()] == [("a",)]
    assert {(r["token"], r["item"]) for r in classes.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    one = spark.createDataFrame([("http://a.b.com/x1/y?u=1&v=2#k",)], "u string")
    assert one.select(url_tokens(one["u"]).alias("t")).first()["t"] == ["host:a", "host:b", "host:com", "path:x#", "path:y", "query:u", "query:v"]
