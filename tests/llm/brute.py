"""Plain Python readings of what the training-data operators compute, and the edge cases that all of them meet."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("row", "key", "h", "n", "words", "lines", "text_hash", "kept", "fp", "node", "root", "ids", "keys", "segment", "host", "held_out", "carried")


def words(text):
    return (text or "").encode().split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def strip(line):
    return line.strip(" \t\n\x0b\x0c\r")


def frame(spark, rows, clash=False):
    """Rows of (doc_id, text) or (doc_id, text, source); ``clash`` adds columns with names that the operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(120_000))
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "one"),
    (5, "the same line of some length here\nshort\n\nthe same line of some length here"),
    (6, "The same LINE of some length here\nother words stand in this line of text\n"),
    (7, "\tthe same line of some length here \nother words stand in this line of text"),
    (8, "other words stand in this line of text\nthe same line of some length here"),
    (8, "other words stand in this line of text\nthe same line of some length here"),
    (9, "ÀÉÎ straße 😀 naïve\u00a0space \u2028 ∂ é́"),
    (10, LONG),
    (11, LONG[:5000] + "\n" + LONG[5000:9000]),
    (None, "the same line of some length here"),
    (12, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3),
    (13, "zz a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (14, "zz a b c d e f g h i j k l m n o p q r s t u v w x y z"),
]


def substring(docs, k=13):
    first = {}
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(b" ".join(kept).decode())))
    return out


def line_dedup(docs, least=20, most=3):
    held = defaultdict(set)
    key = lambda x: lower(strip(x))
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    rank = lambda i: (i is not None, i or 0)
    keeper = {k: max(v, key=rank) for k, v in held.items() if len(v) >= most}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    five = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    seen = Counter(five)
    covered = {p for j, g in enumerate(five) if seen[g] > 1 for p in range(j, j + 5)}
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def secret_base(text):
    text = text or ""
    out = []
    kinds = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
    for k, (name, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(out)]


def fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    grams = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or [b" ".join(w)]
    ones = Counter()
    for g, c in Counter(grams).items():
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += c * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def near(docs):
    fps = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(docs)]


def contained(docs, items, size=5, percent=80):
    out = []
    for i, t in docs:
        w = [x.lower() for x in words(t)]
        for item, text in items:
            v = [x.lower() for x in words(text)]
            if v:
                n = min(size, len(v))
                own = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
                have = own & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                if 100 * len(have) >= percent * len(own):
                    out.append((i, item, len(have), len(own)))
    return out


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def quality(docs):
    """(kept, the text without its host's furniture) of each (id, text, host)."""
    key = lambda x: lower(strip(x))
    held, hosts = defaultdict(set), defaultdict(set)
    for i, t, h in docs:
        hosts[h].add(i)
        for x in (t or "").split("\n"):
            if words(x):
                held[h, key(x)].add(i)
    above = {k for k, v in held.items() if len(v) > 10 and len(v) > 0.01 * len(hosts[k[0]])}
    out = []
    for i, t, h in docs:
        lines = (t or "").split("\n")
        gone = [x for x in lines if (h, key(x)) in above]
        n = len(words(t))
        left = n - sum(len(words(x)) for x in gone)
        kept = not quality_base(t)[5] and left >= 10 and left >= 0.3 * n
        out.append((i, kept, "\n".join(x for x in lines if (h, key(x)) not in above)))
    return out


def pipeline(docs, items, coder):
    """The five stages over (id, text, host) with ids that differ: id, number of tokens, ids, decoded text."""
    hosts = {i: h for i, _, h in docs}
    rows = [(i, t) for i, kept, t in quality(docs) if kept]
    rows = [(i, t) for i, _, _, t in line_dedup(rows)]
    classes = {i: c for i, _, c in near(rows)}
    rows = [(i, t) for i, t in rows if classes[i] == i]
    found = {x[0] for x in contained(rows, items)}
    rows = [(i, t) for i, t in rows if i not in found]
    assert all(i in hosts for i, _ in rows)
    return [(i, len(x := coder.library.encode(t)), x, coder.library.decode(x)) for i, t in rows]
