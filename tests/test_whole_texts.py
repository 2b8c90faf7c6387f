"""The normalising queries over texts far longer than a name, against plain Python."""

import re
import unicodedata

import pytest

from weftlink.functions.scripts import transliterate_text
from weftlink.functions.text import LIGATURES, latin_accents
from weftlink.plans.queries import QUERIES

PAD = "plain words before the rest of it, " * 6
TEXTS = [PAD + "Café Ærø & Sons 12th Straße", PAD + "O'Reilly मुंबई Ωmega 7b 0042 560001 end", PAD + "Ünïted  b4 tail 98765", "short one"]
DOCS = list(enumerate(TEXTS))


def folded(text):
    """As the query folds: accents, ligatures, other scripts, lower case."""
    text = text.replace("°", " ").replace("º", " ").translate(str.maketrans(*latin_accents()))
    text = "".join(c for c in text if not "̀" <= c <= "ͯ")
    for k, v in LIGATURES.items():
        text = text.replace(k, v)
    return text


def norm(text):
    text = re.sub("['`]", "", folded(text).lower()).replace("&", " and ")
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9+]+", " ", text)).strip(" ")


def parts(text, i):
    x = f"00{i}th b{i * 7919} {norm(text)}"
    for pattern, new in ((r"\b(\d+)(?:st|nd|rd|th)\b", r"\1"), (r"(\d)([a-z])", r"\1 \2"), (r"([a-z])(\d)", r"\1 \2"), (r"\b0+(\d)", r"\1")):
        x = re.sub(pattern, new, x)
    w = x.split()
    six, five = re.search(r"\b(\d{6})\b", x), re.search(r"\b(\d{5})$", x)
    return " ".join(w), " ".join(t for t in w if t.isdigit()), (six or five)[1] if six or five else "", " ".join([t for t in w if not t.isdigit()][-2:]), len(w)


WANT = {
    "norm_names": lambda i, t: (norm(t),),
    "transliterate": lambda i, t: (transliterate_text(folded(t)).lower(),),
    "name_keys": lambda i, t: (" ".join(sorted(set(norm(t).split()))), norm(t).split()[0], norm(t).replace(" ", "").replace("+", "")),
    "addr_parts": lambda i, t: parts(t, i),
}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en", "src", len(t)) for i, t in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", list(WANT))
def test_whole_text(spark, folder, name):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES[name](spark, folder).collect()}
    assert got == {i: WANT[name](i, t) for i, t in DOCS}


def test_words_late_in_a_text_reach_the_normalisers(spark, folder):
    addr = {r["doc_id"]: r for r in QUERIES["norm_addresses"](spark, folder).collect()}
    assert addr[1]["postcode"] == "560001" and addr[1]["addr_non_latin"] and "42" in addr[1]["addr_nums"].split()
    recs = {r["entity_id"]: r for r in QUERIES["normalise_records"](spark, folder).collect()}
    assert recs["1"]["non_latin"] and recs["1"]["postcode"] == "560001" and recs["2"]["postcode"] == "98765"
    assert all(w in recs["0"]["name_norm"].split() and w in recs["0"]["addr_norm"].split() for w in ("cafe", "aero"))
    assert unicodedata.normalize("NFKD", recs["2"]["name_norm"]).isascii() and "united" in recs["2"]["name_norm"].split()
