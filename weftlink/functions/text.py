"""Text expressions of the normaliser: Column in, Column out."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import vocab
from .scripts import transliterate_text

#: Letters of scripts from Greek to Indic and CJK.
NON_LATIN = r"[\x{0370}-\x{1DBF}\x{2C00}-\x{2DFF}\x{3000}-\x{D7FF}]"


def literal_map(words: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else F.create_map().cast("map<string,string>")


def missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@cache
def latin_accents() -> tuple[str, str]:
    """Accented Latin letters that decompose to one ASCII letter, and these letters."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in range(0xC0, 0x250) if unicodedata.decomposition(chr(k))]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Letters that become two.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "ł": "l", "Ł": "L", "þ": "th", "ð": "d"}


def unaccent(c: Column) -> Column:
    c = F.regexp_replace(F.translate(c, *latin_accents()), r"[\x{0300}-\x{036F}]", "")
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


@pandas_udf(StringType())
def transliterate(s: pd.Series) -> pd.Series:
    """ASCII readings; only texts in other scripts are touched."""
    return s.map(transliterate_text)


def non_latin(c: Column) -> Column:
    return c.rlike(NON_LATIN)


def fold(c: Column, number_marker: bool = False, scripts: bool = False) -> Column:
    """Lower-case ASCII reading. ``scripts`` adds the Arrow pass for non-Latin scripts; without it the plan stays native."""
    c = missing(c)
    if number_marker:
        c = F.regexp_replace(c, r"(?i)\bn\s*[°º]", " ")
    c = unaccent(F.regexp_replace(c, "[°º]", " "))
    return F.lower(transliterate(c)) if scripts else F.lower(c)


def punctuation(c: Column) -> Column:
    c = F.replace(F.regexp_replace(c, r"['`]", ""), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(c, r"[^a-z0-9+]+", " "))


def basic_norm(c: Column, scripts: bool = False) -> Column:
    return punctuation(fold(c, scripts=scripts))


def join_initials(c: Column) -> Column:
    """Runs of single letters become one word."""
    return F.regexp_replace(c, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def words(c: Column) -> Column:
    return F.filter(F.split(missing(c), " "), lambda t: t != "")


def spaced(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def map_tokens(c: Column, mapping: Mapping[str, str] | Column) -> Column:
    """Each word through a table; words that become empty vanish, and a word may become several."""
    m = mapping if isinstance(mapping, Column) else literal_map(mapping)
    return spaced(F.filter(F.transform(words(c), lambda t: F.coalesce(F.try_element_at(m, t), t)), lambda t: t != ""))


def leet(t: Column) -> Column:
    """Digits read as letters in a word that is neither all letters nor all digits."""
    return F.when(~t.rlike("^[a-z]+$") & ~t.rlike("^[0-9]+$"), F.translate(t, *vocab.LEET)).otherwise(t)


def sorted_words(c: Column) -> Column:
    return spaced(F.array_sort(F.array_distinct(words(c))))


def first_word(c: Column) -> Column:
    return missing(F.get(words(c), 0))


def squash(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def numbers(c: Column) -> Column:
    return F.filter(words(c), lambda t: t.rlike("^[0-9]+$"))
