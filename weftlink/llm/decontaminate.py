"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise
from .ngrams import ngram_hashes, split_words, text_hashes

TABLE_BITS = 20


class SizeClass:
    """The items of one size class: an inverted index over their MinHash sketches, and the hits that each needs.

    The class holds items of over m / 2 to m distinct shingles of ``n`` words. A text with the wanted share of an item lacks at
    most ``missing`` of its shingles, a number that the class bounds by its own m; a sketch is one and a sixteenth of m more
    than that bound (the whole item, if it has fewer), so such a text holds at least the sketch's size less ``missing`` of it.
    The search loses no item, and larger classes ask for more hits before an item is compared.
    """

    def __init__(self, n: int, m: int, percent: int):
        self.n, self.percent = n, percent
        self.sketch = (100 - percent) * m // 100 + 1 + m // 16
        self.items: list[tuple[int, set, np.ndarray]] = []
        self.need: list[int] = []
        self.of: dict[int, list[int]] = defaultdict(list)

    def add(self, key: int, strings: set, hashes: np.ndarray) -> None:
        own = hashes[: self.sketch].tolist()
        for h in own:
            self.of[h].append(len(self.items))
        self.need.append(max(1, len(own) - (100 - self.percent) * len(strings) // 100))
        self.items.append((key, strings, hashes))

    def close(self) -> None:
        """Turns the index into sorted keys and their item lists, end to end."""
        self.keys = np.array(sorted(self.of), np.uint64)
        lists = [self.of[k] for k in self.keys.tolist()]
        self.ends = np.cumsum([0, *map(len, lists)])
        self.lists = np.fromiter((i for x in lists for i in x), np.int32, int(self.ends[-1]))
        self.coarse = np.zeros(1 << TABLE_BITS, bool)
        self.coarse[self.keys >> np.uint64(64 - TABLE_BITS)] = True
        self.need = np.array(self.need)
        del self.of

    def candidates(self, grams: np.ndarray) -> list[int]:
        """The items that have enough of their sketch among a text's shingle hashes."""
        some = np.unique(grams[self.coarse[grams >> np.uint64(64 - TABLE_BITS)]])
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == some]
        if not len(at):
            return []
        hits = np.bincount(np.concatenate([self.lists[self.ends[k] : self.ends[k + 1]] for k in at.tolist()]), minlength=len(self.items))
        return np.flatnonzero(hits >= self.need).tolist()


class Sketches:
    """One block of test items, partitioned by size: a class per shingle length and power of two."""

    def __init__(self, items: list[tuple[int, str]], size: int, percent: int):
        self.percent, self.classes = percent, {}
        for key, text in items:
            words = [w.lower() for w in split_words(text)]
            if not words:
                continue
            n = min(size, len(words))
            strings = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
            m = 1 << max(0, math.ceil(math.log2(len(strings))))
            own = self.classes.setdefault((n, m), SizeClass(n, m, percent))
            own.add(key, strings, np.unique(ngram_hashes(text_hashes(text, lower=True), n)))
        for own in self.classes.values():
            own.close()

    def find(self, text: str | None) -> list[tuple]:
        """(item, shared, size) of each item of which the text holds the wanted share, class by class."""
        hashed, found, words, grams = text_hashes(text, lower=True), [], None, {}
        for (n, _), own in self.classes.items():
            if n not in grams:
                grams[n] = ngram_hashes(hashed, n)
            for i in own.candidates(grams[n]):
                key, strings, hashes = own.items[i]
                words = words or [w.lower() for w in split_words(text)]
                places = np.flatnonzero(np.isin(grams[n], hashes)).tolist()
                shared = len(strings & {b" ".join(words[p : p + n]) for p in places})
                if 100 * shared >= self.percent * len(strings):
                    found.append((key, shared, len(strings)))
        return found


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles``: the pairs in which a document holds at least ``percent`` of an item's shingles.

    Shingles are ``size`` consecutive words (between ASCII white space, A-Z lower-cased), counted once each; an item of
    fewer words is one shingle of all its words, and an item without words is in no document. Null texts have no words.
    Repeated rows give repeated pairs; null ids are carried. Other columns are not read.

    Different item texts are sent to the tasks in blocks of about ``block_chars`` characters each, one pass over the documents
    per block; a block's pairs are a table in the shared folder before the next block is sent, so memory does not depend on the
    size of either table, nor on how many items are equal. Documents are not shuffled; pairs meet the item ids in a join.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    texts = materialise(items.select("text").distinct().select("text", F.monotonically_increasing_id().alias("key")), "item-texts")
    keys = materialise(items.join(texts, "text").select("item_id", "key"), "items")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item long, n_shared long, n_shingles long"
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / block_chars) or 1
    parts = []
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(Sketches([(r["key"], r["text"]) for r in own.collect()], size, percent))

        def search(batch, sent=sent):
            import pyarrow as pa

            rows = [(k, *x) for k, t in enumerate(batch["text"].to_pylist()) for x in sent.value.find(t)]
            if not rows:
                return None
            at, item, shared, size = zip(*rows, strict=True)
            return {"doc_id": batch["doc_id"].take(pa.array(at)), "item": item, "n_shared": shared, "n_shingles": size}

        parts.append(materialise(batches(docs, search, schema), "contained"))
        sent.destroy()
    found = reduce(DataFrame.unionByName, parts)
    return found.join(keys, found["item"] == keys["key"]).select("doc_id", "item_id", "n_shared", "n_shingles")
