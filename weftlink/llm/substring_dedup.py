"""Substring dedup: passages of many words that also stand in an earlier document, found by FM-indexes of shards."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise
from .fm_index import FMIndex
from .ngrams import ngram_hashes, split_words, text_hashes


def segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their least word n-gram hash: (first window, number of windows, that hash).

    A window's key depends on its words alone, so equal windows of any two texts have equal keys.
    """
    grams = ngram_hashes(hashes, gram)
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    span, least, have = window - gram + 1, grams, 1
    while have < span:
        step = min(have, span - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    return first, np.diff(np.concatenate([first, [n]])), least[first]


def _shared_keys(docs: DataFrame, window: int, gram: int, key_rows: int) -> DataFrame:
    """``doc_id, key`` of every key that two or more documents have, for each of its documents.

    A task sorts the keys of its texts, a bounded number at a time. A key in two of its documents is known to be shared: all of
    these are listed at once, and the key leaves the task as one entry. So the exchange carries at most one entry per key and
    block, however many documents hold a key. Entries travel packed, by range of the key.
    """
    spark = docs.sparkSession
    bytes_, = docs.agg(F.sum(F.octet_length("text"))).first()
    ranges = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((bytes_ or 0) / 30 / key_rows))

    def pack(it):
        import pyarrow as pa

        keys, ids, n = [], [], 0

        def flush():
            key, doc = np.concatenate(keys), np.concatenate(ids)
            keys.clear(), ids.clear()
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            shared = np.repeat(low < high, np.diff(np.concatenate([first, [len(key)]])))
            own, single = key[first], low == high
            bounds = np.searchsorted(own, [(r << 64) // ranges for r in range(1, ranges)])
            rows = [(-1, key[shared].tobytes(), doc[shared].tobytes(), b"")]
            for r, (k, d, s) in enumerate(zip(np.split(own, bounds), np.split(low, bounds), np.split(single, bounds), strict=True)):
                if len(k):
                    rows.append((r, k.tobytes(), d.tobytes(), s.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        names = ["range", "key", "doc", "single"]
        for batch in it:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = segments(text_hashes(text), window, gram)[2]
                if len(found):
                    found = np.unique(found)
                    keys.append(found)
                    ids.append(np.full(len(found), doc_id, np.int64))
                    n += len(found)
                if n >= 4 * key_rows:
                    yield flush()
                    n = 0
        if keys:
            yield flush()

    packed = materialise(docs.mapInArrow(pack, "range int, key binary, doc binary, single binary"), "keys")

    def read(table, name, kind):
        return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.empty(0, kind)])

    def meet(table):
        import pyarrow as pa

        key, doc, single = read(table, "key", np.uint64), read(table, "doc", np.int64), read(table, "single", bool)
        order = np.argsort(key, kind="stable")
        key, doc, single = key[order], doc[order], single[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        shared = (low < high) | ~np.logical_and.reduceat(single, first)
        answer = np.repeat(shared, np.diff(np.concatenate([first, [len(key)]]))) & single
        return pa.table({"doc_id": doc[answer], "key": key[answer].view(np.int64)})

    def unpack(batch):
        key, doc = read(batch, "key", np.int64), read(batch, "doc", np.int64)
        return {"doc_id": doc, "key": key}

    met = packed.where("range >= 0").groupBy("range").applyInArrow(meet, "doc_id long, key long")
    return met.unionByName(batches(packed.where("range < 0"), unpack, "doc_id long, key long"))


def earliest_windows(segments: list[str], keys: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the least id of a segment that has it, and how many windows each segment has.

    ``segments`` are different texts of one or more keys, in the order of key and id; windows of different keys differ. The
    segments of a key are halved by id again and again: each time an FM-index of the earlier halves is built once and the later
    halves are streamed through it, which gives matching statistics for every place of theirs; where a statistic reaches
    the window, the interval's least id counts. So each segment meets every earlier one of its key in just one index.
    """
    # A form feed stands alone behind each segment; no word holds one.
    words = " \f ".join([*segments, ""]).split(" ")[:-1]
    number: dict[str, int] = defaultdict(count(1).__next__, {"\f": 0})
    text = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    lengths = np.diff(np.concatenate([[-1], np.flatnonzero(text == 0)]))
    windows = lengths - window  # a segment of w words has w - window + 1 windows; lengths count the 0 too
    earliest, of = np.repeat(ids, windows), np.repeat(np.arange(len(ids)), windows)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    place, size = np.arange(len(keys)) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    row = np.repeat(np.arange(len(ids)), lengths)
    for level in range(int(sizes.max() - 1).bit_length()):
        half = place >> level
        asks = half & 1 == 1
        told = ~asks & ((half + 1 << level) < size)
        known = text[told[row]]
        symbols = np.unique(known)
        code = np.zeros(len(number), np.int64)  # words that the index lacks are 0, as are the ends
        code[symbols] = np.arange(len(symbols))
        index = FMIndex(code[known], len(symbols), np.repeat(ids[told], lengths[told]), window)
        some, starts = windows[asks], np.cumsum(lengths[asks]) - lengths[asks]
        ends = np.repeat(starts + window - 1 - (np.cumsum(some) - some), some) + np.arange(some.sum())
        run, low, high = index.matching_statistics(code[text[asks[row]]], ends)
        found = run >= window
        at = np.flatnonzero(asks[of])[found]
        earliest[at] = np.minimum(earliest[at], index.least(low[found], high[found]))
    return earliest, windows


def _search(it, window: int, shard_words: int):
    """Answers for the segments of one partition, which come in the order of key and id, shard by shard of whole keys."""
    import pyarrow as pa

    def shard(rows):
        key, segment, least, _ = zip(*rows, strict=True)
        earliest, windows = earliest_windows(segment, np.array(key, np.int64), np.array(least, np.int64), window)
        keep = [(r[0], r[1], e.tolist()) for r, e in zip(rows, np.split(earliest, np.cumsum(windows)[:-1]), strict=True) if e.min() < r[3]]
        if keep:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keep, strict=True), (pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], ["key", "segment", "earliest"])

    held, n = [], 0
    for batch in it:
        for row in zip(*(batch[c].to_pylist() for c in ("key", "segment", "least", "last")), strict=True):
            if n >= shard_words and row[0] != held[-1][0]:
                if (out := shard(held)) is not None:
                    yield out
                held, n = [], 0
            held.append(row)
            n += row[1].count(" ") + 2
    if held and (out := shard(held)) is not None:
        yield out


def repeated_windows(docs: DataFrame, window: int, gram: int, shard_words: int, key_rows: int, hot_docs: int) -> DataFrame:
    """``doc_id, text_hash, runs``: (first window, number of windows) of the windows that an earlier document has too.

    A window's least n-gram hash is its key. Texts are cut into segments of windows with one key; segments whose key one
    document alone has cannot repeat and go no further. Under a key of more than ``hot_docs`` documents each window is a
    segment with the hash of all its words as key, so that the variants of a hot passage spread. Equal segments are one; each
    partition takes its segments in shards of whole keys, and streams those of later documents through the compressed indexes of
    those of earlier ones (``earliest_windows``); windows that follow each other join to intervals of any length.
    """
    shared = materialise(_shared_keys(docs, window, gram, key_rows), "shared")
    hot = materialise(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_docs).select("key", F.lit(True).alias("hot")), "hot")
    marked = F.struct("key", F.coalesce("hot", F.lit(False)).alias("hot"))
    hits = materialise(shared.join(hot, "key", "left").groupBy("doc_id").agg(F.collect_set(marked).alias("keys")).select("doc_id", "keys.key", "keys.hot"), "hits")

    def cut(batch):
        out = {"doc_id": [], "text_hash": [], "start": [], "key": [], "segment": []}
        columns = [batch[c].to_pylist() for c in ("doc_id", "text_hash", "text")] + [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "hot")]
        for doc_id, text_hash, text, keys, hot in zip(*columns, strict=True):
            words, hashes = split_words(text), text_hashes(text)
            first, count, key = segments(hashes, window, gram)
            keys = keys.view(np.uint64)
            some = np.isin(key, keys)
            each = np.isin(key, keys[hot.astype(bool)])
            if each.any():
                single = np.concatenate([np.arange(a, a + c) for a, c in zip(first[each].tolist(), count[each].tolist(), strict=True)])
                some &= ~each
                first, count = np.concatenate([first[some], single]), np.concatenate([count[some], np.ones(len(single), np.int64)])
                key = np.concatenate([key[some], ngram_hashes(hashes, window)[single]])
            else:
                first, count, key = first[some], count[some], key[some]
            out["doc_id"] += [doc_id] * len(first)
            out["text_hash"] += [text_hash] * len(first)
            out["start"] += first.tolist()
            out["key"] += key.view(np.int64).tolist()
            out["segment"] += [b" ".join(words[a : a + c + window - 1]).decode() for a, c in zip(first.tolist(), count.tolist(), strict=True)]
        return out if out["doc_id"] else None

    cuts = batches(docs.join(hits, "doc_id"), cut, "doc_id long, text_hash long, start int, key long, segment string")
    cuts = materialise(cuts.withColumn("of", F.xxhash64("segment")), "segments")
    distinct = cuts.groupBy("key", "segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    found = distinct.repartition("key").sortWithinPartitions("key", "least").mapInArrow(lambda it: _search(it, window, shard_words), "key long, segment string, earliest array<long>")
    found = materialise(found.select(F.col("key").alias("f_key"), F.xxhash64("segment").alias("f_of"), "earliest"), "answers")
    each = cuts.select("doc_id", "text_hash", "start", "key", "of").join(found, (F.col("key") == F.col("f_key")) & (F.col("of") == F.col("f_of")))
    single = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("earliest") - 1), lambda k: F.get("earliest", k) < F.col("doc_id")),
        lambda k: F.struct((F.col("start") + k).alias("first"), F.lit(1).alias("count")),
    )
    runs = F.when(F.array_max("earliest") < F.col("doc_id"), F.array(F.struct(F.col("start").alias("first"), F.size("earliest").alias("count")))).otherwise(single)
    return each.select("doc_id", "text_hash", runs.alias("runs")).where(F.size("runs") > 0).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, shard_words: int = 100_000, key_rows: int = 1_000_000, hot_docs: int = 2_000
) -> DataFrame:
    """``doc_id, n_words, n_removed, text``, one row per input row: the words that stay, joined by a space.

    Words stand between ASCII white space and are compared as they are. A word goes if it lies in a run of ``window`` words
    that also starts in a document with a smaller id; runs are judged on the input. Ids are whole numbers.

    Null and empty texts have no words. Texts of null ids are kept whole and are never the earlier one. Rows that share an id
    are one document, judged each: a run within one id is no repeat. An empty table gives an empty result. Other columns are
    not read.

    Texts cross an exchange twice, to be cut and to be rebuilt; keys cross packed. Memory follows ``key_rows`` and
    ``shard_words``, or the different segments of one key where these are more.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    known = docs.where("doc_id IS NOT NULL")
    runs = repeated_windows(known, window, gram, shard_words, key_rows, hot_docs)

    def rebuild(batch):
        out = {"doc_id": batch["doc_id"], "n_words": [], "n_removed": [], "text": []}
        for text, found in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
            words = split_words(text)
            n = len(words)
            if found:
                edge = np.zeros(n + 1, np.int64)
                for r in found:
                    if r["first"] + window <= n:
                        edge[r["first"]] += 1
                        edge[min(n, r["first"] + r["count"] + window - 1)] -= 1
                stay = np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()
                words = [words[i] for i in stay]
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["text"].append(b" ".join(words).decode())
        return out

    return batches(docs.join(runs, ["doc_id", "text_hash"], "left"), rebuild, "doc_id long, n_words long, n_removed long, text string")
