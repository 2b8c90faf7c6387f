"""Candidate pairs: capped equi-joins on keys and TF-IDF top-k joins, each partitioned by country."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.hashing import hash_unit
from ..sources.tables import stage_table

CORE, SORTED, SQUASH, NAME_SPACE, WORD_SPACE, ADDRESS_SPACE, NAME_NUMBER, NOFILL = (1 << k for k in range(8))
EXACT = CORE | SORTED | SQUASH
KEYED = EXACT | NAME_NUMBER | NOFILL
SIMS = ("sim_name_char", "sim_name_addr_word", "sim_addr_char")
#: Terms of a block of vectors: a side is cut in four where that leaves the least number, and no block holds over the most.
BLOCK_TERMS = 250_000, 2_000_000
#: Products of two weights that are held at once.
PRODUCTS = 1_000_000
L, R = "source1_entity_id", "entity_id"


def _pairs(df: DataFrame, bit: int, sim: str | None = None) -> DataFrame:
    sims = [(F.col("sim").cast("double") if s == sim else F.lit(None).cast("double")).alias(s) for s in SIMS]
    return df.select(L, R, F.lit(bit).alias("pass"), *sims)


def capped_join(s1: DataFrame, pool: DataFrame, keys: Sequence[str], max_group: int, bit: int) -> DataFrame:
    """Pairs that agree on ``keys`` (the first is the country), unless over ``max_group`` pool records do or a key is empty.

    The cap is a count joined to the pool side: a hot key is pre-aggregated, dropped by the small result, and never meets the
    other side.
    """
    some = None
    for k in keys[1:]:
        some = (F.col(k) != "") if some is None else some & (F.col(k) != "")
    own = pool.where(some).select(R, *keys)
    small = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_group).drop("_n")
    left = s1.where(some).select(F.col("entity_id").alias(L), *keys).join(small, list(keys))
    return _pairs(left.join(own, list(keys)).select(L, R).distinct(), bit)


def with_numbers(df: DataFrame, limit: int = 4) -> DataFrame:
    """One row per distinct one of the first ``limit`` address numbers."""
    return df.withColumn("num", F.explode(F.array_distinct(F.slice(T.numbers(F.col("addr_nums")), 1, limit))))


def exact_pass(s1: DataFrame, pool: DataFrame, key: str, max_group: int, bit: int = CORE) -> DataFrame:
    return capped_join(s1, pool, ("country", key), max_group, bit)


def name_number_pass(s1: DataFrame, pool: DataFrame, max_group: int) -> DataFrame:
    return capped_join(with_numbers(s1), with_numbers(pool), ("country", "name_core", "num"), max_group, NAME_NUMBER)


def nofill_pass(s1: DataFrame, pool: DataFrame, max_group: int) -> DataFrame:
    if "name_core_nofill" not in s1.columns or "name_core_nofill" not in pool.columns:
        raise ValueError("this pass needs the column name_core_nofill")
    keyed = lambda df: df.withColumn("nofill_key", T.sorted_words(F.col("name_core_nofill")))
    return capped_join(keyed(s1), keyed(pool), ("country", "nofill_key"), max_group, NOFILL)


def word_grams(c: Column) -> Column:
    """Words and pairs of neighbouring words."""
    w = T.words(c)
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))


def char_grams(c: Column, n: int = 3) -> Column:
    """Runs of ``n`` letters of each word with a space on both sides; a shorter word is one run."""
    def of(word):
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))

    return F.flatten(F.transform(T.words(c), of))


@dataclass(frozen=True)
class TopK:
    """A similarity space: the text, its terms, and which pairs stay."""

    column: str
    terms: str = "word"
    k: int = 10
    min_sim: float = 0.2
    min_df: int = 2
    max_df: float = 0.02
    max_df_rows: int | None = None
    max_addr_tokens: int | None = None
    bit: int = WORD_SPACE
    sim: str = "sim_name_addr_word"


def weighted_terms(s1: DataFrame, pool: DataFrame, spec: TopK) -> DataFrame:
    """``side, country, id, term, no, df, w``: unit-length TF-IDF rows (1 + ln tf, smooth idf) over terms that are neither too rare nor too common.

    A term is too common in over a share of the country's rows; only if ``max_df_rows`` is asked for, in over that many too.
    ``no`` is a term's number. Term counts are a table, as document frequencies and weights both read them; so are the numbers, to stay the same.
    """
    grams = word_grams if spec.terms == "word" else char_grams
    rows = s1.select(F.lit(1).alias("side"), "country", F.col("entity_id").alias("id"), spec.column)
    rows = rows.unionByName(pool.select(F.lit(2).alias("side"), "country", F.col("entity_id").alias("id"), spec.column))
    n = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    tf = rows.select("side", "country", "id", F.explode(grams(F.col(spec.column))).alias("term")).groupBy("side", "country", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = stage_table(tf, "terms")
    limit = F.greatest(spec.max_df * F.col("n"), F.lit(float(spec.min_df)))
    if spec.max_df_rows is not None:
        limit = F.least(limit, F.lit(float(spec.max_df_rows)))
    df = tf.groupBy("country", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "country")
    idf = df.where((F.col("df") >= spec.min_df) & (F.col("df") <= limit)).select("country", "term", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = stage_table(idf.withColumn("no", F.monotonically_increasing_id()), "idf")
    raw = tf.join(idf, ["country", "term"]).select("side", "country", "id", "term", "no", "df", ((1.0 + F.log(F.col("tf"))) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("side", "country", "id")))
    return raw.select("side", "country", "id", "term", "no", "df", (F.col("raw") / norm).alias("w"))


def posting_terms(terms: DataFrame, min_sim: float) -> DataFrame:
    """The rows of ``terms`` less each record's commonest terms whose weights together cannot reach ``min_sim``.

    Terms of a record are ordered from the commonest on. Where the rarest term that two records share is among those that
    leave one of them, all that they share is, and their similarity is at most the length of that part: no pair above
    ``min_sim`` is lost, and the longest posting lists shrink most.
    """
    order = W.partitionBy("side", "country", "id").orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)
    return terms.withColumn("_part", F.sum(F.col("w") * F.col("w")).over(order)).where(F.col("_part") > min_sim * min_sim - 1e-9).drop("_part")


def _vectors(block: pa.Table, side: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of one side in order, and of each of its terms the row, the number and the weight."""
    rows = block.filter(pa.array(block["side"].to_numpy() == side)).sort_by("id").combine_chunks()
    lengths = [pa.compute.list_value_length(rows["no"]).to_numpy(), np.zeros(0, np.int64)]
    flat = [rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("no", "w")]
    return rows["id"], np.repeat(np.arange(rows.num_rows), np.concatenate(lengths).astype(np.int64)), *flat


def best_of_block(block: pa.Table, k: int, min_sim: float) -> pa.Table:
    """``L, R, sim`` of the ``k`` most similar vectors of side 2 above ``min_sim``, of each vector of side 1.

    The products of all terms that a pair shares are brought together by sorting, some rows of side 1 at a time; a row that has
    over ``PRODUCTS`` of them is added up in an array of side 2 instead.
    """
    (left, row, term, w), (right, r_row, r_term, r_w) = (_vectors(block, side) for side in (1, 2))
    order = np.argsort(r_term, kind="stable")
    posted, r_w = r_row[order], r_w[order]
    terms, start = np.unique(r_term[order], return_index=True)
    count = np.diff(np.append(start, len(order)))
    at = np.searchsorted(terms, term)
    known = np.append(terms, -1)[at] == term
    row, w, at = row[known], w[known], at[known]
    start, count = start[at], count[at]
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))  # of each row's terms
    done = np.cumsum(count)
    found, a = [], 0
    while a < len(row):
        most = np.searchsorted(done, PRODUCTS + (done[a - 1] if a else 0), "right")
        b = ends[max(np.searchsorted(ends, most, "right") - 1, np.searchsorted(ends, a, "right"))]
        c = count[a:b]
        if c.sum() > PRODUCTS:  # one row
            sums = np.zeros(len(right))
            for i in range(a, b):
                span = slice(start[i], start[i] + count[i])
                sums[posted[span]] += w[i] * r_w[span]
            key, sums = row[a] * len(right) + np.arange(len(right)), sums
        else:
            place = np.arange(c.sum()) + np.repeat(start[a:b] - np.cumsum(c) + c, c)
            key = np.repeat(row[a:b], c) * len(right) + posted[place]
            order = np.argsort(key, kind="stable")
            key, parts = key[order], (np.repeat(w[a:b], c) * r_w[place])[order]
            first = np.flatnonzero(np.append(True, np.diff(key) != 0))
            key, sums = key[first], np.add.reduceat(parts, first)
        sim = np.minimum(1.0, np.floor(sums * 1e6 + 0.5) / 1e6)
        key, sim = key[sim > min_sim], sim[sim > min_sim]
        order = np.lexsort((key, -sim, key // len(right)))
        key, sim = key[order], sim[order]
        own = key // len(right)
        kept = np.arange(len(own)) - np.searchsorted(own, own) < k
        found.append((key[kept], sim[kept]))
        a = b
    key = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
    sim = np.concatenate([np.zeros(0), *(x for _, x in found)])
    take = lambda ids, of: ids.take(pa.array(of))
    return pa.table({L: take(left, key // max(len(right), 1)), R: take(right, key % max(len(right), 1)), "sim": sim})


def topk_join(s1: DataFrame, pool: DataFrame, spec: TopK) -> DataFrame:
    """The ``k`` most similar pool records of each entity above ``min_sim``.

    A country's vectors are dealt to blocks by hash on either side, and every block of entities meets every block of the pool in
    a task, which returns the best of that block only: vectors are shuffled, once per block of the other side, and proposed
    pairs never are. Blocks grow with the tables up to a bound.
    """
    if spec.max_addr_tokens is not None:
        pool = pool.where(F.col("addr_tokens") <= spec.max_addr_tokens)
    vectors = weighted_terms(s1, pool, spec).groupBy("side", "country", "id").agg(F.sort_array(F.collect_list(F.struct("no", "w"))).alias("v"))
    vectors = stage_table(vectors.select("side", "country", "id", F.col("v.no").alias("no"), F.col("v.w").alias("w")), "vectors")
    least, most = BLOCK_TERMS
    terms = lambda side: F.sum(F.when(F.col("side") == side, F.size("no")).otherwise(0))
    blocks = lambda n: F.ceil(n / F.least(F.greatest(n / 4, F.lit(least)), F.lit(most))).cast("int")
    cut = vectors.groupBy("country").agg(blocks(terms(1)).alias("nl"), blocks(terms(2)).alias("nr")).where("nl > 0 AND nr > 0")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = vectors.join(F.broadcast(cut), "country")
    rows = rows.where("side = 1").withColumns({"lb": dealt("nl"), "rb": every("nr")}).unionByName(rows.where("side = 2").withColumns({"rb": dealt("nr"), "lb": every("nl")}))
    k, min_sim = spec.k, spec.min_sim
    near = rows.drop("nl", "nr").groupBy("country", "lb", "rb").applyInArrow(lambda block: best_of_block(block, k, min_sim), f"{L} string, {R} string, sim double")
    best = W.partitionBy(L).orderBy(F.desc("sim"), R)
    kept = near.withColumn("_rk", F.row_number().over(best)).where(F.col("_rk") <= spec.k)
    return _pairs(kept, spec.bit, spec.sim)


def union_passes(parts: Sequence[DataFrame], max_per_s1: int, cap_order: str = "exact_first") -> DataFrame:
    """One row per pair: all pass bits, best similarities; at most ``max_per_s1`` pairs an entity.

    ``exact_first`` puts pairs of any keyed pass first, then the best similarity (none: 0); ``sim_first`` puts name-and-number
    pairs first, then the best similarity (none: -1).
    """
    if cap_order not in ("exact_first", "sim_first"):
        raise ValueError(f"unknown cap order {cap_order!r}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    pairs = rows.groupBy(L, R).agg(F.bit_or("pass").alias("pass"), *[F.max(s).alias(s) for s in SIMS])
    best = F.greatest(*SIMS)
    exact = cap_order == "exact_first"
    lead = F.col("pass").bitwiseAND(KEYED if exact else NAME_NUMBER) != 0
    order = W.partitionBy(L).orderBy(lead.desc(), F.coalesce(best, F.lit(0.0 if exact else -1.0)).desc(), F.col(R))
    return pairs.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= max_per_s1).drop("_rk")


@dataclass(frozen=True)
class BlockingConfig:
    max_group: int = 20
    max_per_s1: int = 60
    cap_order: str = "exact_first"
    name_number: bool = True
    nofill: bool = False
    spaces: tuple[TopK, ...] = (TopK("name_addr", k=25),)


def block(s1: DataFrame, pool: DataFrame, cfg: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Every pass, united and capped. Countries are a key of each join, never a loop."""
    parts = [exact_pass(s1, pool, key, cfg.max_group, bit) for key, bit in (("name_core", CORE), ("name_sorted", SORTED), ("name_squash", SQUASH))]
    if cfg.name_number:
        parts.append(name_number_pass(s1, pool, cfg.max_group))
    if cfg.nofill:
        parts.append(nofill_pass(s1, pool, cfg.max_group))
    parts += [topk_join(s1, pool, spec) for spec in cfg.spaces]
    return union_passes(parts, cfg.max_per_s1, cfg.cap_order)


def existing(pairs: DataFrame, other: DataFrame, name: str = "hit") -> DataFrame:
    """``pairs`` with a column that says whether ``other`` has the pair."""
    marks = other.select(L, R).distinct().withColumn(name, F.lit(True))
    return pairs.join(marks, [L, R], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return existing(pairs, truth, "label").withColumn("label", F.col("label").cast("int"))


def one_word_pairs(s1: DataFrame, pool: DataFrame, max_group: int = 20, share: float = 1.0, seed: int = 7373) -> DataFrame:
    """``side, word`` of pairs whose names differ by one word that one side has more.

    The longer name's words, less each word in turn, meet the shorter name's sorted words in an equi-join. On either side names
    must be unique among entities (of which a hash share may be drawn), and a pool name of over ``max_group`` records is left
    out where the pool is the shorter.
    """
    key = lambda df: df.where(F.col("name_sorted") != "").select("country", "entity_id", "name_sorted", F.split("name_sorted", " ").alias("toks"))
    less = lambda df: df.withColumn("word", F.explode("toks")).withColumn("key", T.spaced(F.array_remove("toks", F.col("word"))))
    names = key(s1)
    once = names.groupBy("country", "name_sorted").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    left, right = names.join(once, ["country", "name_sorted"]), key(pool)
    if share < 1:
        left = left.where(hash_unit(F.col("entity_id"), seed) < share)
    few = right.groupBy("country", "name_sorted").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_group).drop("n")
    a = left.select("country", F.col("name_sorted").alias("key"), F.col("entity_id").alias(L))
    pool_more = less(right).select("country", "key", "word", F.col("entity_id").alias(R)).join(a, ["country", "key"])
    b = right.join(few, ["country", "name_sorted"]).select("country", F.col("name_sorted").alias("key"), F.col("entity_id").alias(R))
    s1_more = less(left).select("country", "key", "word", F.col("entity_id").alias(L)).join(b, ["country", "key"])
    return pool_more.select(F.lit("pool").alias("side"), "word", L, R).unionByName(s1_more.select(F.lit("s1").alias("side"), "word", L, R))


def derive(pairs: DataFrame, word_k: int, max_per_s1: int, address_pass: bool = True, cap_order: str = "exact_first") -> DataFrame:
    """The candidates of a narrower configuration, from those of a wider one.

    Word-pass bits beyond the entity's ``word_k`` best leave, and the address pass if it is off; pairs left without a bit go,
    similarities of lost passes become null, and the cap is applied again.
    """
    word = F.col("pass").bitwiseAND(WORD_SPACE) != 0
    order = W.partitionBy(L).orderBy(F.when(word, F.col("sim_name_addr_word")).desc_nulls_last(), R)
    bits = F.when(word & (F.col("_rk") > word_k), F.col("pass").bitwiseAND(~WORD_SPACE)).otherwise(F.col("pass"))
    rows = pairs.withColumn("_rk", F.row_number().over(order)).withColumn("pass", bits if address_pass else bits.bitwiseAND(~ADDRESS_SPACE))
    for sim, bit in zip(SIMS, (NAME_SPACE, WORD_SPACE, ADDRESS_SPACE), strict=True):
        rows = rows.withColumn(sim, F.when(F.col("pass").bitwiseAND(bit) != 0, F.col(sim)))
    return union_passes([rows.where("pass <> 0").drop("_rk")], max_per_s1, cap_order)


def compose(base: DataFrame, other: DataFrame, s1: DataFrame, countries: Sequence[str]) -> DataFrame:
    """``base`` with the rows of some countries' entities taken from ``other``."""
    own = s1.where(F.col("country").isin(*countries)).select(F.col("entity_id").alias(L))
    return base.join(own, L, "left_anti").unionByName(other.join(own, L, "left_semi"))
