"""Pair features: a registry of groups, each a step from pairs with both records' columns to more columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import similarity as S
from ..functions import text as T
from . import statistics as ST
from .blocking import EXACT, NAME_SPACE, WORD_SPACE
from .competition import rank_and_gap

L, R = "source1_entity_id", "entity_id"
#: Entities and pool records of a block of pairs, on average.
PAIR_BLOCK = 1000, 4000
#: Record columns that the groups read, on either side with the suffix _l or _r.
RECORD_COLUMNS = (
    "name_norm", "name_core", "name_first", "name_sorted", "name_squash", "legal_form", "addr_norm", "addr_nums", "postcode", "region",
    "addr_last", "addr_tokens", "non_latin", "addr_non_latin", "name_core_nofill", "freq_same", "freq_other", "freq_first_other",
)


def align(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs with the columns of both records, as ``x_l`` and ``x_r``, and the pair's country."""
    def side(df, key, suffix):
        own = [c for c in RECORD_COLUMNS if c in df.columns]
        extra = ["country"] if suffix == "l" else []
        return df.select(F.col("entity_id").alias(key), *extra, *[F.col(c).alias(f"{c}_{suffix}") for c in own])

    return pairs.join(side(s1, L, "l"), L).join(side(pool, R, "r"), R)


def check_aligned(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> None:
    """Raises if a pair names a record that neither side has."""
    lost = pairs.join(s1.select(F.col("entity_id").alias(L)), L, "left_anti").select(L).unionByName(pairs.join(pool.select(R), R, "left_anti").select(F.col(R).alias(L)))
    if found := lost.limit(3).collect():
        raise ValueError(f"pairs name unknown records: {[r[0] for r in found]}")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def tristate(c: Column, known: Column) -> Column:
    return F.when(known, c.cast("int"))


def ratio(a: Column, b: Column, known: Column | None = None) -> Column:
    out = F.when(b != 0, a / b)
    return out if known is None else F.when(known, out)


def sets(column: str) -> tuple[Column, Column]:
    return tuple(F.array_distinct(T.words(F.col(f"{column}_{s}"))) for s in "lr")


def some(column: str) -> Column:
    return (F.col(f"{column}_l") != "") & (F.col(f"{column}_r") != "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def equal(column: str) -> Column:
    return flag((F.col(f"{column}_l") == F.col(f"{column}_r")) & (F.col(f"{column}_l") != ""))


@dataclass
class Context:
    """What groups may read besides the pairs."""

    s1: DataFrame | None = None
    pool: DataFrame | None = None
    evidence: DataFrame | None = None


@dataclass(frozen=True)
class Group:
    columns: tuple[str, ...]
    add: Callable[[DataFrame, Context], DataFrame]
    needs: tuple[str, ...] = field(default=())


REGISTRY: dict[str, Group] = {}


def group(name: str, columns: str, needs: tuple[str, ...] = ()):
    def put(fn):
        REGISTRY[name] = Group(tuple(columns.split()), fn, needs)
        return fn

    return put


@group("blocking", "pass_exact pass_name_char pass_name_addr sim_name_char sim_name_addr_word sim_addr_char")
def blocking(df, ctx):
    bit = lambda b: flag(F.col("pass").bitwiseAND(b) != 0)
    return df.withColumns({"pass_exact": bit(EXACT), "pass_name_char": bit(NAME_SPACE), "pass_name_addr": bit(WORD_SPACE)})


@group("name_fuzzy", "nm_ratio nm_partial nm_token_sort nm_token_set nm_jw core_ratio core_token_set core_jw core_lev squash_ratio")
def name_fuzzy(df, ctx):
    n, c = ("name_norm_l", "name_norm_r"), ("name_core_l", "name_core_r")
    longest = F.greatest(*[F.length(x) for x in c])
    return df.withColumns(
        {
            "nm_ratio": S.indel_ratio(*n),
            "nm_partial": S.partial_ratio(*n),
            "nm_token_sort": S.token_sort_ratio(*n),
            "nm_token_set": S.token_set_ratio(*n),
            "nm_jw": S.jaro_winkler_ratio(*n),
            "core_ratio": S.indel_ratio(*c),
            "core_token_set": S.token_set_ratio(*c),
            "core_jw": S.jaro_winkler_ratio(*c),
            "core_lev": F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(*c) / longest),
            "squash_ratio": S.indel_ratio("name_squash_l", "name_squash_r"),
        }
    )


@group("name_tokens", "tok_jaccard tok_dice tok_common tok_len_l tok_len_r first_eq sorted_eq prefix4_eq")
def name_tokens(df, ctx):
    a, b = sets("name_core")
    both = F.size(F.array_intersect(a, b))
    start = [F.substring(f"name_squash_{s}", 1, 4) for s in "lr"]
    return df.withColumns(
        {
            "tok_jaccard": F.coalesce(jaccard(a, b), F.lit(0.0)),
            "tok_dice": F.coalesce(ratio(2 * both, F.size(a) + F.size(b)), F.lit(0.0)),
            "tok_common": both,
            "tok_len_l": F.size(a),
            "tok_len_r": F.size(b),
            "first_eq": equal("name_first"),
            "sorted_eq": equal("name_sorted"),
            "prefix4_eq": flag((start[0] == start[1]) & (start[0] != "")),
        }
    )


@group("legal", "legal_eq legal_missing_l legal_missing_r")
def legal(df, ctx):
    return df.withColumns({"legal_eq": equal("legal_form")} | {f"legal_missing_{s}": flag(F.col(f"legal_form_{s}") == "") for s in "lr"})


@group("numeric", "num_jaccard num_shared_any num_first_eq postcode_eq")
def numeric(df, ctx):
    a, b = sets("addr_nums")
    known = some("addr_nums")
    first = F.get(T.words(F.col("addr_nums_l")), 0) == F.get(T.words(F.col("addr_nums_r")), 0)
    return df.withColumns(
        {
            "num_jaccard": jaccard(a, b),
            "num_shared_any": tristate(F.arrays_overlap(a, b), known),
            "num_first_eq": tristate(first, known),
            "postcode_eq": tristate(F.col("postcode_l") == F.col("postcode_r"), some("postcode")),
        }
    )


@group("address", "ad_token_set ad_partial ad_ratio ad_jaccard ad_contain region_eq last_eq addr_empty_r")
def address(df, ctx):
    a, b = sets("addr_norm")
    pair, known = ("addr_norm_l", "addr_norm_r"), some("addr_norm")
    return df.withColumns(
        {
            "ad_token_set": F.when(known, S.token_set_ratio(*pair)),
            "ad_partial": F.when(known, S.partial_ratio(*pair)),
            "ad_ratio": F.when(known, S.indel_ratio(*pair)),
            "ad_jaccard": jaccard(a, b),
            "ad_contain": ratio(F.size(F.array_intersect(a, b)), F.size(a), known),
            "region_eq": tristate(F.col("region_l") == F.col("region_r"), some("region")),
            "last_eq": tristate(F.col("addr_last_l") == F.col("addr_last_r"), some("addr_last")),
            "addr_empty_r": flag(F.col("addr_norm_r") == ""),
        }
    )


def ranked(df: DataFrame, what: dict[str, str]) -> DataFrame:
    """``ctx_rank_x`` and ``ctx_gap_x`` of each named column among the entity's candidates."""
    out = {}
    for name, column in what.items():
        out[f"ctx_rank_{name}"], out[f"ctx_gap_{name}"] = rank_and_gap(column)
    return df.withColumns(out)


@group("context", "ctx_rank_name ctx_gap_name ctx_rank_addr ctx_gap_addr ctx_n_cands", ("address",))
def context(df, ctx):
    return ranked(df, {"name": "sim_name_char", "addr": "ad_token_set"}).withColumn("ctx_n_cands", F.count(F.lit(1)).over(W.partitionBy(L)))


@group("meta", "is_s3 non_latin_r len_ratio_name")
def meta(df, ctx):
    a, b = (F.length(f"name_core_{s}") for s in "lr")
    return df.withColumns(
        {
            "is_s3": flag(F.col(R).startswith("S3-")),
            "non_latin_r": flag(F.col("non_latin_r")),
            "len_ratio_name": F.coalesce(ratio(F.least(a, b), F.greatest(a, b)), F.lit(0.0)),
        }
    )


@group("pool_context", "ctx_pool_indegree")
def pool_context(df, ctx):
    return df.withColumn("ctx_pool_indegree", F.count(F.lit(1)).over(W.partitionBy(R)))


@group("frequency", "fq_s1_l fq_pool_l fq_first_pool_l fq_pool_r fq_s1_r core_eq")
def frequency(df, ctx):
    read = {"fq_s1_l": "freq_same_l", "fq_pool_l": "freq_other_l", "fq_first_pool_l": "freq_first_other_l", "fq_pool_r": "freq_same_r", "fq_s1_r": "freq_other_r"}
    return df.withColumns({k: F.col(v) for k, v in read.items()} | {"core_eq": equal("name_core")})


def idf_overlap(df: DataFrame, pool: DataFrame, column: str, prefix: str) -> DataFrame:
    """Cosine, top shared and shared shares of both sides under the smooth idf of the pair's country, per pair.

    Each pair's words join the idf table once and are summed per pair; the table is never a broadcast map.
    """
    a, b = sets(column)
    tagged = F.transform(F.array_union(a, b), lambda t: F.struct(t.alias("token"), F.array_contains(a, t).alias("in_l"), F.array_contains(b, t).alias("in_r")))
    n = ST.totals(pool)
    known = df.where(some(column)).select(L, R, "country", F.explode(tagged).alias("x")).select(L, R, "country", "x.*")
    idf = ST.smooth_idf(pool, column).select("country", "token", "idf")
    rows = known.join(idf, ["country", "token"], "left").join(n, "country", "left")
    top = F.log(1.0 + F.coalesce("n_docs", F.lit(0))) + 1.0
    rows = rows.select(L, R, "in_l", "in_r", top.alias("top"), F.coalesce("idf", top).alias("idf"))
    both = F.col("in_l") & F.col("in_r")
    total = lambda c, v=F.col("idf"): F.sum(F.when(c, v).otherwise(0.0))
    square = F.col("idf") * F.col("idf")
    clip = lambda c: F.least(F.lit(1.0), c)
    found = rows.groupBy(L, R).agg(
        clip(total(both, square) / F.sqrt(total(F.col("in_l"), square) * total(F.col("in_r"), square))).alias(f"{prefix}_cos"),
        clip(F.max(F.when(both, F.col("idf")).otherwise(0.0)) / F.max("top")).alias(f"{prefix}_top"),
        clip(total(both) / total(F.col("in_l"))).alias(f"{prefix}_cover_l"),
        clip(total(both) / total(F.col("in_r"))).alias(f"{prefix}_cover_r"),
    )
    return found


@group("idf", "idf_name_cos idf_name_top idf_name_cover_l idf_name_cover_r idf_addr_cos idf_addr_top idf_addr_cover_l idf_addr_cover_r")
def idf(df, ctx):
    found = [idf_overlap(df, ctx.pool, c, p) for c, p in (("name_core", "idf_name"), ("addr_norm", "idf_addr"))]
    return df.join(found[0], [L, R], "left").join(found[1], [L, R], "left")


@group("token_freq", "freq_name_l freq_name_r freq_addr_l freq_addr_r")
def token_freq(df, ctx):
    for column, short in (("name_core", "name"), ("addr_norm", "addr")):
        counts = ST.value_counts(ctx.pool, column)
        for s in "lr":
            own = f"{column}_{s}"
            df = df.join(counts.select("country", F.col("value").alias(own), F.col("n").alias("_n")), ["country", own], "left")
            df = df.withColumn(f"freq_{short}_{s}", F.when(F.col(own) != "", F.coalesce("_n", F.lit(0)))).drop("_n")
    return df


@group("ctx_idf", "ctx_rank_idf_name ctx_gap_idf_name ctx_rank_idf_addr ctx_gap_idf_addr ctx_n_same_name", ("idf",))
def ctx_idf(df, ctx):
    same = F.sum(flag((F.col("name_core_l") == F.col("name_core_r")) & (F.col("name_core_l") != ""))).over(W.partitionBy(L))
    return ranked(df, {"idf_name": "idf_name_cos", "idf_addr": "idf_addr_cos"}).withColumn("ctx_n_same_name", same)


@group("address_extra", "ad_contain_r addr_empty_l num_contain_l num_contain_r postcode_prefix_eq addr_len_ratio")
def address_extra(df, ctx):
    a, b = sets("addr_norm")
    x, y = sets("addr_nums")
    numbered = some("addr_nums")
    shared = F.size(F.array_intersect(x, y))
    n, m = (F.size(T.words(F.col(f"addr_norm_{s}"))) for s in "lr")
    start = [F.substring(f"postcode_{s}", 1, 3) for s in "lr"]
    return df.withColumns(
        {
            "ad_contain_r": ratio(F.size(F.array_intersect(a, b)), F.size(b), some("addr_norm")),
            "addr_empty_l": flag(F.col("addr_norm_l") == ""),
            "num_contain_l": ratio(shared, F.size(x), numbered),
            "num_contain_r": ratio(shared, F.size(y), numbered),
            "postcode_prefix_eq": tristate(start[0] == start[1], some("postcode")),
            "addr_len_ratio": ratio(F.least(n, m), F.greatest(n, m), some("addr_norm")),
        }
    )


@group("nofill", "nofill_ratio nofill_token_set nofill_jaccard nofill_eq fill_n_l fill_n_r")
def nofill(df, ctx):
    a, b = sets("name_core_nofill")
    pair = ("name_core_nofill_l", "name_core_nofill_r")
    lost = lambda s: F.size(T.words(F.col(f"name_core_{s}"))) - F.size(T.words(F.col(f"name_core_nofill_{s}")))
    return df.withColumns(
        {
            "nofill_ratio": S.indel_ratio(*pair),
            "nofill_token_set": S.token_set_ratio(*pair),
            "nofill_jaccard": F.coalesce(jaccard(a, b), F.lit(0.0)),
            "nofill_eq": flag((F.array_sort(a) == F.array_sort(b)) & (F.size(a) > 0)),
            "fill_n_l": lost("l"),
            "fill_n_r": lost("r"),
        }
    )


def valued_words(names: DataFrame, column: str, evidence: DataFrame, side: str) -> DataFrame:
    """``column, _words``: each distinct name's words in order, with the log-odds of a side or null."""
    names = names.where(F.col(column) != "").distinct()
    words = names.select(column, F.explode(F.array_distinct(T.words(F.col(column)))).alias("word"))
    valued = words.join(evidence.where(F.col("side") == side).select("word", "llr"), "word", "left")
    return valued.groupBy(column).agg(F.sort_array(F.collect_list(F.struct("word", "llr"))).alias("_words"))


def evidence_columns(side: str, words: str, other: Column, strong: float) -> dict[str, Column]:
    """The group's columns of one side, from its name's valued words and the words of the other name."""
    v = F.transform(F.filter(words, lambda x: ~F.array_contains(other, x["word"])), lambda x: x["llr"])
    some = F.filter(v, lambda x: x.isNotNull())
    count = lambda found: F.when(F.col(words).isNull(), 0).otherwise(F.size(F.filter(v, found))).cast("long")
    outs = {"sum": F.coalesce(F.aggregate(some, F.lit(0.0), lambda t, x: t + x), F.lit(0.0)), "min": F.array_min(v), "max": F.array_max(v)}
    outs |= {"decoy": count(lambda x: x <= -strong), "filler": count(lambda x: x >= strong), "unknown": count(lambda x: x.isNull())}
    return {f"te_{side}_{k}": c for k, c in outs.items()}


@group("tok_evidence", " ".join(f"te_{s}_{k}" for s in ("pool", "s1") for k in ("sum", "min", "max", "decoy", "filler", "unknown")))
def tok_evidence(df, ctx, strong: float = 1.0):
    """One-sided words valued by the learned log-odds of their side; words without a value are counted apart.

    Words get their values once per name, and names bring them to the pairs, so that no pair is exploded or grouped.
    """
    a, b = sets("name_core")
    for s, column, records, other in (("pool", "name_core_r", ctx.pool, a), ("s1", "name_core_l", ctx.s1, b)):
        names = df.select(column) if records is None else records.select(F.col("name_core").alias(column))
        df = df.join(valued_words(names, column, ctx.evidence, s), column, "left")
        df = df.withColumns(evidence_columns(s, "_words", other, strong)).drop("_words")
    return df


def evidence_of_blocks(s1: DataFrame, pool: DataFrame, keys: Sequence[str], evidence: DataFrame, strong: float = 1.0) -> DataFrame:
    """``tok_evidence`` of all pairs that agree on ``keys``, whole: the columns are found once per two names of a block.

    Either side's records of a key are dealt to blocks by hash, each block of entities meets each of the pool, and a block holds
    a name once, with its ids. What is shuffled grows with the records and the blocks; the pairs are spelt out last, in the task
    that met them. Blocks are small and their pairs many, so their number of tasks is set and not left to their bytes.
    """
    keys, n = list(keys), int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df, name, size: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cut = blocks(s1, "nl", PAIR_BLOCK[0]).join(blocks(pool, "nr", PAIR_BLOCK[1]), keys)
    dealt = lambda c: F.pmod(F.xxhash64("entity_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def side(df: DataFrame, s: str, name: str, lb: Column, rb: Column) -> DataFrame:
        column, ids = f"name_core_{s}", f"_ids_{s}"
        rows = df.select(*keys, "entity_id", F.col("name_core").alias(column)).join(cut, keys).withColumns({"_lb": lb, "_rb": rb})
        held = rows.groupBy(*keys, "_lb", "_rb", column).agg(F.collect_list("entity_id").alias(ids))
        words = valued_words(df.select(F.col("name_core").alias(column)), column, evidence, name).withColumnRenamed("_words", f"_words_{s}")
        return held.join(words, column, "left").repartition(n, *keys, "_lb", "_rb")

    met = side(s1, "l", "s1", dealt("nl"), every("nr")).join(side(pool, "r", "pool", every("nl"), dealt("nr")), [*keys, "_lb", "_rb"])
    a, b = sets("name_core")
    columns = evidence_columns("pool", "_words_r", a, strong) | evidence_columns("s1", "_words_l", b, strong)
    rows = met.select("_ids_l", "_ids_r", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumn(L, F.explode("_ids_l")).drop("_ids_l").withColumn(R, F.explode("_ids_r")).select(L, R, *columns)


def interaction_flags(name: Column, addr: Column, overlap: Column, high: float = 0.9, weak_addr: float = 0.2, weak_name: float = 0.5) -> dict[str, Column]:
    """Strong on one side and weak on the other, or strong on both; 0 where a value is undefined."""
    return {
        "name_strong_addr_weak": flag((name >= high) & (overlap < weak_addr)),
        "addr_strong_name_weak": flag((addr >= high) & (name < weak_name)),
        "both_strong": flag((name >= high) & (addr >= high)),
    }


@group("interactions", "name_strong_addr_weak addr_strong_name_weak both_strong", ("name_fuzzy", "address"))
def interactions(df, ctx):
    return df.withColumns(interaction_flags(F.col("core_token_set"), F.col("ad_token_set"), F.col("ad_jaccard")))


@group("missing_flags", "nums_empty_l nums_empty_r")
def missing_flags(df, ctx):
    return df.withColumns({f"nums_empty_{s}": flag(F.col(f"addr_nums_{s}") == "") for s in "lr"})


@group("phonetic", " ".join(f"{p}phonetic_{k}" for p in ("", "addr_") for k in ("exact_match", "jaccard", "token_overlap_ratio")))
def phonetic(df, ctx):
    """Soundex and Metaphone codes of the lettered words, pooled as sets and compared in order; null on rows of other scripts."""
    for column, prefix, script in (("name_core", "", "non_latin"), ("addr_norm", "addr_", "addr_non_latin")):
        for s in "lr":
            lettered = F.filter(T.words(F.col(f"{column}_{s}")), lambda t: t.rlike("^[a-z]"))
            df = df.withColumn(f"_sx_{s}", F.transform(lettered, lambda t: F.soundex(t))).withColumn(f"_mp_{s}", S.metaphone_codes(lettered))
        a, b = (F.array_distinct(F.concat(F.transform(f"_sx_{s}", lambda t: F.concat(F.lit("s"), t)), F.transform(f"_mp_{s}", lambda t: F.concat(F.lit("m"), t)))) for s in "lr")
        known = ~(F.col(f"{script}_l").cast("boolean") | F.col(f"{script}_r").cast("boolean")) & (F.size(a) > 0) & (F.size(b) > 0)
        both = F.size(F.array_intersect(a, b))
        df = df.withColumns(
            {
                f"{prefix}phonetic_exact_match": tristate((F.col("_sx_l") == F.col("_sx_r")) & (F.col("_mp_l") == F.col("_mp_r")), known),
                f"{prefix}phonetic_jaccard": F.when(known, jaccard(a, b)),
                f"{prefix}phonetic_token_overlap_ratio": F.when(known, both / F.size(a)),
            }
        ).drop("_sx_l", "_sx_r", "_mp_l", "_mp_r")
    return df


DEFAULT = ("blocking", "name_fuzzy", "name_tokens", "legal", "numeric", "address", "context", "meta")


def feature_names(groups: Sequence[str] = DEFAULT) -> list[str]:
    """Columns of some groups, in order; unknown and repeated groups raise."""
    if unknown := [g for g in groups if g not in REGISTRY]:
        raise ValueError(f"unknown feature groups {unknown}")
    if len(set(groups)) < len(groups):
        raise ValueError("a feature group is listed twice")
    return [c for g in groups for c in REGISTRY[g].columns]


def build_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, groups: Sequence[str] = DEFAULT, evidence: DataFrame | None = None) -> DataFrame:
    """``source1_entity_id, entity_id`` and the columns of ``groups`` in order; undefined values are null, never NaN.

    Every pair must name known records: pairs of others are left out, and ``check_aligned`` tells whether there are any.
    """
    names = feature_names(groups)
    if "tok_evidence" in groups and evidence is None:
        raise ValueError("the group tok_evidence needs an evidence table")
    ctx, df, done = Context(s1, pool, evidence), align(pairs, s1, pool), set()

    def add(name):
        nonlocal df
        if name not in done:
            for need in REGISTRY[name].needs:
                add(need)
            df = REGISTRY[name].add(df, ctx)
            done.add(name)

    for g in groups:
        add(g)
    return df.select(L, R, *names)
