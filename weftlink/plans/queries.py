"""Registered queries over the driver's tables, each with its equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import vocab
from ..functions.hashing import fold_of, hash_unit
from ..operators import blocking as B
from ..operators import competition as C
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import learn as LN
from ..operators import match as M
from ..operators import normalise as N
from ..operators import split as SP
from ..operators import statistics as ST
from ..sources import tables as IO
from . import sql as Q
from .records import SPACE, L, R, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P = "s AS source1_entity_id, e AS entity_id"


def query(oracle: str | None = None, **extra: str):
    """Registers a query of a World; ``oracle`` is SQL over the shared steps of ``plans.sql``."""

    def put(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(World(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[fn.__name__] = Q.sql(oracle, **extra)
        return fn

    return put


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def q6(*exprs: str) -> str:
    return ", ".join(f"round(({e.rsplit(' AS ', 1)[0]})::DOUBLE, 6) AS {e.rsplit(' AS ', 1)[-1]}" for e in exprs)


# ---- the whole path -------------------------------------------------------------------------------------------------


@query(f"SELECT s AS source1_entity_id, tp::BIGINT AS tp, n_pred::BIGINT AS n_pred, n_true::BIGINT AS n_true, {q6(Q.f05() + ' AS f05')} FROM ec")
def er_end_to_end_heuristic(w: World) -> DataFrame:
    """Block, score, decide one-to-one, and F0.5 of every entity."""
    rows = E.with_scores(E.entity_counts(D.decide(w.scored), w.ids, w.truth))
    return rows.select(L, "tp", "n_pred", "n_true", *r6("f05"))


# ---- normalisation --------------------------------------------------------------------------------------------------

_RAW = """SELECT doc_id, lang, "text" AS t FROM documents"""
_FROM, _TO = T.latin_accents()
_FOLD = f"translate({{}}, '{_FROM}', '{_TO}')"
for _k, _v in T.LIGATURES.items():
    _FOLD = f"replace({_FOLD}, '{_k}', '{_v}')"
_PUNCT = r"trim(regexp_replace(replace(regexp_replace({}, '[''`]', '', 'g'), '&', ' and '), '[^a-z0-9+]+', ' ', 'g'))"
_NORM = _PUNCT.format("lower(" + _FOLD.format("t") + ")")


def _raw(w: World) -> DataFrame:
    return w.spark.read.parquet(f"{w.sf_dir}/documents.parquet").select("doc_id", "lang", F.col("text").alias("t"))


@query(f"SELECT doc_id, {_NORM} AS norm FROM rawtext", rawtext=_RAW)
def norm_names(w: World) -> DataFrame:
    return _raw(w).select("doc_id", T.basic_norm(F.col("t")).alias("norm"))


@query(f"SELECT doc_id, lower({_FOLD.format('t')}) AS folded FROM rawtext", rawtext=_RAW)
def transliterate(w: World) -> DataFrame:
    return _raw(w).select("doc_id", T.fold(F.col("t"), scripts=True).alias("folded"))


_TOKENS = {"street": "st", "the": "le", "of": "", "and": "et al", "blue": "azure"}
_CASE = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOKENS.items()) + " ELSE t END"


@query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda t: {_CASE}), lambda x: x <> ''), ' ') AS mapped FROM part")
def map_tokens(w: World) -> DataFrame:
    part = w.spark.read.parquet(f"{w.sf_dir}/part.parquet")
    return part.select("p_partkey", T.map_tokens(F.col("p_name"), _TOKENS).alias("mapped"))


@query(
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct({Q.words("n")})), ' ') AS name_sorted, coalesce({Q.words("n")}[1], '') AS name_first,
  regexp_replace(n, '[^a-z0-9]', '', 'g') AS name_squash FROM (SELECT doc_id, {_NORM} AS n FROM rawtext)""",
    rawtext=_RAW,
)
def name_keys(w: World) -> DataFrame:
    n = F.col("n")
    rows = _raw(w).select("doc_id", T.basic_norm(F.col("t")).alias("n"))
    return rows.select("doc_id", T.sorted_words(n).alias("name_sorted"), T.first_word(n).alias("name_first"), T.squash(n).alias("name_squash"))


_SPLIT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\b(\d+)(?:st|nd|rd|th)\b', '\1', 'g'),
  '(\d)([a-z])', '\1 \2', 'g'), '([a-z])(\d)', '\1 \2', 'g'), '\b0+(\d)', '\1', 'g'), '\s+', ' ', 'g'))"""
_WORDS_ONLY = "list_filter(string_split(x, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$'))"


@query(
    rf"""SELECT doc_id, x AS addr_norm, array_to_string({Q.nums("x")}, ' ') AS addr_nums,
  CASE WHEN regexp_extract(x, '\b(\d{{6}})\b', 1) <> '' THEN regexp_extract(x, '\b(\d{{6}})\b', 1) ELSE regexp_extract(x, '\b(\d{{5}})$', 1) END AS postcode,
  array_to_string({_WORDS_ONLY}[greatest(len({_WORDS_ONLY}) - 1, 1):len({_WORDS_ONLY})], ' ') AS addr_last, len({Q.words("x")}) AS addr_tokens
  FROM (SELECT doc_id, {_SPLIT} AS x FROM (SELECT doc_id, '00' || doc_id || 'th b' || (doc_id * 7919) || ' ' || {_NORM} AS a FROM rawtext))""",
    rawtext=_RAW,
)
def addr_parts(w: World) -> DataFrame:
    k = F.col("doc_id").cast("string")
    a = F.concat(F.lit("00"), k, F.lit("th b"), (F.col("doc_id") * 7919).cast("string"), F.lit(" "), T.basic_norm(F.col("t")))
    rows = _raw(w).select("doc_id", N.split_tokens(a).alias("x"))
    return rows.select("doc_id", *[v.alias(k) for k, v in N.address_parts(F.col("x")).items()])


@query()
def norm_addresses(w: World) -> DataFrame:
    """The whole address normaliser with regions and street words."""
    rows = _raw(w).select("doc_id", F.concat_ws(", ", "t", F.lit("Springfield"), F.when(F.col("doc_id") % 2 == 0, "New York 14610").otherwise("Tamil Nadu")).alias("business_address"))
    return N.normalise_addresses(rows).drop("business_address")


_NAMES = sorted(vocab.REGION)
_lit = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_table = lambda words: f"MAP({_lit(words)}, {_lit(words.values())})"
_BARE = rf"trim(regexp_replace(regexp_replace({_PUNCT.format('c')}, '\b\d+\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""SELECT doc_id, coalesce(list_filter(list_transform(list_transform(string_split(a, ','), lambda c: {_BARE}), lambda c: (m[c])), lambda c: c IS NOT NULL)[1], '') AS code
  FROM (SELECT doc_id, lower({_FOLD.format("t")}) || ', ' || {_lit(_NAMES)}[doc_id % {len(_NAMES)} + 1] || ' 14610' AS a, {_table(vocab.REGION)} AS m FROM rawtext)""",
    rawtext=_RAW,
)
def region_lookup(w: World) -> DataFrame:
    """The first component that names a region, of each text and one region's name in turn."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int"))
    rows = _raw(w).select("doc_id", N.region_components(F.concat(T.fold(F.col("t")), F.lit(", "), name, F.lit(" 14610")), vocab.REGION).alias("c"))
    return rows.select("doc_id", T.missing(F.get(F.filter("c", lambda x: x["code"].isNotNull()), 0)["code"]).alias("code"))


_FORMS = sorted(vocab.LEGAL)
_LEET = "CASE WHEN regexp_matches(x, '^[a-z]+$') OR regexp_matches(x, '^[0-9]+$') THEN x ELSE translate(x, '0134578', 'oleastb') END"


@query(
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(ws, lambda x: m[x] IS NULL AND m[{_LEET}] IS NULL), lambda x: {_LEET}), ' ') AS core,
  array_to_string(list_filter(list_transform(ws, lambda x: coalesce(m[x], m[{_LEET}])), lambda x: x IS NOT NULL), ' ') AS form
  FROM (SELECT doc_id, list_append({Q.words("n")}, {_lit(_FORMS)}[doc_id % {len(_FORMS)} + 1]) AS ws, {_table(vocab.LEGAL)} AS m FROM (SELECT doc_id, {_NORM} AS n FROM rawtext))""",
    rawtext=_RAW,
)
def legal_forms(w: World) -> DataFrame:
    """Each text with one legal form behind it, parted into other words and legal forms."""
    last = F.get(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % len(_FORMS)).cast("int"))
    rows = _raw(w).select("doc_id", F.concat_ws(" ", T.basic_norm(F.col("t")), last).alias("n"))
    core, form = N.legal_split(F.col("n"))
    return rows.select("doc_id", core.alias("core"), form.alias("form"))


@query(
    f"""SELECT entity_id, array_to_string(list_filter({Q.words("name_core")}, lambda t: t <> name_first), ' ') AS core FROM rec WHERE regexp_matches(name_first, '^[a-z]{{4,}}$')
  UNION ALL SELECT entity_id, name_core FROM rec WHERE NOT regexp_matches(name_first, '^[a-z]{{4,}}$')"""
)
def drop_own_country(w: World) -> DataFrame:
    return w.records.select("entity_id", N.drop_own_country(F.col("name_core"), F.col("name_first")).alias("core"))


@query(
    r"""SELECT entity_id, trim(regexp_replace(trim(regexp_replace(n, '^(?:(?:mr|mrs|ms|dr|smt|shri|sri|messrs|the)\s+)+', '')), '^(?:and )+|(?: and)+$|^and$', '', 'g')) AS core
  FROM (SELECT entity_id, CASE length(name_core) % 3 WHEN 0 THEN 'mr the ' || name_core WHEN 1 THEN 'and ' || name_core || ' and and' ELSE name_core END AS n FROM rec)"""
)
def honorifics(w: World) -> DataFrame:
    n = F.col("name_core")
    kind = F.length(n) % 3
    built = F.when(kind == 0, F.concat(F.lit("mr the "), n)).when(kind == 1, F.concat(F.lit("and "), n, F.lit(" and and"))).otherwise(n)
    return w.records.select("entity_id", N.strip_honorifics(built).alias("core"))


@query("""SELECT entity_id, array_to_string(list_transform(string_split(x, ' '), lambda t: CASE WHEN regexp_matches(t, '^[a-z]+$') OR regexp_matches(t, '^[0-9]+$') THEN t
  ELSE translate(t, '0134578', 'oleastb') END), ' ') AS folded FROM (SELECT entity_id, replace(name_addr, 'o', '0') AS x FROM rec)""")
def leet(w: World) -> DataFrame:
    return w.records.select("entity_id", T.spaced(F.transform(F.split(F.replace("name_addr", F.lit("o"), F.lit("0")), " "), T.leet)).alias("folded"))


@query(f"""SELECT entity_id, CASE WHEN len({Q.words("name_core_nofill")}) = 0 THEN name_core ELSE name_core_nofill END AS kept FROM rec""")
def strip_fillers(w: World) -> DataFrame:
    fillers = F.array(*[F.lit(t) for t in ("the", "of", "de", "la", "and")])
    return w.records.select("entity_id", N.strip_fillers(F.col("name_core"), fillers).alias("kept"))


@query()
def normalise_records(w: World) -> DataFrame:
    """The whole normaliser, Arrow pass for other scripts included; each text is both name and address, whole."""
    docs = w.spark.read.parquet(f"{w.sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("string").alias("entity_id"), F.col("text").alias("business_name"), F.col("text").alias("business_address"), F.col("lang").alias("country"))
    return N.normalise_records(rows)


# ---- lists and sources ----------------------------------------------------------------------------------------------


@query(f"SELECT {P} FROM truth")
def truth_explode(w: World) -> DataFrame:
    lists = IO.id_lists(w.truth, w.ids).select(L, F.concat(F.array_join("ids", ", "), F.lit(",")).alias("matched_entity_ids"))
    return IO.truth_pairs(lists)


@query("SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS ids FROM s1 LEFT JOIN cand ON s1.entity_id = cand.s GROUP BY ALL")
def id_lists_roundtrip(w: World) -> DataFrame:
    return IO.id_lists(w.pairs, w.ids).select(L, F.array_join("ids", ",").alias("ids"))


_SIDES = {"matches": "bm", "candidates": "bc"}
_CHECKS = {
    "repeated entity": "SELECT s FROM {t} GROUP BY s HAVING count(*) > 1",
    "missing entity": "SELECT entity_id FROM s1 WHERE entity_id NOT IN (SELECT s FROM {t})",
    "unknown entity": "SELECT DISTINCT s FROM {t} WHERE s NOT IN (SELECT entity_id FROM s1)",
    "repeated id": "SELECT s FROM {t} WHERE len(list_distinct(ids)) < len(ids)",
    "foreign id": "SELECT x FROM (SELECT unnest(ids) AS x FROM {t}) WHERE NOT regexp_matches(x, '^S[23]-')",
    "unknown id": "SELECT x FROM (SELECT unnest(ids) AS x FROM {t}) WHERE x NOT IN (SELECT entity_id FROM pool)",
}
_BROKEN = """SELECT s, CASE k % 5 WHEN 2 THEN list_concat(ids, ids) WHEN 3 THEN list_append(ids, 'X-' || k) WHEN 4 THEN list_append(ids, 'S2-none' || k) ELSE ids END AS ids, k FROM
  (SELECT s1.entity_id AS s, list_filter(list(e ORDER BY e), lambda x: x IS NOT NULL) AS ids, substr(s1.entity_id, 4)::BIGINT // 3 AS k FROM s1 LEFT JOIN {t} t ON s1.entity_id = t.s GROUP BY ALL) WHERE k % 5 <> 0"""
_SPOILT = "SELECT s, ids FROM {t}0 UNION ALL SELECT s, ids FROM {t}0 WHERE k % 5 = 1 UNION ALL SELECT 'S1-none' || k, ids FROM {t}0 WHERE k % 10 = 3"


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{side}: {rule}' AS rule, (SELECT count(*) FROM ({c.format(t=t)})) AS problems" for side, t in _SIDES.items() for rule, c in _CHECKS.items())
    + " UNION ALL SELECT 'match outside candidates', (SELECT count(*) FROM bm JOIN bc USING (s) WHERE len(list_filter(bm.ids, lambda x: NOT list_contains(bc.ids, x))) > 0))",
    bm0=_BROKEN.format(t="truth"),
    bc0=_BROKEN.format(t="cand"),
    bm=_SPOILT.format(t="bm"),
    bc=_SPOILT.format(t="bc"),
)
def submission_check(w: World) -> DataFrame:
    """The checks over lists of which some are lost, repeated, doubled within, or hold foreign and unknown ids."""

    def spoilt(pairs):
        k = F.floor(F.substring(L, 4, 20).cast("long") / 3)
        lists = IO.id_lists(pairs, w.ids).withColumn("k", k).where("k % 5 <> 0")
        more = lambda prefix: F.array_append("ids", F.concat(F.lit(prefix), F.col("k").cast("string")))
        of = F.col("k") % 5
        lists = lists.withColumn("ids", F.when(of == 2, F.concat("ids", "ids")).when(of == 3, more("X-")).when(of == 4, more("S2-none")).otherwise(F.col("ids")))
        strange = lists.where("k % 10 = 3").select(F.concat(F.lit("S1-none"), F.col("k").cast("string")).alias(L), "ids")
        return lists.select(L, "ids").unionByName(lists.where("k % 5 = 1").select(L, "ids")).unionByName(strange)

    return IO.validate(spoilt(w.truth), spoilt(w.pairs), w.ids, w.pool)


# ---- blocking -------------------------------------------------------------------------------------------------------


def _bits(df: DataFrame) -> DataFrame:
    return df.select(L, R, F.col("pass").alias("bit"))


def _exact(name: str):
    return f"SELECT {P}, bit FROM {name}"


@query(_exact("core"))
def exact_core(w: World) -> DataFrame:
    return _bits(B.exact_pass(w.s1, w.pool, "name_core", Q.MAX_GROUP, B.CORE))


@query(_exact("sorted"))
def exact_sorted(w: World) -> DataFrame:
    return _bits(B.exact_pass(w.s1, w.pool, "name_sorted", Q.MAX_GROUP, B.SORTED))


@query(_exact("squash"))
def exact_squash(w: World) -> DataFrame:
    return _bits(B.exact_pass(w.s1, w.pool, "name_squash", Q.MAX_GROUP, B.SQUASH))


@query(_exact("namenum"))
def name_num(w: World) -> DataFrame:
    return _bits(B.name_number_pass(w.s1, w.pool, Q.MAX_GROUP))


_NF = f"SELECT *, array_to_string(list_sort(list_distinct({Q.words('name_core_nofill')})), ' ') AS k FROM "


@query(
    _exact("nofillpass"),
    nfl=_NF + "s1",
    nfr=_NF + "pool",
    nofillpass=Q.capped("country, k", "nfl", "nfr", 128, "k <> ''"),
)
def nofill(w: World) -> DataFrame:
    return _bits(B.nofill_pass(w.s1, w.pool, Q.MAX_GROUP))


@query(f"SELECT {P}, sim FROM topword")
def topk_word(w: World) -> DataFrame:
    return B.topk_join(w.s1, w.pool, SPACE).select(L, R, F.col("sim_name_addr_word").alias("sim"))


@query(f"SELECT {P}, sim FROM topchar", **Q.topk("name_core", "char", 10, 0.5, 8, "topchar", "addr_tokens <= 9", 0.1))
def topk_char(w: World) -> DataFrame:
    spec = B.TopK("name_core", "char", 10, 0.5, 2, 0.1, max_addr_tokens=9, bit=B.NAME_SPACE, sim="sim_name_char")
    return B.topk_join(w.s1, w.pool, spec).select(L, R, F.col("sim_name_char").alias("sim"))


@query(f"SELECT {P}, sim FROM topaddr", **Q.topk("addr_norm", "word", 10, 0.3, 32, "topaddr"))
def topk_address(w: World) -> DataFrame:
    spec = B.TopK("addr_norm", "word", 10, 0.3, bit=B.ADDRESS_SPACE, sim="sim_addr_char")
    return B.topk_join(w.s1, w.pool, spec).select(L, R, F.col("sim_addr_char").alias("sim"))


def _passes(w: World) -> list[DataFrame]:
    keys = (("name_core", B.CORE), ("name_sorted", B.SORTED), ("name_squash", B.SQUASH))
    return [*[B.exact_pass(w.s1, w.pool, k, Q.MAX_GROUP, b) for k, b in keys], B.name_number_pass(w.s1, w.pool, Q.MAX_GROUP), B.topk_join(w.s1, w.pool, SPACE)]


def _cap(n: int, mask: int, none: int) -> str:
    return f"SELECT {P}, pass, sim FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY (pass & {mask}) <> 0 DESC, coalesce(sim, {none}) DESC, e) AS rk FROM united) WHERE rk <= {n}"


@query(_cap(3, 199, 0))
def union_cap_exact_first(w: World) -> DataFrame:
    return B.union_passes(_passes(w), 3).select(L, R, "pass", F.col("sim_name_addr_word").alias("sim"))


@query(_cap(3, 64, -1))
def union_cap_sim_first(w: World) -> DataFrame:
    return B.union_passes(_passes(w), 3, "sim_first").select(L, R, "pass", F.col("sim_name_addr_word").alias("sim"))


@query(f"SELECT {P}, pass, sim FROM cand")
def block_all(w: World) -> DataFrame:
    return w.pairs.select(L, R, "pass", F.col("sim_name_addr_word").alias("sim"))


@query(f"SELECT cand.s AS source1_entity_id, cand.e AS entity_id, (truth.s IS NOT NULL)::INT AS label FROM cand LEFT JOIN truth USING (s, e)")
def label_pairs(w: World) -> DataFrame:
    return B.label_pairs(w.pairs, w.truth).select(L, R, "label")


@query("SELECT entity_id FROM s1 WHERE entity_id NOT IN (SELECT s FROM cand)")
def absent_anti(w: World) -> DataFrame:
    return w.s1.select("entity_id").join(w.pairs.select(F.col(L).alias("entity_id")), "entity_id", "left_anti")


# Names of the documents seldom differ by one word; parts, whose names are few and whose type is added to half of them, often do.
_PARTS = dict(
    prec="""SELECT p_partkey % 4 = 0 AS mine, 'S' || (CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END) || '-' || p_partkey AS entity_id, p_brand AS country, p_name, p_type,
  CASE WHEN p_partkey // 4 % 2 = 0 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS name_core FROM part""",
    psort=f"SELECT *, array_to_string(list_sort(list_distinct({Q.words('name_core')})), ' ') AS name_sorted FROM prec",
    ps1="SELECT * FROM psort WHERE mine",
    ppool="SELECT * FROM psort WHERE NOT mine",
    ptruth="SELECT l.entity_id AS s, r.entity_id AS e FROM ps1 l JOIN ppool r USING (country, p_name, p_type)",
)
_ONE = """SELECT l.country, l.entity_id AS s, l.name_sorted FROM ps1 l WHERE name_sorted <> '' AND (SELECT count(*) FROM ps1 x WHERE x.country = l.country AND x.name_sorted = l.name_sorted) = 1"""
_LESS = "SELECT country, id, word, array_to_string(list_filter(toks, lambda t: t <> word), ' ') AS k FROM (SELECT country, {id} AS id, string_split(name_sorted, ' ') AS toks, unnest(string_split(name_sorted, ' ')) AS word FROM {src} WHERE name_sorted <> '')"
_NEAR = _PARTS | dict(
    onename=_ONE,
    poolless=_LESS.format(id="entity_id", src="ppool"),
    s1less=_LESS.format(id="s", src="onename"),
    fewpool=f"SELECT * FROM (SELECT country, entity_id AS e, name_sorted, count(*) OVER (PARTITION BY country, name_sorted) AS n FROM ppool WHERE name_sorted <> '') WHERE n <= {Q.MAX_GROUP}",
    nearpairs="""SELECT 'pool' AS side, word, o.s, p.id AS e FROM poolless p JOIN onename o ON p.country = o.country AND p.k = o.name_sorted
  UNION ALL SELECT 's1', word, q.id, f.e FROM s1less q JOIN fewpool f ON q.country = f.country AND q.k = f.name_sorted""",
)


def _parts(w: World) -> SP.Fold:
    part = w.spark.read.parquet(f"{w.sf_dir}/part.parquet")
    mine = F.col("p_partkey") % 4 == 0
    key = F.concat(F.lit("S"), F.when(mine, "1").otherwise("2"), F.lit("-"), F.col("p_partkey").cast("string"))
    name = F.when(F.floor(F.col("p_partkey") / 4) % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.lower("p_type")))
    rows = part.select(mine.alias("mine"), key.alias("entity_id"), F.col("p_brand").alias("country"), "p_name", "p_type", name.alias("name_core"))
    rows = rows.withColumn("name_sorted", T.sorted_words(F.col("name_core")))
    s1, pool = rows.where("mine"), rows.where("NOT mine")
    own = s1.select(F.col("entity_id").alias(L), "country", "p_name", "p_type")
    return SP.Fold(s1, pool, pool.join(own, ["country", "p_name", "p_type"]).select(L, R))


@query(f"SELECT side, word, {P} FROM nearpairs", **_NEAR)
def near_duplicates(w: World) -> DataFrame:
    world = _parts(w)
    return B.one_word_pairs(world.s1, world.pool, Q.MAX_GROUP)


# ---- statistics -----------------------------------------------------------------------------------------------------


@query(f"SELECT country, token, count(*) AS df FROM (SELECT country, unnest(list_distinct({Q.words('addr_norm')})) AS token FROM pool) GROUP BY ALL")
def doc_freq(w: World) -> DataFrame:
    return ST.doc_freq(w.pool, "addr_norm")


@query("SELECT p_brand AS country, p_name AS value, count(*) AS n FROM part WHERE p_name <> '' GROUP BY ALL")
def value_counts(w: World) -> DataFrame:
    part = w.spark.read.parquet(f"{w.sf_dir}/part.parquet").withColumn("country", F.col("p_brand"))
    return ST.value_counts(part, "p_name")


@query(
    """SELECT entity_id, CASE WHEN name_core <> '' THEN (greatest(same_n - 1, 0)::DOUBLE / greatest(same_total - 1, 1) * 1e6)::FLOAT END AS freq_same,
  CASE WHEN name_core <> '' THEN (coalesce(other_n, 0)::DOUBLE / greatest(coalesce(other_total, 0), 1) * 1e6)::FLOAT END AS freq_other,
  CASE WHEN name_first <> '' THEN (coalesce(first_n, 0)::DOUBLE / greatest(coalesce(other_total, 0), 1) * 1e6)::FLOAT END AS freq_first_other
  FROM (SELECT *, count(*) OVER (PARTITION BY country, name_core) AS same_n, count(*) OVER (PARTITION BY country) AS same_total FROM s1)
  LEFT JOIN (SELECT country, name_core, count(*) AS other_n FROM pool GROUP BY ALL) USING (country, name_core)
  LEFT JOIN (SELECT country, name_first, count(*) AS first_n FROM pool GROUP BY ALL) USING (country, name_first)
  LEFT JOIN (SELECT country, count(*) AS other_total FROM pool GROUP BY ALL) USING (country)"""
)
def frequencies(w: World) -> DataFrame:
    return ST.add_frequencies(w.s1, w.pool)[0].select("entity_id", "freq_same", "freq_other", "freq_first_other")


@query("SELECT e AS entity_id, count(DISTINCT s) AS n FROM cand GROUP BY e")
def indegree(w: World) -> DataFrame:
    return ST.in_degree(w.pairs)


_IDF = f"""SELECT token, ln((SELECT count(*) FROM pool)::DOUBLE / count(*)) AS idf FROM (SELECT unnest(list_distinct({Q.words("name_core")})) AS token FROM pool) GROUP BY token"""


@query("SELECT token, round(idf, 6) AS idf FROM idft", idft=_IDF)
def idf_table(w: World) -> DataFrame:
    return ST.idf_table(w.pool).select("token", *r6("idf"))


# ---- pair features --------------------------------------------------------------------------------------------------


def _features(w: World, *groups: str, only: tuple[str, ...] = ()) -> DataFrame:
    df = X.build_features(w.pairs, w.s1, w.pool, groups)
    double = [c for c, t in df.dtypes if t == "double" and (not only or c in only)]
    return df.select(L, R, *[F.round(c, 6).alias(c) if c in double else c for c in df.columns if c not in (L, R) and (not only or c in only)])


_A, _B2 = (Q.words(f"name_core_{s}") for s in "lr")
_NA, _NB = (Q.words(f"addr_nums_{s}") for s in "lr")
_DA, _DB = (Q.words(f"addr_norm_{s}") for s in "lr")
_BOTH = lambda c: f"{c}_l <> '' AND {c}_r <> ''"
_EQ = lambda c: f"({_BOTH(c)} AND {c}_l = {c}_r)::INT"
_D = lambda c: f"len(list_distinct({c}))"


@query(f"SELECT {P}, ((pass & 7) <> 0)::INT AS pass_exact, ((pass & 8) <> 0)::INT AS pass_name_char, ((pass & 16) <> 0)::INT AS pass_name_addr, NULL::DOUBLE AS sim_name_char, sim AS sim_name_addr_word, NULL::DOUBLE AS sim_addr_char FROM cand")
def feat_blocking(w: World) -> DataFrame:
    return _features(w, "blocking")


@query(
    f"""SELECT {P}, {q6(f"coalesce({Q.jaccard(_A, _B2)}, 0) AS tok_jaccard", f"coalesce(2.0 * {Q.inter(_A, _B2)} / nullif({_D(_A)} + {_D(_B2)}, 0), 0) AS tok_dice")},
  {Q.inter(_A, _B2)} AS tok_common, {_D(_A)} AS tok_len_l, {_D(_B2)} AS tok_len_r, {_EQ("name_first")} AS first_eq, {_EQ("name_sorted")} AS sorted_eq,
  (substr(name_squash_l, 1, 4) = substr(name_squash_r, 1, 4) AND name_squash_l <> '')::INT AS prefix4_eq FROM al"""
)
def feat_name_tokens(w: World) -> DataFrame:
    return _features(w, "name_tokens")


@query(f"SELECT {P}, {_EQ('legal_form')} AS legal_eq, (legal_form_l = '')::INT AS legal_missing_l, (legal_form_r = '')::INT AS legal_missing_r FROM al")
def feat_legal(w: World) -> DataFrame:
    return _features(w, "legal")


@query(
    f"""SELECT {P}, {q6(f"{Q.jaccard(_NA, _NB)} AS num_jaccard")}, CASE WHEN {_BOTH("addr_nums")} THEN ({Q.inter(_NA, _NB)} > 0)::INT END AS num_shared_any,
  CASE WHEN {_BOTH("addr_nums")} THEN ({_NA}[1] = {_NB}[1])::INT END AS num_first_eq, CASE WHEN {_BOTH("postcode")} THEN (postcode_l = postcode_r)::INT END AS postcode_eq FROM al"""
)
def feat_numeric(w: World) -> DataFrame:
    return _features(w, "numeric")


@query(
    f"""SELECT {P}, {q6(f"{Q.jaccard(_DA, _DB)} AS ad_jaccard", f"CASE WHEN {_BOTH('addr_norm')} THEN {Q.inter(_DA, _DB)}::DOUBLE / {_D(_DA)} END AS ad_contain")},
  CASE WHEN {_BOTH("region")} THEN (region_l = region_r)::INT END AS region_eq, CASE WHEN {_BOTH("addr_last")} THEN (addr_last_l = addr_last_r)::INT END AS last_eq,
  (addr_norm_r = '')::INT AS addr_empty_r FROM al"""
)
def feat_address(w: World) -> DataFrame:
    return _features(w, "address", only=("ad_jaccard", "ad_contain", "region_eq", "last_eq", "addr_empty_r"))


@query(
    f"""SELECT {P}, (starts_with(e, 'S3-'))::INT AS is_s3, non_latin_r::INT AS non_latin_r,
  {q6("coalesce(least(length(name_core_l), length(name_core_r))::DOUBLE / nullif(greatest(length(name_core_l), length(name_core_r)), 0), 0) AS len_ratio_name")} FROM al"""
)
def feat_meta(w: World) -> DataFrame:
    return _features(w, "meta")


@query(
    f"""SELECT {P}, rank() OVER (PARTITION BY s ORDER BY sim DESC NULLS LAST) AS rank_sim, {q6("max(sim) OVER (PARTITION BY s) - sim AS gap_sim")},
  count(*) OVER (PARTITION BY s) AS n_cands, count(*) OVER (PARTITION BY e) AS indegree FROM cand"""
)
def feat_context(w: World) -> DataFrame:
    rank, gap = C.rank_and_gap("sim_name_addr_word")
    rows = w.pairs.withColumns({"rank_sim": rank, "gap_sim": gap, "n_cands": F.count(F.lit(1)).over(W.partitionBy(L)), "indegree": F.count(F.lit(1)).over(W.partitionBy(R))})
    return rows.select(L, R, "rank_sim", *r6("gap_sim"), "n_cands", "indegree")


@query(f"SELECT {P}, count(*) OVER (PARTITION BY e) AS ctx_pool_indegree FROM al")
def feat_pool_context(w: World) -> DataFrame:
    return _features(w, "pool_context")


_RATE = """(SELECT entity_id AS id, CASE WHEN name_core <> '' THEN (greatest(same_n - 1, 0)::DOUBLE / greatest(same_total - 1, 1) * 1e6)::FLOAT END AS fs,
  CASE WHEN name_core <> '' THEN (coalesce(other_n, 0)::DOUBLE / greatest(other_total, 1) * 1e6)::FLOAT END AS fo
  FROM (SELECT *, count(*) OVER (PARTITION BY country, name_core) AS same_n, count(*) OVER (PARTITION BY country) AS same_total FROM {a})
  LEFT JOIN (SELECT country, name_core, count(*) AS other_n FROM {b} GROUP BY ALL) USING (country, name_core)
  LEFT JOIN (SELECT country, count(*) AS other_total FROM {b} GROUP BY ALL) USING (country))"""


@query(
    f"""SELECT {P}, a.fs AS fq_s1_l, a.fo AS fq_pool_l, b.fs AS fq_pool_r, b.fo AS fq_s1_r, {_EQ("name_core")} AS core_eq
  FROM al JOIN {_RATE.format(a="s1", b="pool")} a ON s = a.id JOIN {_RATE.format(a="pool", b="s1")} b ON e = b.id"""
)
def feat_frequency(w: World) -> DataFrame:
    s1, pool = ST.add_frequencies(w.s1, w.pool)
    return X.build_features(w.pairs, s1, pool, ("frequency",)).drop("fq_first_pool_l")


def _idf_sql(column: str, prefix: str) -> dict[str, str]:
    a, b = Q.words(f"{column}_l"), Q.words(f"{column}_r")
    return {
        f"{prefix}_n": "SELECT country, count(*) AS n FROM pool GROUP BY country",
        f"{prefix}_df": f"SELECT country, token, count(*) AS df FROM (SELECT country, unnest(list_distinct({Q.words(column)})) AS token FROM pool) GROUP BY ALL",
        f"{prefix}_t": f"SELECT s, e, country, token, list_contains({a}, token) AS il, list_contains({b}, token) AS ir FROM (SELECT *, unnest(list_distinct(list_concat({a}, {b}))) AS token FROM al WHERE {column}_l <> '' AND {column}_r <> '')",
        f"{prefix}_v": f"SELECT *, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS v, ln(1.0::DOUBLE + n) + 1 AS top FROM {prefix}_t JOIN {prefix}_n USING (country) LEFT JOIN {prefix}_df USING (country, token)",
        f"{prefix}_x": f"""SELECT s, e, least(1.0, sum(CASE WHEN il AND ir THEN v * v ELSE 0 END) / sqrt(sum(CASE WHEN il THEN v * v ELSE 0 END) * sum(CASE WHEN ir THEN v * v ELSE 0 END))) AS {prefix}_cos,
  least(1.0, max(CASE WHEN il AND ir THEN v ELSE 0 END) / max(top)) AS {prefix}_top, least(1.0, sum(CASE WHEN il AND ir THEN v ELSE 0 END) / sum(CASE WHEN il THEN v ELSE 0 END)) AS {prefix}_cover_l,
  least(1.0, sum(CASE WHEN il AND ir THEN v ELSE 0 END) / sum(CASE WHEN ir THEN v ELSE 0 END)) AS {prefix}_cover_r FROM {prefix}_v GROUP BY s, e""",
    }


_IDF8 = _idf_sql("name_core", "idf_name") | _idf_sql("addr_norm", "idf_addr")
_IDF_COLUMNS = [f"idf_{k}_{c}" for k in ("name", "addr") for c in ("cos", "top", "cover_l", "cover_r")]


@query(f"SELECT {P}, {q6(*[f'{c} AS {c}' for c in _IDF_COLUMNS])} FROM cand LEFT JOIN idf_name_x USING (s, e) LEFT JOIN idf_addr_x USING (s, e)", **_IDF8)
def feat_idf(w: World) -> DataFrame:
    return _features(w, "idf")


@query(
    f"""SELECT {P}, rank() OVER (PARTITION BY s ORDER BY n DESC NULLS LAST) AS ctx_rank_idf_name, {q6("max(n) OVER (PARTITION BY s) - n AS ctx_gap_idf_name")},
  rank() OVER (PARTITION BY s ORDER BY a DESC NULLS LAST) AS ctx_rank_idf_addr, {q6("max(a) OVER (PARTITION BY s) - a AS ctx_gap_idf_addr")},
  sum({_EQ("name_core")}) OVER (PARTITION BY s)::BIGINT AS ctx_n_same_name
  FROM (SELECT al.*, round(idf_name_cos, 9) AS n, round(idf_addr_cos, 9) AS a FROM al LEFT JOIN idf_name_x USING (s, e) LEFT JOIN idf_addr_x USING (s, e))""",
    **_IDF8,
)
def feat_ctx_idf(w: World) -> DataFrame:
    """Ranks on values rounded to nine places, so that sums in another order tie alike."""
    df = X.REGISTRY["idf"].add(X.align(w.pairs, w.s1, w.pool), X.Context(w.s1, w.pool))
    df = df.withColumns({c: F.round(c, 9) for c in ("idf_name_cos", "idf_addr_cos")})
    names = X.REGISTRY["ctx_idf"].columns
    df = X.REGISTRY["ctx_idf"].add(df, X.Context(w.s1, w.pool))
    return df.select(L, R, *[F.round(c, 6).alias(c) if "gap" in c else c for c in names])


@query(
    f"""SELECT {P}, CASE WHEN name_core_l <> '' THEN coalesce(a.n, 0) END AS freq_name_l, CASE WHEN name_core_r <> '' THEN coalesce(b.n, 0) END AS freq_name_r,
  CASE WHEN addr_norm_l <> '' THEN coalesce(c.n, 0) END AS freq_addr_l, CASE WHEN addr_norm_r <> '' THEN coalesce(d.n, 0) END AS freq_addr_r FROM al
  LEFT JOIN vn a ON al.country = a.country AND name_core_l = a.v LEFT JOIN vn b ON al.country = b.country AND name_core_r = b.v
  LEFT JOIN va c ON al.country = c.country AND addr_norm_l = c.v LEFT JOIN va d ON al.country = d.country AND addr_norm_r = d.v""",
    vn="SELECT country, name_core AS v, count(*) AS n FROM pool GROUP BY ALL",
    va="SELECT country, addr_norm AS v, count(*) AS n FROM pool GROUP BY ALL",
)
def feat_token_freq(w: World) -> DataFrame:
    return _features(w, "token_freq")


@query(
    f"""SELECT {P}, {q6(f"CASE WHEN {_BOTH('addr_norm')} THEN {Q.inter(_DA, _DB)}::DOUBLE / {_D(_DB)} END AS ad_contain_r")}, (addr_norm_l = '')::INT AS addr_empty_l,
  {q6(f"CASE WHEN {_BOTH('addr_nums')} THEN {Q.inter(_NA, _NB)}::DOUBLE / {_D(_NA)} END AS num_contain_l", f"CASE WHEN {_BOTH('addr_nums')} THEN {Q.inter(_NA, _NB)}::DOUBLE / {_D(_NB)} END AS num_contain_r")},
  CASE WHEN {_BOTH("postcode")} THEN (substr(postcode_l, 1, 3) = substr(postcode_r, 1, 3))::INT END AS postcode_prefix_eq,
  {q6(f"CASE WHEN {_BOTH('addr_norm')} THEN least(len({_DA}), len({_DB}))::DOUBLE / greatest(len({_DA}), len({_DB})) END AS addr_len_ratio")} FROM al"""
)
def feat_address_extra(w: World) -> DataFrame:
    return _features(w, "address_extra")


_FA, _FB = (Q.words(f"name_core_nofill_{s}") for s in "lr")


@query(
    f"""SELECT {P}, {q6(f"coalesce({Q.jaccard(_FA, _FB)}, 0) AS nofill_jaccard")}, (len({_FA}) > 0 AND list_sort(list_distinct({_FA})) = list_sort(list_distinct({_FB})))::INT AS nofill_eq,
  len({_A}) - len({_FA}) AS fill_n_l, len({_B2}) - len({_FB}) AS fill_n_r FROM al"""
)
def feat_nofill(w: World) -> DataFrame:
    return _features(w, "nofill", only=("nofill_jaccard", "nofill_eq", "fill_n_l", "fill_n_r"))


@query(
    f"""SELECT {P}, coalesce(n >= 0.9 AND a < 0.2, false)::INT AS name_strong_addr_weak, coalesce(a >= 0.9 AND n < 0.5, false)::INT AS addr_strong_name_weak,
  coalesce(n >= 0.9 AND a >= 0.9, false)::INT AS both_strong FROM (SELECT s, e, {Q.jaccard(_A, _B2)} AS n, {Q.jaccard(_DA, _DB)} AS a FROM al)"""
)
def feat_interactions(w: World) -> DataFrame:
    """The flags over word overlaps, which SQL has too."""
    n, a = X.jaccard(*X.sets("name_core")), X.jaccard(*X.sets("addr_norm"))
    return w.aligned.withColumns(X.interaction_flags(n, a, a)).select(L, R, "name_strong_addr_weak", "addr_strong_name_weak", "both_strong")


@query()
def feat_interactions_fuzzy(w: World) -> DataFrame:
    return _features(w, "interactions")


@query(f"SELECT {P}, (addr_nums_l = '')::INT AS nums_empty_l, (addr_nums_r = '')::INT AS nums_empty_r FROM al")
def feat_missing(w: World) -> DataFrame:
    return _features(w, "missing_flags")


@query(f"SELECT {P}, {q6('1 - levenshtein(name_core_l, name_core_r)::DOUBLE / greatest(length(name_core_l), length(name_core_r), 1) AS core_lev')} FROM al")
def feat_lev(w: World) -> DataFrame:
    return _features(w, "name_fuzzy", only=("core_lev",))


@query(f"SELECT {P}, {q6('jaro_winkler_similarity(name_core_l, name_core_r) AS core_jw', 'jaro_winkler_similarity(name_norm_l, name_norm_r) AS nm_jw')} FROM al")
def feat_jaro_winkler(w: World) -> DataFrame:
    return _features(w, "name_fuzzy", only=("core_jw", "nm_jw"))


@query()
def feat_fuzzy_rest(w: World) -> DataFrame:
    return _features(w, "name_fuzzy", "address", "nofill")


@query()
def feat_phonetic(w: World) -> DataFrame:
    return _features(w, "phonetic")


_EV = _NEAR | dict(
    labelled="SELECT side, word, (ptruth.s IS NOT NULL)::INT AS m FROM nearpairs LEFT JOIN ptruth USING (s, e)",
    base="SELECT side, avg(m) AS b FROM labelled GROUP BY side HAVING avg(m) > 0 AND avg(m) < 1",
    evid="""SELECT side, word, count(*) AS n, round(ln(((sum(m) + 5 * b) / b) / ((count(*) - sum(m) + 5 * (1 - b)) / (1 - b))), 4) AS llr
  FROM labelled JOIN base USING (side) GROUP BY side, word, b HAVING count(*) >= 2""",
)


def _evidence(world: SP.Fold) -> DataFrame:
    return LN.fit_evidence(world.s1, world.pool, world.truth, Q.MAX_GROUP, 2, 5.0)


@query("SELECT side, word, n, llr FROM evid", **_EV)
def token_evidence(w: World) -> DataFrame:
    return _evidence(_parts(w))


_TE = ("pool", "rc", "lc"), ("s1", "lc", "rc")


@query(
    f"""SELECT {P}, {", ".join(f"round(coalesce(sum(CASE WHEN side = '{d}' THEN llr END), 0), 6) AS te_{d}_sum, min(CASE WHEN side = '{d}' THEN llr END) AS te_{d}_min, max(CASE WHEN side = '{d}' THEN llr END) AS te_{d}_max, count(CASE WHEN side = '{d}' AND llr <= -0.1 THEN 1 END) AS te_{d}_decoy, count(CASE WHEN side = '{d}' AND llr >= 0.1 THEN 1 END) AS te_{d}_filler, count(CASE WHEN side = '{d}' AND llr IS NULL THEN 1 END) AS te_{d}_unknown" for d, _, _ in _TE)}
  FROM psome LEFT JOIN (SELECT * FROM ({" UNION ALL ".join(f"SELECT s, e, '{d}' AS side, unnest(list_filter(list_distinct({Q.words(a)}), lambda t: NOT list_contains({Q.words(b)}, t))) AS word FROM psome" for d, a, b in _TE)})
  LEFT JOIN evid USING (side, word)) USING (s, e) GROUP BY s, e""",
    **_EV | {"psome": "SELECT l.entity_id AS s, r.entity_id AS e, l.name_core AS lc, r.name_core AS rc FROM ps1 l JOIN ppool r USING (country, p_type)"},
)
def feat_tok_evidence(w: World) -> DataFrame:
    """All twelve columns, over parts of one brand and type; a word is strong from 0.1 on."""
    world = _parts(w)
    df = X.evidence_of_blocks(world.s1, world.pool, ("country", "p_type"), _evidence(world), strong=0.1)
    return df.select(L, R, *[F.round(c, 6).alias(c) if c.endswith("sum") else F.col(c) for c in X.REGISTRY["tok_evidence"].columns])


_N1L, _N1R = "la[1]", "lb[1]"


@query(
    f"""SELECT {P}, CASE WHEN known THEN (x = y)::INT END AS hn_eq, CASE WHEN known THEN (x <> y AND sub)::INT END AS hn_substr,
  CASE WHEN known THEN (x <> y AND NOT sub AND one)::INT END AS hn_onedigit, CASE WHEN known THEN (x <> y AND NOT sub AND NOT one AND abs(x::DOUBLE - y::DOUBLE) <= 20)::INT END AS hn_near, {q6("CASE WHEN known THEN ln(1 + abs(x::DOUBLE - y::DOUBLE)) END AS hn_absdiff")},
  CASE WHEN x IS NULL THEN 1 ELSE 0 END + CASE WHEN y IS NULL THEN 2 ELSE 0 END AS hn_missing
  FROM (SELECT s, e, x, y, x IS NOT NULL AND y IS NOT NULL AS known, contains(x, y) OR contains(y, x) AS sub,
  length(x) = length(y) AND len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1 AS one
  FROM (SELECT s, e, {_NA}[1] AS x, {_NB}[1] AS y FROM al))"""
)
def house_number(w: World) -> DataFrame:
    found = C.house_numbers(F.col("addr_nums_l"), F.col("addr_nums_r"))
    return w.aligned.withColumns(found).select(L, R, *[F.round(c, 6).alias(c) if c == "hn_absdiff" else c for c in found])


def _others(keys: str) -> str:
    return f"coalesce((SELECT max(o.prob) FROM gr o WHERE {' AND '.join(f'o.{k} IS NOT DISTINCT FROM g.{k}' for k in keys.split())} AND o.e <> g.e), 0)"


@query(
    f"""SELECT g.s AS source1_entity_id, g.e AS entity_id, CASE WHEN num IS NOT NULL THEN count(*) OVER (PARTITION BY s, num) - 1 END AS grp_num_n,
  CASE WHEN num IS NOT NULL THEN {_others("s num")} END AS grp_num_p1max,
  CASE WHEN num IS NOT NULL THEN (min(substr(e, 2, 1)) OVER (PARTITION BY s, num) <> max(substr(e, 2, 1)) OVER (PARTITION BY s, num))::INT END AS grp_num_xsrc,
  CASE WHEN numl IS NOT NULL THEN sum(coalesce((num = numl)::INT, 0)) OVER (PARTITION BY s)::BIGINT END AS grp_s1num_n, count(*) OVER (PARTITION BY s, name_core_r) - 1 AS grp_name_n,
  {_others("s name_core_r")} AS grp_name_p1max, CASE WHEN addr_norm_r <> '' THEN count(*) OVER (PARTITION BY s, addr_norm_r) - 1 END AS grp_addr_n FROM gr g""",
    gr=f"SELECT *, {_NB}[1] AS num, {_NA}[1] AS numl FROM sc",
)
def decoy_groups(w: World) -> DataFrame:
    rows = C.group_features(w.scored)
    return rows.select(L, R, *[c for c in rows.columns if c.startswith("grp_")])


@query(
    f"""SELECT {P}, {q6("coalesce(max(CASE WHEN k = 'l' THEN v END), 0) AS uidf_max_l", "coalesce(max(CASE WHEN k = 'r' THEN v END), 0) AS uidf_max_r",
    "coalesce(sum(CASE WHEN k = 'l' THEN v END), 0) AS uidf_sum_l", "coalesce(sum(CASE WHEN k = 'r' THEN v END), 0) AS uidf_sum_r",
    "(coalesce(sum(CASE WHEN k <> 'b' THEN v END), 0)) / greatest(coalesce(sum(v), 0), 1e-9) AS uidf_share")} FROM cand LEFT JOIN
  (SELECT s, e, k, coalesce(idf, (SELECT quantile_cont(idf, 0.5) FROM idft)) AS v FROM
  (SELECT s, e, token, CASE WHEN list_contains({_A}, token) AND list_contains({_B2}, token) THEN 'b' WHEN list_contains({_A}, token) THEN 'l' ELSE 'r' END AS k
  FROM (SELECT *, unnest(list_distinct(list_concat({_A}, {_B2}))) AS token FROM al)) LEFT JOIN idft USING (token)) USING (s, e) GROUP BY s, e""",
    idft=_IDF,
)
def unmatched_idf(w: World) -> DataFrame:
    rows = C.unmatched_idf(w.aligned, ST.idf_table(w.pool))
    return rows.select(L, R, *r6("uidf_max_l", "uidf_max_r", "uidf_sum_l", "uidf_sum_r", "uidf_share"))


@query(
    f"""SELECT {P}, ({_NA}[2] = {_NB}[2])::INT AS hn2_eq, CASE WHEN len({_NA}) > 0 AND len({_NB}) > 0 THEN (list_sort(list_distinct({_NA})) = list_sort(list_distinct({_NB})))::INT END AS nums_set_eq,
  {_D(_A)} - {Q.inter(_A, _B2)} AS n_only_l, {_D(_B2)} - {Q.inter(_A, _B2)} AS n_only_r, (len({_NA}) > 0 AND len({_NB}) > 0 AND {Q.inter(_NA, _NB)} = 0)::INT AS unum_conflict FROM al"""
)
def unit_numbers(w: World) -> DataFrame:
    found = C.unit_numbers(F.col("addr_nums_l"), F.col("addr_nums_r"), F.col("name_core_l"), F.col("name_core_r"))
    found["unum_conflict"] = C.number_conflict(F.col("addr_nums_l"), F.col("addr_nums_r"))
    return w.aligned.withColumns(found).select(L, R, *found)


# ---- competition ----------------------------------------------------------------------------------------------------


def _side(k: str, t: str, p: str) -> str:
    w = f"(PARTITION BY {k} ORDER BY prob DESC, {t})"
    other = f"CASE WHEN row_number() OVER {w} = 1 THEN coalesce(lead(prob) OVER {w}, 0) ELSE max(prob) OVER (PARTITION BY {k}) END"
    return f"""row_number() OVER {w} AS {p}_rank, {other} AS {p}_best_other, round(sum(prob) OVER (PARTITION BY {k}), 6) AS {p}_p1_sum,
  sum((prob >= 0.5)::INT) OVER (PARTITION BY {k})::BIGINT AS {p}_n_likely, round(prob - ({other}), 6) AS {p}_gap"""


@query(f"SELECT {P}, {_side('s', 'e', 's1')}, {_side('e', 's', 'pool')}, count(*) OVER (PARTITION BY e) AS pool_degree FROM sc")
def competition(w: World) -> DataFrame:
    rows = C.competition(w.scored)
    names = [c for c in rows.columns if c.startswith(("s1_", "pool_"))]
    return rows.select(L, R, *[F.round(c, 6).alias(c) if c.endswith(("sum", "gap")) else c for c in names])


@query(f"SELECT {P}, prob FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY prob DESC, e) AS k FROM sc) WHERE k <= 3 AND prob >= 0.2")
def keep_mask(w: World) -> DataFrame:
    return C.keep(w.scored, "prob", 0.2, 3).select(L, R, "prob")


_TOP2 = "SELECT s, e, prob, row_number() OVER (PARTITION BY s ORDER BY prob DESC, e) AS k FROM sc"
_like = lambda a, b, c: Q.jaccard(Q.words(f"{a}.{c}"), Q.words(f"{b}.{c}"))


@query(
    f"""SELECT a.s AS source1_entity_id, a.e AS entity_id, o.prob AS anc_p1,
  {q6(f"{_like('p', 'q', 'addr_norm')} AS anc_addr_ts", f"{_like('p', 'q', 'addr_norm')} AS anc_addr_ratio", f"{_like('p', 'q', 'name_norm')} AS anc_name_ts")},
  CASE WHEN p.addr_nums <> '' AND q.addr_nums <> '' THEN (p.addr_nums = q.addr_nums)::INT END AS anc_nums_eq
  FROM top2 a LEFT JOIN top2 o ON a.s = o.s AND o.k = CASE WHEN a.k = 1 THEN 2 ELSE 1 END JOIN pool p ON a.e = p.entity_id LEFT JOIN pool q ON o.e = q.entity_id""",
    top2=_TOP2,
)
def anchor(w: World) -> DataFrame:
    """With word overlaps for scores, which SQL has too; ``anchor_scores`` has the real ones."""
    return C.anchors(w.scored, w.pool, scores=C.OVERLAP).select(L, R, "anc_p1", *r6("anc_addr_ts", "anc_addr_ratio", "anc_name_ts"), "anc_nums_eq")


@query()
def anchor_scores(w: World) -> DataFrame:
    return C.anchors(w.scored, w.pool)


@query(
    f"""SELECT a.s AS source1_entity_id, a.e AS entity_id, {q6(f"{_like('p', 'q', 'addr_norm')} AS riv_addr_ts", f"{_like('p', 'q', 'name_norm')} AS riv_name_ts",
    f"{_like('p', 'm', 'addr_norm')} - {_like('p', 'q', 'addr_norm')} AS riv_addr_gap")}
  FROM topr a LEFT JOIN topr o ON a.e = o.e AND o.k = CASE WHEN a.k = 1 THEN 2 ELSE 1 END JOIN pool p ON a.e = p.entity_id JOIN s1 m ON a.s = m.entity_id LEFT JOIN s1 q ON o.s = q.entity_id""",
    topr="SELECT s, e, prob, row_number() OVER (PARTITION BY e ORDER BY prob DESC, s) AS k FROM sc",
)
def rival(w: World) -> DataFrame:
    return C.rivals(w.scored, w.s1, w.pool, scores=C.OVERLAP).select(L, R, *r6("riv_addr_ts", "riv_name_ts", "riv_addr_gap"))


@query()
def rival_scores(w: World) -> DataFrame:
    return C.rivals(w.scored, w.s1, w.pool)


@query(
    f"""SELECT a.s AS source1_entity_id, a.e AS entity_id, {q6("CASE WHEN sum(CASE WHEN sa IS NOT NULL THEN b.prob END) > 0 THEN sum(b.prob * sa) / sum(CASE WHEN sa IS NOT NULL THEN b.prob END) END AS coh_addr",
    "CASE WHEN sum(CASE WHEN sn IS NOT NULL THEN b.prob END) > 0 THEN sum(b.prob * sn) / sum(CASE WHEN sn IS NOT NULL THEN b.prob END) END AS coh_name")}, count(CASE WHEN b.prob >= 0.5 AND sa >= 0.8 THEN 1 END) AS coh_support
  FROM sc a LEFT JOIN sc b ON a.s = b.s AND a.e <> b.e,
  LATERAL (SELECT {Q.jaccard(Q.words('a.addr_norm_r'), Q.words('b.addr_norm_r'))} AS sa, {Q.jaccard(Q.words('a.name_norm_r'), Q.words('b.name_norm_r'))} AS sn)
  GROUP BY a.s, a.e"""
)
def cohesion(w: World) -> DataFrame:
    return C.cohesion(w.scored, w.pool, scores=C.OVERLAP).select(L, R, *r6("coh_addr", "coh_name"), "coh_support")


@query()
def cohesion_scores(w: World) -> DataFrame:
    return C.cohesion(w.scored, w.pool)


# ---- decisions ------------------------------------------------------------------------------------------------------


@query(f"SELECT {P}, prob FROM oto")
def one_to_one(w: World) -> DataFrame:
    return D.one_to_one(w.scored).select(L, R, "prob")


@query(f"SELECT {P}, prob FROM rk WHERE prob >= 0.4 AND prob >= 0.6::DOUBLE * p_max AND p_max >= 0.45 AND rnk <= 2")
def decide_threshold(w: World) -> DataFrame:
    return D.decide(w.scored, D.Rule(0.4, 0.6, 0.45, 2))


def _decode(src: str, q: str, score: str, none: str, most: int, tol: float = 0.0) -> dict[str, str]:
    return dict(
        dq=f"SELECT s, e, prob, rnk, {q} AS q FROM {src}",
        dc="SELECT *, sum(q) OVER (PARTITION BY s ORDER BY rnk) AS cum, sum(q) OVER (PARTITION BY s) AS total, sum(ln(1 - q)) OVER (PARTITION BY s) AS logs FROM dq",
        dv=f"SELECT *, CASE WHEN rnk <= {most} THEN {score} END AS v, {none} AS floor FROM dc",
        db="SELECT *, max(v) OVER (PARTITION BY s) AS best FROM dv",
        dk=f"SELECT *, min(CASE WHEN v >= best - {tol!r}::DOUBLE THEN rnk END) OVER (PARTITION BY s) AS kk FROM db",
    )


@query(
    f"SELECT {P}, prob FROM dk WHERE rnk <= kk AND best > floor",
    **_decode("rk", "power(least(greatest(prob, 0.0::DOUBLE), 1 - 1e-7::DOUBLE), 1.2::DOUBLE)", "1.25::DOUBLE * cum / (0.25::DOUBLE * (total + 0.1::DOUBLE) + rnk)", "exp(logs) * exp(-0.1::DOUBLE)", 11),
)
def decide_expected(w: World) -> DataFrame:
    return D.decide_expected(w.scored, D.ExpectedRule(1.2, 0.1))


@query(
    f"SELECT {P}, prob FROM dk WHERE rnk <= kk AND best > floor",
    **_decode(
        "rk",
        "least(greatest(prob, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)",
        "3.0::DOUBLE * 1.25::DOUBLE * cum / (0.25::DOUBLE * (total + 0.2::DOUBLE) + rnk) - 2.0::DOUBLE * 1.25::DOUBLE * cum / (0.25::DOUBLE * (total + 0.2::DOUBLE) + cum)",
        "exp(logs) * exp(-0.2::DOUBLE)",
        11,
        1e-12,
    ),
)
def decode_tight(w: World) -> DataFrame:
    return D.decode_tight(w.scored, 3.0, 0.2, 11, True)


_RULES = D.rule_table((0.3, 0.4, 0.5, 0.6, 0.7), (0.0, 0.6), (0.0, 0.2), (2, 11))


def _tried(rules: str) -> str:
    """SQL of the macro score of every rule of a table."""
    return f"""SELECT {rules}.rule, tau_abs, tau_rel, tau_single, max_matches, avg({Q.f05("coalesce(tp, 0)", "coalesce(n_pred, 0)", "coalesce(n_true, 0)")}) AS f, coalesce(sum(n_pred), 0)::BIGINT AS n_pred
  FROM {rules} CROSS JOIN s1 LEFT JOIN (SELECT s, count(*) AS n_true FROM truth GROUP BY s) t ON s1.entity_id = t.s
  LEFT JOIN (SELECT rule, rk.s, count(*) AS n_pred, count(truth.s) AS tp FROM rk JOIN {rules} ON prob >= tau_abs AND prob >= tau_rel * p_max AND p_max >= tau_single AND rnk <= max_matches
  LEFT JOIN truth ON rk.s = truth.s AND rk.e = truth.e GROUP BY ALL) c ON c.rule = {rules}.rule AND c.s = s1.entity_id GROUP BY ALL"""


_VALUES = " UNION ALL ".join(f"SELECT {i} AS rule, {r.tau_abs!r}::DOUBLE AS tau_abs, {r.tau_rel!r}::DOUBLE AS tau_rel, {r.tau_single!r}::DOUBLE AS tau_single, {r.max_matches} AS max_matches" for i, r in enumerate(_RULES))
_FIRST = "SELECT * FROM {t} WHERE f >= (SELECT max(f) FROM {t}) - 1e-4::DOUBLE ORDER BY tau_abs DESC, tau_rel DESC, tau_single DESC, max_matches LIMIT 1"


@query("SELECT rule, tau_abs, tau_rel, tau_single, max_matches, round(f, 6) AS f_beta, n_pred FROM tried", rules=_VALUES, tried=_tried("rules"))
def rule_grid(w: World) -> DataFrame:
    return D.evaluate_rules(w.scored, w.ids, w.truth, _RULES).select("rule", "tau_abs", "tau_rel", "tau_single", "max_matches", *r6("f_beta"), "n_pred")


@query(
    "SELECT round(tau_abs, 6) AS tau_abs, round(tau_rel, 6) AS tau_rel, round(tau_single, 6) AS tau_single, max_matches, true AS one_to_one FROM best2",
    rules=_VALUES,
    tried=_tried("rules"),
    best1=_FIRST.format(t="tried"),
    rules2="SELECT 1000 + k AS rule, round(tau_abs + round(k * 0.005::DOUBLE, 10), 10) AS tau_abs, tau_rel, round(tau_single + round(k * 0.005::DOUBLE, 10), 10) AS tau_single, max_matches FROM best1, range(-6, 7) r(k)",
    tried2=_tried("rules2"),
    all_tried="SELECT * FROM tried UNION ALL SELECT * FROM tried2",
    best2=_FIRST.format(t="all_tried"),
)
def rule_tuning(w: World) -> DataFrame:
    best, _ = D.tune(w.scored, w.ids, w.truth, _RULES)
    return w.spark.createDataFrame([asdict(best)]).select(*r6("tau_abs", "tau_rel", "tau_single"), F.col("max_matches").cast("int"), "one_to_one")


_GAMMAS, _MISSES = (0.8, 1.2, 2.0), (0.0, 0.1, 0.4)


@query(
    f"""SELECT g.gamma AS gamma, g.miss AS miss, round(avg({Q.f05("coalesce(tp, 0)", "coalesce(n_pred, 0)", "coalesce(n_true, 0)")}), 6) AS f_beta FROM (SELECT gamma, miss, entity_id FROM sets CROSS JOIN s1) g
  LEFT JOIN (SELECT s, count(*) AS n_true FROM truth GROUP BY s) t ON g.entity_id = t.s
  LEFT JOIN (SELECT gamma, miss, s, count(*) AS n_pred, count(t.e) AS tp FROM (SELECT * FROM xk WHERE rnk <= kk AND best > floor) LEFT JOIN truth t USING (s, e) GROUP BY ALL) c ON c.gamma = g.gamma AND c.miss = g.miss AND c.s = g.entity_id GROUP BY g.gamma, g.miss""",
    sets=" UNION ALL ".join(f"SELECT {g!r}::DOUBLE AS gamma, {m!r}::DOUBLE AS miss" for g in _GAMMAS for m in _MISSES),
    xq="SELECT s, e, prob, rnk, gamma, miss, power(least(greatest(prob, 0.0::DOUBLE), 1 - 1e-7::DOUBLE), gamma) AS q FROM rk, sets",
    xc="SELECT *, sum(q) OVER (PARTITION BY gamma, miss, s ORDER BY rnk) AS cum, sum(q) OVER (PARTITION BY gamma, miss, s) AS total, sum(ln(1 - q)) OVER (PARTITION BY gamma, miss, s) AS logs FROM xq",
    xv="SELECT *, CASE WHEN rnk <= 11 THEN 1.25::DOUBLE * cum / (0.25::DOUBLE * (total + miss) + rnk) END AS v, exp(logs - miss) AS floor FROM xc",
    xb="SELECT *, max(v) OVER (PARTITION BY gamma, miss, s) AS best FROM xv",
    xk="SELECT *, min(CASE WHEN v >= best THEN rnk END) OVER (PARTITION BY gamma, miss, s) AS kk FROM xb",
)
def expected_tuning(w: World) -> DataFrame:
    return D.tune_expected(w.scored, w.ids, w.truth, _GAMMAS, _MISSES)[1].select("gamma", "miss", *r6("f_beta"))


_WEIGHTS = (1.0, 3.0)
_TIGHT_SCORE = f"({Q.f05('coalesce(tp, 0)', 'coalesce(n_pred, 0)', 'coalesce(n_true, 0)')} - 2 * ({Q.f05('coalesce(tp, 0)', 'coalesce(tp, 0)', 'coalesce(n_true, 0)')} - {Q.f05('coalesce(tp, 0)', 'coalesce(n_pred, 0)', 'coalesce(n_true, 0)')}))"


@query(
    f"""SELECT g.w AS weight, g.miss AS miss, round(avg({_TIGHT_SCORE}), 6) AS tight FROM (SELECT w, miss, entity_id FROM sets CROSS JOIN s1) g
  LEFT JOIN (SELECT s, count(*) AS n_true FROM truth GROUP BY s) t ON g.entity_id = t.s
  LEFT JOIN (SELECT w, miss, s, count(*) AS n_pred, count(t.e) AS tp FROM (SELECT * FROM yk WHERE rnk <= kk AND best > floor) LEFT JOIN truth t USING (s, e) GROUP BY ALL) c ON c.w = g.w AND c.miss = g.miss AND c.s = g.entity_id GROUP BY g.w, g.miss""",
    sets=" UNION ALL ".join(f"SELECT {w!r}::DOUBLE AS w, {m!r}::DOUBLE AS miss" for w in _WEIGHTS for m in _MISSES),
    rkall="SELECT s, e, prob, row_number() OVER (PARTITION BY s ORDER BY prob DESC, e) AS rnk FROM sc",
    yq="SELECT s, e, prob, rnk, w, miss, least(greatest(prob, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM rkall, sets",
    yc="SELECT *, sum(q) OVER (PARTITION BY w, miss, s ORDER BY rnk) AS cum, miss + sum(q) OVER (PARTITION BY w, miss, s) AS total, sum(ln(1 - q)) OVER (PARTITION BY w, miss, s) AS logs FROM yq",
    yv="SELECT *, CASE WHEN rnk <= 11 THEN w * 1.25::DOUBLE * cum / (0.25::DOUBLE * total + rnk) - (w - 1) * 1.25::DOUBLE * cum / (0.25::DOUBLE * total + cum) END AS v, exp(logs - miss) AS floor FROM yc",
    yb="SELECT *, max(v) OVER (PARTITION BY w, miss, s) AS best FROM yv",
    yk="SELECT *, min(CASE WHEN v >= best - 1e-12::DOUBLE THEN rnk END) OVER (PARTITION BY w, miss, s) AS kk FROM yb",
)
def tight_tuning(w: World) -> DataFrame:
    """The tight score of every decoder of a grid, a false match weighing three."""
    return D.tight_table(w.scored, w.ids, w.truth, _WEIGHTS, _MISSES, 3.0).select("weight", "miss", *r6("tight"))


_ROLE = f"CASE WHEN {Q.hash_unit('entity_id', 42)} < 0.5 THEN 'val' ELSE 'fit' END"


@query(
    f"""SELECT slice, count(*) AS n_s1, {q6("avg(f) AS f05", "sum(tp)::DOUBLE / nullif(sum(n_pred), 0) AS precision", "sum(tp)::DOUBLE / nullif(sum(n_true), 0) AS recall",
    "avg(f - 0.45::DOUBLE * (g - f)) AS f_tight", "avg(f - 0.45::DOUBLE * (g - f)) - 0.0072::DOUBLE AS est_public")} FROM
  (SELECT *, {Q.f05()} AS f, {Q.f05('tp', 'tp', 'n_true')} AS g FROM vc) JOIN (SELECT entity_id, unnest(['all', country]) AS slice FROM s1 WHERE {_ROLE} = 'val') ON s = entity_id GROUP BY slice""",
    vr="SELECT * FROM (SELECT sc.s, sc.e, sc.prob, row_number() OVER (PARTITION BY e ORDER BY prob DESC, s) AS rp FROM sc WHERE s IN (SELECT entity_id FROM s1 WHERE " + _ROLE + " = 'val')) WHERE rp = 1",
    vp="SELECT v.s, v.e FROM (SELECT *, max(prob) OVER (PARTITION BY s) AS p_max FROM vr) v WHERE prob >= 0.5 AND p_max >= 0.5",
    vc="""SELECT s1.entity_id AS s, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM s1
  LEFT JOIN (SELECT s, count(*) AS n_pred FROM vp GROUP BY s) p ON s1.entity_id = p.s LEFT JOIN (SELECT s, count(*) AS n_true FROM truth GROUP BY s) t ON s1.entity_id = t.s
  LEFT JOIN (SELECT s, count(*) AS tp FROM vp JOIN truth USING (s, e) GROUP BY s) b ON s1.entity_id = b.s""",
)
def mock_scores(w: World) -> DataFrame:
    """A rule's scores on the entities of one role, over all and by country."""
    from . import pipeline

    roles = w.s1.select("entity_id", F.when(SP.val_mask(F.col("entity_id"), 0.5), "val").otherwise("fit").alias("role"))
    rows = pipeline.mock_scores(w.scored.select(L, R, "prob"), SP.Fold(w.s1, w.pool, w.truth), roles, D.Rule(max_matches=60))
    return rows.select("slice", "n_s1", *r6("f05", "precision", "recall", "f_tight", "est_public"))


@query(
    f"""SELECT {P}, prob FROM rkc WHERE country = 'de' AND prob >= 0.4 AND prob >= 0.5::DOUBLE * p_max AND p_max >= 0.4 AND rnk <= 2
  UNION ALL SELECT {P}, prob FROM rkc WHERE country = 'fr' AND prob >= 0.6 AND p_max >= 0.7 AND rnk <= 1
  UNION ALL SELECT {P}, prob FROM rkc WHERE country NOT IN ('de', 'fr') AND prob >= 0.5 AND p_max >= 0.5 AND rnk <= 11""",
    otc="SELECT * FROM (SELECT sc.s, sc.e, sc.prob, sc.country, row_number() OVER (PARTITION BY CASE WHEN country IN ('de', 'fr') THEN country ELSE '' END, e ORDER BY prob DESC, s) AS rp FROM sc) WHERE rp = 1",
    rkc="SELECT *, max(prob) OVER (PARTITION BY s) AS p_max, row_number() OVER (PARTITION BY s ORDER BY prob DESC, e) AS rnk FROM otc",
)
def rules_by_country(w: World) -> DataFrame:
    rules = {"de": D.Rule(0.4, 0.5, 0.4, 2), "fr": D.Rule(0.6, 0.0, 0.7, 1)}
    return D.decide_by_country(w.scored.select(L, R, "prob"), w.s1, rules).select(L, R, "prob")


# ---- evaluation -----------------------------------------------------------------------------------------------------

_EF = f"SELECT *, {Q.f05()} AS f, {Q.f05('tp', 'tp', 'n_true')} AS g FROM ec"


@query(
    f"""SELECT {q6("avg(f) AS f05", "avg(CASE WHEN n_true = 0 THEN f END) AS f05_single", "avg(CASE WHEN n_true > 0 THEN f END) AS f05_matched", "avg(f - 2 * (g - f)) AS tight",
    "sum(tp)::DOUBLE / nullif(sum(n_pred), 0) AS precision", "sum(tp)::DOUBLE / nullif(sum(n_true), 0) AS recall")}, count(*) AS n_s1, sum(n_pred)::BIGINT AS n_pred, sum(n_true)::BIGINT AS n_true FROM ef""",
    ef=_EF,
)
def macro_f05(w: World) -> DataFrame:
    rows = E.score_pairs(D.decide(w.scored), w.ids, w.truth)
    return rows.select(*r6("f05", "f05_single", "f05_matched", "tight", "precision", "recall"), "n_s1", "n_pred", "n_true")


@query(f"SELECT s AS source1_entity_id, {q6('f - 2 * (g - f) AS tight')} FROM ef", ef=_EF)
def tight(w: World) -> DataFrame:
    return E.with_scores(E.entity_counts(D.decide(w.scored), w.ids, w.truth)).select(L, *r6("tight"))


@query(
    f"""SELECT {q6("sum(tp)::DOUBLE / sum(n_true) AS recall", "count(CASE WHEN n_true > 0 AND tp > 0 THEN 1 END)::DOUBLE / count(CASE WHEN n_true > 0 THEN 1 END) AS entity_recall",
    f"avg({Q.f05('tp', 'tp', 'n_true')}) AS ceiling_f05", "avg(n_pred) AS mean_candidates", "quantile_cont(n_pred, 0.95) AS p95_candidates")}, max(n_pred)::BIGINT AS max_candidates,
  {q6("1 - sum(n_pred)::DOUBLE / (count(*) * (SELECT count(*) FROM pool)) AS reduction")} FROM ec""",
    pred="SELECT s, e, 1.0 AS prob FROM cand",
)
def blocking_report(w: World) -> DataFrame:
    rows = E.blocking_report(w.pairs, w.ids, w.truth, w.pool.agg(F.count(F.lit(1))).scalar())
    return rows.select(*r6("recall", "entity_recall", "ceiling_f05", "mean_candidates", "p95_candidates"), "max_candidates", *r6("reduction"))


@query(
    "SELECT name, count(CASE WHEN (coalesce(pass, 0) & bit) <> 0 THEN 1 END) AS found, round(count(CASE WHEN (coalesce(pass, 0) & bit) <> 0 THEN 1 END)::DOUBLE / count(*), 6) AS recall FROM truth LEFT JOIN cand USING (s, e) CROSS JOIN (VALUES ('core', 1), ('sorted', 2), ('squash', 4), ('word', 16), ('num', 64)) v(name, bit) GROUP BY name"
)
def pass_recall(w: World) -> DataFrame:
    bits = {"core": B.CORE, "sorted": B.SORTED, "squash": B.SQUASH, "word": B.WORD_SPACE, "num": B.NAME_NUMBER}
    return E.pass_recall(w.pairs, w.truth, bits).select("name", "found", *r6("recall"))


_YES = lambda c: f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"
_SLICES = {
    "country": "country",
    "non_latin": _YES("non_latin"),
    "ambiguous": _YES("same > 1 AND name_core <> ''"),
    "singleton": _YES("n_true = 0"),
    "n_matches": "CASE WHEN n_true = 0 THEN '0' WHEN n_true = 1 THEN '1' WHEN n_true = 2 THEN '2' WHEN n_true <= 4 THEN '3-4' ELSE '5+' END",
    "postcode": _YES("postcode <> ''"),
    "addr_empty": _YES("addr_norm = ''"),
}


@query(
    f"""SELECT family, slice, count(*) AS n_s1, {q6("avg(f) AS f05", "sum(tp)::DOUBLE / nullif(sum(n_pred), 0) AS precision", "sum(tp)::DOUBLE / nullif(sum(n_true), 0) AS recall")} FROM (
  {" UNION ALL ".join(f"SELECT '{k}' AS family, {v} AS slice, f, tp, n_pred, n_true FROM sl UNION ALL SELECT '{k}', 'all', f, tp, n_pred, n_true FROM sl" for k, v in _SLICES.items())}
  UNION ALL SELECT 'match_source', 'all', f, tp, n_pred, n_true FROM sl
  UNION ALL SELECT 'match_source', src, f, tp, n_pred, n_true FROM sl JOIN (SELECT DISTINCT s, substr(e, 1, 2) AS src FROM truth) USING (s)) GROUP BY family, slice""",
    ef=_EF,
    sl="SELECT ef.*, x.country, x.non_latin, x.name_core, x.postcode, x.addr_norm, x.same FROM ef JOIN (SELECT *, count(*) OVER (PARTITION BY country, name_core) AS same FROM s1) x ON ef.s = x.entity_id",
)
def slice_report(w: World) -> DataFrame:
    rows = E.slice_report(D.decide(w.scored), w.s1, w.truth)
    return rows.select("family", "slice", "n_s1", *r6("f05", "precision", "recall"))


_ERR = """SELECT p.s, p.e, CASE WHEN p.s IN (SELECT s FROM truth) THEN 'false_merge' ELSE 'single_merge' END AS kind FROM pred p ANTI JOIN truth t ON p.s = t.s AND p.e = t.e
  UNION ALL SELECT t.s, t.e, CASE WHEN t.s IN (SELECT s FROM pred) THEN 'missed' ELSE 'false_single' END FROM truth t ANTI JOIN pred p ON p.s = t.s AND p.e = t.e"""


@query("SELECT kind, count(*) AS n FROM err GROUP BY kind", err=_ERR)
def error_counts(w: World) -> DataFrame:
    return E.error_counts(D.decide(w.scored), w.truth)


@query(
    f"""SELECT s AS source1_entity_id, e AS entity_id, kind, l.name_core AS name_l, l.addr_norm AS addr_l, r.name_core AS name_r, r.addr_norm AS addr_r FROM
  (SELECT * FROM err WHERE kind = 'single_merge' ORDER BY {Q.hash_unit("(s || '|' || e)", 0)}, s, e LIMIT 20) x JOIN s1 l ON s = l.entity_id JOIN pool r ON e = r.entity_id""",
    err=_ERR,
)
def error_samples(w: World) -> DataFrame:
    return E.error_samples(D.decide(w.scored), w.s1, w.pool, w.truth, "single_merge")


_REL = f"SELECT l.doc_id, round({Q.hash_unit('l.doc_id::VARCHAR', 3)}, 9) AS p, quality FROM labels l"


@query("""SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_prob, round(avg(quality), 6) AS mean_label FROM (SELECT p, quality, i, max(b)::INT AS bin FROM (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM rel), range(1, 21) r(b) WHERE round_even(n * (b - 1) / 20.0::DOUBLE, 0) <= i GROUP BY ALL) GROUP BY bin""", rel=_REL)
def reliability(w: World) -> DataFrame:
    labels = w.spark.read.parquet(f"{w.sf_dir}/labels.parquet").withColumn("p", F.round(hash_unit(F.col("doc_id"), 3), 9))
    return E.reliability(labels, "p", "quality", "doc_id").select("bin", "n", *r6("mean_prob", "mean_label"))


@query(
    """SELECT round((SELECT (sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE) / (count(*) * (SELECT count(*) FROM rk2 WHERE quality = 0)) FROM rk2 WHERE quality = 1), 6) AS auc,
  round(avg((p - quality) ** 2), 6) AS brier, round(avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), 6) AS log_loss FROM rel""",
    rel=_REL,
    rk2="SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM rel",
)
def score_quality(w: World) -> DataFrame:
    """Rank, squared and logarithmic scores of a probability against a label, in one row."""
    labels = w.spark.read.parquet(f"{w.sf_dir}/labels.parquet").withColumn("p", F.round(hash_unit(F.col("doc_id"), 3), 9))
    parts = E.auc(labels, "p", "quality"), E.brier(labels, "p", "quality"), M.log_loss(labels, "p", "quality")
    return parts[0].select(*r6("auc")).withColumn("brier", F.round(parts[1].scalar(), 6)).withColumn("log_loss", F.round(parts[2].scalar(), 6))


@query(
    """SELECT round(sum(n * abs(mean_prob - mean_label)) / sum(n), 6) AS ece FROM (SELECT bin, count(*) AS n, avg(p) AS mean_prob, avg(quality) AS mean_label FROM
  (SELECT p, quality, i, max(b)::INT AS bin FROM (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM rel), range(1, 11) r(b) WHERE round_even(n * (b - 1) / 10.0::DOUBLE, 0) <= i GROUP BY ALL) GROUP BY bin)""",
    rel=_REL,
)
def calibration_error(w: World) -> DataFrame:
    labels = w.spark.read.parquet(f"{w.sf_dir}/labels.parquet").withColumn("p", F.round(hash_unit(F.col("doc_id"), 3), 9))
    return E.calibration(E.reliability(labels, "p", "quality", "doc_id", 10)).select(*r6("ece"))


@query(
    f"""SELECT {q6("f AS f05", "f - t2 AS loss_fp", "1 - f - (f - t2) AS loss_fn", "t AS f_tight", "t - 0.0072::DOUBLE AS est_public")} FROM
  (SELECT avg(f) AS f, avg(f - (g - f)) AS t2, avg(f - 0.45::DOUBLE * (g - f)) AS t FROM ef)""",
    ef=_EF,
)
def loss_parts(w: World) -> DataFrame:
    return E.loss_parts(D.decide(w.scored), w.ids, w.truth).select(*r6("f05", "loss_fp", "loss_fn", "f_tight", "est_public"))


# ---- splits and samples ---------------------------------------------------------------------------------------------


@query(f"SELECT entity_id FROM s1 WHERE {Q.hash_unit('entity_id', 7)} < 100::DOUBLE / (SELECT count(*) FROM s1)")
def hash_sample(w: World) -> DataFrame:
    return SP.sample_s1(w.s1, 100).select("entity_id")


@query(f"SELECT p.entity_id, {Q.hash_unit('coalesce(o.s, p.entity_id)', 42)} < 0.2 AS val FROM pool p LEFT JOIN (SELECT e, min(s) AS s FROM truth GROUP BY e) o ON p.entity_id = o.e")
def val_split(w: World) -> DataFrame:
    return SP.pool_mask(w.pool, w.truth, 0.2, SP.VAL).select("entity_id", "val")


@query(f"SELECT entity_id, {Q.hash_unit('entity_id', 4242)} < 0.25 AS tune FROM s1")
def inner_split(w: World) -> DataFrame:
    tune, rest = SP.inner_split(SP.Fold(w.s1, w.pool, w.truth))
    return tune.s1.select("entity_id", F.lit(True).alias("tune")).unionByName(rest.s1.select("entity_id", F.lit(False).alias("tune")))


@query(f"SELECT s1.entity_id, count(t.e) AS n_true FROM s1 LEFT JOIN truth t ON s1.entity_id = t.s WHERE {Q.hash_unit('s1.entity_id', 99)} >= 0.2 GROUP BY ALL")
def harder_fold(w: World) -> DataFrame:
    fold = SP.harder_fold(SP.Fold(w.s1, w.pool, w.truth))
    own = fold.s1.select(F.col("entity_id").alias(L)).join(fold.truth.select(L, F.col(R).alias("e")), L, "left")
    return own.groupBy(F.col(L).alias("entity_id")).agg(F.count("e").alias("n_true"))


@query(f"SELECT entity_id, least(floor({Q.hash_unit('entity_id', 6161)} * 5), 4)::INT AS fold FROM s1")
def cv_folds(w: World) -> DataFrame:
    return w.s1.select("entity_id", fold_of(F.col("entity_id"), 5).alias("fold"))


@query(f"SELECT entity_id FROM s1 WHERE {Q.hash_unit('entity_id', 6161)} >= 0.25 AND {Q.hash_unit('entity_id', 6161)} < 0.5")
def hash_windows(w: World) -> DataFrame:
    return SP.hash_window(w.s1, F.col("entity_id"), 0.25, 0.5, SP.FOLD).select("entity_id")


@query(f"SELECT entity_id FROM s1 ORDER BY {Q.hash_unit('entity_id', 5152)}, entity_id LIMIT 25")
def smallest_hashes(w: World) -> DataFrame:
    return SP.smallest_hash(w.s1, F.col("entity_id"), 25, SP.DROP).select("entity_id")


@query(
    f"SELECT s AS source1_entity_id, country FROM (SELECT s, country, sum(n) OVER (PARTITION BY country ORDER BY {Q.hash_unit('s', 7)}, s) AS run FROM (SELECT s, country, count(*) AS n FROM al GROUP BY ALL)) WHERE run <= 50"
)
def budget_sample(w: World) -> DataFrame:
    sizes = w.aligned.groupBy(L, "country").agg(F.count(F.lit(1)).alias("n"))
    return SP.budget_sample(sizes, L, "n", 50, SP.SAMPLE, "country").select(L, "country")


_MOCK = {"en": (30, 90), "de": (20, 50), "fr": (10, 40)}


@query(
    f"""SELECT entity_id, role FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY (role IN ('val', 'tune'))::INT, {Q.hash_unit("entity_id", 5152)}, entity_id) AS k,
  count(*) OVER (PARTITION BY country) - want AS extra FROM
  (SELECT m.entity_id, m.country, CASE WHEN {Q.hash_unit("m.entity_id", 42)} < 0.2 THEN 'val' ELSE 'fit' END AS role, coalesce(want, 1000000) AS want FROM ms1 m LEFT JOIN mwant USING (country))) WHERE role IN ('val', 'tune') OR k > extra""",
    goal=" UNION ALL ".join(f"SELECT '{c}' AS country, {a} AS gs, {p} AS gp" for c, (a, p) in _MOCK.items()),
    mshare="SELECT c.country, coalesce(least(1.0::DOUBLE, gp::DOUBLE / n), 1.0::DOUBLE) AS share, gp::DOUBLE / gs AS ratio FROM (SELECT country, count(*) AS n FROM pool GROUP BY country) c LEFT JOIN goal USING (country)",
    ms1=f"SELECT s1.* FROM s1 JOIN mshare USING (country) WHERE {Q.hash_unit('entity_id', 5151)} < share",
    mpool=f"SELECT p.country FROM pool p JOIN mshare USING (country) LEFT JOIN (SELECT e, min(s) AS s FROM truth GROUP BY e) o ON p.entity_id = o.e WHERE {Q.hash_unit('coalesce(o.s, p.entity_id)', 5151)} < share",
    mwant="SELECT country, round_even(count(*) / ratio, 0)::BIGINT AS want FROM mpool JOIN mshare USING (country) GROUP BY country, ratio",
)
def mock_fold(w: World) -> DataFrame:
    roles = w.s1.select("entity_id", F.when(SP.val_mask(F.col("entity_id")), "val").otherwise("fit").alias("role"))
    return SP.mock_fold(SP.Fold(w.s1, w.pool, w.truth), _MOCK, roles)[1]


# ---- learnt tables --------------------------------------------------------------------------------------------------


def _odd(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of the same name, the pool's words spelt otherwise on non-Latin rows."""
    odd = F.when(F.col("non_latin"), F.replace("name_norm", F.lit("th"), F.lit("d"))).otherwise(F.col("name_norm"))
    return B.exact_pass(w.s1, w.pool, "name_core", Q.MAX_GROUP).select(L, R), w.s1, w.pool.withColumn("name_norm", odd)


@query(
    """SELECT token, partner, n, round(n::DOUBLE / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, partner) AS k FROM cnt WHERE token <> partner) WHERE k = 1 AND n >= 3 AND n >= 0.5 * total""",
    zipped="""SELECT unnest(string_split(l.name_norm, ' ')) AS partner, unnest(string_split(replace(r.name_norm, 'th', 'd'), ' ')) AS token FROM core c JOIN s1 l ON c.s = l.entity_id JOIN pool r ON c.e = r.entity_id
  WHERE r.non_latin AND len(string_split(l.name_norm, ' ')) = len(string_split(replace(r.name_norm, 'th', 'd'), ' '))""",
    cnt="SELECT token, partner, count(*) AS n, (sum(count(*)) OVER (PARTITION BY token))::BIGINT AS total FROM zipped GROUP BY token, partner",
)
def fit_token_map(w: World) -> DataFrame:
    return LN.fit_token_map(*_odd(w)).select("token", "partner", "n", *r6("share"))


_FP = "SELECT * FROM al WHERE NOT non_latin_r"


@query(
    f"""SELECT token, sum(a)::BIGINT AS added, sum(h)::BIGINT AS held FROM
  (SELECT unnest(list_filter(list_distinct({_B2}), lambda t: NOT list_contains({_A}, t))) AS token, 1 AS a, 0 AS h FROM fp UNION ALL SELECT unnest(list_distinct({_A})), 0, 1 FROM fp)
  GROUP BY token HAVING sum(a) >= 0.001::DOUBLE * (SELECT count(*) FROM fp) AND sum(a) > 0 AND sum(a) >= sum(h) + 1""",
    fp=_FP,
)
def fit_fillers(w: World) -> DataFrame:
    return LN.fit_fillers(w.pairs.select(L, R), w.s1, w.pool, 0.001)


# ---- training helpers -----------------------------------------------------------------------------------------------

_HN = f"""SELECT s, e, label, sng, coalesce({Q.jaccard(_A, _B2)}, 0) AS n, coalesce({Q.jaccard(_DA, _DB)}, 0) AS a, prob FROM
  (SELECT sc.*, (t.s IS NOT NULL)::INT AS label, sc.s NOT IN (SELECT s FROM truth) AS sng FROM sc LEFT JOIN truth t ON sc.s = t.s AND sc.e = t.e)"""


@query(
    f"""SELECT {P}, (CASE WHEN label = 0 AND ((n = 1 AND a < 0.2) OR (a >= 0.9 AND n < 0.5)) THEN 3.0
  WHEN sng THEN 2.0 WHEN label = 0 AND n < 0.5 AND a < 0.1 AND {Q.hash_unit("(s || '|' || e)", 7)} >= 0.5 THEN 0.0 ELSE 1.0 END)::DOUBLE
  + CASE WHEN label = 0 AND prob >= 0.5 THEN 1.0 WHEN label = 1 AND prob < 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS weight FROM hn""",
    hn=_HN,
)
def hard_negative_weights(w: World) -> DataFrame:
    """The rules over word overlaps in place of fuzzy scores, which SQL lacks."""
    rows = X.REGISTRY["name_tokens"].add(w.scored, X.Context())
    rows = rows.withColumn("ad_jaccard", F.coalesce(X.jaccard(*X.sets("addr_norm")), F.lit(0.0)))
    stand = {"ad_token_set": F.col("ad_jaccard"), "core_token_set": F.col("tok_jaccard"), "sim_name_char": F.col("tok_jaccard"), "core_eq": (F.col("tok_jaccard") == 1).cast("int")}
    rows = M.with_singleton(B.label_pairs(rows, w.truth), w.truth).withColumns(stand)
    return M.hard_negative_weights(rows, M.KINDS[:2], 3.0, 2.0, 0.5, 2.0, 1.5).select(L, R, "weight")


@query(f"SELECT {P}, prob, label FROM hn WHERE (label = 0 AND prob >= 0.6) OR (label = 1 AND prob < 0.95)", hn=_HN)
def mined_errors(w: World) -> DataFrame:
    """False positives from 0.6 on and near misses under 0.95."""
    rows = w.scored.select(L, R, "prob")
    return M.false_positives(rows, w.truth, 0.6).unionByName(M.near_misses(rows, w.truth, 0.95))


@query(
    "SELECT country, stage, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY country), 6) AS share FROM st GROUP BY country, stage",
    st="""SELECT t.s, t.e, l.country, CASE WHEN c.s IS NULL THEN 'blocking' WHEN k.s IS NULL THEN 'one_to_one' WHEN p.s IS NULL THEN 'threshold' ELSE 'found' END AS stage FROM truth t JOIN s1 l ON t.s = l.entity_id
  LEFT JOIN cand c ON t.s = c.s AND t.e = c.e LEFT JOIN oto k ON t.s = k.s AND t.e = k.e LEFT JOIN pred p ON t.s = p.s AND t.e = p.e""",
)
def stage_crosstab(w: World) -> DataFrame:
    """Where true pairs are lost, as shares of each country's."""
    lost = E.lost_at(w.truth, {"blocking": w.pairs, "one_to_one": D.one_to_one(w.scored), "threshold": D.decide(w.scored)})
    return E.stage_shares(lost, w.s1).select("country", "stage", "n", *r6("share"))


@query("SELECT country, least(floor(p * 5), 4)::INT AS bin, count(*) AS n FROM (SELECT s, country, max(prob) AS p FROM sc GROUP BY s, country) GROUP BY ALL")
def pmax_histogram(w: World) -> DataFrame:
    return E.score_histogram(E.best_scores(w.scored, w.s1), 5)


@query("SELECT entity_id AS source1_entity_id, country, p_max, coalesce(n, 0) AS n_cands FROM s1 LEFT JOIN (SELECT s, max(prob) AS p_max, count(*) AS n FROM sc GROUP BY s) ON s = entity_id")
def best_scores(w: World) -> DataFrame:
    return E.best_scores(w.scored, w.s1)


@query(
    """SELECT coalesce(a.s, b.s) AS source1_entity_id, coalesce(a.e, b.e) AS entity_id, CASE WHEN b.s IS NULL THEN 'left' WHEN a.s IS NULL THEN 'right' ELSE 'both' END AS side
  FROM (SELECT s, e FROM rk WHERE prob >= 0.5 AND rnk <= 1) a FULL JOIN (SELECT s, e FROM rk WHERE prob >= 0.6 AND rnk <= 3) b ON a.s = b.s AND a.e = b.e"""
)
def submission_diff(w: World) -> DataFrame:
    return E.match_diff(*(D.decide(w.scored, D.Rule(t, 0.0, 0.0, m)) for t, m in ((0.5, 1), (0.6, 3))))


def _labelled(w: World) -> DataFrame:
    rows = B.label_pairs(X.REGISTRY["name_tokens"].add(w.scored, X.Context()), w.truth).withColumnRenamed("tok_jaccard", "name")
    return rows.withColumn("addr", F.coalesce(X.jaccard(*X.sets("addr_norm")), F.lit(0.0)))


@query(f"SELECT label, {q6('avg(n) AS name', 'avg(a) AS addr', 'sum(n * prob) / sum(prob) AS weighted_name', 'sum(a * prob) / sum(prob) AS weighted_addr')}, count(*) AS rows FROM hn GROUP BY label", hn=_HN)
def class_means(w: World) -> DataFrame:
    return E.means_by_class(_labelled(w), ("name", "addr"), "prob").select("label", *r6("name", "addr", "weighted_name", "weighted_addr"), "rows")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({v}, label), 6) AS r FROM hn" for c, v in (("prob", "prob"), ("name", "n"), ("addr", "a"))), hn=_HN)
def label_correlation(w: World) -> DataFrame:
    return E.correlations(_labelled(w), ("prob", "name", "addr")).select("column", *r6("r"))


@query("SELECT country, count(*) FILTER (side = 1) AS n_s1, count(*) FILTER (side = 2) AS n_pool FROM (SELECT country, 1 AS side FROM s1 UNION ALL SELECT country, 2 FROM pool) GROUP BY country")
def target_shape(w: World) -> DataFrame:
    return SP.shape(w.s1, w.pool)


@query(
    f"""SELECT {P}, pass, sim FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY (pass & 199) <> 0 DESC, coalesce(sim, 0) DESC, e) AS rk FROM
  (SELECT s, e, CASE WHEN wr > 2 THEN pass & ~16 ELSE pass END AS pass, CASE WHEN wr > 2 THEN NULL ELSE sim END AS sim FROM
  (SELECT *, CASE WHEN (pass & 16) <> 0 THEN row_number() OVER (PARTITION BY s ORDER BY CASE WHEN (pass & 16) <> 0 THEN sim END DESC NULLS LAST, e) ELSE 0 END AS wr FROM cand)) WHERE pass <> 0) WHERE rk <= 4"""
)
def derive_narrower(w: World) -> DataFrame:
    return B.derive(w.pairs, 2, 4).select(L, R, "pass", F.col("sim_name_addr_word").alias("sim"))


@query(f"SELECT {P} FROM pred JOIN s1 ON s = entity_id WHERE country NOT IN ('de', 'fr') UNION ALL SELECT {P} FROM rk JOIN s1 ON s = entity_id WHERE country IN ('de', 'fr') AND rnk = 1")
def compose_countries(w: World) -> DataFrame:
    return B.compose(D.decide(w.scored).select(L, R), D.decide(w.scored, D.Rule(0.0, 0.0, 0.0, 1)).select(L, R), w.s1, ["de", "fr"])


@query(
    f"""SELECT country, count(*) AS n_s1, {q6("avg(coalesce(c, 0)) AS cands_per_s1", "avg((coalesce(m, 0) > 0)::INT) AS matched_share", "avg(coalesce(m, 0)) AS matches_per_s1")} FROM s1
  LEFT JOIN (SELECT s, count(*) AS c FROM cand GROUP BY s) a ON entity_id = a.s LEFT JOIN (SELECT s, count(*) AS m FROM pred GROUP BY s) b ON entity_id = b.s GROUP BY country"""
)
def country_table(w: World) -> DataFrame:
    return E.country_table(w.s1, w.pairs, D.decide(w.scored)).select("country", "n_s1", *r6("cands_per_s1", "matched_share", "matches_per_s1"))


@query()
def error_tags(w: World) -> DataFrame:
    """Tags of the errors of a rule that finds only some of the pairs of one name."""
    x = X.build_features(w.pairs, w.s1, w.pool, ("name_fuzzy", "name_tokens", "numeric", "address", "meta", "address_extra"))
    return E.error_tags(E.error_pairs(D.decide(w.scored), w.truth), x)


# ---- models ---------------------------------------------------------------------------------------------------------


def _training(w: World) -> tuple[DataFrame, tuple[str, ...]]:
    groups = ("blocking", "name_tokens", "numeric", "meta")
    names = tuple(X.feature_names(groups))
    return B.label_pairs(X.build_features(w.pairs, w.s1, w.pool, groups), w.truth), names


@query()
def two_stage(w: World) -> DataFrame:
    """The whole learned path on the record view: two stages, cross-fitted, calibrated and decoded.

    Pairs of one name stand for the truth, as equal texts are too few to learn from.
    """
    from . import pipeline

    true = B.exact_pass(w.s1, w.pool, "name_core", Q.MAX_GROUP).select(L, R)
    fold = SP.Fold(IO.stage_table(w.s1, "s1"), IO.stage_table(w.pool, "pool"), IO.stage_table(true, "truth"))
    return pipeline.run(fold, fold, pipeline.Config(kind="logreg", groups=("blocking", "name_tokens", "numeric", "meta")))[0]


@query()
def isotonic(w: World) -> DataFrame:
    rows = B.label_pairs(w.scored.select(L, R, "prob"), w.truth)
    return M.Isotonic().fit(rows).apply(rows).select(L, R, "prob")


@query()
def logreg(w: World) -> DataFrame:
    rows, names = _training(w)
    return M.Matcher(names, "logreg").fit(rows).predict(rows).select(L, R, "prob")


@query()
def gbt_crossfit(w: World) -> DataFrame:
    rows, names = _training(w)
    rows = IO.stage_table(rows, "training")
    models = M.cross_fit(rows, names, 2, max_iter=5, max_depth=3)
    return M.cross_predict(models, rows, rows).select(L, R, "prob")
