"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contained_items
from .language_model import lm_scores
from .line_dedup import line_dedup
from .pieces import encode_decode, read_model
from .pii import pseudonymise
from .quality import quality_rules
from .secrets import secret_scan
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .url_filters import url_filter

_OWN_KEY = token_bytes(32)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("host", "text_hash", "boilerplate", "depleted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), read_model())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting ``spark.weftlink.pii.key``; without one, a key of this process alone, which nobody can reverse later."""
    key = spark.conf.get("spark.weftlink.pii.key", None)
    return pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else _OWN_KEY)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_rules,
        op3_line_dedup,
        op4_secret_scan,
        op5_simhash,
        op6_benchmark_containment,
        op7_sentencepiece,
        op8_url_filter,
        op9_lm_scores,
        op10_pii_pseudonyms,
    )
}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 12] AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE f < doc_id),
each AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op3_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_benchmark_containment": rf"""
WITH i AS (SELECT item_id, list_transform({_WORDS.format('"text"')}, lambda x: {_LOWER.format("x")}) AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(5, len(ws)) AS n FROM i WHERE len(ws) > 0),
si AS (SELECT DISTINCT item_id, n, ws[j:j + n - 1] AS s FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS j FROM sized)),
counts AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
d AS (SELECT doc_id, list_transform({_WORDS.format('"text"')}, lambda x: {_LOWER.format("x")}) AS ws FROM documents),
sd AS (SELECT DISTINCT doc_id, ws[j:j + n - 1] AS s FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM sized) WHERE len(ws) >= n))
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles FROM si JOIN sd USING (s) JOIN counts USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles""",
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, "source" AS host, coalesce("text", '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT doc_id, i, ws[i:i + 4] AS five FROM win),
twice AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS c FROM keyed) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id),
l AS (SELECT doc_id, host, len({_WORDS.format("line")}) AS n, {_KEY} AS k FROM (SELECT doc_id, host, unnest(ls) AS line FROM w)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY host),
above AS (SELECT host, k FROM l JOIN hosts USING (host) GROUP BY host, k, host_docs
  HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.01::DOUBLE * host_docs),
gone AS (SELECT doc_id, sum(n)::BIGINT AS n_line_words FROM l JOIN above USING (host, k) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_line_words, 0)::BIGINT AS n_line_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
  NOT base_failed AND NOT (n_words - n_line_words < 10 OR n_words - n_line_words < 0.3::DOUBLE * n_words) AS kept
FROM f""",
}
