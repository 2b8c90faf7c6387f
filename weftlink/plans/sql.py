"""The record view and the shared steps as DuckDB SQL, for the equivalents of queries."""

from __future__ import annotations

import re

MAX_GROUP, MAX_PER_S1, TOP_K = 20, 60, 5


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def nums(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: regexp_matches(x, '^[0-9]+$'))"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


def jaccard(a: str, b: str) -> str:
    i = inter(a, b)
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {i}::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b})) - {i}) END"


def hash_unit(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 15))::BIGINT / power(2, 60)::DOUBLE)"


def f05(tp: str = "tp", n_pred: str = "n_pred", n_true: str = "n_true") -> str:
    return f"(CASE WHEN {n_true} = 0 THEN CASE WHEN {n_pred} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN {tp} = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * {tp} / (0.25::DOUBLE * {n_true} + {n_pred}) END)"


def capped(keys: str, left: str, right: str, bit: int, some: str, cap: int = MAX_GROUP) -> str:
    return f"""SELECT DISTINCT l.entity_id AS s, r.entity_id AS e, {bit} AS bit, NULL::DOUBLE AS sim FROM (SELECT * FROM {left} WHERE {some}) l
  JOIN (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {right} WHERE {some}) r USING ({keys}) WHERE n <= {cap}"""


def grams(c: str, kind: str) -> str:
    if kind == "char":
        return f"flatten(list_transform({words(c)}, lambda t: list_transform(range(1, greatest(length(t) + 2 - 3 + 1, 1) + 1), lambda i: substr(' ' || t || ' ', i, 3))))"
    w = words(c)
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def topk(column: str, kind: str, k: int, min_sim: float, bit: int, name: str, where: str = "true", max_df: float = 0.02) -> dict[str, str]:
    """CTEs of a similarity join; the last, ``name``, has s, e, bit, sim."""
    return {
        f"{name}_rows": f"SELECT 1 AS side, country, entity_id AS id, {column} AS t FROM s1 UNION ALL SELECT 2, country, entity_id, {column} FROM pool WHERE {where}",
        f"{name}_n": f"SELECT country, count(*) AS n FROM {name}_rows GROUP BY country",
        f"{name}_tf": f"SELECT side, country, id, term, count(*) AS tf FROM (SELECT side, country, id, unnest({grams('t', kind)}) AS term FROM {name}_rows) GROUP BY ALL",
        f"{name}_idf": f"""SELECT country, term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM (SELECT country, term, count(*) AS df FROM {name}_tf GROUP BY ALL)
  JOIN {name}_n USING (country) WHERE df >= 2 AND df <= greatest({max_df}::DOUBLE * n, 2)""",
        f"{name}_raw": f"SELECT side, country, id, term, (1 + ln(tf)) * idf AS raw FROM {name}_tf JOIN {name}_idf USING (country, term)",
        f"{name}_w": f"SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, country, id)) AS w FROM {name}_raw",
        f"{name}_sim": f"""SELECT l.id AS s, r.id AS e, least(1.0::DOUBLE, round(sum(l.w * r.w), 6)) AS sim FROM (SELECT * FROM {name}_w WHERE side = 1) l
  JOIN (SELECT * FROM {name}_w WHERE side = 2) r USING (country, term) GROUP BY ALL""",
        name: f"SELECT s, e, {bit} AS bit, sim FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, e) AS rk FROM {name}_sim WHERE sim > {min_sim}) WHERE rk <= {k}",
    }


_ADDR = "trim((n_chars % 500)::VARCHAR || ' ' || array_to_string(w[5:12], ' '))"
_LAST = "list_filter(w[5:12], lambda x: NOT regexp_matches(x, '^[0-9]+$'))"
_COLUMNS = (
    "name_norm name_core name_first name_sorted name_squash legal_form addr_norm addr_nums postcode region addr_last addr_tokens non_latin addr_non_latin name_core_nofill"
).split()

CTES: dict[str, str] = {
    "raw": """SELECT doc_id, "text", lang, n_chars, regexp_extract_all(lower("text"), '[a-z0-9]+') AS w FROM documents""",
    "rec0": f"""SELECT 'S' || (1 + doc_id % 3)::VARCHAR || '-' || lpad(doc_id::VARCHAR, 6, '0') AS entity_id, (1 + doc_id % 3)::INT AS "source", lang AS country, "text",
  array_to_string(w[1:4], ' ') AS name_core, {_ADDR} AS addr_norm, array_to_string(list_sort(list_distinct(w[1:4])), ' ') AS name_sorted,
  array_to_string(w[1:4], '') AS name_squash, coalesce(w[1], '') AS name_first, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(w[4], '') END AS legal_form,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE lpad((n_chars % 100000)::VARCHAR, 5, '0') END AS postcode, lang AS region,
  array_to_string({_LAST}[greatest(len({_LAST}) - 1, 1):len({_LAST})], ' ') AS addr_last, doc_id % 7 = 0 AS non_latin, doc_id % 11 = 0 AS addr_non_latin,
  array_to_string(list_filter(w[1:4], lambda x: x NOT IN ('the', 'of', 'de', 'la', 'and')), ' ') AS name_core_nofill FROM raw""",
    "rec": f"""SELECT *, name_core AS name_norm, array_to_string({nums("addr_norm")}, ' ') AS addr_nums, len({words("addr_norm")}) AS addr_tokens,
  trim(name_core || ' ' || addr_norm) AS name_addr FROM rec0""",
    "s1": 'SELECT * FROM rec WHERE "source" = 1',
    "pool": 'SELECT * FROM rec WHERE "source" <> 1',
    "truth": """SELECT o.s, p.entity_id AS e FROM pool p JOIN (SELECT "text", min(entity_id) AS s FROM s1 GROUP BY "text") o USING ("text")""",
    "core": capped("country, name_core", "s1", "pool", 1, "name_core <> ''"),
    "sorted": capped("country, name_sorted", "s1", "pool", 2, "name_sorted <> ''"),
    "squash": capped("country, name_squash", "s1", "pool", 4, "name_squash <> ''"),
    "s1num": f"SELECT entity_id, country, name_core, unnest(list_distinct({nums('addr_nums')}[1:4])) AS num FROM s1",
    "poolnum": f"SELECT entity_id, country, name_core, unnest(list_distinct({nums('addr_nums')}[1:4])) AS num FROM pool",
    "namenum": capped("country, name_core, num", "s1num", "poolnum", 64, "name_core <> '' AND num <> ''"),
    **topk("name_addr", "word", TOP_K, 0.2, 16, "topword"),
    "united": """SELECT s, e, bit_or(bit) AS pass, max(CASE WHEN bit = 16 THEN sim END) AS sim FROM
  (SELECT * FROM core UNION ALL SELECT * FROM sorted UNION ALL SELECT * FROM squash UNION ALL SELECT * FROM namenum UNION ALL SELECT * FROM topword) GROUP BY s, e""",
    "cand": f"""SELECT s, e, pass, sim FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY (pass & 199) <> 0 DESC, coalesce(sim, 0) DESC, e) AS rk FROM united)
  WHERE rk <= {MAX_PER_S1}""",
    "al": f"""SELECT c.*, l.country, {", ".join(f"l.{x} AS {x}_l, r.{x} AS {x}_r" for x in _COLUMNS)} FROM cand c JOIN s1 l ON c.s = l.entity_id JOIN pool r ON c.e = r.entity_id""",
    "sc": f"""SELECT *, round(0.6::DOUBLE * CASE WHEN (pass & 7) <> 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(sim, 0.0::DOUBLE))) END
  + 0.4::DOUBLE * coalesce({jaccard(words("addr_norm_l"), words("addr_norm_r"))}, 0.0::DOUBLE), 6) AS prob FROM al""",
    "oto": "SELECT * FROM (SELECT s, e, prob, row_number() OVER (PARTITION BY e ORDER BY prob DESC, s) AS rp FROM sc) WHERE rp = 1",
    "rk": "SELECT *, max(prob) OVER (PARTITION BY s) AS p_max, row_number() OVER (PARTITION BY s ORDER BY prob DESC, e) AS rnk FROM oto",
    "pred": "SELECT s, e, prob FROM rk WHERE prob >= 0.5 AND p_max >= 0.5 AND rnk <= 11",
    "ec": """SELECT s1.entity_id AS s, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM s1
  LEFT JOIN (SELECT s, count(*) AS n_pred FROM (SELECT DISTINCT s, e FROM pred) GROUP BY s) p ON s1.entity_id = p.s
  LEFT JOIN (SELECT s, count(*) AS n_true FROM truth GROUP BY s) t ON s1.entity_id = t.s
  LEFT JOIN (SELECT s, count(*) AS tp FROM (SELECT DISTINCT s, e FROM pred) JOIN truth USING (s, e) GROUP BY s) b ON s1.entity_id = b.s""",
}


def sql(final: str, **extra: str) -> str:
    """``final`` behind the CTEs that it needs, in order."""
    known = CTES | extra
    names, need = list(known), set()

    def add(text: str) -> None:
        for name in names:
            if name not in need and re.search(rf"(?<![\w.'\"]){name}(?![\w'\"])", text):
                need.add(name)
                add(known[name])

    add(final)
    used = [f"{n} AS (\n{known[n]})" for n in names if n in need]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + final
