"""Every registered linkage query runs; those with SQL give its rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftlink.plans.queries import ORACLE_SQL, QUERIES
from weftlink.plans.records import World

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
#: Queries without SQL, and the tests that hold them.
HELD = {
    "feat_fuzzy_rest": "test_brute.py",
    "feat_interactions_fuzzy": "test_brute.py",
    "feat_phonetic": "test_brute.py",
    "anchor_scores": "test_brute.py",
    "rival_scores": "test_brute.py",
    "cohesion_scores": "test_brute.py",
    "error_tags": "test_brute.py",
    "norm_addresses": "test_whole_texts.py",
    "normalise_records": "test_whole_texts.py",
    "two_stage": "test_pipeline.py",
    "gbt_crossfit": "test_linkage.py",
    "logreg": "test_linkage.py",
    "isotonic": "test_linkage.py",
}
#: Of these, the ones whose models take long to fit.
SLOW = {"two_stage", "gbt_crossfit", "logreg", "isotonic"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [{c: plain(v) for c, v in r.asDict().items()} for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows and os.path.exists(os.path.join(os.path.dirname(__file__), HELD[name]))
        return
    found = con.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    want = [dict(zip(found.columns, map(plain, r), strict=True)) for r in found.fetchall()]
    key = lambda d: str(sorted((k, str(v)) for k, v in d.items()))
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_hot_key_never_meets_the_other_side(spark):
    """A plan of an exact pass has no product and reads four columns of the record table, with the filters at the scan."""
    plan = QUERIES["exact_core"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert read.startswith("struct<entity_id:string,source:int,country:string,name_core:string>") and "PushedFilters: [IsNotNull" in plan


def test_rules_never_meet_pairs_in_a_join(spark):
    """Rule evaluation shows no nested loop: pairs are aggregated over the thresholds they meet."""
    from weftlink.operators import decide as D

    w = World(spark, SF)
    seen = []
    gains = D._gains
    try:
        D._gains = lambda rows, axes: (seen.append(rows._jdf.queryExecution().toString()), gains(rows, axes))[1]
        table = D.evaluate_rules(w.scored, w.ids, w.truth, D.rule_table())
    finally:
        D._gains = gains
    assert table.count() == 3906 and seen and not any("NestedLoop" in p or "Cartesian" in p for p in seen)


def test_truth_shuffles_no_texts(spark, tmp_path):
    """Texts are compared by digest: null texts own nothing, and no exchange carries a text."""
    texts = ["a", "a", "a", None, None, "", "", "b", "a"]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    truth = World(spark, str(tmp_path)).truth
    assert sorted(map(tuple, truth.collect())) == [("S1-000000", "S2-000001"), ("S1-000000", "S3-000002"), ("S1-000000", "S3-000008"), ("S1-000006", "S3-000005")]
    lines = truth._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Join" in x and "text#" in x for x in lines) and not any("Aggregate" in x and "text#" in x for x in lines)


def test_record_table_holds_no_texts(spark, tmp_path):
    """A record's size does not grow with its text: of the words behind the twelfth only the digest stays."""
    rare = " ".join(map(str, range(20_000)))
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l {i} {rare}", "en", i) for i in range(8)], "doc_id long, text string, lang string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table = World(spark, str(tmp_path)).records
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles()) < 100_000
    assert "text" not in table.columns and table.select("text_key").distinct().count() == 8


#: Queries whose disk at 1 GB is in the README: of each document they keep the record view and a digest.
BOUND = [
    "house_number",
    "rival",
    "absent_anti",
    "anchor_scores",
    "best_scores",
    "class_means",
    "cohesion",
    "cohesion_scores",
    "competition",
    "decide_threshold",
    "decoy_groups",
    "error_samples",
    "error_tags",
    "feat_address",
    "feat_blocking",
    "feat_ctx_idf",
    "feat_idf",
    "feat_lev",
    "feat_numeric",
    "fit_fillers",
    "hard_negative_weights",
]


@pytest.mark.parametrize("name", BOUND)
def test_no_texts_on_disk(spark, name):
    """No table that the query's plan reads, in the shared folder or as input, has a column of whole texts."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "text#" not in plan


def test_evidence_of_parts_joins_no_pairs(spark):
    """The query spells its pairs out behind its last join."""
    plan = QUERIES["feat_tok_evidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[0].count("Generate explode(_ids_") == 2


#: Queries that read the candidates, or the join that makes them: no number of rows bounds a term of theirs.
UNBOUND = ["absent_anti", "best_scores", "class_means", "cohesion_scores", "competition", "decide_threshold", "feat_blocking", "feat_idf", "feat_lev", "feat_numeric", "rival", "topk_word"]


@pytest.mark.parametrize("name", UNBOUND)
def test_no_term_is_bounded_in_rows(spark, monkeypatch, tmp_path, name):
    """Every similarity join that the query makes has no bound in rows, as its SQL has none."""
    from weftlink.operators import blocking as B

    os.symlink(SF, tmp_path / "tables")
    seen, of = [], B.weighted_terms
    monkeypatch.setattr(B, "weighted_terms", lambda s1, pool, spec: (seen.append(spec), of(s1, pool, spec))[1])
    QUERIES[name](spark, f"{tmp_path}/tables")
    assert seen and all(spec.max_df_rows is None for spec in seen)
