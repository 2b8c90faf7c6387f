"""Files to files on a generated world with decoys."""

import random
import re
from dataclasses import replace

import pytest

from weftlink.__main__ import main
from weftlink.operators import blocking as B
from weftlink.operators import decide as D
from weftlink.operators import evaluate as E
from weftlink.operators import features as X
from weftlink.operators import match as M
from weftlink.operators import split as SP
from weftlink.plans import pipeline, snapshot

WORDS = "acme globex initech umbra vertex lumen cobalt delta falcon harbor ivory juniper kestrel lotus maple nimbus onyx prism quartz raven".split()


def world(folder, seed, n=90):
    r = random.Random(seed)
    files = {1: [], 2: [], 3: []}
    truth = []
    for i in range(n):
        country = r.choice(["US", "India"])
        name, number = " ".join(r.sample(WORDS, 2)), r.randint(1, 900)
        street = f"{r.choice(WORDS)} street"
        files[1].append((f"S1-{i}", f"{name.title()} Inc", f"{number} {street}, Springfield", country))
        own = []
        for k in (2, 3):
            if r.random() < 0.6:
                own.append(f"S{k}-{i}")
                files[k].append((own[-1], f"{name} services" if r.random() < 0.3 else f"{name} Incorporated", f"{number} {street.replace('street', 'St')}", country))
            if r.random() < 0.35:
                files[k].append((f"S{k}-9{i:04d}", f"{name} holdings", f"{number + r.randint(30, 90)} {r.choice(WORDS)} road", country))
        truth.append((f"S1-{i}", ",".join(own)))
    folder.mkdir()
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for k, rows in files.items():
        (folder / f"source{k}.tsv").write_text(head + "".join("\t".join(x) + "\n" for x in rows))
    (folder / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))


CFG = pipeline.Config(kind="logreg", groups=("blocking", "name_tokens", "numeric", "meta"))


def test_config_roundtrip():
    cfg = pipeline.Config(kind="logreg", groups=("address", "meta"), drop=("addr_empty_r",), weights=(1.0, 3.0))
    assert pipeline.Config.from_record(cfg.record()) == cfg and "addr_empty_r" not in cfg.features
    assert set(pipeline.ZERO_GAIN) <= set(X.feature_names([g for g in X.REGISTRY]))
    with pytest.raises(ValueError, match="no features"):
        pipeline.Config(drop=("nope",))


def test_stages_can_be_run_apart_and_again(spark, tmp_path, monkeypatch, capsys):
    """What was fitted is saved and read back and links well; a second run reads the kept tables; another configuration is refused."""
    world(tmp_path / "train", 1)
    world(tmp_path / "test", 2, 40)
    work, model, out = (str(tmp_path / x) for x in ("work", "model", "out"))
    fitted = pipeline.fit_files(spark, str(tmp_path / "train"), model, CFG, work)
    again = pipeline.Fitted.load(spark, model)
    assert (again.cfg, again.weight, again.miss, again.fillers, again.token_map) == (CFG, fitted.weight, fitted.miss, fitted.fillers, fitted.token_map)
    problems = {r["rule"]: r["problems"] for r in pipeline.apply_files(spark, model, str(tmp_path / "test"), out, work).collect()}
    assert not any(problems.values())
    files = sorted((tmp_path / "out" / "matches").glob("part-*"))
    (tmp_path / "pred.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(line + "\n" for f in files for line in f.read_text().splitlines()[1:]))
    assert main(["score", str(tmp_path / "pred.tsv"), str(tmp_path / "test" / "truth.tsv")]) == 0
    assert float(re.search(r"'f05': ([0-9.]+)", capsys.readouterr().out)[1]) > 0.85
    assert main(["verify", str(tmp_path / "pred.tsv"), str(tmp_path / "pred.tsv")]) == 0
    monkeypatch.setattr(B, "block", lambda *a: pytest.fail("candidates are kept"))
    pipeline.fit_files(spark, str(tmp_path / "train"), model, CFG, work)
    pipeline.apply_files(spark, model, str(tmp_path / "test"), out, work)
    with pytest.raises(ValueError, match="another configuration"):
        pipeline.fit_files(spark, str(tmp_path / "train"), model, replace(CFG, floor=0.5), work)


def test_mock_tuning(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "US" if i % 2 else "India") for i in range(40)], "entity_id string, country string")
    pool = spark.createDataFrame([(f"S2-{i}", "US") for i in range(40)], "entity_id string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(0, 40, 2)] + [("S1-39", "S2-39")], "source1_entity_id string, entity_id string")
    fold = SP.Fold(s1, pool, truth)
    roles = spark.createDataFrame([(f"S1-{i}", ("tune", "val", "fit")[i % 3]) for i in range(40)], "entity_id string, role string")
    scored = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", 0.8 if i % 2 == 0 else 0.4) for i in range(40)], "source1_entity_id string, entity_id string, prob double")
    rule, _ = pipeline.tune_mock(scored, fold, roles, D.rule_table((0.3, 0.5, 0.7), (0.0,), (0.0,), (4,)))
    assert 0.4 < rule.tau_abs <= 0.8
    with pytest.raises(ValueError, match="one-to-one"):
        pipeline.tune_mock(scored, fold, roles, [D.Rule(one_to_one=False)])
    rows = {r["slice"]: r for r in pipeline.mock_scores(scored, fold, roles, D.Rule(0.3, 0, 0.3)).collect()}
    own = E.score_pairs(D.decide(scored, D.Rule(0.3, 0, 0.3)), pipeline.part(fold, roles, "val").s1.selectExpr("entity_id AS source1_entity_id"), truth).first()
    assert set(rows) == {"all", "US", "India"} and rows["all"]["n_s1"] == own["n_s1"] == rows["US"]["n_s1"] + rows["India"]["n_s1"]
    assert rows["all"]["f05"] == pytest.approx(own["f05"]) and rows["all"]["est_public"] == pytest.approx(rows["all"]["f_tight"] - E.PUBLIC_OFFSET)
    assert rows["India"]["f05"] == 1.0


def test_snapshot(spark, tmp_path):
    """Features are made once; models are fitted, stopped, weighed, tuned and reported on their sides."""
    world(tmp_path / "train", 1, 160)
    world(tmp_path / "val", 3, 60)
    train, val = (pipeline.load(spark, str(tmp_path / k), CFG) for k in ("train", "val"))
    snap = snapshot.Snapshot.build(spark, str(tmp_path / "snap"), train, val, CFG)
    sides = {k: {r[0] for r in snap.s1(k).collect()} for k in snapshot.SIDES}
    assert not sides["fit"] & (sides["stop"] | sides["tune"]) and not sides["stop"] & sides["tune"] and len(set.union(*(sides[k] for k in ("fit", "stop", "tune")))) == 160
    assert snap.features("fit", ["tok_jaccard"]).columns == ["source1_entity_id", "entity_id", "tok_jaccard"]
    assert snap.meta("val").columns == list(snapshot.KEYS) and snap.column("val", "num_jaccard").count() == snap.labels("val").count()
    some = [r["source1_entity_id"] for r in snap.batches("fit", ["tok_jaccard"], 0.0, 0.5)]
    rest = [r["source1_entity_id"] for r in snap.batches("fit", ["tok_jaccard"], 0.5, 1.0)]
    assert len(some) + len(rest) == snap.labels("fit").count() and not set(some) & set(rest)
    with pytest.raises(ValueError, match="unknown side"):
        snap.rows("test")
    model = snapshot.fit(snap, kind="logreg", negatives=M.HardNegatives(("singleton_decoy",)))
    rules = D.rule_table((0.3, 0.5, 0.7), (0.0, 0.6), (0.0,), (4,))
    rule, row = snapshot.evaluate(snap, model, rules)
    row = row.first()
    assert row["f05"] > 0.8 and row["auc"] > 0.8 and 0 <= row["brier"] < 0.2 and row["ece"] < 0.3 and rule.max_matches == 4
    both = snapshot.fit(snap, kind="gbt", seeds=(1, 2), max_iter=4, max_depth=3)
    assert isinstance(both, M.Ensemble) and snapshot.score_side(snap, "val", both).count() == snap.labels("val").count()
    chosen, info = snapshot.second_round(snap, M.HardNegatives(fp_weight=3.0), kind="logreg", rules=rules)
    assert info["round2_kept"] == (info["tune_round2"] >= info["tune_round1"] + M.ROUND2_MARGIN) and isinstance(chosen, M.Matcher)
    again = snapshot.Snapshot.build(spark, str(tmp_path / "snap"), train, val, CFG)
    assert again.rows("val").count() == snap.rows("val").count()


def test_bags_caps_and_stopping(spark):
    r = random.Random(2)
    rows = [(f"s{i // 4}", f"p{i}", float(i % 4 == 0) + r.random(), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "source1_entity_id string, entity_id string, f double, label int")
    bags = M.fit_bags(df, ("f",), 2, "logreg")
    assert len(bags.parts) == 2 and bags.predict(df).count() == 400 and bags.importance()["f"] == pytest.approx(1)
    kept = M.capped_rows(df, 100)
    assert 20 < kept.count() < 200 and kept.groupBy("source1_entity_id").count().where("count <> 4").count() == 0
    stopped = M.fit_stopping(df, ("f",), max_iter=10, max_depth=2)
    assert stopped.model.stages[-1].getNumTrees <= 10 and stopped.predict(df).count() == 400
    scored = df.selectExpr("source1_entity_id", "entity_id", "least(f, 1.0) AS prob")
    truth = df.where("label = 1").select("source1_entity_id", "entity_id")
    wrong, lost = M.false_positives(scored, truth, 0.5), M.near_misses(scored, truth, 1.1)
    assert wrong.where("label = 1 OR prob < 0.5").count() == 0 and lost.count() == 100
