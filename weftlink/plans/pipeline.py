"""The learned path end to end: stage 1 over all candidates, stage 2 over the kept ones, calibration, decoding, files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
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

L, R = "source1_entity_id", "entity_id"
STAGE2 = (
    "p1 s1_rank s1_best_other s1_gap s1_p1_sum s1_n_likely pool_rank pool_best_other pool_gap pool_p1_sum pool_n_likely pool_degree "
    "anc_p1 anc_addr_ts anc_addr_ratio anc_name_ts anc_nums_eq riv_addr_ts riv_name_ts riv_addr_gap coh_addr coh_name coh_support "
    "hn_eq hn_substr hn_onedigit hn_near hn_absdiff hn_missing grp_num_n grp_num_p1max grp_num_xsrc grp_s1num_n grp_name_n grp_name_p1max grp_addr_n "
    "uidf_max_l uidf_max_r uidf_sum_l uidf_sum_r uidf_share unum_conflict"
).split()


# Stage-1 columns without use in any stage, kept in their groups for models that read them.
ZERO_GAIN = ("sim_addr_char", "addr_empty_r", "addr_empty_l", "postcode_prefix_eq")


@dataclass(frozen=True)
class Config:
    blocking: B.BlockingConfig = field(default_factory=B.BlockingConfig)
    normalise: N.NormaliseConfig = N.DEFAULT
    groups: tuple[str, ...] = X.DEFAULT
    drop: tuple[str, ...] = ()  # feature columns to leave out
    kind: str = "gbt"
    folds: int = 2
    stage1_share: float = 0.5  # of the entities on the fit side, by hash
    floor: float = 0.01
    most: int = 16
    weights: tuple[float, ...] = (3.0,)  # what a false match may cost in decoding
    misses: tuple[float, ...] = (0.0, 0.2)
    select_weight: float = 3.0  # what it costs in choosing among them

    def __post_init__(self):
        if unknown := set(self.drop) - set(X.feature_names(self.groups)):
            raise ValueError(f"no features to drop: {sorted(unknown)}")

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(c for c in X.feature_names(self.groups) if c not in self.drop)

    def record(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def from_record(cls, d: dict) -> Config:
        tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        blocking = tuples(d["blocking"]) | {"spaces": tuple(B.TopK(**x) for x in d["blocking"]["spaces"])}
        return cls(**tuples(d) | {"blocking": B.BlockingConfig(**blocking), "normalise": N.NormaliseConfig(**d["normalise"])})

    def key(self) -> str:
        """A mark of the configuration, for names of kept tables."""
        return hashlib.sha256(json.dumps(self.record(), sort_keys=True).encode()).hexdigest()[:12]


def store_for(spark: SparkSession, cfg: Config, folder: str | None = None, *folds: SP.Fold) -> IO.Store:
    """Where a run keeps its tables; those of another configuration, or of folds with other ids, are refused."""
    marks = [tuple(IO.fingerprint(df, "entity_id").first()) for f in folds for df in (f.s1, f.pool)] if folder else []
    return IO.Store(spark, folder, {"config": cfg.record(), "ids": marks})


def prepare(s1: DataFrame, pool: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Both sides with the frequencies that features read."""
    return ST.add_frequencies(s1, pool) if "frequency" in cfg.groups else (s1, pool)


def candidates(fold: SP.Fold, cfg: Config, store: IO.Store) -> DataFrame:
    """Candidate pairs with their country, as a table in folders by country."""
    own = fold.s1.select(F.col("entity_id").alias(L), "country")
    return store("candidates", lambda: B.block(fold.s1, fold.pool, cfg.blocking).join(own, L), by="country").drop("country")


def stage1_rows(fold: SP.Fold, cfg: Config, store: IO.Store) -> DataFrame:
    """Candidates with stage-1 features, as a table: training and scoring read them."""
    s1, pool = prepare(fold.s1, fold.pool, cfg)
    return store("stage1", lambda: X.build_features(candidates(fold, cfg, store), s1, pool, cfg.groups).select(L, R, *cfg.features))


def stage2_rows(scored: DataFrame, fold: SP.Fold, cfg: Config, store: IO.Store) -> DataFrame:
    """Kept candidates with stage-2 features. Competition counts every candidate, anchors and cohesion the kept ones."""
    every = store("scored", lambda: scored.select(L, R, "p1"))
    kept = store("kept", lambda: C.keep(every, "p1", cfg.floor, cfg.most).select(L, R, "p1"))

    def build() -> DataFrame:
        own = ("name_core", "addr_norm", "addr_nums")
        side = lambda df, k, s: df.select(F.col("entity_id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in own])
        rows = kept.join(side(fold.s1, L, "l"), L).join(side(fold.pool, R, "r"), R)
        rows = IO.stage_table(C.group_features(rows), "groups")
        rows = IO.stage_table(C.unmatched_idf(rows, IO.stage_table(ST.idf_table(fold.pool), "idf")), "decoys")
        rows = rows.withColumns(C.house_numbers(F.col("addr_nums_l"), F.col("addr_nums_r"))).withColumn("unum_conflict", C.number_conflict(F.col("addr_nums_l"), F.col("addr_nums_r")))
        for more in (C.competition(every).drop("p1"), C.anchors(kept, fold.pool), C.rivals(every, fold.s1, fold.pool), C.cohesion(kept, fold.pool)):
            rows = rows.join(IO.stage_table(more, "rivalry"), [L, R])
        return rows.select(L, R, *STAGE2)

    return store("stage2", build)


@dataclass
class Fitted:
    """Everything that a run learns: both stages, calibration, and the decoder's cost of a false match and expected misses."""

    cfg: Config
    stage1: M.Matcher
    stage2: list[M.Matcher]
    calibration: M.Isotonic
    weight: float
    miss: float
    fillers: list[str] = field(default_factory=list)
    token_map: dict[str, str] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes models first and the record last, so that a folder with a record is whole."""
        self.stage1.save(f"{path}/stage1")
        for i, m in enumerate(self.stage2):
            m.save(f"{path}/stage2-{i}")
        self.calibration.save(f"{path}/calibration")
        record = {"config": self.cfg.record(), "stage2": len(self.stage2), "weight": self.weight, "miss": self.miss, "fillers": self.fillers, "token_map": self.token_map}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        d = json.loads(spark.read.text(f"{path}/record").first()["value"])
        stage2 = [M.Matcher.load(f"{path}/stage2-{i}") for i in range(d["stage2"])]
        return cls(Config.from_record(d["config"]), M.Matcher.load(f"{path}/stage1"), stage2, M.Isotonic.load(f"{path}/calibration"), d["weight"], d["miss"], d["fillers"], d["token_map"])


def _first(cfg: Config):
    """The share of entities that stage 1 is fitted on."""
    return hash_unit(F.col(L), SP.SAMPLE) < cfg.stage1_share


def choose_decoder(even: DataFrame, ids: DataFrame, truth: DataFrame, cfg: Config) -> tuple[float, float, DataFrame]:
    """The weight and misses of best tight score on some entities, and the table of all tried; ties go to the first tried."""
    table = IO.stage_table(D.tight_table(even, ids, truth, cfg.weights, cfg.misses, cfg.select_weight), "decoders")
    best = table.orderBy(F.desc(F.round("tight", 12)), "place").first()
    return best["weight"], best["miss"], table


def fit(train: SP.Fold, cfg: Config, store: IO.Store | None = None) -> Fitted:
    """Stage 1 on a hash share of the fit side, stage 2 cross-fitted on the rest, calibration and decoding on the tune side."""
    store = store or IO.Store(train.s1.sparkSession)
    x1 = store("labelled1", lambda: B.label_pairs(stage1_rows(train, cfg, store), train.truth))
    tune = SP.val_mask(F.col(L), 0.25, SP.TUNE)
    stage1 = M.Matcher(cfg.features, cfg.kind).fit(x1.where(~tune & _first(cfg)))
    x2 = store("labelled2", lambda: B.label_pairs(stage2_rows(stage1.predict(x1.drop("label"), "p1"), train, cfg, store), train.truth))
    rest = x2.where(~tune & ~_first(cfg))
    models = M.cross_fit(rest, STAGE2, cfg.folds, cfg.kind)
    held = M.cross_predict(models, x2.drop("label"), rest).select(L, R, "prob").where(tune)
    held = IO.stage_table(D.one_to_one(held), "held")
    calibration = M.Isotonic().fit(B.label_pairs(held, train.truth))
    even = IO.stage_table(calibration.apply(held), "even")
    ids = train.s1.select(F.col("entity_id").alias(L)).where(tune)
    weight, miss, _ = choose_decoder(even, ids, train.truth.join(ids, L, "left_semi"), cfg)
    return Fitted(cfg, stage1, models, calibration, weight, miss)


def score(fold: SP.Fold, fitted: Fitted, store: IO.Store | None = None) -> DataFrame:
    """Calibrated probabilities of a fold's kept candidates."""
    store = store or IO.Store(fold.s1.sparkSession)
    cfg = fitted.cfg
    scored = fitted.stage1.predict(stage1_rows(fold, cfg, store), "p1")
    x2 = stage2_rows(scored, fold, cfg, store)
    none = fold.s1.select(F.col("entity_id").alias(L)).limit(0)
    return store("final", lambda: fitted.calibration.apply(M.cross_predict(fitted.stage2, x2, none).select(L, R, "prob")))


def decode(scored: DataFrame, fitted: Fitted) -> DataFrame:
    return D.decode_tight(scored, fitted.weight, fitted.miss, single=True)


def run(train: SP.Fold, test: SP.Fold, cfg: Config = Config(), folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, scored) of a test fold from a train fold; records are normalised already. ``folder`` makes the run resumable."""
    store = store_for(train.s1.sparkSession, cfg, folder, train, test)
    fitted = fit(train, cfg, store.under("train"))
    scored = score(test, fitted, store.under("test"))
    return decode(scored, fitted), scored


def part(fold: SP.Fold, roles: DataFrame, role: str) -> SP.Fold:
    """The entities of a role with their truth; the pool stays whole, as it is what they are told apart from."""
    s1 = fold.s1.join(roles.where(F.col("role") == role).select("entity_id"), "entity_id", "left_semi")
    return SP.Fold(s1, fold.pool, fold.truth.join(s1.select(F.col("entity_id").alias(L)), L, "left_semi"))


def tune_mock(scored: DataFrame, mock: SP.Fold, roles: DataFrame, rules: Sequence[D.Rule] | None = None, fp_weight: float = 1.0) -> tuple[D.Rule, DataFrame]:
    """The best rule on the mock fold's tune entities; scores went through the one-to-one step, so every rule must keep it."""
    rules = D.rule_table() if rules is None else rules
    if not all(r.one_to_one for r in rules):
        raise ValueError("the scores are one-to-one already: every rule must be")
    tune = part(mock, roles, "tune")
    ids = tune.s1.select(F.col("entity_id").alias(L))
    return D.tune(scored.join(ids, L, "left_semi"), ids, tune.truth, rules, fp_weight)


def mock_scores(scored: DataFrame, mock: SP.Fold, roles: DataFrame, rule: D.Rule | D.ExpectedRule, role: str = "val") -> DataFrame:
    """``slice`` (all, then each country) with the scores of a rule on a role's entities, tight score and estimate included."""
    own = part(mock, roles, role)
    ids = own.s1.select(F.col("entity_id").alias(L), "country")
    counts = IO.stage_table(E.entity_counts(D.apply_rule(scored.join(ids, L, "left_semi"), rule), ids, own.truth).join(ids, L), "mock")
    rows = counts.withColumn("slice", F.explode(F.array(F.lit("all"), F.col("country"))))
    c = F.col("tp"), F.col("n_pred"), F.col("n_true")
    tight = F.avg(E.tight(*c, E.FP_WEIGHT))
    return rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_s1"),
        F.avg(D.f_beta(*c)).alias("f05"),
        F.try_divide(F.sum("tp"), F.sum("n_pred")).alias("precision"),
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("recall"),
        tight.alias("f_tight"),
        (tight - E.PUBLIC_OFFSET).alias("est_public"),
    )


def load(spark: SparkSession, folder: str, cfg: Config, store: IO.Store | None = None) -> SP.Fold:
    """A fold from ``source1.tsv``, ``source2.tsv``, ``source3.tsv`` and, where there is one, ``truth.tsv``."""
    store = store or IO.Store(spark)
    build = lambda k: N.normalise_records(IO.check_source(IO.read_tsv(spark, f"{folder}/source{k}.tsv"), k), cfg.normalise)
    parts = [store(f"records-{k}", lambda k=k: build(k), by="country") for k in (1, 2, 3)]
    try:
        truth = IO.stage_table(IO.truth_pairs(IO.read_tsv(spark, f"{folder}/truth.tsv", IO.TRUTH)), "truth")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        truth = spark.createDataFrame([], IO.PAIR)
    return SP.Fold(parts[0], parts[1].unionByName(parts[2]), truth)


def learnt(train: SP.Fold, store: IO.Store) -> tuple[list[str], dict[str, str], DataFrame]:
    """(fillers, token map, evidence of words) of a train fold, each a small table that is learnt once."""
    fillers = store("fillers", lambda: LN.fit_fillers(train.truth, train.s1, train.pool))
    words = store("token-map", lambda: LN.fit_token_map(train.truth, train.s1, train.pool))
    evidence = store("evidence", lambda: LN.fit_evidence(train.s1, train.pool, train.truth))
    return LN.as_list(fillers), LN.as_map(words), evidence


def _dressed(fold: SP.Fold, fillers: list[str], token_map: dict[str, str], cfg: Config) -> SP.Fold:
    """A fold whose names went through the learnt token map, with the names less fillers."""
    s1, pool = (N.add_nofill(N.apply_token_map(df, token_map, cfg.normalise), fillers) for df in (fold.s1, fold.pool))
    return SP.Fold(s1, pool, fold.truth)


def fit_files(spark: SparkSession, train_dir: str, model_dir: str, cfg: Config = Config(), work: str | None = None) -> Fitted:
    """The first stage of a linkage: learns from a train folder and writes what it learnt."""
    store = IO.Store(spark, work and f"{work}/fit", {"config": cfg.record(), "from": train_dir})
    train = load(spark, train_dir, cfg, store)
    fillers, token_map, _ = learnt(train, store)
    fitted = fit(_dressed(train, fillers, token_map, cfg), cfg, store)
    fitted = replace(fitted, fillers=fillers, token_map=token_map)
    fitted.save(spark, model_dir)
    return fitted


def apply_files(spark: SparkSession, model_dir: str, test_dir: str, out_dir: str, work: str | None = None) -> DataFrame:
    """The second stage: scores a test folder with what was learnt, writes both lists, returns their check."""
    fitted = Fitted.load(spark, model_dir)
    store = IO.Store(spark, work and f"{work}/apply", {"config": fitted.cfg.record(), "from": test_dir, "model": model_dir})
    test = _dressed(load(spark, test_dir, fitted.cfg, store), fitted.fillers, fitted.token_map, fitted.cfg)
    scored = score(test, fitted, store)
    ids = test.s1.select(F.col("entity_id").alias(L))
    matches = store("matches", lambda: decode(scored, fitted))
    IO.write_submission(matches, scored, ids, out_dir)
    return IO.validate(IO.id_lists(matches, ids), IO.id_lists(scored, ids), ids, test.pool)


def link(spark: SparkSession, train_dir: str, test_dir: str, out_dir: str, cfg: Config = Config(), work: str | None = None) -> DataFrame:
    """Files to files, both stages; models go beside the lists."""
    fit_files(spark, train_dir, f"{out_dir}/model", cfg, work)
    return apply_files(spark, f"{out_dir}/model", test_dir, out_dir, work)
