"""A store of pair features by side, on which models are fitted and compared without blocking or features being made again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import match as M
from ..operators import split as SP
from ..sources import tables as IO
from .pipeline import Config, candidates, prepare

L, R = "source1_entity_id", "entity_id"
#: What models learn from, what stops them, what rules are tuned on, and what is reported.
SIDES = ("fit", "stop", "tune", "val")
STOP_SHARE = 0.3  # of the tune side's entities, by hash
KEYS = (L, R, "country", "pass", "label")


@dataclass
class Snapshot:
    """Tables by side: ``rows`` (keys, country, pass, label, features), entities and truth."""

    store: IO.Store
    cfg: Config
    folds: dict[str, SP.Fold]

    @classmethod
    def build(cls, spark: SparkSession, folder: str, train: SP.Fold, val: SP.Fold, cfg: Config = Config()) -> Snapshot:
        """The snapshot of a configuration and two folds of normalised records, under ``folder`` by their common mark.

        Sides that are whole already are read, so a build that was cut off goes on. The pool of the inner sides is the train
        fold's: a rule is tuned among the decoys that it will meet.
        """
        tune, fit = SP.inner_split(train)
        stops = hash_unit(F.col("entity_id"), SP.FOLD) < STOP_SHARE
        own = lambda s1: train.truth.join(s1.select(F.col("entity_id").alias(L)), L, "left_semi")
        parts = {"fit": fit.s1, "stop": tune.s1.where(stops), "tune": tune.s1.where(~stops)}
        folds = {k: SP.Fold(s1, train.pool, own(s1)) for k, s1 in parts.items()} | {"val": val}
        marks = {k: tuple(IO.fingerprint(df, "entity_id").first()) for k, df in (("train", train.s1), ("pool", train.pool), ("val", val.s1), ("val-pool", val.pool))}
        snap = cls(IO.Store(spark, f"{folder.rstrip('/')}/{cfg.key()}", {"config": cfg.record(), "ids": marks}), cfg, folds)
        for side in SIDES:
            snap.rows(side)
        return snap

    def rows(self, side: str) -> DataFrame:
        if side not in self.folds:
            raise ValueError(f"unknown side {side!r}; known: {SIDES}")
        fold, store = self.folds[side], self.store.under(side)

        def build() -> DataFrame:
            s1, pool = prepare(fold.s1, fold.pool, self.cfg)
            pairs = candidates(fold, self.cfg, store)
            found = X.build_features(pairs, s1, pool, self.cfg.groups).select(L, R, *self.cfg.features)
            keyed = B.label_pairs(pairs.select(L, R, "pass"), fold.truth).join(s1.select(F.col("entity_id").alias(L), "country"), L)
            return keyed.join(found, [L, R]).select(*KEYS, *self.cfg.features)

        return store("rows", build)

    def features(self, side: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Keys and features; only the columns asked for are read."""
        return self.rows(side).select(L, R, *(columns or self.cfg.features))

    def meta(self, side: str) -> DataFrame:
        return self.rows(side).select(*KEYS)

    def labels(self, side: str) -> DataFrame:
        return self.rows(side).select(L, R, "label")

    def column(self, side: str, name: str) -> DataFrame:
        return self.rows(side).select(L, R, name)

    def s1(self, side: str) -> DataFrame:
        return self.folds[side].s1.select(F.col("entity_id").alias(L))

    def truth(self, side: str) -> DataFrame:
        return self.folds[side].truth

    def batches(self, side: str, columns: Sequence[str] | None = None, low: float = 0.0, high: float = 1.0) -> Iterator[Row]:
        """Rows of the entities in a hash range, partition by partition, for readers outside Spark."""
        rows = SP.hash_window(self.rows(side), F.col(L), low, high, SP.FOLD)
        return rows.select(*KEYS, *(columns or self.cfg.features)).toLocalIterator(prefetchPartitions=True)


def fit(snap: Snapshot, columns: Sequence[str] | None = None, kind: str = "gbt", negatives: M.HardNegatives | None = None, seeds: Sequence[int] = (42,), **params) -> M.Matcher | M.Ensemble:
    """A model of the fit side, or the mean of one per seed; boosted trees stop by the stop side."""
    columns = tuple(columns or snap.cfg.features)
    rows = snap.rows("fit")
    if negatives:
        rows = negatives.weigh(M.with_singleton(rows, snap.truth("fit"))).where("weight > 0")
    weight = [c for c in ("weight",) if c in rows.columns]
    rows = rows.select(L, R, *columns, "label", *weight)
    stop = None
    if kind == "gbt":
        more = snap.rows("stop").select(L, R, *columns, "label").withColumns({w: F.lit(1.0) for w in weight})
        rows, stop = rows.withColumn("_stop", F.lit(False)).unionByName(more.withColumn("_stop", F.lit(True))), "_stop"
    models = [M.Matcher(columns, kind, s, stop=stop, **params).fit(rows) for s in seeds]
    return models[0] if len(models) == 1 else M.Ensemble(models)


def columns_of(model: M.Matcher | M.Ensemble) -> tuple[str, ...]:
    return model.columns if isinstance(model, M.Matcher) else model.parts[0].columns


def score_side(snap: Snapshot, side: str, model: M.Matcher | M.Ensemble) -> DataFrame:
    """``source1_entity_id, entity_id, prob, label`` of a side, as a table."""
    scored = model.predict(snap.features(side, columns_of(model))).select(L, R, "prob")
    return IO.stage_table(scored.join(snap.labels(side), [L, R]), f"scored-{side}")


def evaluate(snap: Snapshot, model: M.Matcher | M.Ensemble, rules: Sequence[D.Rule] | None = None) -> tuple[D.Rule, DataFrame]:
    """The rule tuned on the tune side, and one row of the val side's scores under it.

    The row holds macro scores, pair precision and recall, and the model's rank, squared and logarithmic scores and calibration
    error.
    """
    rule, _ = D.tune(score_side(snap, "tune", model).select(L, R, "prob"), snap.s1("tune"), snap.truth("tune"), rules)
    val = score_side(snap, "val", model)
    scores = E.score_pairs(D.decide(val.select(L, R, "prob"), rule), snap.s1("val"), snap.truth("val"))
    table = E.reliability(val.withColumn("_key", F.concat_ws("|", L, R)), "prob", "label", "_key")
    for one in (E.auc(val), E.brier(val), M.log_loss(val), E.calibration(table)):
        scores = scores.withColumn(one.columns[0], one.scalar())
    return rule, scores


def second_round(snap: Snapshot, negatives: M.HardNegatives, columns: Sequence[str] | None = None, kind: str = "gbt", rules: Sequence[D.Rule] | None = None, **params) -> tuple[M.Matcher, dict]:
    """A second round of weights on what the first got wrong, kept only for its gain on the tune side."""
    columns = tuple(columns or snap.cfg.features)

    def gain(model: M.Matcher) -> float:
        scored = score_side(snap, "tune", model).select(L, R, "prob")
        return D.tune(scored, snap.s1("tune"), snap.truth("tune"), rules)[1].agg(F.max("f_beta")).first()[0]

    return M.fit_rounds(snap.rows("fit").drop("country", "pass"), snap.truth("fit"), columns, negatives, gain, kind, **params)
