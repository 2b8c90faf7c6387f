"""Scorers of pairs: a heuristic in plain expressions, and models of pyspark.ml behind one class."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fold_of, hash_unit
from .blocking import label_pairs

L, R = "source1_entity_id", "entity_id"


def heuristic() -> Column:
    """1 for keyed pairs, else the best similarity (none: 0), within [0, 1]."""
    best = F.greatest(F.lit(0.0), *[F.col(s).cast("double") for s in ("sim_name_char", "sim_name_addr_word", "sim_addr_char")])
    return F.when(F.col("pass_exact") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0))))


def check_features(df: DataFrame, columns: Sequence[str]) -> None:
    """The columns a model was fitted on, in that order, and nothing else but keys and targets."""
    own = [c for c in df.columns if c not in (L, R, "label", "weight", "fold", "prob", "country", "pass")]
    if own != list(columns):
        raise ValueError(f"the model needs the features {list(columns)}, not {own}")


def _filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undefined values as -1 beside a flag that says so."""
    values = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns}
    return df.withColumns(values | {f"_m_{c}": F.col(c).isNull().cast("double") for c in columns})


@dataclass
class Matcher:
    """``kind``: heuristic, logreg or gbt. Fits on ``label`` (and ``weight``), scores into ``prob``."""

    columns: tuple[str, ...]
    kind: str = "gbt"
    seed: int = 42
    max_iter: int = 20
    max_depth: int = 5
    model: PipelineModel | None = field(default=None)
    stop: str | None = None  # the column that marks rows which only say when to stop

    def fit(self, df: DataFrame) -> Matcher:
        check_features(df.drop(self.stop) if self.stop else df, self.columns)
        if self.kind == "heuristic":
            return self
        inputs = [f"{p}_{c}" for c in self.columns for p in ("_x", "_m")]
        steps = [VectorAssembler(inputCols=inputs, outputCol="_v")]
        weight = {"weightCol": "weight"} if "weight" in df.columns else {}
        if self.kind == "logreg":
            steps += [StandardScaler(inputCol="_v", outputCol="_f", withMean=True), LogisticRegression(featuresCol="_f", labelCol="label", regParam=1e-3, **weight)]
        elif self.kind == "gbt":
            stop = {"validationIndicatorCol": self.stop} if self.stop else {}
            steps.append(GBTClassifier(featuresCol="_v", labelCol="label", seed=self.seed, maxIter=self.max_iter, maxDepth=self.max_depth, **weight, **stop))
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        self.model = Pipeline(stages=steps).fit(_filled(df.withColumn("label", F.col("label").cast("double")), self.columns))
        return self

    def predict(self, df: DataFrame, name: str = "prob") -> DataFrame:
        check_features(df, self.columns)
        return self.score(df, name)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, whatever further columns it has, with the probability as ``name``: one projection, no join."""
        if self.kind == "heuristic":
            return df.withColumn(name, heuristic())
        out = self.model.transform(_filled(df, self.columns))
        return out.withColumn("_p", vector_to_array("probability")[1]).select(*df.columns, F.col("_p").alias(name))

    def importance(self) -> dict[str, float]:
        """Share of each feature, its flag included."""
        last = self.model.stages[-1]
        raw = last.featureImportances.toArray() if self.kind == "gbt" else abs(last.coefficients.toArray())
        whole = raw.sum() or 1.0
        return {c: float((raw[2 * i] + raw[2 * i + 1]) / whole) for i, c in enumerate(self.columns)}

    def save(self, path: str) -> None:
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        _session().createDataFrame([(list(self.columns), self.kind, self.seed)], "columns array<string>, kind string, seed int").coalesce(1).write.mode("overwrite").json(f"{path}/matcher")

    @classmethod
    def load(cls, path: str) -> Matcher:
        row = _session().read.schema("columns array<string>, kind string, seed int").json(f"{path}/matcher").first()
        model = None if row["kind"] == "heuristic" else PipelineModel.load(f"{path}/model")
        return cls(tuple(row["columns"]), row["kind"], row["seed"], model=model)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


@dataclass
class Ensemble:
    """The mean of several matchers."""

    parts: list[Matcher]

    def predict(self, df: DataFrame, name: str = "prob") -> DataFrame:
        check_features(df, self.parts[0].columns)
        out = df
        for i, m in enumerate(self.parts):
            out = m.score(out, f"_p{i}")
        mean = sum((F.col(f"_p{i}") for i in range(1, len(self.parts))), F.col("_p0")) / len(self.parts)
        return out.withColumn(name, mean).drop(*[f"_p{i}" for i in range(len(self.parts))])

    def importance(self) -> dict[str, float]:
        each = [m.importance() for m in self.parts]
        return {c: sum(e[c] for e in each) / len(each) for c in each[0]}


def cross_fit(train: DataFrame, columns: Sequence[str], folds: int = 2, kind: str = "gbt", **params) -> list[Matcher]:
    """A model per fold of entities, fitted on the other folds."""
    parts = train.withColumn("fold", fold_of(F.col(L), folds))
    return [Matcher(tuple(columns), kind, **params).fit(parts.where(F.col("fold") != f).drop("fold")) for f in range(folds)]


def cross_predict(models: Sequence[Matcher], df: DataFrame, train_ids: DataFrame, name: str = "prob") -> DataFrame:
    """Training entities are scored by the model that has not seen them, others by the mean of all."""
    check_features(df, models[0].columns)
    out = df
    for i, m in enumerate(models):
        out = m.score(out, f"_p{i}")
    ids = train_ids.select(L).distinct().withColumn("_seen", F.lit(True))
    fold = fold_of(F.col(L), len(models))
    mean = sum((F.col(f"_p{i}") for i in range(1, len(models))), F.col("_p0")) / len(models)
    own = F.coalesce(*[F.when(F.col("_seen") & (fold == i), F.col(f"_p{i}")) for i in range(len(models))], mean)
    return out.join(ids, L, "left").withColumn(name, own).drop("_seen", *[f"_p{i}" for i in range(len(models))])


class Isotonic:
    """Calibration by isotonic regression; values beyond the fitted range are clamped."""

    def fit(self, rows: DataFrame, prob: str = "prob", label: str = "label") -> Isotonic:
        data = rows.select(F.col(prob).cast("double").alias("_f"), F.col(label).cast("double").alias("_l"))
        self.model = IsotonicRegression(featuresCol="_f", labelCol="_l", predictionCol="_c").fit(data)
        return self

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Isotonic:
        own = cls()
        own.model = IsotonicRegressionModel.load(path)
        return own

    def apply(self, rows: DataFrame, prob: str = "prob") -> DataFrame:
        out = self.model.transform(rows.withColumn("_f", F.col(prob).cast("double")))
        return out.withColumn(prob, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_c")))).drop("_f", "_c")


def log_loss(rows: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    return rows.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


# Kinds of hard negatives and their conditions, and what makes a negative easy.
MINED = {
    "same_name_diff_addr": "core_eq = 1 AND ad_jaccard < 0.2",
    "same_addr_diff_name": "ad_token_set >= 0.9 AND core_token_set < 0.5",
    "top_cosine_nonmatch": "ctx_rank_name = 1",
    "singleton_decoy": "singleton",
}
EASY = "sim_name_char < 0.5 AND ad_jaccard < 0.1 AND NOT singleton"
ROUND2_MARGIN = 0.002
KINDS = tuple(MINED)


def mined(kind: str) -> Column:
    """Whether a pair is a hard negative of a kind; needs ``label, singleton`` and the features that its condition reads."""
    if kind not in MINED:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    return F.coalesce((F.col("label") == 0) & F.expr(MINED[kind]), F.lit(False))


def easy_negative() -> Column:
    """Negatives that both similarities call distant; never a singleton's, never where one is undefined."""
    return F.coalesce((F.col("label") == 0) & F.expr(EASY), F.lit(False))


def false_positives(scored: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows scored ``threshold`` or more that are no true pairs, ``label`` 0."""
    return label_pairs(scored, truth).where((F.col("prob") >= threshold) & (F.col("label") == 0))


def near_misses(scored: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """True pairs scored under ``threshold``, ``label`` 1."""
    return label_pairs(scored, truth).where((F.col("prob") < threshold) & (F.col("label") == 1))


def with_singleton(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Marks candidates of entities that have no true pair."""
    owners = truth.select(L).distinct().withColumn("_owner", F.lit(True))
    return pairs.join(owners, L, "left").withColumn("singleton", F.col("_owner").isNull()).drop("_owner")


def hard_negative_weights(
    pairs: DataFrame,
    kinds: Sequence[str] = (),
    rule_weight: float = 3.0,
    singleton_weight: float = 1.0,
    easy_keep: float = 1.0,
    fp_weight: float = 1.0,
    miss_weight: float = 1.0,
    seed: int = 7,
    threshold: float = 0.5,
) -> DataFrame:
    """``weight`` of each pair.

    One; 0 for easy negatives outside a hash sample of ``easy_keep``; at least ``rule_weight`` for mined kinds and
    ``singleton_weight`` for candidates of singletons. With a first round's ``prob``, false positives and near misses then
    gain their weights less one.
    """
    base = F.lit(1.0)
    if easy_keep < 1:
        kept = hash_unit(F.concat_ws("|", L, R), seed) < easy_keep
        base = F.when(easy_negative() & ~kept, 0.0).otherwise(1.0)
    for kind in kinds:
        base = F.when(mined(kind), F.greatest(base, F.lit(rule_weight))).otherwise(base)
    if singleton_weight > 1:
        base = F.when(F.col("singleton"), F.greatest(base, F.lit(singleton_weight))).otherwise(base)
    if "prob" in pairs.columns:
        wrong, lost = (F.col("label") == 0) & (F.col("prob") >= threshold), (F.col("label") == 1) & (F.col("prob") < threshold)
        base = base + F.when(wrong, fp_weight - 1).when(lost, miss_weight - 1).otherwise(0.0)
    return pairs.withColumn("weight", base)


@dataclass(frozen=True)
class HardNegatives:
    """What a round of fitting weighs; see ``hard_negative_weights``."""

    kinds: tuple[str, ...] = ()
    rule_weight: float = 3.0
    singleton_weight: float = 1.0
    easy_keep: float = 1.0
    fp_weight: float = 2.0
    miss_weight: float = 1.0
    threshold: float = 0.5
    seed: int = 7

    def weigh(self, pairs: DataFrame) -> DataFrame:
        return hard_negative_weights(pairs, self.kinds, self.rule_weight, self.singleton_weight, self.easy_keep, self.fp_weight, self.miss_weight, self.seed, self.threshold)


def weight_counts(weighted: DataFrame) -> DataFrame:
    """One row: rows, positives, kept rows, sum of weights."""
    return weighted.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("positives"),
        F.count_if(F.col("weight") > 0).alias("kept_rows"),
        F.sum("weight").alias("weight_sum"),
    )


def fit_rounds(rows: DataFrame, truth: DataFrame, columns: Sequence[str], cfg: HardNegatives, gain: Callable[[Matcher], float], kind: str = "gbt", **params) -> tuple[Matcher, dict]:
    """A model of one round of weights, or of two if the second is better on the tune side by ``ROUND2_MARGIN``.

    ``rows`` has keys, ``columns``, ``label`` and what the mining conditions read; rows of weight 0 are left out. The second
    round adds weight to what the first got wrong on its own rows. ``gain`` scores a model on entities that ``rows`` lacks.
    """
    marked = with_singleton(rows, truth)

    def fit(pairs):
        weighted = cfg.weigh(pairs).where("weight > 0").select(L, R, *columns, "label", "weight")
        return Matcher(tuple(columns), kind, cfg.seed, **params).fit(weighted)

    first = fit(marked)
    own = first.predict(rows.select(L, R, *columns)).select(L, R, "prob")
    second = fit(marked.join(own, [L, R]))
    scores = gain(first), gain(second)
    kept = scores[1] >= scores[0] + ROUND2_MARGIN
    return (second if kept else first), {"round2_kept": kept, "tune_round1": scores[0], "tune_round2": scores[1]}


def fit_bags(rows: DataFrame, columns: Sequence[str], bags: int, kind: str = "gbt", seed: int = 42, **params) -> Ensemble:
    """One model per disjoint hash slice of the entities; they score as their mean."""
    parts = rows.withColumn("fold", fold_of(F.col(L), bags, seed))
    return Ensemble([Matcher(tuple(columns), kind, seed, **params).fit(parts.where(F.col("fold") == b).drop("fold")) for b in range(bags)])


def capped_rows(rows: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` rows at most: a hash share of the entities, each with all its rows."""
    total = rows.count()
    return rows if total <= most else rows.where(hash_unit(F.col(L), seed) < most / total)


def fit_stopping(rows: DataFrame, columns: Sequence[str], stop_share: float = 0.1, max_iter: int = 100, seed: int = 42, **params) -> Matcher:
    """Boosted trees whose number of rounds is set by a hash slice of entities that the fit leaves out.

    The slice is marked for the learner, which stops when the slice's error no longer falls.
    """
    marked = rows.withColumn("_stop", hash_unit(F.col(L), seed) < stop_share)
    return Matcher(tuple(columns), "gbt", seed, max_iter, stop="_stop", **params).fit(marked)
