"""Model search per target: folds, grids, refinement, thresholds, leaderboard, refit."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property, partial, reduce
from threading import Lock

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from riskspark.functions.columns import ident, number, squeeze
from riskspark.operators import balance as B, evaluate as V, models as M, split as S
from riskspark.operators.models import FEATURES, KEY, LABEL, WEIGHT
from riskspark.plans.risk import RiskModel
from riskspark.plans.search import FoldSearch
from riskspark.plans.selection import encode_categories, select_features
from riskspark.operators.profile import tagged_union
from riskspark.spec import Bundle, FeatureSpec

LEADERBOARD = ("model string, Accuracy double, Precision double, Recall double, F1 double, ROC_AUC double, "
               "RMSE double, MAE double, R2 double, best_params string, threshold double")


@dataclass(frozen=True)
class SuiteOptions:
    """Search settings; the booleans are the ablation switches."""

    test_size: float = 0.2
    seed: int = 42
    folds: int = 5
    balancing: str = "class_weight"
    scaling: bool = True
    refine: bool = True
    one_hot: bool = True
    selection: bool = True
    drop_null_targets: bool = True
    models: tuple[str, ...] | None = None
    grids: Mapping[str, Mapping[str, list]] = field(default_factory=dict)
    parallelism: int = 4


@dataclass
class SuiteResult:
    leaderboard: DataFrame
    best_name: str | None
    best_params: dict
    threshold: float | None
    model: PipelineModel | None
    feature_order: list[str]
    importance: Callable[[], DataFrame] | None
    confusion: dict[str, DataFrame]
    residuals: dict[str, DataFrame]
    spec: FeatureSpec
    skipped: dict[str, str] = field(default_factory=dict)

    @cached_property
    def coefficients(self) -> DataFrame | None:
        """Coefficients or importances of the best model, worked out when they are asked for."""
        return self.importance() if self.importance else None

    def risk_model(self, encoder=None) -> RiskModel:
        """``encoder`` holds the levels of the training rows. A feature that is null for a row makes its risk null."""
        kind, model = self.spec["target"], self.model

        def score(df: DataFrame, name: str) -> DataFrame:
            cols, features = df.columns, self.spec.features
            known = reduce(lambda a, b: a & b, [number(ident(c)).isNotNull() for c in features], F.lit(True))
            keyed = df.withColumn("_known", known).withColumns({c: F.coalesce(number(ident(c)), F.lit(0.0)) for c in features})
            # rows of equal features score alike
            keyed = keyed.withColumn(KEY, F.md5(F.concat_ws("|", *[ident(c).cast("string") for c in features])))
            out = model.transform(keyed)
            out = M.with_score(out, name) if kind == "binary" else out.withColumn(name, F.col("prediction"))
            return out.select(*[ident(c) for c in cols], F.when(F.col("_known"), ident(name)).alias(name))

        return RiskModel(self.spec, score, encoder, self.threshold)


def prepare_rows(bundle: Bundle, key: str) -> tuple[DataFrame, int]:
    """_key, numeric features, label; a null target is an error (drop such rows first)."""
    df, spec = bundle.df, bundle.spec
    target = number(ident("target"))
    stats = df.agg(F.count("*").alias("n"), F.count(target).alias("k"), F.max(target).alias("hi")).first()
    if stats["n"] != stats["k"]:
        raise ValueError("rows with a null target: derive the target with drop_null_rows=True")
    label = (target == F.lit(stats["hi"])).cast("double") if spec["target"] == "binary" else squeeze(target, F.lit(float(stats["n"])))
    return df.select(ident(key).cast("string").alias(KEY), *[number(ident(c)).alias(c) for c in spec.features],
                     label.alias(LABEL)), stats["n"]


class _Split:
    """Training and held-out rows of one split, as vectors, for scaled and unscaled models."""

    def __init__(self, train: DataFrame, held: DataFrame, spec: FeatureSpec, opts: SuiteOptions):
        self.train, self.held, self.spec, self.opts = train, held, spec, opts
        self.ready: dict[bool, tuple] = {}
        self.lock = Lock()      # models are searched side by side

    def get(self, scaled: bool):
        with self.lock:
            return self._get(scaled and self.opts.scaling)

    def _get(self, scaled: bool):
        if scaled not in self.ready:
            pipe, order = M.feature_pipeline(self.train, self.spec, scaled=scaled)
            *scale, assembler = pipe.stages
            rows = PipelineModel(scale).transform(self.train) if scale else self.train
            strategy = self.opts.balancing if self.spec["target"] == "binary" else "none"
            rows = B.balance(rows, strategy, key=KEY, label=LABEL, features=assembler.getInputCols(), seed=self.opts.seed)
            fit = assembler.transform(rows).select(KEY, LABEL, WEIGHT, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
            held = pipe.transform(self.held).select(KEY, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
            self.ready[scaled] = (fit, held, M.fit_context(fit), pipe, order)
        return self.ready[scaled]

    def fit(self, entry: M.ModelEntry, params: Mapping):
        fit, held, ctx, pipe, order = self.get(entry.scaled)
        model = entry.build(params, ctx).fit(fit)
        stages = model.stages if isinstance(model, PipelineModel) else [model]
        return model.transform(held), PipelineModel([*pipe.stages, *stages]), order

    def release(self):
        for fit, held, *_ in self.ready.values():
            fit.unpersist()
            held.unpersist()


def slim(pred: DataFrame, kind: str) -> DataFrame:
    """The columns metrics read, kept once: they are scored several times."""
    pred = M.with_score(pred) if kind == "binary" else pred.withColumn("score", F.col("prediction"))
    return pred.select(KEY, LABEL, "prediction", "score").persist(StorageLevel.MEMORY_AND_DISK)


def run_suite(bundle: Bundle, key: str, options: SuiteOptions = SuiteOptions()) -> SuiteResult:
    """Search every registered model for the target's kind and keep the best one, refit on all rows."""
    spec, kind = bundle.spec, bundle.spec["target"]
    if kind not in ("binary", "continuous"):
        raise ValueError("only continuous and binary targets can be modelled")
    if options.balancing not in B.STRATEGIES:
        raise ValueError(f"unknown balancing strategy {options.balancing!r}")
    spark = bundle.df.sparkSession
    nothing = SuiteResult(spark.createDataFrame([], LEADERBOARD), None, {}, None, None, [], None, {}, {}, spec)
    if not spec.features:
        print("no feature is left to model on")
        return nothing
    registry = M.CLASSIFIERS if kind == "binary" else M.REGRESSORS
    if options.drop_null_targets:
        bundle = bundle._replace(df=bundle.df.filter(number(ident("target")).isNotNull()))
    rows, _ = prepare_rows(bundle, key)
    if kind == "binary":
        rows = rows.withColumn("_stratum", F.col(LABEL).cast("int"))
    else:
        rows = S.quantile_bins(rows, LABEL, 5, "_stratum")
    rows = S.stratified_split(rows, [KEY], ["_stratum"], test_size=options.test_size, seed=options.seed)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    train = rows.filter(~F.col("is_test"))
    folds = S.stratified_folds(train, [KEY], ["_stratum"] if kind == "binary" else [], k=options.folds, seed=options.seed)
    folds = folds.persist(StorageLevel.MEMORY_AND_DISK)
    splits = [_Split(folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f), spec, options) for f in range(options.folds)]
    final = _Split(train, rows.filter("is_test"), spec, options)
    search = FoldSearch(folds, splits, spec, kind, options.balancing, options.scaling, options.parallelism)
    confusion, residuals, skipped = {}, {}, {}
    thresholds, chosen = {}, {}

    def rate(name: str):
        """The model's row of the leaderboard, or None if it is skipped."""
        entry = registry[name]
        try:
            params, scores = search.best(entry, options.grids.get(name, entry.grid), options.refine)
            pred = slim(final.fit(entry, params)[0], kind)
            text = json.dumps(params)
            if kind == "binary":
                cut = V.best_threshold(V.threshold_curve(scores.persist(StorageLevel.MEMORY_AND_DISK), LABEL, "score"))
                scores.unpersist()
                called = pred.withColumn("called", (F.col("score") >= cut).cast("int"))
                m = V.classification_metrics(called, LABEL, "called").first()
                auc = V.roc_auc(pred, LABEL, "score").first()[0]
                row = (name, m["Accuracy"], m["Precision"], m["Recall"], m["F1"], auc, None, None, None, text, cut)
                confusion[name] = V.confusion(called.withColumn("y", F.col(LABEL).cast("int")), "y", "called", [0, 1])
                thresholds[name] = cut
            else:
                m = V.regression_metrics(pred, LABEL, "prediction").first()
                row = (name, None, None, None, None, None, m["RMSE"], m["MAE"], m["R2"], text, None)
                residuals[name] = V.residual_table(pred, LABEL, "prediction", [KEY])
            chosen[name] = params
            return row
        except (ValueError, ArithmeticError, IllegalArgumentException) as err:
            # data a model cannot take leaves the others in the race; anything else is a failure of the job
            skipped[name] = str(err).splitlines()[0] if str(err) else type(err).__name__
            return None

    try:
        with ThreadPoolExecutor(options.parallelism) as pool:
            board = [r for r in pool.map(rate, [n for n in registry if options.models is None or n in options.models]) if r]
        if not board:
            return replace(nothing, skipped=skipped)
        best = max(board, key=lambda r: r[4])[0] if kind == "binary" else min(board, key=lambda r: r[6])[0]
        everything = _Split(rows, rows.limit(0), spec, options)
        _, model, order = everything.fit(registry[best], chosen[best])
        everything.release()
        importance = partial(coefficients, best, model, order, rows, kind, spark)
    finally:
        search.release()
        final.release()
        folds.unpersist()
        rows.unpersist()
    table = spark.createDataFrame(board, LEADERBOARD)
    table = table.orderBy(F.desc("F1")) if kind == "binary" else table.orderBy("RMSE")
    return SuiteResult(table, best, chosen[best], thresholds.get(best), model, order, importance, confusion, residuals, spec, skipped)


def coefficients(name: str, model: PipelineModel, order: list[str], rows: DataFrame, kind: str, spark) -> DataFrame:
    """Coefficients or importances named by the vector's own column order (sign kept)."""
    values = None
    for stage in model.stages:
        reads = next((p for p in ("featuresCol", "inputCol") if stage.hasParam(p)), None)
        if reads is None or stage.getOrDefault(reads) != FEATURES:
            continue        # weights of kernel features are not those of columns
        found = getattr(stage, "coefficients", None)
        found = getattr(stage, "featureImportances", None) if found is None else found
        if found is not None:
            values = found.toArray() if hasattr(found, "toArray") else found
            break
    if values is None:
        return permutation_importance(model, rows, order, kind).select(
            F.lit(name).alias("model"), "feature", "coefficient", F.abs("coefficient").alias("abs_coef"))
    return spark.createDataFrame([(name, f, float(v), abs(float(v))) for f, v in zip(order, values)],
                                 "model string, feature string, coefficient double, abs_coef double")


def permutation_importance(model, rows: DataFrame, features: list[str], kind: str, *, repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """Loss of accuracy (or R2) when one column is shuffled, mean over repeats.

    Shuffling is one exchange per repeat: each row meets a partner row and borrows its
    value for one feature at a time; all features are scored in the same job.
    """
    base = rows.select(KEY, LABEL, *[ident(f) for f in features]).persist(StorageLevel.MEMORY_AND_DISK)

    def quality(df: DataFrame, by) -> DataFrame:
        pred = model.transform(df)
        g = pred.groupBy(*by) if by else pred.groupBy()
        if kind == "binary":
            return g.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double")).alias("q"))
        e = F.col(LABEL) - F.col("prediction")
        return g.agg((F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(LABEL))).alias("q"))

    start = quality(base, []).first()["q"]
    total: dict[str, float] = {f: 0.0 for f in features}
    for r in range(repeats):
        mixed = partner_rows(base, features, f"{seed}-{r}")
        choices = F.array(*[F.lit(f) for f in features])
        many = mixed.withColumn("_f", F.explode(choices))
        many = many.withColumns({f: F.when(F.col("_f") == f, ident(f"_p_{f}")).otherwise(ident(f)) for f in features})
        many = many.withColumn(KEY, F.concat_ws("|", KEY, "_f")).drop(*[f"_p_{f}" for f in features])
        for row in quality(many, ["_f"]).collect():
            total[row["_f"]] += start - row["q"]
    base.unpersist()
    return rows.sparkSession.createDataFrame([(f, v / repeats) for f, v in total.items()], "feature string, coefficient double")


def partner_rows(base: DataFrame, features: list[str], salt: str) -> DataFrame:
    """Each row next to another one: rows in hash order, shifted by a third of the table."""
    indexed = hash_index(base, KEY, salt)
    n = base.count()
    shift = max(1, n // 3)
    other = indexed.select(((F.col("_i") + shift) % n).alias("_i"), *[ident(f).alias(f"_p_{f}") for f in features])
    return indexed.join(other, "_i").drop("_i")


def hash_index(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Dense 0-based position in hash order, counted per md5 bucket (no single-task sort)."""
    from pyspark.sql import Window

    h = df.withColumn("_h", F.md5(F.concat(ident(key), F.lit(salt)))).withColumn("_b", F.substring("_h", 1, 3))
    below = h.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4096 rows
    below = below.withColumn("_o", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", ident(key)))
    return h.join(F.broadcast(below), "_b").withColumn("_i", F.col("_o") + at - 1).drop("_h", "_b", "_o")


def model_target(bundle: Bundle, key: str, options: SuiteOptions = SuiteOptions()):
    """Selection (or plain encoding) and the model suite for one target."""
    if options.selection:
        picked = select_features(bundle, one_hot=options.one_hot)
        return run_suite(picked.bundle, key, options), picked.encoder
    encoded, enc = encode_categories(bundle, one_hot=options.one_hot)
    return run_suite(encoded, key, options), enc


# --- Fixed values: the ablation settings, from everything off to only refinement off
ABLATIONS = {
    "no refinement": dict(refine=False),
    "no refinement, no balancing": dict(refine=False, balancing="none"),
    "no refinement, no balancing, no selection": dict(refine=False, balancing="none", selection=False),
    "no refinement, no balancing, no selection, no one-hot": dict(refine=False, balancing="none", selection=False, one_hot=False),
}


def run_ablations(bundle: Bundle, key: str, options: SuiteOptions = SuiteOptions(), settings=None) -> DataFrame:
    """Leaderboards of every ablation setting, tagged."""
    settings = settings or ABLATIONS

    def board(change: Mapping) -> DataFrame:
        return model_target(bundle, key, replace(options, **change))[0].leaderboard

    with ThreadPoolExecutor(options.parallelism) as pool:
        return tagged_union(dict(zip(settings, pool.map(board, settings.values()))), "setting")
