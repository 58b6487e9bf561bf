"""Model registries (M3-M19) and the walk-forward back-test.

A model is a ``ModelSpec``: what fits it, plus how its output becomes a 0/1 prediction:

* ``proba``: P(class 1) >= threshold (classifiers with probabilities),
* ``score``: regression score >= threshold (linear/lasso/elastic net on 0/1),
* ``sign``:  regression score > 0 on labels in {-1, 1} (ridge classifier).

``build`` makes a ``pyspark.ml`` estimator; ``trees`` names a ``Boost`` or a ``Forest``, which
``operators.boosting`` and ``operators.forest`` grow for all models and folds of a call together; ``kernel`` is fitted by
``operators.kernel``, also for all folds together; ``knn`` is the exact neighbour vote of ``operators.knn``.

Fits are pooled over the panel: one fit per (model, fold) on every ticker's
rows with ``d < train_end``. Fits are distributed Spark jobs; the driver only
loops over the (model, fold) pairs of ``pyspark.ml`` models, whose number is bounded by the registry
and the calendar, and submits them from a small thread pool.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.ml import Pipeline
import math

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators import boosting as bo
from candela.operators import folds as fo
from candela.operators import forest as fr
from candela.operators import kernel as ke
from candela.operators import knn as kn
from candela.operators import trees as tr
from candela.operators.boosting import Boost
from candela.operators.forest import Forest
from candela.operators.kernel import Kernel
from candela.operators.trees import Ensemble, Fold
from candela.session import checkpoint_dir, written


#: rows of a partition that the fits go over again and again
PARTITION_ROWS = 1 << 16

#: the long table that every back-test returns
PREDICTION_SCHEMA = ("model string, fold_id int, Ticker string, Date date, Target int, probability double, "
                     "Predictions int, fwd_return double")


@dataclass(frozen=True)
class FitContext:
    n_train: int          # training rows
    label_std: float      # population std of the fitted label


@dataclass(frozen=True)
class ModelSpec:
    name: str
    ordinal: int
    build: Callable[[FitContext], object] | None = field(repr=False, default=None)
    output: str = "proba"          # proba | score | sign | state
    has_probability: bool = True
    trees: object = None           # Boost or Forest
    knn: tuple | None = None       # (k, metric, weights)
    kernel: Kernel | None = None   # random features, Newton steps
    label: str | None = None       # regression target column (default: Target)
    balanced: bool = False         # class weights n / (2 n_class) on each training fold
    scale: str | None = None       # 'pop' (ddof 0), 'samp' (ddof 1 + 1e-8) per-fold z-score
    rff: tuple | None = None       # (components, gamma or None for 1/p, seed): RBF random features
    platt: bool = False            # calibrate a margin to a probability with a logistic fit


def _logistic(max_iter, c=1.0):
    # L2 with C: regParam = 1/(C n) on the mean loss; no internal standardization
    return lambda ctx: LogisticRegression(
        maxIter=max_iter, regParam=1.0 / (c * max(ctx.n_train, 1)), elasticNetParam=0.0,
        standardization=False, labelCol="label")


def _ridge(alpha):
    # Spark divides the L2 term by the label std; scale regParam back so the
    # solution equals the closed-form ridge on the summed squared loss.
    return lambda ctx: LinearRegression(
        regParam=alpha * (ctx.label_std or 1.0) / max(ctx.n_train, 1), elasticNetParam=0.0,
        standardization=False, solver="normal", labelCol="label")


def _linear():
    return lambda ctx: LinearRegression(regParam=0.0, solver="normal", labelCol="label")


def _lasso(alpha):
    return lambda ctx: LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False,
                                        maxIter=1000, labelCol="label")


def _elastic(alpha, l1_ratio):
    def build(ctx):
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
        r = l1 + (ctx.label_std or 1.0) * l2
        return LinearRegression(regParam=r, elasticNetParam=l1 / r, standardization=False,
                                maxIter=1000, labelCol="label")
    return build


# Module-level models (linear family with the single-model presets).
MODULE_MODELS = [
    ModelSpec("LinearRegression", 20, _linear(), output="score", has_probability=False),
    ModelSpec("Lasso", 21, _lasso(0.001), output="score", has_probability=False),
    ModelSpec("ElasticNet", 22, _elastic(0.001, 0.5), output="score", has_probability=False),
]

# Re-aimed time-series model (M21): AR(p) on daily price changes with a drift
# intercept; the direction is the sign of the predicted next change.
AR_LAGS = 5
AR_MODEL = ModelSpec("ARDrift", 30, lambda ctx: LinearRegression(regParam=0.0, solver="normal", labelCol="label"),
                     output="sign", has_probability=False, label="_next_change")

def _svc(c):
    # the random features are the kernel map already: rescaling them would change the kernel
    return lambda ctx: LinearSVC(regParam=1.0 / (c * max(ctx.n_train, 1)), maxIter=200, standardization=False,
                                 labelCol="label")


def _l2_linear(reg_fn, intercept=True):
    return lambda ctx: LinearRegression(regParam=reg_fn(ctx), elasticNetParam=0.0, standardization=False,
                                        fitIntercept=intercept, solver="normal", labelCol="label")


SVC_RFF = (200, None, 42)


def _pipeline_svc():
    # M16 re-aimed: random Fourier features of the z-scored inputs, a linear SVM, Platt's calibration
    return ModelSpec("SVC", 7, _svc(1.0), scale="pop", rff=SVC_RFF, platt=True)


# The 'pipeline' registry presets, in registry order; what the libraries default to is spelt out.
PIPELINE_REGISTRY = [
    ModelSpec("RandomForest", 0, trees=Forest(200, 15, leaf=10, split=20)),
    ModelSpec("GradientBoosting", 1, trees=Boost(150, 8, first_order=True)),
    ModelSpec("ExtraTrees", 2, trees=Forest(200, 15, bootstrap=False, random_cuts=True)),
    ModelSpec("HistGradientBoosting", 3, trees=Boost(200, 10, growth="leaf", leaves=31, leaf=20)),
    ModelSpec("LogisticRegression", 4, _logistic(1000)),
    ModelSpec("Ridge", 5, _ridge(1.0), output="sign", has_probability=False),
    ModelSpec("KNN", 6, knn=(10, "euclidean", "uniform")),
    _pipeline_svc(),
    ModelSpec("XGBoost", 8, trees=Boost(200, 8, l2=1.0, hessian=1.0)),
    ModelSpec("LightGBM", 9, trees=Boost(200, 8, growth="leaf", leaves=31, leaf=20, hessian=1e-3)),
    ModelSpec("CatBoost", 10, trees=Boost(200, 8, growth="oblivious", l2=3.0, prior=False)),
]

# The presets of the comparison runner.
COMPARISON_REGISTRY = [
    ModelSpec("RandomForest", 0, trees=Forest(300, 18, leaf=15, split=30)),
    ModelSpec("GradientBoosting", 1, trees=Boost(200, 10, first_order=True)),
    ModelSpec("ExtraTrees", 2, trees=Forest(300, 18, bootstrap=False, random_cuts=True)),
    ModelSpec("HistGradientBoosting", 3, trees=Boost(250, 12, growth="leaf", leaves=31, leaf=20)),
    ModelSpec("LogisticRegression", 4, _logistic(2000)),
    ModelSpec("RidgeClassifier", 5, _ridge(1.0), output="sign", has_probability=False),
    ModelSpec("KNN", 6, knn=(15, "euclidean", "distance")),
    _pipeline_svc(),
    ModelSpec("XGBoost", 8, trees=Boost(250, 10, l2=1.0, hessian=1.0)),
    ModelSpec("LightGBM", 9, trees=Boost(250, 10, growth="leaf", leaves=31, leaf=20, hessian=1e-3)),
    ModelSpec("CatBoost", 10, trees=Boost(250, 10, growth="oblivious", l2=3.0, prior=False)),
]

# Per-module presets (balanced logistic and forests, scaled kernel models, slower boosting).
MODULE_SPECS = [
    ModelSpec("LogisticRegressionBalanced", 40, _logistic(1000), balanced=True),
    # M16-M19 re-aimed: random Fourier features of the z-scored inputs, then a linear model
    ModelSpec("SVCBalanced", 46, _svc(1.0), balanced=True, scale="pop", rff=SVC_RFF, platt=True),
    ModelSpec("SVR", 41, kernel=Kernel("svr", 200, None, c=1.0, epsilon=0.1), output="score", has_probability=False),
    ModelSpec("KernelRidge", 42, _l2_linear(lambda ctx: (ctx.label_std or 1.0) / max(ctx.n_train, 1), False),
              output="score", has_probability=False, scale="pop", rff=(200, 0.1, 42)),
    ModelSpec("GaussianProcess", 43, kernel=Kernel("gp", 200, 0.5)),
    # backend profile: per-fold z-score with ddof 1 and +1e-8
    ModelSpec("LogisticRegressionZ", 44, _logistic(2000), balanced=True, scale="samp"),
    ModelSpec("RandomForestModule", 50, trees=Forest(200, 10, leaf=15, split=30, balanced=True, seed=1)),
    ModelSpec("ExtraTreesModule", 51, trees=Forest(500, 20, leaf=15, split=30, bootstrap=False, random_cuts=True, balanced=True, seed=1)),
    ModelSpec("GradientBoostingModule", 52, trees=Boost(200, 5, 0.05, first_order=True, rows=0.8, split=20, leaf=10, seed=1)),
    ModelSpec("HistGradientBoostingModule", 53, trees=Boost(200, 6, 0.05, growth="leaf", leaves=31, leaf=20, l2=1.0, seed=1)),
    ModelSpec("XGBoostModule", 54, trees=Boost(500, 6, 0.05, rows=0.8, columns=0.8, hessian=5.0, gain=0.1, l1=0.1, l2=1.0, seed=1)),
    # row sampling without a sampling frequency stays off in this library
    ModelSpec("LightGBMModule", 55, trees=Boost(500, 6, 0.05, growth="leaf", leaves=31, columns=0.8, leaf=20, hessian=1e-3, l1=0.1, l2=1.0, seed=1)),
    ModelSpec("CatBoostModule", 56, trees=Boost(500, 6, 0.05, growth="oblivious", l2=3.0, prior=False, seed=1)),
]

# M20 re-aimed: a 3-component Gaussian mixture (full covariance) as the regime
# emission model; regimes are ordered by the mean of the first input.
REGIME_MODEL = ModelSpec("RegimeMixture", 45, lambda ctx: GaussianMixture(k=3, maxIter=100, seed=1, tol=0.01),
                         output="state")

REGISTRY = {m.name: m for m in PIPELINE_REGISTRY + MODULE_MODELS + [AR_MODEL] + MODULE_SPECS + [REGIME_MODEL]}


def ar_features(df: DataFrame, p: int = AR_LAGS) -> tuple[DataFrame, list[str]]:
    """Lagged price changes d_0..d_{p-1} (d_k = Close_{t-k} - Close_{t-k-1}) and
    the next change as regression target; one window stage per series."""
    from candela.operators.features import w_series
    w = w_series()
    lags = {f"_c{k}": F.lag("Close", k).over(w) for k in range(1, p + 1)}
    x = df.withColumns(lags).withColumn("_next_change", F.lead("Close", 1).over(w) - F.col("Close"))
    cols = {"d_0": F.col("Close") - F.col("_c1")}
    for k in range(1, p):
        cols[f"d_{k}"] = F.col(f"_c{k}") - F.col(f"_c{k + 1}")
    x = x.withColumns(cols).drop(*lags)
    preds = [f"d_{k}" for k in range(p)]
    return x.na.drop(subset=preds), preds


def _label(spec: ModelSpec) -> F.Column:
    if spec.label:
        return F.col(spec.label).cast("double")
    y = F.col("Target").cast("double")
    return (2 * y - 1) if spec.output == "sign" else y


@dataclass
class Fitted:
    """A fitted model plus the column preparation learnt on its training fold."""
    spec: ModelSpec
    model: object                                # a pyspark.ml pipeline, an Ensemble, or the rows that vote (KNN)
    inputs: list[str]
    prep: dict = field(default_factory=dict)     # column name -> expression (per-fold scaling)
    rff: tuple | None = None                     # (omega p x D, phase D) of the random-feature map
    calib: object = None                          # Platt logistic model on the margin

    @property
    def stages(self):
        return self.model.stages


def _finite(c: str) -> F.Column:
    x = F.col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _prepare(spec: ModelSpec, train: DataFrame, predictors: list[str]):
    """Per-fold scaling (E6/E7) as column expressions and the random-feature
    parameters (M16-M19). Scaling statistics use finite values only; a
    non-finite or missing input becomes the training mean (z = 0)."""
    exprs, cols = {}, list(predictors)
    if spec.scale:
        std = F.stddev_pop if spec.scale == "pop" else F.stddev_samp
        row = train.agg(*[F.avg(_finite(c)).alias(f"m_{i}") for i, c in enumerate(predictors)],
                        *[std(_finite(c)).alias(f"s_{i}") for i, c in enumerate(predictors)]).first()
        cols = []
        for i, c in enumerate(predictors):
            m, sd = float(row[f"m_{i}"] or 0.0), float(row[f"s_{i}"] or 0.0)
            sd = (sd if sd > 0 else 1.0) if spec.scale == "pop" else sd + 1e-8
            exprs[f"_z_{i}"] = F.coalesce((_finite(c) - F.lit(m)) / F.lit(sd), F.lit(0.0))
            cols.append(f"_z_{i}")
    rff = None
    if spec.rff:
        d, gamma, seed = spec.rff
        p = len(cols)
        gamma = gamma if gamma is not None else 1.0 / p
        rng = np.random.default_rng(seed)
        rff = (rng.normal(0.0, math.sqrt(2.0 * gamma), size=(p, d)), rng.uniform(0.0, 2 * math.pi, size=d))
    return exprs, cols, rff


def _features(df: DataFrame, prep: dict, inputs: list[str], rff) -> DataFrame:
    """Add the ``features`` vector: assembled inputs, or their random Fourier
    features sqrt(2/D) cos(x W + b) computed per Arrow batch with numpy."""
    x = df.withColumns(prep) if prep else df
    if rff is None:
        return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(x)
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import types as T
    omega, phase = rff
    scale = math.sqrt(2.0 / omega.shape[1])
    out_schema = T.StructType(x.schema.fields + [T.StructField("_rff", T.ArrayType(T.DoubleType()))])

    def rff_batches(batches):
        for pdf in batches:
            m = pdf[inputs].to_numpy(dtype="float64")
            z = scale * np.cos(m @ omega + phase)
            pdf["_rff"] = list(z)
            yield pdf

    y = x.mapInPandas(rff_batches, out_schema)
    return y.withColumn("features", array_to_vector("_rff")).drop("_rff")


def fit(spec: ModelSpec, train: DataFrame, predictors: list[str]) -> Fitted:
    """Fit preparation + features + estimator on ``train`` (one training fold; ``Ticker`` and ``Date`` name its rows)."""
    if spec.trees:
        rows, one = train.withColumn("d", F.lit(0)), [Fold(0, 1)]
        if isinstance(spec.trees, Boost):
            fitted = bo.boost(rows, predictors, [spec.trees], one, ["Ticker", "Date"])
            fitted[-1].unpersist()
            return Fitted(spec, bo.ensembles(fitted, len(predictors))[0][0], predictors)
        trees, edges, blocks = fr.grow(rows, predictors, [spec.trees], one, ["Ticker", "Date"])
        blocks.unpersist()
        return Fitted(spec, fr.ensembles(trees, [spec.trees], edges, len(predictors))[0][0], predictors)
    if spec.knn:
        return Fitted(spec, train.select("Ticker", "Date", "Target", *predictors), predictors)
    base = train.select(*predictors, _label(spec).alias("label")).where(F.col("label").isNotNull())
    prep, inputs, rff = _prepare(spec, base, predictors)
    t = _features(base, prep, inputs, rff).select("features", "label")
    if rff is not None:
        checkpoint_dir(train.sparkSession)
        t = t.checkpoint()                               # the feature map runs once per fold, and no step of the solver carries its plan
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s"),
                  F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("pos")).first()
    n, pos = int(stats["n"]), int(stats["pos"] or 0)
    ctx = FitContext(n, float(stats["s"] or 0.0))
    est = spec.build(ctx)
    if spec.balanced and 0 < pos < n:
        w1, w0 = n / (2.0 * pos), n / (2.0 * (n - pos))
        t = t.withColumn("weight", F.when(F.col("label") > 0, F.lit(w1)).otherwise(F.lit(w0)))
        est = est.setWeightCol("weight")
    model = Pipeline(stages=[est]).fit(t)
    calib = None
    if spec.platt:
        margin = model.transform(t).select(vector_to_array("rawPrediction")[1].alias("m"), "label")
        calib = Pipeline(stages=[VectorAssembler(inputCols=["m"], outputCol="features"),
                                 LogisticRegression(regParam=0.0, labelCol="label")]).fit(margin)
    return Fitted(spec, model, inputs, prep, rff, calib)


def score(spec: ModelSpec, fitted, rows: DataFrame, threshold: float = 0.51) -> DataFrame:
    """Append ``probability`` (P(class 1), null without one) and ``Predictions``."""
    if spec.trees or spec.knn:
        if spec.trees:
            out = rows.withColumn("probability", fitted.model.probability([F.col(c) for c in fitted.inputs]))
        else:  # rows are named by ticker alone
            k, metric, weights = spec.knn
            asked = rows.select("Ticker", F.lit("1970-01-01").cast("date").alias("Date"), *fitted.inputs)
            out = rows.join(kn.knn_fold(fitted.model, asked, fitted.inputs, k, metric, weights).drop("Date"), "Ticker")
        return out.withColumn("Predictions", (F.col("probability") >= threshold).cast("int"))
    out = fitted.model.transform(_features(rows, fitted.prep, fitted.inputs, fitted.rff))
    out = out.drop("features")
    if fitted.calib is not None:
        out = out.withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction",
                                                                                    "probability", "prediction")
        cal = VectorAssembler(inputCols=["_margin"], outputCol="features")
        out = fitted.calib.stages[-1].transform(cal.transform(out)).drop("features", "_margin")
    out = out.drop(*fitted.prep.keys()) if fitted.prep else out
    if spec.output == "state":
        # posterior of the component whose mean of the first input is highest
        means = [float(g.mean.toArray()[0]) for g in fitted.model.stages[-1].gaussians]
        top = int(np.argmax(means))
        out = out.withColumn("probability", vector_to_array(F.col("probability"))[top]).drop("prediction")
        return out.withColumn("Predictions", (F.col("probability") >= threshold).cast("int"))
    if spec.output == "proba":
        out = out.withColumn("probability", vector_to_array(F.col("probability"))[1])
        return out.withColumn("Predictions", (F.col("probability") >= threshold).cast("int"))
    s = F.col("prediction")
    pred = (s > 0) if spec.output == "sign" else (s >= threshold)
    return out.withColumn("probability", F.lit(None).cast("double")).withColumn("Predictions", pred.cast("int"))


def sized(data: DataFrame, rows: int) -> DataFrame:
    """``data`` in partitions of about ``PARTITION_ROWS`` of its ``rows``. How finely the ticks behind it were cut doesn't matter then:
    every pass of an iterative fit has as many tasks, and sends the driver as many results, as the rows it reads ask for."""
    return data.coalesce(max(1, math.ceil(rows / PARTITION_ROWS)))


def backtest(df: DataFrame, predictors: list[str], specs: list[ModelSpec],
             wf: fo.WalkForward = fo.PIPELINE_WF, threshold: float = 0.51,
             max_parallel: int = 4) -> DataFrame:
    """Walk-forward predictions of every model, as one long table.

    ``df`` must hold ``Ticker, Date, Target, fwd_return`` and the predictors.
    It is persisted while the models are fitted; the predictions are written to the shared folder, so
    nothing stays cached when they are read, but what the caller had cached.
    """
    own = not df.is_cached
    df = df.persist()                                 # features are computed once for all fits
    cal = fo.calendar(df).persist()                   # one row per date
    data = fo.with_date_ordinal(df, cal)
    if not any(s.output == "state" for s in specs):   # a mixture starts from rows drawn by partition: others would change its regimes
        # the fits are many short jobs, and each carries the plans since the last checkpoint along
        checkpoint_dir(df.sparkSession)
        data = sized(data, df.count()).checkpoint()
    data = data.persist()
    fold_table = fo.folds(cal, wf).persist()          # one row per fold (bounded by calendar / step)
    fold_rows = fold_table.collect()
    tests = fo.assign_test(data, fold_table)
    jobs = [(s, r) for s in specs if s.build for r in fold_rows]

    def run(job):
        spec, r = job
        model = fit(spec, fo.train_rows(data, r["train_end"]), predictors)
        t = tests.where(F.col("fold_id") == r["fold_id"])
        return score(spec, model, t, threshold).select(
            F.lit(spec.name).alias("model"), "fold_id", "Ticker", "Date", "Target", "probability", "Predictions", "fwd_return")

    parts = []
    if fold_rows:
        kinds = [kind for kind in (Boost, Forest, Kernel) if any(isinstance(s.trees or s.kernel, kind) for s in specs)]
        neighbours = [(s, r) for s in specs if s.knn for r in fold_rows]
        # a fit of ``build`` is many short jobs, mostly the driver's work: trees and neighbours run beside them, trees on two thirds of the
        # cores, so that no short job waits for a queue of long tasks
        cores = df.sparkSession.sparkContext.defaultParallelism
        share = max(1, 2 * cores // (3 * len(kinds))) if jobs and kinds else None
        with ThreadPoolExecutor(max_workers=max_parallel) as ex, ThreadPoolExecutor(max_workers=max_parallel) as beside:
            side = [beside.submit(_grown_rows, data, predictors, specs, fold_rows, threshold, kind, share) for kind in kinds]
            side += [beside.submit(_knn_rows, data, tests, predictors, s, r, threshold) for s, r in neighbours]
            # solvers on random features take the most steps: they begin first
            fits = {i: ex.submit(run, jobs[i]) for i in sorted(range(len(jobs)), key=lambda i: jobs[i][0].rff is None)}
            parts = [fits[i].result() for i in range(len(jobs))] + [x.result() for x in side]
    if not parts:
        return df.sparkSession.createDataFrame([], PREDICTION_SCHEMA)
    out = written(reduce(DataFrame.unionByName, parts), "predictions")
    for x in (fold_table, data, cal, *[df] * own):
        x.unpersist()
    return out


def _knn_rows(data: DataFrame, tests: DataFrame, predictors: list[str], spec: ModelSpec, fold, threshold: float) -> DataFrame:
    """Test rows of the neighbour vote in one fold."""
    k, metric, weights = spec.knn
    train = fo.train_rows(data, fold["train_end"]).select("Ticker", "Date", "Target", *predictors)
    if train.limit(k).count() < k:
        raise ValueError(f"fold {fold['fold_id']} has fewer than k = {k} training rows")
    t = tests.where(F.col("fold_id") == fold["fold_id"])
    p = kn.knn_fold(train, t.select("Ticker", "Date", *predictors), predictors, k, metric, weights)
    return written(t.join(p, ["Ticker", "Date"]).select(
        F.lit(spec.name).alias("model"), "fold_id", "Ticker", "Date", "Target", "probability",
        (F.col("probability") >= threshold).cast("int").alias("Predictions"), "fwd_return"), "neighbours")


def _grown_rows(data: DataFrame, predictors: list[str], specs: list[ModelSpec], fold_rows, threshold: float, kind: type,
                share: int | None = None) -> DataFrame:
    """Test rows of the boosted models, the forests or the kernel machines, which are grown together."""
    spark = data.sparkSession
    folds = [Fold(r["fold_id"], r["train_end"], r["test_start"], r["test_end"]) for r in fold_rows]
    keep = ["Ticker", "Date", "Target", "fwd_return"]
    schema = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in keep)
    mine = [s for s in specs if isinstance(s.trees or s.kernel, kind)]
    params = [s.trees or s.kernel for s in mine]
    if kind is Boost:
        state = bo.boost(data, predictors, params, folds, keep, share)[-1]
        scored, held = tr.scored_rows(state, folds, len(mine), schema, spark), state
        probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    elif kind is Kernel:
        scored, _, held = ke.backtest(data, predictors, params, folds, keep, schema)
        # a regression's value is no probability
        no = F.element_at(F.array(*[F.lit(not s.has_probability) for s in mine]), F.col("spec") + 1)
        probability = F.when(~no, F.col("score"))
    else:
        trees, _, held = fr.grow(data, predictors, params, folds, keep, share)
        scored = tr.scored_rows(fr.scores(trees, params, held), folds, len(mine), schema, spark)
        probability = F.col("score")
    rows = written(scored, "scores")
    held.unpersist()
    name = F.element_at(F.array(*[F.lit(s.name) for s in mine]), F.col("spec") + 1)
    decided = F.col("score") if kind is Kernel else probability
    return rows.select(name.alias("model"), "fold_id", "Ticker", "Date", "Target", probability.alias("probability"),
                       (decided >= threshold).cast("int").alias("Predictions"), "fwd_return")


def registry_frame(spark, specs: list[ModelSpec]) -> DataFrame:
    return spark.createDataFrame([(s.name, s.ordinal, s.has_probability) for s in specs],
                                 "model string, ordinal int, has_probability boolean")


def feature_importance(model: Fitted, predictors: list[str]) -> list[tuple[str, float]]:
    """D-26: (feature, share of the splits' gains) of a fitted tree ensemble, descending."""
    return sorted(zip(predictors, map(float, model.model.importance)), key=lambda kv: -kv[1])


# ---------------------------------------------------------------- seasonal AR(I)MA re-aims

SEASON = 5
HR_LONG_AR = 10


def seasonal_lags(df: DataFrame, season: int = SEASON, lags: int = HR_LONG_AR) -> DataFrame:
    """y_t = (1 - B)(1 - B^s) Close_t and its lags y_lag0..y_lag{lags}; ``y_next``
    is the label (y_{t+1}) and ``d_back`` = Delta Close_{t+1-s}, so that the next
    price change is y_{t+1} + d_back. One window stage over the series."""
    from candela.operators.features import w_series
    w = w_series()
    need = lags + season + 1
    c = {f"_c{j}": F.lag("Close", j).over(w) for j in range(1, need + 1)}
    x = df.withColumns(c).withColumn("_cn", F.lead("Close", 1).over(w))
    col = lambda j: F.col("Close") if j == 0 else F.col(f"_c{j}")
    ys = {}
    for k in range(0, lags + 1):
        ys[f"y_lag{k}"] = (col(k) - col(k + 1)) - (col(k + season) - col(k + season + 1))
    x = x.withColumns(ys)
    x = x.withColumn("y_next", (F.col("_cn") - F.col("Close")) - (col(season - 1) - col(season)))
    x = x.withColumn("d_back", col(season - 1) - col(season))
    return x.drop(*c, "_cn").na.drop(subset=list(ys) + ["d_back"])


def sarima_hr_backtest(df: DataFrame, exog: list[str] | None = None, wf: fo.WalkForward = fo.PIPELINE_WF,
                       name: str = "SARIMA") -> DataFrame:
    """Walk-forward Hannan-Rissanen fit per fold.

    Stage 1: y_t on y_{t-1..t-10} (long AR) by least squares; its residual
    e_t estimates the innovation. Stage 2: y_{t+1} on y_t..y_{t-4} (AR 5),
    y_{t-4}, y_{t-9} (seasonal AR), e_{t-4} (seasonal MA) and ``exog``, with an
    intercept (drift). Prediction: 1 when the implied next change
    y_{t+1} + Delta Close_{t+1-s} is positive.
    """
    from candela.operators.features import w_series
    exog = exog or []
    x = seasonal_lags(df).persist()
    cal = fo.calendar(x).persist()
    data = fo.with_date_ordinal(x, cal).persist()
    fold_table = fo.folds(cal, wf).persist()
    fold_rows = fold_table.collect()
    tests = fo.assign_test(data, fold_table).select("fold_id", "Ticker", "Date")
    s1_in = [f"y_lag{k}" for k in range(1, HR_LONG_AR + 1)]
    s2_in = [f"y_lag{k}" for k in range(0, 5)] + [f"y_lag{SEASON - 1 + SEASON}", "e_lag4"] + exog
    parts = []
    for r in fold_rows:
        tr = fo.train_rows(data, r["train_end"])
        s1 = Pipeline(stages=[VectorAssembler(inputCols=s1_in, outputCol="features"),
                              LinearRegression(regParam=0.0, solver="normal", labelCol="y_lag0")]).fit(tr)
        e = s1.transform(data).withColumn("e", F.col("y_lag0") - F.col("prediction")).drop("features", "prediction")
        e = e.withColumn("e_lag4", F.lag("e", SEASON - 1).over(w_series())).na.drop(subset=["e_lag4"])
        tr2 = fo.train_rows(e, r["train_end"]).where(F.col("y_next").isNotNull())
        s2 = Pipeline(stages=[VectorAssembler(inputCols=s2_in, outputCol="features", handleInvalid="keep"),
                              LinearRegression(regParam=0.0, solver="normal", labelCol="y_next")]).fit(tr2)
        t = e.join(tests.where(F.col("fold_id") == r["fold_id"]), ["Ticker", "Date"])
        sc = s2.transform(t)
        parts.append(sc.select(F.lit(name).alias("model"), "fold_id", "Ticker", "Date", "Target",
                               F.lit(None).cast("double").alias("probability"),
                               ((F.col("prediction") + F.col("d_back")) > 0).cast("int").alias("Predictions"),
                               "fwd_return"))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], PREDICTION_SCHEMA)
