"""Forecast operators (F1-F10): price paths with volatility bands per ticker.

The forecast works on one state row per ticker (last bar + training-slice
statistics), so its size is the ticker universe, never the history length.

* ``series_state``: D-8/D-9/D-10/D-11 per ticker: start price and date,
  return mean/volatility over the training slice (fallback .001/.02 under 20
  returns), mean Close of the slice, mean of the last 20 returns.
* ``price_path``: F3 (``pipeline``), F4 (``app``, 5% pull to the training
  mean) and F5 (``backend``, asymmetric step from the last-20 mean return),
  clamped to +-10% of the start price, with the F6 band price*(1 +- sigma*sqrt(i)).
* ``recursive_directions``: F2/F7, the step-by-step re-scoring with a fitted
  model while Close_Ratio/Trend state evolves.
* ``stitch``: F10, history + forecast with a connector row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.expr import clamp, pct_change
from candela.operators import folds as fo
from candela.operators.features import w_series
from candela.operators.trees import Ensemble
from candela.session import checkpoint_dir
from candela.sources.reference import business_days

# Forecast constants.
MIN_RETURNS = 20
FALLBACK_MEAN, FALLBACK_VOL = 0.001, 0.02
FALLBACK_R20 = 0.01
CLAMP_LO, CLAMP_HI = 0.9, 1.1
REVERSION = 0.05
UP_SCALE, DOWN_SCALE, STEP_CAP = 1.2, 0.8, 0.05


def series_state(df: DataFrame, ratio: float = 0.7, returns_col: str = "Returns") -> DataFrame:
    """One row per ticker: Ticker, last_date, start, mu, sigma, hist_avg, r20, train_cut.

    The training slice is the first floor(n_dates * ratio) dates of the panel
    calendar (the same cut the final fit uses).
    """
    cal = fo.calendar(df)
    # the calendar is one row per date: its total count rides along as a column
    cal = cal.withColumn("train_cut", F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(ratio)).cast("int"))
    r = fo.with_date_ordinal(df, cal)
    ret = F.col(returns_col) if returns_col in df.columns else pct_change(
        F.col("Close"), F.lag("Close", 1).over(w_series()))
    r = r.withColumn("_r", ret)
    last20 = Window.partitionBy("Ticker").orderBy(F.col("Date").desc())
    r = r.withColumn("_recent", F.row_number().over(last20) <= MIN_RETURNS)
    in_train = F.col("d") < F.col("train_cut")
    tr = F.when(in_train, F.col("_r"))
    st = r.groupBy("Ticker").agg(
        F.max("Date").alias("last_date"),
        F.max_by("Close", "Date").alias("start"),
        F.count(tr).alias("_n"), F.avg(tr).alias("_m"), F.stddev_samp(tr).alias("_s"),
        F.avg(F.when(in_train, F.col("Close"))).alias("hist_avg"),
        F.avg(F.when(F.col("_recent"), F.col("_r"))).alias("_r20"),
        F.first("train_cut").alias("train_cut"),
    )
    enough = F.col("_n") >= MIN_RETURNS
    return st.select(
        "Ticker", "last_date", "start",
        F.when(enough, F.col("_m")).otherwise(F.lit(FALLBACK_MEAN)).alias("mu"),
        F.when(enough, F.col("_s")).otherwise(F.lit(FALLBACK_VOL)).alias("sigma"),
        "hist_avg", F.coalesce(F.col("_r20"), F.lit(FALLBACK_R20)).alias("r20"), "train_cut")


def step_price(variant: str, step: Column, up: Column) -> Column:
    """Path price at 1-based ``step`` given the direction flag ``up``."""
    start = F.col("start")
    if variant == "backend":
        change = F.when(up, F.abs(F.col("r20")) * UP_SCALE).otherwise(-F.abs(F.col("r20")) * DOWN_SCALE)
        change = clamp(change, -STEP_CAP, STEP_CAP)
    else:
        change = F.when(up, F.col("mu")).otherwise(-F.col("mu"))
    price = start * (F.lit(1.0) + step * change)
    if variant in ("app", "backend"):
        price = price * (1 - REVERSION) + F.col("hist_avg") * REVERSION
    return clamp(price, start * CLAMP_LO, start * CLAMP_HI)


def price_path(state: DataFrame, directions: DataFrame, horizon: int = 30, variant: str = "pipeline") -> DataFrame:
    """``directions`` has Ticker, step, Prediction (0/1), Probability.

    Output: Ticker, step, Date (business days), Close, Prediction, Direction,
    Probability, Upper, Lower.
    """
    days = business_days(state.select("Ticker", F.col("last_date").alias("Date")), horizon)
    x = days.join(state, "Ticker").join(directions, ["Ticker", "step"])
    step = F.col("step").cast("double")
    price = step_price(variant, step, F.col("Prediction") == 1)
    band = F.col("sigma") * F.sqrt(step)
    x = x.withColumn("Close", price)
    return x.select(
        "Ticker", "step", "Date", "Close", F.col("Prediction").cast("int").alias("Prediction"),
        F.when(F.col("Prediction") == 1, "Up").otherwise("Down").alias("Direction"),
        F.col("Probability").cast("double").alias("Probability"),
        (F.col("Close") * (1 + band)).alias("Upper"), (F.col("Close") * (1 - band)).alias("Lower"))


def fixed_directions(state: DataFrame, direction: DataFrame, horizon: int) -> DataFrame:
    """The same direction for every step (rule models, or features that never advance)."""
    return (direction.select("Ticker", "Prediction", "Probability")
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))))


def fallback_path(state: DataFrame, horizon: int = 30, legacy_bands: bool = False) -> DataFrame:
    """F8: +0.1% per step, 'Up', probability .5. Bands are the F6 band unless
    ``legacy_bands`` (slopes of +1.1% and +0.9% per step)."""
    days = business_days(state.select("Ticker", F.col("last_date").alias("Date")), horizon)
    x = days.join(state, "Ticker")
    step = F.col("step").cast("double")
    close = F.col("start") * (1 + 0.001 * step)
    if legacy_bands:
        up, lo = F.col("start") * (1 + 0.011 * step), F.col("start") * (1 + 0.009 * step)
    else:
        band = F.col("sigma") * F.sqrt(step)
        up, lo = close * (1 + band), close * (1 - band)
    return x.select("Ticker", "step", "Date", close.alias("Close"), F.lit(1).alias("Prediction"),
                    F.lit("Up").alias("Direction"), F.lit(0.5).alias("Probability"),
                    up.alias("Upper"), lo.alias("Lower"))


def recursive_directions(spec, model, last_rows: DataFrame, state: DataFrame, horizons: list[int],
                         horizon: int = 30, threshold: float = 0.51, variant: str = "pipeline",
                         checkpoint_every: int = 10) -> DataFrame:
    """Score each ticker's state, step the price, update Close_Ratio_h
    and Trend_h, repeat. One small frame (one row per ticker) per step;
    lineage is cut with a reliable checkpoint every ``checkpoint_every`` steps.
    """
    from candela.operators.models import score

    spark = last_rows.sparkSession
    checkpoint_dir(spark)
    # the starting state is small (one row per ticker); a reliable checkpoint
    # cuts its lineage to the feature pipeline before the loop
    cur = last_rows.join(state.select("Ticker", "start", "mu", "sigma", "hist_avg", "r20"), "Ticker").checkpoint()
    feats = [c for h in horizons for c in (f"Close_Ratio_{h}", f"Trend_{h}")]
    outs = []
    for i in range(1, horizon + 1):
        scored = score(spec, model, cur, threshold).select(
            "Ticker", "start", "mu", "sigma", "hist_avg", "r20", *feats,
            F.col("Predictions").alias("Prediction"), F.col("probability").alias("Probability"),
            F.lit(i).alias("step"))
        scored = scored.checkpoint() if i % checkpoint_every == 0 else scored.persist()
        price = step_price(variant, F.lit(float(i)), F.col("Prediction") == 1)
        upd = {}
        for h in horizons:
            ratio = F.col(f"Close_Ratio_{h}")
            upd[f"Close_Ratio_{h}"] = F.when(ratio.isNotNull() & (ratio != 0),
                                             price / (F.col("start") / ratio)).otherwise(ratio)
            upd[f"Trend_{h}"] = F.col(f"Trend_{h}") + (2 * F.col("Prediction") - 1) / F.lit(float(h))
        outs.append(scored.select("Ticker", "step", "Prediction", "Probability"))
        cur = scored.withColumns(upd).drop("Prediction", "Probability", "step")
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def last_rows(df: DataFrame) -> DataFrame:
    """D-11: each ticker's last row (``max_by`` over Date, partial aggregation)."""
    cols = [c for c in df.columns if c != "Ticker"]
    s = df.groupBy("Ticker").agg(F.max_by(F.struct(*cols), "Date").alias("_last"))
    return s.select("Ticker", "_last.*")


def stitch(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast in one series; the last history point is
    repeated as step 0 of the forecast so the two lines connect."""
    h = history.select("Ticker", "Date", "Close", F.lit("history").alias("kind"), F.lit(None).cast("int").alias("step"),
                       F.lit(None).cast("double").alias("Upper"), F.lit(None).cast("double").alias("Lower"))
    last = history.groupBy("Ticker").agg(F.max("Date").alias("Date"), F.max_by("Close", "Date").alias("Close"))
    conn = last.select("Ticker", "Date", "Close", F.lit("forecast").alias("kind"), F.lit(0).alias("step"),
                       F.col("Close").alias("Upper"), F.col("Close").alias("Lower"))
    f = forecast.select("Ticker", "Date", "Close", F.lit("forecast").alias("kind"), "step", "Upper", "Lower")
    return h.unionByName(conn).unionByName(f)


def folded_directions(spec, model, last_rows: DataFrame, state: DataFrame, predictors: list[str],
                      horizons: list[int], horizon: int = 30, threshold: float = 0.51,
                      variant: str = "pipeline") -> DataFrame:
    """F2/F7 for models that are an expression (linear ones, tree ensembles) in one pass: the whole step recursion
    is a fold (``aggregate`` over ``sequence(1, H)``) whose state is the evolving
    Close_Ratio/Trend values; coefficients or tree arrays are literals. A linear margin
    is computed as the fitted model does (dot product, then intercept); the
    probabilities agree with ``model.transform`` to about one ulp.
    """
    trees = isinstance(model.model, Ensemble)
    if not trees:
        est = model.stages[-1]
        w = [float(v) for v in est.coefficients.toArray()]
        b = float(est.intercept)
    x = last_rows.join(state.select("Ticker", "start", "mu", "sigma", "hist_avg", "r20"), "Ticker")
    feats = [c for h in horizons for c in (f"Close_Ratio_{h}", f"Trend_{h}")]
    empty = F.array().cast("array<struct<step:int,Prediction:int,Probability:double>>")
    init = F.struct(*[F.col(c).cast("double").alias(c) for c in feats], empty.alias("out"))

    def merge(acc, i):
        if not trees:
            dot = None
            for c, wc in zip(predictors, w):
                term = acc[c] * F.lit(wc)
                dot = term if dot is None else dot + term
        value = model.model.probability([acc[c] for c in predictors]) if trees else dot + F.lit(b)
        # bound by a lambda, so that the trees are walked once a step, however often the value is used
        return F.transform(F.array(value), lambda v: after(acc, i, v))[0]

    def after(acc, i, value):
        """The state after step ``i``, given the ensemble's probability or the linear margin."""
        if trees or spec.output == "proba":
            prob = value if trees else F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
            up = prob >= threshold
        else:
            prob = F.lit(None).cast("double")
            up = (value > 0) if spec.output == "sign" else (value >= threshold)
        price = step_price(variant, i.cast("double"), up)
        nxt = []
        for h in horizons:
            r, t = acc[f"Close_Ratio_{h}"], acc[f"Trend_{h}"]
            nxt.append(F.when(r.isNotNull() & (r != 0), price / (F.col("start") / r)).otherwise(r)
                       .alias(f"Close_Ratio_{h}"))
            nxt.append((t + (2 * up.cast("int") - 1) / F.lit(float(h))).alias(f"Trend_{h}"))
        rec = F.struct(i.alias("step"), up.cast("int").alias("Prediction"), prob.alias("Probability"))
        return F.struct(*nxt, F.concat(acc["out"], F.array(rec)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, merge)
    return (x.select("Ticker", F.explode(folded["out"]).alias("o"))
             .select("Ticker", "o.step", "o.Prediction", "o.Probability"))


LINEAR_MODELS = ("LogisticRegressionModel", "LinearRegressionModel")


def model_directions(spec, model, last_rows: DataFrame, state: DataFrame, predictors: list[str],
                     horizons: list[int], horizon: int = 30, threshold: float = 0.51,
                     variant: str = "pipeline") -> DataFrame:
    """one-pass fold for linear models and tree ensembles, step loop for everything else."""
    plain = not model.prep and model.rff is None and model.calib is None
    if isinstance(model.model, Ensemble) or plain and not spec.knn and type(model.stages[-1]).__name__ in LINEAR_MODELS:
        return folded_directions(spec, model, last_rows, state, predictors, horizons, horizon, threshold, variant)
    # a neighbour search is a large plan: its lineage is cut at every step
    return recursive_directions(spec, model, last_rows, state, horizons, horizon, threshold, variant, 1 if spec.knn else 10)
