"""Further registered queries: file round trips, checks over data, rankings by score, regimes (see ``catalog``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candela.functions import expr
from candela.operators import cleaning as cl
from candela.operators import features as fe
from candela.operators import folds as fo
from candela.operators import halo
from candela.operators import hmm
from candela.operators import metrics as me
from candela.operators import models as mo
from candela.operators import stats as stt
from candela.operators.trees import Fold
from candela.plans import catalog as c
from candela.plans import sqltext as sq
from candela.plans.catalog import register
from candela.session import checkpoint_dir, written
from candela.sources import bars as src


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ file sources and sinks

@register("bars_csv_round_trip", f"SELECT Ticker, Date, Open, High, Low, Close, Volume FROM ({sq.BARS_DAILY}) b WHERE Ticker IN ('A', 'R') AND Date >= DATE '1994-01-01'")
def q_bars_csv(spark, d):
    """A2/A3/A4: daily bars written as CSV, a folder per ticker, and read back for two tickers from a date on."""
    path = _scratch(spark, "bars-csv")
    src.write_bars(src.bars_daily(spark, d), path, "csv")
    return src.read_bars(spark, path, "csv", tickers=["A", "R"], start="1994-01-01")


@register("bars_parquet_round_trip", f"SELECT Ticker, Date, Open, High, Low, Close, Volume FROM ({sq.BARS_WIDE}) b")
def q_bars_parquet(spark, d):
    """A1/A4: the wide panel written as Parquet, a folder per ticker, and read back."""
    path = _scratch(spark, "bars-parquet")
    src.write_bars(src.bars_wide(spark, d), path)
    return src.read_bars(spark, path)


_PREP_SQL, _PREP_COLS = sq.features(c.CLEAN_DAILY_SQL, "prep")


@register("processed_sink", _PREP_SQL, [x for x in _PREP_COLS if x not in {"Open", "High", "Low", "Close"}])
def q_processed_sink(spark, d):
    """A5: the processed feature table written and read back."""
    path = _scratch(spark, "processed")
    df = c._prep(spark, d)
    src.write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


@register("vendor_columns", f"SELECT Ticker, Date, Open, High, Low, Close, Volume FROM ({sq.BARS_DAILY}) b WHERE Ticker = 'A'")
def q_vendor_columns(spark, d):
    """A vendor's frame (two-level and lower-case names, another column order, one more column) in bar schema."""
    b = src.bars_daily(spark, d).where("Ticker = 'A'")
    vendor = b.select(F.col("Close").alias("('Close', 'A')"), F.col("Open").alias("open"), F.col("High").alias("High_A"), F.col("Volume").cast("double").alias("VOLUME"),
                      F.col("Low").alias("low_A"), F.col("Date").cast("timestamp").alias("date"), F.lit(0.0).alias("Adj"))
    return src.normalise_vendor_columns(vendor, "A")


# ------------------------------------------------------------------ checks over data

_BACK_SQL, _BACK_COLS = sq.backend_features(c.CLEAN_DAILY_SQL)


@register("backend_predictors", f"SELECT * EXCLUDE (Ticker, Date, Close, Target, Day_of_Week, Month) FROM ({_BACK_SQL}) b", [x for x in _BACK_COLS if x not in fe.BACKEND_EXCLUDE])
def q_backend_predictors(spark, d):
    """The backend profile's inputs: all columns but keys, Close, Target and calendar."""
    df = fe.features(c._clean_daily(spark, d), "backend")
    return df.select(*fe.backend_predictors(df))


def _type_sql(source: str, columns: list[str], part: str) -> str:
    mask = lambda col: "CASE WHEN {0} IS NOT NULL THEN {1} END".format(col, " + ".join(
        f"CASE WHEN regexp_matches(trim(CAST({col} AS VARCHAR)), '{p}') THEN {1 << i} ELSE 0 END" for i, (_, p) in enumerate(cl.TYPE_PATTERNS)))
    names = "CASE WHEN m IS NULL THEN 'void' " + " ".join(f"WHEN (m & {1 << i}) > 0 THEN '{t}'" for i, (t, _) in enumerate(cl.TYPE_PATTERNS)) + " ELSE 'string' END"
    parts = " UNION ALL ".join(
        f"SELECT {part} AS part, '{col}' AS col, count({col}) AS v, count(*) - count({col}) AS u, bit_and({mask(col)}) AS m FROM src GROUP BY {part}" for col in columns)
    want = "CASE col " + " ".join(f"WHEN '{k}' THEN '{t.simpleString()}'" for k, t in cl.EXPECTED_TYPES.items()) + " END"
    return f"""
WITH src AS ({source}), p AS ({parts}), n AS (SELECT *, {names} AS one FROM p),
a AS (SELECT col, sum(v)::BIGINT AS n_values, sum(u)::BIGINT AS n_null, bit_and(m) AS m, count(DISTINCT CASE WHEN one <> 'void' THEN one END) > 1 AS drift FROM n GROUP BY col),
t AS (SELECT col AS "column", n_values, n_null, {names} AS narrowest, {want} AS expected, drift FROM a)
SELECT "column", n_values, n_null, narrowest, expected,
  coalesce(narrowest = expected OR (narrowest = 'bigint' AND expected = 'double') OR narrowest = 'void', true) AS fits, drift FROM t"""


@register("type_report", _type_sql(sq.BARS_HOURLY, ["Date", "Open", "High", "Low", "Close", "Volume"], "Ticker"))
def q_type_report(spark, d):
    """The narrowest type that all values of hourly bars bear, per column, against the expected types (Date is a
    timestamp there, not a date), and whether tickers differ."""
    return cl.type_drift(src.bars_hourly(spark, d), "Ticker")


@register("index_validity", f"""
WITH x AS (SELECT *, coalesce(Date < lag(Date) OVER (PARTITION BY Ticker ORDER BY _ord), false) AS back FROM ({c.RAW_SQL}) r)
SELECT Ticker, count(*) AS n_rows, count(*) - count(Date) AS null_dates, count_if(back)::BIGINT AS backward,
       count(*) = count(Date) AND count_if(back) = 0 AS valid FROM x GROUP BY Ticker""")
def q_index_validity(spark, d):
    """Whether dates are there and ascend in ingest order, per ticker."""
    return cl.index_validity(c._raw(spark, d))


@register("series_position", f"SELECT Ticker, Date, Close, row_number() OVER (PARTITION BY Ticker ORDER BY Date) - 1 AS position FROM ({sq.BARS_DAILY}) b")
def q_series_position(spark, d):
    """D-20: the place of each bar in its series by date, without a sort of whole series."""
    return halo.global_row_index(src.bars_daily(spark, d)).select("Ticker", "Date", "Close", F.col("_g").cast("long").alias("position"))


# ------------------------------------------------------------------ QQ points with a twin

def _inv_normal_sql(p: str) -> str:
    def horner(coefs, x):
        out = sq.dbl(coefs[0])
        for k in coefs[1:]:
            out = f"({out} * {x} + {sq.dbl(k)})"
        return out
    one = sq.dbl(1.0)
    low, high, q = f"sqrt({sq.dbl(-2.0)} * ln({p}))", f"sqrt({sq.dbl(-2.0)} * ln({one} - {p}))", f"({p} - {sq.dbl(0.5)})"
    r = f"({q} * {q})"
    tail = lambda x: f"({horner(expr._C, x)} / ({horner(expr._D, x)} * {x} + {one}))"
    return (f"(CASE WHEN {p} < {sq.dbl(expr._P_LOW)} THEN {tail(low)} WHEN {p} > {sq.dbl(1 - expr._P_LOW)} THEN -{tail(high)} "
            f"ELSE {horner(expr._A, r)} * {q} / ({horner(expr._B, r)} * {r} + {one}) END)")


@register("qq_points", f"""
WITH f AS ({c.PIPE_SQL}), x AS (SELECT Ticker, Returns AS sample, row_number() OVER (PARTITION BY Ticker ORDER BY Returns) AS i,
  count(*) OVER (PARTITION BY Ticker) AS n FROM f WHERE Returns IS NOT NULL),
m AS (SELECT *, CASE WHEN i = 1 THEN 1 - power(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = n THEN power(0.5::DOUBLE, 1.0::DOUBLE / n)
  ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS med FROM x),
t AS (SELECT *, {_inv_normal_sql('med')} AS theoretical FROM m)
SELECT Ticker, CAST(i AS INTEGER) AS i, theoretical, sample, regr_slope(sample, theoretical) OVER (PARTITION BY Ticker) AS slope,
       regr_intercept(sample, theoretical) OVER (PARTITION BY Ticker) AS intercept FROM t""", ["theoretical", "sample", "slope", "intercept"])
def q_qq_points(spark, d):
    """D-19: normal QQ points (Filliben medians) and fitted line per ticker."""
    return stt.qq_points(c._pipe(spark, d), "Returns")


# ------------------------------------------------------------------ ROC-AUC of scores

_SCORES = ["RSI", "BB_Position", "MACD", "Close_Ratio_5", "Close_Ratio_60", "Trend_5", "Trend_60", "Volatility_10"]


@register("roc_auc", f"""
WITH f AS ({c.PIPE_ENG_SQL}), p AS ({" UNION ALL ".join(f"SELECT '{s}' AS model, Target, {s}::DOUBLE AS score FROM f" for s in _SCORES)}),
r AS (SELECT model, Target, rank() OVER (PARTITION BY model ORDER BY score) AS rk, count(*) OVER (PARTITION BY model, score) AS ties FROM p WHERE score IS NOT NULL),
a AS (SELECT model, count_if(Target = 1)::BIGINT AS n_pos, count_if(Target <> 1)::BIGINT AS n_neg, sum(CASE WHEN Target = 1 THEN rk + (ties - 1) / 2.0::DOUBLE END) AS w FROM r GROUP BY model)
SELECT model, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (w - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END AS auc FROM a""", ["auc"])
def q_roc_auc(spark, d):
    """D-3: ROC-AUC of the indicators as scores for the next day's direction (trends have many ties)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in _SCORES])).alias("x")
    return me.roc_auc(c._pipe_engineered(spark, d).select("Target", pairs).select("Target", "x.*"), "score")


@register("roc_auc_models")
def q_roc_auc_models(spark, d):
    """D-3: ROC-AUC of the linear classifiers' probabilities over all walk-forward folds."""
    specs = [mo.REGISTRY["LogisticRegression"], mo.REGISTRY["KNN"]]
    return me.roc_auc(mo.backtest(c._model_input(spark, d), c.PIPE_PREDICTORS, specs))


# ------------------------------------------------------------------ regimes with transitions, trees of other profiles

@register("regime_hmm")
def q_regime_hmm(spark, d):
    """Three Gaussian regimes with transitions on the module features, fitted per fold by EM; P(top regime) over
    the test window >= threshold."""
    x, preds = c._module_input(spark, d)
    x = x.persist()
    cal = fo.calendar(x).persist()
    folds = [Fold(r["fold_id"], r["train_end"], r["test_start"], r["test_end"]) for r in fo.folds(cal, fo.PLAIN_WF).collect()]
    out, _, held = hmm.backtest(fo.with_date_ordinal(x, cal), preds, folds)
    p = F.element_at("posterior", -1)
    out = written(out.select(F.lit("RegimeHmm").alias("model"), "fold_id", "Ticker", "Date", "Target", p.alias("probability"),
                             (p >= 0.51).cast("int").alias("Predictions"), "fwd_return"), "regimes")
    for df in (held, cal, x):
        df.unpersist()
    return out


@register("model_forest_modules")
def q_forest_modules(spark, d):
    """M8/M9: the single-model presets of both forests (balanced classes, 30 rows to split, 15 a leaf), expanding folds."""
    x, preds = c._module_input(spark, d)
    return mo.backtest(x, preds, [mo.REGISTRY["RandomForestModule"], mo.REGISTRY["ExtraTreesModule"]], fo.PLAIN_WF)
