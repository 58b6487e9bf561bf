"""Registered queries: Spark callables and their DuckDB oracle SQL.

Each entry reads the driver's test tables (or bars Spark derives from them)
at full size. Double columns computed by different summation orders are
rounded to 6 decimals on both sides; exact values (prices) are not rounded.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.operators import cleaning as cl
from candela.operators import features as fe
from candela.plans import sqltext as sq
from candela.session import written
from candela.sources import bars as src
from candela.sources import reference as ref

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HALO_ROWS = 512
ORACLE: dict[str, str] = {}
ROUND = 6


def _round(df: DataFrame, cols: list[str], digits: int = ROUND) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols}) if cols else df


def register(name: str, sql: str | None = None, round_cols: list[str] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _round(fn(spark, sf_dir), round_cols or [])
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sq.rounded(sql, round_cols or [])
        return run
    return deco


# ------------------------------------------------------------------ sources

@register("bars_daily", sq.BARS_DAILY)
def q_bars_daily(spark, d):
    """Daily OHLCV bars per return flag from lineitem."""
    return src.bars_daily(spark, d)


@register("bars_hourly", sq.BARS_HOURLY)
def q_bars_hourly(spark, d):
    """Hourly OHLCV bars per event type from events."""
    return src.bars_hourly(spark, d)


@register("bars_sparse", sq.BARS_SPARSE)
def q_bars_sparse(spark, d):
    """Daily OHLCV bars per order priority from orders (calendar with gaps)."""
    return src.bars_sparse(spark, d)


@register("bars_wide", sq.BARS_WIDE)
def q_bars_wide(spark, d):
    """Daily OHLCV bars for 16 part-key tickers from lineitem."""
    return src.bars_wide(spark, d)


@register("universe_filter", f"""
SELECT * FROM ({sq.BARS_WIDE}) b
WHERE Ticker IN ('P01', 'P03', 'P07', 'P12') AND Date >= DATE '1996-01-01' AND Date < DATE '2000-01-01'""")
def q_universe_filter(spark, d):
    """A1/A2: a ticker universe over a half-open date range."""
    b = src.bars_wide(spark, d)
    return (b.where(F.col("Ticker").isin("P01", "P03", "P07", "P12"))
             .where((F.col("Date") >= F.lit("1996-01-01").cast("date"))
                    & (F.col("Date") < F.lit("2000-01-01").cast("date"))))


_SUPPLIER_DIM = """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, r_name AS sector
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


@register("dim_search", f"""
SELECT * FROM ({_SUPPLIER_DIM}) d
WHERE contains(lower(symbol), 'america') OR contains(lower(name), 'america') OR contains(lower(sector), 'america')
""")
def q_dim_search(spark, d):
    """Case-insensitive substring search over symbol, name and sector."""
    return ref.search_dimension(ref.supplier_dimension(spark, d), "AMERICA")


@register("dim_search_symbol", f"""
SELECT * FROM ({_SUPPLIER_DIM}) d
WHERE contains(lower(symbol), 's1') OR contains(lower(name), 's1') OR contains(lower(sector), 's1')""")
def q_dim_search_symbol(spark, d):
    """Search matching on the symbol and name columns."""
    return ref.search_dimension(ref.supplier_dimension(spark, d), "s1")


@register("alias_resolve", """
SELECT s_suppkey, s.symbol, coalesce(a.vendor_symbol, s.symbol) AS resolved
FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name ELSE 'NATION_' || CAST(s_nationkey AS VARCHAR) END AS symbol FROM supplier) s
LEFT JOIN (
  SELECT n_name AS symbol, r_name || '/' || n_name AS vendor_symbol
  FROM nation JOIN region ON n_regionkey = r_regionkey) a
ON s.symbol = a.symbol""")
def q_alias_resolve(spark, d):
    """Resolve requested symbols through an alias map (left join + coalesce).

    Suppliers in debt are asked for by their own name, which has no alias and stays.
    """
    sup = spark.read.parquet(f"{d}/supplier.parquet").select(
        "s_suppkey", F.when(F.col("s_acctbal") < 0, F.col("s_name")).otherwise(
            F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).alias("symbol"))
    return ref.resolve_aliases(sup, ref.nation_aliases(spark, d), "symbol", "resolved")


@register("bday_calendar", f"""
WITH last AS (SELECT Ticker, max(Date) AS Date FROM ({sq.BARS_DAILY}) b GROUP BY 1),
days AS (SELECT Ticker, unnest(list_filter(generate_series(Date + 1, Date + 49, INTERVAL 1 DAY),
                                           lambda d: isodow(d) <= 5)[1:30]) AS Date FROM last)
SELECT Ticker, CAST(row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS INTEGER) AS step,
       CAST(Date AS DATE) AS Date FROM days""")
def q_bday_calendar(spark, d):
    """A10: the next 30 business days after each ticker's last bar."""
    last = src.bars_daily(spark, d).groupBy("Ticker").agg(F.max("Date").alias("Date"))
    return ref.business_days(last, 30)


# ------------------------------------------------------------------ cleaning & quality

RAW_SQL = sq.with_defects(sq.BARS_DAILY)


def _raw(spark, d):
    return src.with_defects(src.bars_daily(spark, d))


@register("raw_bars", RAW_SQL)
def q_raw_bars(spark, d):
    """Daily bars with injected defects and an ingest ordinal (input of the quality checks)."""
    return _raw(spark, d)


@register("clean_ohlc", sq.clean(RAW_SQL, has_ord=True))
def q_clean_ohlc(spark, d):
    """Keep-first de-dup, OHLC consistency filter and null drop."""
    return cl.clean_stock_data(_raw(spark, d))


@register("dedup_keep_first", f"""
SELECT * EXCLUDE (_pd) FROM (
  SELECT *, lag({{'d': Date}}) OVER (PARTITION BY Ticker ORDER BY Date, _ord) AS _pd FROM ({RAW_SQL}) r) x
WHERE _pd IS NULL OR _pd.d IS DISTINCT FROM Date""")
def q_dedup(spark, d):
    """B2: first row per (Ticker, Date) by ingest order."""
    return cl.dedup_keep_first(_raw(spark, d))


@register("inconsistent_rows", f"""
SELECT * FROM ({RAW_SQL}) r
WHERE coalesce(Low > Open OR High < Open OR Low > Close OR High < Close, false)""")
def q_inconsistent(spark, d):
    """Rows whose Low/High do not bound Open and Close."""
    return cl.inconsistent_rows(_raw(spark, d))


@register("missing_profile", f"""
SELECT Ticker, c AS "column", CAST(m AS BIGINT) AS missing FROM (
  SELECT Ticker,
    count_if(Date IS NULL) AS Date_, count_if(Open IS NULL OR isnan(Open)) AS Open_,
    count_if(High IS NULL OR isnan(High)) AS High_, count_if(Low IS NULL OR isnan(Low)) AS Low_,
    count_if(Close IS NULL OR isnan(Close)) AS Close_, count_if(Volume IS NULL) AS Volume_
  FROM ({RAW_SQL}) r GROUP BY Ticker) a
UNPIVOT (m FOR c IN (Date_ AS 'Date', Open_ AS 'Open', High_ AS 'High', Low_ AS 'Low',
                     Close_ AS 'Close', Volume_ AS 'Volume'))""")
def q_missing(spark, d):
    """Missing values per ticker and column."""
    return cl.missing_profile(_raw(spark, d))


@register("dup_count", f"""
SELECT Ticker, CAST(count(*) - count(DISTINCT {{'d': Date}}) AS BIGINT) AS duplicate_count
FROM ({RAW_SQL}) r GROUP BY Ticker""")
def q_dup_count(spark, d):
    """Duplicate dates per ticker."""
    return cl.duplicate_count(_raw(spark, d))


def _iqr_static_sql(src_sql: str) -> str:
    cols = ["Open", "High", "Low", "Close"]
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    cond = " OR ".join(
        f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false)"
        for c in cols)
    return f"""
WITH r AS ({src_sql}), s AS (SELECT Ticker, {qs} FROM r GROUP BY Ticker)
SELECT r.* FROM r JOIN s USING (Ticker) WHERE {cond}"""


@register("iqr_static", _iqr_static_sql(RAW_SQL))
def q_iqr_static(spark, d):
    """Rows outside the per-ticker 1.5 IQR fences of any price column."""
    return cl.iqr_static(_raw(spark, d))


def _iqr_rolling_sql(src_sql: str, window: int = 252) -> str:
    cols = ["Open", "High", "Low", "Close"]
    w = f"(PARTITION BY Ticker ORDER BY _ord ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    parts = []
    for c in cols:
        q = f"quantile_cont({c}, [0.25, 0.75]) OVER {w}"
        parts.append(f"{q} AS _q_{c}, count({c}) OVER {w} AS _n_{c}")
    flags = []
    for c in cols:
        q1, q3 = f"_q_{c}[1]", f"_q_{c}[2]"
        flags.append(f"coalesce(CASE WHEN _n_{c} = {window} THEN ({c} < {q1} - 1.5 * ({q3} - {q1}) "
                     f"OR {c} > {q3} + 1.5 * ({q3} - {q1})) END, false) AS {c}_outlier")
    return f"""
SELECT Ticker, Date, Open, High, Low, Close, Volume, _ord, {", ".join(flags)}
FROM (SELECT *, {", ".join(parts)} FROM ({src_sql}) r) x"""


@register("iqr_rolling", _iqr_rolling_sql(RAW_SQL))
def q_iqr_rolling(spark, d):
    """Rolling 252-row IQR outlier flags in ingest order."""
    return cl.iqr_rolling_flags(_raw(spark, d))


@register("iqr_rolling_halo", _iqr_rolling_sql(RAW_SQL))
def q_iqr_rolling_halo(spark, d):
    """B12 on 512-row ingest-order buckets with a 251-row halo (equal to iqr_rolling)."""
    return cl.iqr_rolling_flags_halo(_raw(spark, d), rows_per_bucket=512)


@register("rolling_outliers", f"""
SELECT * FROM ({_iqr_rolling_sql(RAW_SQL)}) f
WHERE Open_outlier OR High_outlier OR Low_outlier OR Close_outlier""")
def q_rolling_outliers(spark, d):
    """Rows with any rolling outlier flag."""
    return cl.rolling_outliers(_raw(spark, d))


@register("outlier_bundle", f"""
SELECT 'static' AS kind, * FROM ({_iqr_static_sql(RAW_SQL)}) a
UNION ALL
SELECT 'rolling' AS kind, Ticker, Date, Open, High, Low, Close, Volume, _ord FROM ({_iqr_rolling_sql(RAW_SQL)}) f
WHERE Open_outlier OR High_outlier OR Low_outlier OR Close_outlier
UNION ALL
SELECT 'inconsistent' AS kind, * FROM ({RAW_SQL}) r
WHERE coalesce(Low > Open OR High < Open OR Low > Close OR High < Close, false)""")
def q_outlier_bundle(spark, d):
    """Static, rolling and inconsistent rows in one long table."""
    return cl.outlier_bundle(_raw(spark, d))


@register("quality_report", f"""
SELECT Ticker, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(CAST(Date IS NULL AS INT) + CAST(Open IS NULL OR isnan(Open) AS INT) + CAST(High IS NULL OR isnan(High) AS INT)
       + CAST(Low IS NULL OR isnan(Low) AS INT) + CAST(Close IS NULL OR isnan(Close) AS INT)
       + CAST(Volume IS NULL AS INT)) AS BIGINT) AS missing_total,
  sum(CAST(Date IS NULL AS INT) + CAST(Open IS NULL AS INT) + CAST(High IS NULL AS INT)
      + CAST(Low IS NULL AS INT) + CAST(Close IS NULL AS INT) + CAST(Volume IS NULL AS INT)) > 0 AS has_missing,
  CAST(count(*) - count(DISTINCT {{'d': Date}}) AS BIGINT) AS duplicate_count,
  CAST(count_if(Open_outlier OR High_outlier OR Low_outlier OR Close_outlier) AS BIGINT) AS outlier_count,
  CAST(count_if(coalesce(Low > Open OR High < Open OR Low > Close OR High < Close, false)) AS BIGINT) AS inconsistent_count,
  CAST(0 AS BIGINT) AS type_mismatches,
  (sum(CAST(Date IS NULL AS INT) + CAST(Open IS NULL AS INT) + CAST(High IS NULL AS INT)
      + CAST(Low IS NULL AS INT) + CAST(Close IS NULL AS INT) + CAST(Volume IS NULL AS INT)) = 0)
   AND count_if(coalesce(Low > Open OR High < Open OR Low > Close OR High < Close, false)) = 0 AS is_clean
FROM ({_iqr_rolling_sql(RAW_SQL)}) f GROUP BY Ticker""")
def q_quality_report(spark, d):
    """Per-ticker data-quality report."""
    return cl.quality_report(_raw(spark, d))


def _clean_data_sql(src_sql: str) -> str:
    return f"""
SELECT Ticker, Date, Open, High, Low, Close, Volume, _ord FROM (
  SELECT *, lag({{'d': Date}}) OVER (PARTITION BY Ticker ORDER BY Date, _ord) AS _pd
  FROM ({_iqr_rolling_sql(src_sql)}) f
  WHERE NOT (Open_outlier OR High_outlier OR Low_outlier OR Close_outlier)) x
WHERE _pd IS NULL OR _pd.d IS DISTINCT FROM Date"""


@register("clean_data", _clean_data_sql(RAW_SQL))
def q_clean_data(spark, d):
    """Drop rolling-IQR outliers (ingest order), then keep-first de-dup."""
    return cl.clean_data(_raw(spark, d))


@register("train_test_tag", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date) - 1 AS rn,
                  floor(count(*) OVER (PARTITION BY Ticker) * CAST(0.7 AS DOUBLE)) AS cut FROM ({sq.BARS_DAILY}) x),
t AS (SELECT * EXCLUDE (rn, cut), CASE WHEN rn < cut THEN 'train' ELSE 'test' END AS segment FROM b
      UNION ALL SELECT * EXCLUDE (rn, cut), 'test' AS segment FROM b WHERE rn = cut - 1)
SELECT * FROM t""")
def q_train_test_tag(spark, d):
    """train/test segments of each series with the joining point repeated."""
    return cl.tag_train_test(src.bars_daily(spark, d), 0.7)


# ------------------------------------------------------------------ features

CLEAN_DAILY_SQL = sq.clean(sq.BARS_DAILY)


def _clean_daily(spark, d):
    return cl.clean_stock_data(src.bars_daily(spark, d))


for _p in ("pipeline", "prep", "app"):
    _sql, _dcols = sq.features(CLEAN_DAILY_SQL, _p)
    _keep_exact = {"Open", "High", "Low", "Close"}

    def _mk(profile):
        def q(spark, d):
            return fe.features(_clean_daily(spark, d), profile)
        q.__doc__ = f"C1-C25/C28: indicator features, '{profile}' profile, over cleaned daily bars."
        return q

    register(f"features_{_p}", _sql, [c for c in _dcols if c not in _keep_exact])(_mk(_p))

_bsql, _bcols = sq.backend_features(CLEAN_DAILY_SQL)


@register("features_backend", _bsql, _bcols)
def q_features_backend(spark, d):
    """Lagged indicator features of the 'backend' profile."""
    return fe.features(_clean_daily(spark, d), "backend")


# ------------------------------------------------------------------ walk-forward, baselines, metrics

from candela.operators import baselines as bl  # noqa: E402
from candela.operators import folds as fo  # noqa: E402
from candela.operators import metrics as me  # noqa: E402

PREP_SQL, _ = sq.features(CLEAN_DAILY_SQL, "prep")
PIPE_SQL, _ = sq.features(CLEAN_DAILY_SQL, "pipeline")


def _fold_sql(frame_sql: str, ratio=0.7, step=250, gap=0, min_train=1, min_test=1) -> str:
    """CTEs ``f`` (frame), ``cal`` (date ordinals) and ``fk`` (kept folds)."""
    return f"""
f AS ({frame_sql}),
cal AS (SELECT Date, CAST(row_number() OVER (ORDER BY Date) - 1 AS INTEGER) AS d FROM (SELECT DISTINCT Date FROM f) x),
nn AS (SELECT CAST(count(*) AS INTEGER) AS n FROM cal),
fs AS (SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS fold_id, CAST(ts AS INTEGER) AS test_start, n
       FROM (SELECT unnest(generate_series(CAST(floor(n * CAST({ratio!r} AS DOUBLE)) AS BIGINT), n - 1, {step})) AS ts, n
             FROM nn) y),
fk AS (SELECT fold_id, test_start, CAST(least(test_start + {step}, n) AS INTEGER) AS test_end,
              CAST(test_start - {gap} AS INTEGER) AS train_end, n AS n_dates FROM fs
       WHERE test_start - {gap} > 0 AND test_start - {gap} >= {min_train}
         AND least(test_start + {step}, n) - test_start >= {min_test})"""


def _engineered(frame_sql: str) -> str:
    return f"SELECT * FROM ({frame_sql}) e WHERE {sq.not_null_all(['Close_Ratio_5', 'Trend_5', 'Close_Ratio_60', 'Trend_60', 'RSI', 'Volatility_10', 'Returns', 'Log_Returns', 'Gap_Pct', 'Volume_Pct_Change', 'BB_Position', 'BB_Std', 'BB_Middle', 'Signal_Line', 'MACD'])}"


PIPE_ENG_SQL = _engineered(PIPE_SQL)


def _pipe_engineered(spark, d):
    f = fe.features(_clean_daily(spark, d), "pipeline")
    return fe.engineer_features(f, (5, 60), 2)[0]


@register("folds", f"WITH {_fold_sql(PIPE_ENG_SQL, gap=21, min_train=50, min_test=10)} SELECT * FROM fk")
def q_folds(spark, d):
    """Walk-forward folds (ratio .7, step 250, purge gap 21, skip rule)."""
    df = _pipe_engineered(spark, d)
    return fo.folds(fo.calendar(df), fo.PIPELINE_WF)


@register("fold_train_counts", f"""
WITH {_fold_sql(PIPE_ENG_SQL, gap=21, min_train=50, min_test=10)},
r AS (SELECT f.*, cal.d FROM f JOIN cal USING (Date))
SELECT fk.fold_id, fk.train_end, fk.test_start, fk.test_end,
  CAST((SELECT count(*) FROM r WHERE r.d < fk.train_end) AS BIGINT) AS train_rows,
  CAST(coalesce((SELECT sum(Target) FROM r WHERE r.d < fk.train_end), 0) AS BIGINT) AS train_pos,
  CAST((SELECT count(*) FROM r WHERE r.d >= fk.test_start AND r.d < fk.test_end) AS BIGINT) AS test_rows
FROM fk""")
def q_fold_train_counts(spark, d):
    """Train and test sizes per fold from cumulative per-date counts."""
    df = _pipe_engineered(spark, d)
    cal = fo.calendar(df)
    return fo.fold_train_counts(fo.with_date_ordinal(df, cal), fo.folds(cal, fo.PIPELINE_WF))


def _naive_sql() -> str:
    return f"""
WITH {_fold_sql(f"SELECT * FROM ({PREP_SQL}) p")},
f2 AS (SELECT f.*, {sq.pct('lead(Close) OVER (PARTITION BY Ticker ORDER BY Date)', 'Close')} AS fwd_return FROM f),
t AS (SELECT f2.*, fk.fold_id FROM f2 JOIN cal USING (Date) JOIN fk ON cal.d >= fk.test_start AND cal.d < fk.test_end)
SELECT 'NaiveBaseline' AS model, fold_id, Ticker, Date, Target,
       CAST(coalesce(lag(Target) OVER (PARTITION BY Ticker, fold_id ORDER BY Date), 0) AS INTEGER) AS Predictions,
       fwd_return
FROM t"""


def _ma_sql() -> str:
    frame = f"""SELECT * FROM (SELECT *, {sq.roll('avg', 'Close', 60)} AS MA_60 FROM ({PREP_SQL}) p) q
WHERE MA_60 IS NOT NULL"""
    return f"""
WITH {_fold_sql(frame)},
f2 AS (SELECT f.*, {sq.pct('lead(Close) OVER (PARTITION BY Ticker ORDER BY Date)', 'Close')} AS fwd_return FROM f),
t AS (SELECT f2.*, fk.fold_id FROM f2 JOIN cal USING (Date) JOIN fk ON cal.d >= fk.test_start AND cal.d < fk.test_end)
SELECT 'MovingAverage' AS model, fold_id, Ticker, Date, Target,
       CAST(Close > MA_60 AS INTEGER) AS Predictions, fwd_return
FROM t"""


def _prep(spark, d):
    return fe.features(_clean_daily(spark, d), "prep")


@register("baseline_naive", _naive_sql())
def q_baseline_naive(spark, d):
    """M1: naive baseline predictions over expanding folds (no gap)."""
    return bl.naive_predictions(_prep(spark, d))


@register("baseline_ma", _ma_sql())
def q_baseline_ma(spark, d):
    """Close above its 60-row moving average, over expanding folds."""
    return bl.ma_predictions(_prep(spark, d))


BASE_PRED_SQL = f"SELECT * FROM ({_naive_sql()}) a UNION ALL SELECT * FROM ({_ma_sql()}) b"


def _base_preds(spark, d):
    p = _prep(spark, d)
    return bl.naive_predictions(p).unionByName(bl.ma_predictions(p))


METRICS_SQL = f"""
WITH p AS ({BASE_PRED_SQL}),
c AS (SELECT model,
        CAST(count_if(Target = 1 AND Predictions = 1) AS BIGINT) AS tp,
        CAST(count_if(Target = 0 AND Predictions = 1) AS BIGINT) AS fp,
        CAST(count_if(Target = 1 AND Predictions = 0) AS BIGINT) AS fn,
        CAST(count_if(Target = 0 AND Predictions = 0) AS BIGINT) AS tn,
        CAST(sum(Predictions) AS BIGINT) AS total_trades, count(*) AS n
      FROM p GROUP BY model)
SELECT model,
  CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) END AS accuracy,
  CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) END AS directional_accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1,
  CASE WHEN tp + fn > 0 AND tn + fp > 0
       THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 END AS roc_auc,
  total_trades, tp, fp, fn, tn
FROM c"""

_MCOLS = ["accuracy", "directional_accuracy", "precision", "recall", "f1", "roc_auc"]


@register("metrics", METRICS_SQL, _MCOLS)
def q_metrics(spark, d):
    """D-2...D-5: metrics of both baselines in one aggregate."""
    return me.classification_metrics(_base_preds(spark, d)).drop("confusion_matrix")


@register("confusion", f"""
WITH p AS ({BASE_PRED_SQL})
SELECT model, CAST(Target AS INTEGER) AS actual, CAST(Predictions AS INTEGER) AS predicted,
       CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY ALL""")
def q_confusion(spark, d):
    """D-1: confusion counts in long form (model, actual, predicted, n)."""
    p = _base_preds(spark, d)
    return p.groupBy("model", F.col("Target").cast("int").alias("actual"),
                     F.col("Predictions").cast("int").alias("predicted")) \
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("sharpe", f"""
WITH p AS ({BASE_PRED_SQL}),
s AS (SELECT model, avg(fwd_return * (2 * Predictions - 1)) AS m, stddev_samp(fwd_return * (2 * Predictions - 1)) AS sd
      FROM p GROUP BY model)
SELECT model, CASE WHEN sd > 0 THEN m / sd * {sq.dbl(252 ** 0.5)} ELSE 0.0 END AS sharpe FROM s""", ["sharpe"])
def q_sharpe(spark, d):
    """D-6: annualised Sharpe of the long/short strategy each model implies."""
    return me.sharpe(_base_preds(spark, d))


_ORD_SQL = "SELECT * FROM (VALUES ('NaiveBaseline', 0), ('MovingAverage', 1)) v(model, ordinal)"


def _ordinals(spark):
    return spark.createDataFrame([("NaiveBaseline", 0), ("MovingAverage", 1)], "model string, ordinal int")


@register("rank_models", f"""
WITH m AS ({METRICS_SQL}), o AS ({_ORD_SQL})
SELECT m.*, o.ordinal, CAST(row_number() OVER (ORDER BY precision DESC NULLS LAST, o.ordinal) AS INTEGER) AS rank
FROM m JOIN o USING (model)""", _MCOLS)
def q_rank_models(spark, d):
    """D-21: models ranked by precision, ties by registry order."""
    m = me.classification_metrics(_base_preds(spark, d)).drop("confusion_matrix")
    return me.rank_models(m.join(F.broadcast(_ordinals(spark)), "model"), "Precision")


@register("best_model", f"""
WITH m AS ({METRICS_SQL}), o AS ({_ORD_SQL})
SELECT * FROM (SELECT m.*, o.ordinal, CAST(row_number() OVER (ORDER BY precision DESC NULLS LAST, o.ordinal) AS INTEGER) AS rank
FROM m JOIN o USING (model)) r WHERE rank = 1""", _MCOLS)
def q_best_model(spark, d):
    """D-22: the best model by precision."""
    m = me.classification_metrics(_base_preds(spark, d)).drop("confusion_matrix")
    return me.best_model(m.join(F.broadcast(_ordinals(spark)), "model"), "precision")


@register("top_models", f"""
WITH m AS ({METRICS_SQL}), o AS ({_ORD_SQL})
SELECT * FROM (SELECT m.*, o.ordinal, CAST(row_number() OVER (ORDER BY f1 DESC NULLS LAST, o.ordinal) AS INTEGER) AS rank
FROM m JOIN o USING (model)) r WHERE rank <= 5""", _MCOLS)
def q_top_models(spark, d):
    """D-23: the five best models by F1."""
    m = me.classification_metrics(_base_preds(spark, d)).drop("confusion_matrix")
    return me.top_k(m.join(_ordinals(spark), "model"), 5, "f1")


@register("benchmark_report", f"""
WITH m AS ({METRICS_SQL})
SELECT model, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
       total_trades, round(roc_auc, 4) AS roc_auc, tp, fp, fn, tn FROM m""")
def q_benchmark_report(spark, d):
    """D-28: the extended benchmark table, rounded."""
    return me.report_table(me.classification_metrics(_base_preds(spark, d)), extended=True)


@register("metrics_all_models", f"""
WITH m AS ({METRICS_SQL}), o AS ({_ORD_SQL} UNION ALL SELECT 'NoPredictions', 2)
SELECT model, ordinal, coalesce(accuracy, 0) AS accuracy, directional_accuracy, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall,
       coalesce(f1, 0) AS f1, roc_auc, coalesce(total_trades, 0) AS total_trades, tp, fp, fn, tn FROM o LEFT JOIN m USING (model)""", _MCOLS)
def q_metrics_all_models(spark, d):
    """D-7: a registered model without predictions scores 0 and keeps its row."""
    models = _ordinals(spark).union(spark.createDataFrame([("NoPredictions", 2)], "model string, ordinal int"))
    return me.empty_safe(me.classification_metrics(_base_preds(spark, d)).drop("confusion_matrix"), models)


# ------------------------------------------------------------------ model back-tests (rows-only checks)

from candela.operators import models as mo  # noqa: E402

PIPE_PREDICTORS = ["Close_Ratio_5", "Trend_5", "Close_Ratio_60", "Trend_60"]


def _model_input(spark, d):
    return bl.with_forward_return(_pipe_engineered(spark, d))


def _backtest_query(names: list[str], doc: str):
    def q(spark, d):
        return mo.backtest(_model_input(spark, d), PIPE_PREDICTORS, [mo.REGISTRY[n] for n in names])
    q.__doc__ = doc
    return q


for _key, _names, _doc in [
    ("model_logistic", ["LogisticRegression"], "M7: L2 logistic regression (C=1) walk-forward predictions."),
    ("model_ridge", ["Ridge"], "M4: ridge classifier (alpha 1, labels -1/1, sign of the score)."),
    ("model_linear", ["LinearRegression"], "M3: least squares on the 0/1 target, score >= threshold."),
    ("model_lasso", ["Lasso"], "M5: lasso (alpha .001), score >= threshold."),
    ("model_elastic_net", ["ElasticNet"], "M6: elastic net (alpha .001, l1 ratio .5), score >= threshold."),
    ("model_rf", ["RandomForest"], "M8: random forest (200 trees, depth 15, split 20, leaf 10, sqrt features)."),
    ("model_extra_trees", ["ExtraTrees"], "M9: randomised trees, random cuts, without bootstrap (200, depth 15)."),
    ("model_gbt", ["GradientBoosting"], "M10: gradient-boosted trees (150, depth 8, step .1), splits by the gradients' variance."),
    ("model_hist_gbt", ["HistGradientBoosting"], "M11: Newton boosting, best leaf first (200, depth 10, 31 leaves of 20 rows)."),
    ("model_boosted_presets", ["XGBoost", "LightGBM", "CatBoost"],
     "M12-M14: level-wise with L2, best leaf first, and oblivious trees (200, depth 8, step .1), grown together."),
]:
    register(_key)(_backtest_query(_names, _doc))

@register("model_ar_drift")
def q_model_ar_drift(spark, d):
    """M21 (re-aimed): AR(5) with drift on daily changes, direction = sign of the
    predicted next change, walk-forward as the other models."""
    x, preds = mo.ar_features(_model_input(spark, d))
    return mo.backtest(x, preds, [mo.AR_MODEL])


#: the linear family of ``model_comparison``; the whole registry is compared by ``comparison_all``
LINEAR_FAMILY = ["LogisticRegression", "Ridge", "LinearRegression", "Lasso", "ElasticNet"]


@register("model_comparison")
def q_model_comparison(spark, d):
    """E13/D-21: metrics and precision rank of the linear family and both baselines, on the same rows and folds."""
    return ev.compare_models(_model_input(spark, d), PIPE_PREDICTORS, [mo.REGISTRY[n] for n in LINEAR_FAMILY])


@register("comparison_all")
def q_comparison_all(spark, d):
    """E13/D-21: metrics and precision rank of the pipeline registry's eleven models and both baselines."""
    return ev.compare_models(_model_input(spark, d), PIPE_PREDICTORS, mo.PIPELINE_REGISTRY)


# ------------------------------------------------------------------ forecast

from candela.operators import forecast as fc  # noqa: E402

H = 30


def _state_and_naive(spark, d):
    df = _pipe_engineered(spark, d)
    state = fc.series_state(df, 0.7)
    prev_target = F.lag("Target", 1).over(fe.w_series())
    naive = fc.last_rows(df.withColumn("_pt", prev_target).select("Ticker", "Date", "_pt")) \
              .select("Ticker", F.col("_pt").cast("int").alias("Prediction"), F.lit(None).cast("double").alias("Probability"))
    return df, state, naive


def _forecast_sql(variant: str) -> str:
    ret = "Returns"
    if variant == "backend":
        change = (f"least(greatest(CASE WHEN pt = 1 THEN abs(r20) * {sq.dbl(1.2)} ELSE -abs(r20) * {sq.dbl(0.8)} END, "
                  f"{sq.dbl(-0.05)}), {sq.dbl(0.05)})")
    else:
        change = "CASE WHEN pt = 1 THEN mu ELSE -mu END"
    price = f"start * (1.0::DOUBLE + CAST(step AS DOUBLE) * ({change}))"
    if variant in ("app", "backend"):
        price = f"({price}) * {sq.dbl(1 - 0.05)} + hist_avg * {sq.dbl(0.05)}"
    price = f"least(greatest({price}, start * {sq.dbl(0.9)}), start * {sq.dbl(1.1)})"
    return f"""
WITH f AS ({PIPE_ENG_SQL}),
cal AS (SELECT Date, CAST(row_number() OVER (ORDER BY Date) - 1 AS INTEGER) AS d,
               CAST(floor(count(*) OVER () * CAST(0.7 AS DOUBLE)) AS INTEGER) AS train_cut
        FROM (SELECT DISTINCT Date FROM f) x),
r AS (SELECT f.*, cal.d, cal.train_cut, lag(Target) OVER (PARTITION BY Ticker ORDER BY Date) AS pt,
             row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) <= 20 AS recent
      FROM f JOIN cal USING (Date)),
s AS (SELECT Ticker, max(Date) AS last_date, arg_max(Close, Date) AS start, arg_max(pt, Date) AS pt,
        count({ret}) FILTER (WHERE d < train_cut) AS n, avg({ret}) FILTER (WHERE d < train_cut) AS m,
        stddev_samp({ret}) FILTER (WHERE d < train_cut) AS sd,
        avg(Close) FILTER (WHERE d < train_cut) AS hist_avg,
        coalesce(avg({ret}) FILTER (WHERE recent), {sq.dbl(0.01)}) AS r20
      FROM r GROUP BY Ticker),
st AS (SELECT *, CASE WHEN n >= 20 THEN m ELSE {sq.dbl(0.001)} END AS mu,
              CASE WHEN n >= 20 THEN sd ELSE {sq.dbl(0.02)} END AS sigma FROM s),
days AS (SELECT Ticker, unnest(list_filter(generate_series(last_date + 1, last_date + {H * 7 // 5 + 7}, INTERVAL 1 DAY),
                                           lambda x: isodow(x) <= 5)[1:{H}]) AS Date FROM st),
steps AS (SELECT Ticker, CAST(row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS INTEGER) AS step,
                 CAST(Date AS DATE) AS Date FROM days),
p AS (SELECT steps.*, st.*, {price} AS price FROM steps JOIN st USING (Ticker))
SELECT Ticker, step, Date, price AS Close, CAST(pt AS INTEGER) AS Prediction,
       CASE WHEN pt = 1 THEN 'Up' ELSE 'Down' END AS Direction, CAST(NULL AS DOUBLE) AS Probability,
       price * (1.0::DOUBLE + sigma * sqrt(CAST(step AS DOUBLE))) AS Upper,
       price * (1.0::DOUBLE - sigma * sqrt(CAST(step AS DOUBLE))) AS Lower
FROM p"""


_FC_ROUND = ["Close", "Upper", "Lower"]


def _fc_query(variant):
    def q(spark, d):
        df, state, naive = _state_and_naive(spark, d)
        return fc.price_path(state, fc.fixed_directions(state, naive, H), H, variant)
    return q


register("forecast_path", _forecast_sql("pipeline"), _FC_ROUND)(_fc_query("pipeline"))
QUERIES["forecast_path"].__doc__ = "F3/F6/F9/A10: price path (+-mean return per step) with bands, naive direction."
register("forecast_reverting", _forecast_sql("app"), _FC_ROUND)(_fc_query("app"))
QUERIES["forecast_reverting"].__doc__ = "F4: path pulled 5% toward the training-mean Close each step."
register("forecast_asymmetric", _forecast_sql("backend"), _FC_ROUND)(_fc_query("backend"))
QUERIES["forecast_asymmetric"].__doc__ = "F5: asymmetric step from the mean of the last 20 returns."


@register("forecast_model")
def q_forecast_model(spark, d):
    """Logistic model fitted on the first 70% of dates, re-scored step by
    step while Close_Ratio/Trend evolve (one fold expression for a linear model);
    price path and bands as F3/F6."""
    df = _pipe_engineered(spark, d).persist()
    state = fc.series_state(df, 0.7)
    cal = fo.calendar(df)
    cut = cal.agg(F.floor(F.count(F.lit(1)) * F.lit(0.7)).cast("int").alias("c")).first()["c"]
    spec = mo.REGISTRY["LogisticRegression"]
    model = mo.fit(spec, fo.train_rows(fo.with_date_ordinal(df, cal), cut), PIPE_PREDICTORS)
    last = fc.last_rows(df.select("Ticker", "Date", *PIPE_PREDICTORS)).drop("Date")
    dirs = fc.model_directions(spec, model, last, state, PIPE_PREDICTORS, [5, 60], H)
    return fc.price_path(state, dirs, H, "pipeline")


@register("forecast_model_trees")
def q_forecast_model_trees(spark, d):
    """F1/F2/F7 with a tree model (random forest preset): its trees are arrays that one
    expression walks, so the recursion over the steps is one pass."""
    df = _pipe_engineered(spark, d).persist()
    state = fc.series_state(df, 0.7)
    cal = fo.calendar(df)
    cut = cal.agg(F.floor(F.count(F.lit(1)) * F.lit(0.7)).cast("int").alias("c")).first()["c"]
    spec = mo.REGISTRY["RandomForest"]
    model = mo.fit(spec, fo.train_rows(fo.with_date_ordinal(df, cal), cut), PIPE_PREDICTORS)
    last = fc.last_rows(df.select("Ticker", "Date", *PIPE_PREDICTORS)).drop("Date")
    dirs = fc.model_directions(spec, model, last, state, PIPE_PREDICTORS, [5, 60], H)
    return fc.price_path(state, dirs, H, "pipeline")


def _winner_input(spark, d):
    """The winner queries' rows as a written table: ticks are read once, and no fit carries the bars' and windows' plan along."""
    return written(_model_input(spark, d), "rows")


@register("forecast_winner")
def q_forecast_winner(spark, d):
    """D-22/F1-F7: the best of the registry's eleven models, refitted, forecasts 30 steps."""
    df = _winner_input(spark, d)
    return ev.winner_forecast(df, PIPE_PREDICTORS, mo.PIPELINE_REGISTRY, [5, 60], H)[1]


@register("result_winner")
def q_result_winner(spark, d):
    """The result document of the winner's forecast."""
    df = _winner_input(spark, d)
    comp, path = ev.winner_forecast(df, PIPE_PREDICTORS, mo.PIPELINE_REGISTRY, [5, 60], H)
    return rp.result_lines(df.select("Ticker", "Date", "Close"), path, comp, _headline(df, path))


@register("forecast_stitch", f"""
WITH b AS ({PIPE_ENG_SQL}), p AS ({_forecast_sql("pipeline")}),
l AS (SELECT Ticker, max(Date) AS Date, arg_max(Close, Date) AS Close FROM b GROUP BY Ticker)
SELECT Ticker, Date, Close, 'history' AS kind, CAST(NULL AS INTEGER) AS step, CAST(NULL AS DOUBLE) AS Upper, CAST(NULL AS DOUBLE) AS Lower FROM b
UNION ALL SELECT Ticker, Date, Close, 'forecast', 0, Close, Close FROM l
UNION ALL SELECT Ticker, Date, Close, 'forecast', step, Upper, Lower FROM p""", _FC_ROUND)
def q_forecast_stitch(spark, d):
    """History and forecast in one table with a connector row."""
    df, state, naive = _state_and_naive(spark, d)
    path = fc.price_path(state, fc.fixed_directions(state, naive, H), H, "pipeline")
    return fc.stitch(df.select("Ticker", "Date", "Close"), path)


# ------------------------------------------------------------------ statistics & chart tables

from candela.operators import stats as stt  # noqa: E402
from candela.plans import report as rp  # noqa: E402


def _pipe(spark, d):
    return fe.features(_clean_daily(spark, d), "pipeline")


@register("hist_returns", f"""
WITH f AS ({PIPE_SQL}), x AS (SELECT Ticker, Returns AS v FROM f WHERE Returns IS NOT NULL),
r AS (SELECT Ticker, min(v) AS mn, max(v) AS mx, avg(v) AS mean FROM x GROUP BY Ticker),
b AS (SELECT x.Ticker, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / ((mx - mn) / 50)), 49) END AS INTEGER) AS bin
      FROM x JOIN r USING (Ticker)),
c AS (SELECT Ticker, bin, count(*) AS cnt FROM b GROUP BY Ticker, bin),
g AS (SELECT Ticker, mn, mx, mean, CAST(unnest(generate_series(0, 49)) AS INTEGER) AS bin FROM r)
SELECT g.Ticker, g.bin, mn + bin * (mx - mn) / 50 AS lo, mn + (bin + 1) * (mx - mn) / 50 AS hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count, mean
FROM g LEFT JOIN c USING (Ticker, bin)""", ["lo", "hi", "mean"])
def q_hist_returns(spark, d):
    """D-13/G5: 50-bin histogram of daily returns per ticker with the mean."""
    return stt.histogram(_pipe(spark, d), "Returns", 50)


@register("box_by_year", f"""
WITH f AS ({PIPE_SQL}), x AS (SELECT Ticker, year(Date) AS year, Returns AS v FROM f WHERE Returns IS NOT NULL),
q AS (SELECT Ticker, year, CAST(count(*) AS BIGINT) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM x GROUP BY Ticker, year)
SELECT Ticker, year, n, q1, median, q3,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
  max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
  CAST(count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS fliers
FROM x JOIN q USING (Ticker, year) GROUP BY Ticker, year, n, q1, median, q3""",
          ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
def q_box_by_year(spark, d):
    """D-14/D-15/D-16: yearly box-plot statistics of daily returns per ticker."""
    return stt.box_by_year(_pipe(spark, d), "Returns")


_MONTHS = [f"m{m}" for m in range(1, 13)]


@register("pivot_day_month", f"""
WITH f AS ({PIPE_SQL})
SELECT Ticker, isodow(Date) - 1 AS Day_of_Week,
  {", ".join(f"avg(CASE WHEN month(Date) = {m} THEN Returns END) AS m{m}" for m in range(1, 13))}
FROM f GROUP BY Ticker, isodow(Date) - 1""", _MONTHS)
def q_pivot_day_month(spark, d):
    """D-17: mean daily return by weekday x month (pivot)."""
    return stt.pivot_day_month(_pipe(spark, d), "Returns")


def _acf_sql(max_lag=50):
    leads = ", ".join(f"c * lead(c, {h}) OVER (PARTITION BY Ticker ORDER BY Date) AS p{h}" for h in range(1, max_lag + 1))
    sums = ", ".join(f"coalesce(sum(p{h}), 0.0) AS p{h}" for h in range(1, max_lag + 1))
    cols = ", ".join(f"p{h} AS '{h}'" for h in range(1, max_lag + 1))
    return f"""
WITH f AS ({PIPE_SQL}), x AS (SELECT Ticker, Date, Returns AS v FROM f WHERE Returns IS NOT NULL),
m AS (SELECT Ticker, avg(v) AS mv, count(*) AS n FROM x GROUP BY Ticker),
c AS (SELECT x.Ticker, x.Date, v - mv AS c, n FROM x JOIN m USING (Ticker)),
p AS (SELECT Ticker, n, c * c AS c0, {leads} FROM c),
s AS (SELECT Ticker, first(n) AS n, sum(c0) AS den, {sums} FROM p GROUP BY Ticker),
u AS (UNPIVOT s ON {", ".join(f"p{h}" for h in range(1, max_lag + 1))} INTO NAME lagname VALUE num)
SELECT Ticker, CAST(substr(lagname, 2) AS INTEGER) AS lag, CASE WHEN den <> 0 THEN num / den END AS acf,
       {sq.dbl(1.96)} / sqrt(CAST(n AS DOUBLE)) AS band95, {sq.dbl(2.58)} / sqrt(CAST(n AS DOUBLE)) AS band99
FROM u"""


@register("acf", _acf_sql(), ["acf", "band95", "band99"])
def q_acf(spark, d):
    """D-18: autocorrelation of daily returns, lags 1-50, with 95%/99% bands."""
    return stt.autocorrelation(_pipe(spark, d), "Returns", 50)


@register("acf_halo", _acf_sql(), ["acf", "band95", "band99"])
def q_acf_halo(spark, d):
    """D-18 on 512-row buckets with a 50-row forward halo (equal to acf)."""
    return stt.autocorrelation(_pipe(spark, d), "Returns", 50, rows_per_bucket=HALO_ROWS)


@register("tail_n", f"""
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS k
FROM ({sq.BARS_DAILY}) b) x WHERE k <= 100""")
def q_tail_n(spark, d):
    """D-24: the last 100 bars of each ticker."""
    return stt.tail_n(src.bars_daily(spark, d), 100)


@register("candlesticks", f"""
SELECT * EXCLUDE (k), CASE WHEN Close >= Open THEN 'up' ELSE 'down' END AS candle
FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS k FROM ({sq.BARS_DAILY}) b) x
WHERE k <= 100""")
def q_candlesticks(spark, d):
    """Candlestick table of the last 100 bars with colour."""
    return stt.candlesticks(src.bars_daily(spark, d), 100)


@register("indicator_panel", f"""
WITH f AS ({PREP_SQL})
SELECT Ticker, Date, Close, BB_Middle + BB_Std * 2.0 AS BB_Upper, BB_Middle, BB_Middle - BB_Std * 2.0 AS BB_Lower,
       RSI, RSI > 70 AS overbought, RSI < 30 AS oversold, MACD, Signal_line AS Signal,
       MACD - Signal_line AS MACD_Hist, CAST(Volume AS DOUBLE) / 1e6 AS Volume_M
FROM f""", ["BB_Upper", "BB_Middle", "BB_Lower", "RSI", "MACD", "Signal", "MACD_Hist", "Volume_M"])
def q_indicator_panel(spark, d):
    """Bollinger bands, RSI zones, MACD histogram, volume in millions."""
    return stt.indicator_panel(_prep(spark, d), "Signal_line")


@register("price_range", f"SELECT Ticker, Date, High, Low, Close FROM ({sq.BARS_DAILY}) b")
def q_price_range(spark, d):
    """High/Low envelope per ticker."""
    return stt.price_range(src.bars_daily(spark, d))


@register("cum_return", f"""
WITH f AS ({PIPE_SQL})
SELECT Ticker, Date, Returns,
  CASE WHEN min(Returns) OVER w <= -1 THEN 0.0 ELSE exp(sum(ln(1 + Returns)) OVER w) END AS cum_return
FROM f WINDOW w AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
          ["Returns", "cum_return"])
def q_cum_return(spark, d):
    """Cumulative return per ticker."""
    return stt.cumulative_return(_pipe(spark, d), "Returns")


@register("metric_bars", f"""
WITH m AS ({METRICS_SQL})
SELECT model, precision AS value, precision = max(precision) OVER () AS is_best FROM m""", ["value"])
def q_metric_bars(spark, d):
    """G3/D-25: precision bars with the best model flagged."""
    m = me.classification_metrics(_base_preds(spark, d))
    return rp.metric_bars(m, "Precision")


@register("result_json")
def q_result_json(spark, d):
    """Result document as JSON lines (historical, predictions, metrics, comparison, best)."""
    df, state, naive = _state_and_naive(spark, d)
    path = fc.price_path(state, fc.fixed_directions(state, naive, H), H, "pipeline")
    m = me.classification_metrics(_base_preds(spark, d), with_sharpe=True)
    comp = me.rank_models(m.join(F.broadcast(_ordinals(spark)), "model"), "precision")
    return rp.result_lines(df.select("Ticker", "Date", "Close"), path, comp, _headline(df, path))


# ------------------------------------------------------------------ single-indicator views

_BACK_SQL, _BACK_ROUND = sq.backend_features(CLEAN_DAILY_SQL)
_PIPE_SQL_FULL, _PIPE_ROUND = sq.features(CLEAN_DAILY_SQL, "pipeline")
_APP_SQL, _APP_ROUND = sq.features(CLEAN_DAILY_SQL, "app")

_VIEWS = [
    # name, profile, columns, doc
    ("returns", "pipeline", ["Returns"], "C1: daily percentage return."),
    ("lagged_returns", "backend", ["Returns_1d", "Returns_3d", "Returns_5d", "Returns_10d", "Returns_21d"],
     "C2: k-day returns lagged one day."),
    ("log_returns", "pipeline", ["Log_Returns"], "C3: log return."),
    ("gap_range", "pipeline", ["High_Low_Pct", "Gap_Pct"], "C4/C5: range and gap ratios."),
    ("volume_change", "pipeline", ["Volume_Pct_Change"], "C6: volume change (x/0 = Infinity)."),
    ("rsi14", "pipeline", ["RSI"], "C7: 14-row RSI (simple means)."),
    ("ema_macd", "pipeline", ["MACD", "Signal_Line"], "C8-C10: EMA 12/26, MACD and its EMA-9 signal."),
    ("macd_hist", "backend", ["MACD", "MACD_Signal", "MACD_Hist"], "C11: lagged MACD histogram."),
    ("bollinger", "pipeline", ["BB_Middle", "BB_Std", "BB_Position"], "C12/C13: Bollinger middle, std, position."),
    ("bb_width", "backend", ["BB_Position", "BB_Width"], "C13/C14: lagged band position and width."),
    ("volatility", "pipeline", ["Volatility_10"], "C15: 10-row volatility of returns."),
    ("volatility_lagged", "backend", ["Volatility_5d", "Volatility_10d", "Volatility_21d"],
     "C16: volatility of lagged returns, lagged again."),
    ("volume_ratio", "backend", ["Volume_Ratio_20d"], "C17: volume over its 20-row mean, lagged."),
    ("obv", "backend", ["OBV", "OBV_Change_5d"], "C18/C19: on-balance volume and its 5-row change."),
    ("close_ratio", "app", ["Close_Ratio_2", "Close_Ratio_5", "Close_Ratio_60", "Close_Ratio_250"],
     "C20: Close over its h-row mean."),
    ("close_ma_ratio", "backend", ["Close_MA_5_Ratio", "Close_MA_10_Ratio", "Close_MA_20_Ratio", "Close_MA_50_Ratio"],
     "C21: lagged Close / moving-average ratios."),
    ("trend", "app", ["Trend_2", "Trend_5", "Trend_60", "Trend_250"], "C22: sums of past targets (shift 1)."),
    ("target", "pipeline", ["Target"], "C24: next-day direction label."),
    ("calendar", "pipeline", ["Day_of_Week", "Month"], "C25: Monday=0 weekday and month."),
]
_PROFILE_SQL = {"pipeline": (_PIPE_SQL_FULL, _PIPE_ROUND), "backend": (_BACK_SQL, _BACK_ROUND),
                "app": (_APP_SQL, _APP_ROUND)}


def _view(profile, cols):
    def q(spark, d):
        return fe.features(_clean_daily(spark, d), profile).select("Ticker", "Date", *cols)
    return q


for _name, _prof, _cols, _doc in _VIEWS:
    _psql, _pround = _PROFILE_SQL[_prof]
    _sql = f"SELECT Ticker, Date, {', '.join(_cols)} FROM ({_psql}) v"
    _fn = _view(_prof, _cols)
    _fn.__doc__ = _doc
    register(_name, _sql, [c for c in _cols if c in _pround])(_fn)


# ------------------------------------------------------------------ module path (L3) and scaled models

MODULE_HORIZONS = (2, 5, 60, 250, 1000)


def _module_input(spark, d):
    """L3 input: processed features (prep profile) re-engineered with horizons up to 1000, shift 1."""
    eng, preds = fe.engineer_features(_prep(spark, d), MODULE_HORIZONS, 1)
    return bl.with_forward_return(eng), preds


def _module_query(name: str, doc: str):
    def q(spark, d):
        x, preds = _module_input(spark, d)
        return mo.backtest(x, preds, [mo.REGISTRY[name]], fo.PLAIN_WF)
    q.__doc__ = doc
    return q


for _key, _name, _doc in [
    ("module_logistic", "LogisticRegressionBalanced",
     "L3/M7: balanced logistic regression on the module features (horizons to 1000), expanding folds."),
    ("svc_rff", "SVCBalanced", "M16 (re-aimed): RBF random features of z-scored inputs -> linear SVM -> Platt probability."),
    ("svr_rff", "SVR", "M17: epsilon-insensitive regression on RBF random features, score >= threshold."),
    ("kernel_ridge_rff", "KernelRidge", "M18 (re-aimed): RBF(gamma .1) random features -> ridge without intercept."),
    ("gp_rff", "GaussianProcess", "M19: Gaussian process classification by Laplace's approximation on RBF(length 1) random features."),
    ("regime_mixture", "RegimeMixture",
     "M20 (re-aimed): 3-regime Gaussian mixture on the module features; P(top regime) >= threshold."),
]:
    register(_key)(_module_query(_name, _doc))


def _backend(spark, d):
    return bl.with_forward_return(fe.features(_clean_daily(spark, d), "backend"))


def fold_zscore_stats(df, predictors, wf):
    """Per fold, mean and sample std (+1e-8) of each predictor over the finite
    training values (the statistics the per-fold scaler of the models uses)."""
    cal = fo.calendar(df)
    data = fo.with_date_ordinal(df, cal)
    out = None
    for r in fo.folds(cal, wf).collect():            # one row per fold
        tr = fo.train_rows(data, r["train_end"])
        a = tr.agg(*[F.avg(mo._finite(c)).alias(f"m{i}") for i, c in enumerate(predictors)],
                   *[F.stddev_samp(mo._finite(c)).alias(f"s{i}") for i, c in enumerate(predictors)])
        stack = "stack({}, {}) as (feature, mean, std)".format(
            len(predictors), ", ".join(f"'{c}', m{i}, s{i} + 1e-8" for i, c in enumerate(predictors)))
        part = a.selectExpr(f"{r['fold_id']} as fold_id", stack)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "fold_id int, feature string, mean double, std double")


_BACK_PREDS = [c for c in ["Returns_1d", "Returns_3d", "Returns_5d", "Returns_10d", "Returns_21d", "Log_Returns",
                           "Volatility_5d", "Volatility_10d", "Volatility_21d", "RSI_14", "MACD", "MACD_Signal",
                           "MACD_Hist", "BB_Position", "BB_Width", "Volume_Ratio_20d", "OBV", "OBV_Change_5d",
                           "High_Low_Pct", "Gap_Pct", "Close_MA_5_Ratio", "Close_MA_10_Ratio", "Close_MA_20_Ratio",
                           "Close_MA_50_Ratio"]]


def _zscore_sql():
    parts = " UNION ALL ".join(
        f"SELECT fold_id, '{c}' AS feature, avg(CASE WHEN isfinite({c}) THEN {c} END) AS mean, "
        f"stddev_samp(CASE WHEN isfinite({c}) THEN {c} END) + 1e-8 AS std FROM tr GROUP BY fold_id"
        for c in _BACK_PREDS)
    return f"""
WITH {_fold_sql(_BACK_SQL, gap=21, min_train=50, min_test=10)},
r AS (SELECT f.*, cal.d FROM f JOIN cal USING (Date)),
tr AS (SELECT fk.fold_id, r.* FROM fk JOIN r ON r.d < fk.train_end)
SELECT CAST(fold_id AS INTEGER) AS fold_id, feature, mean, std FROM ({parts}) u"""


@register("fold_zscore", _zscore_sql(), ["mean", "std"])
def q_fold_zscore(spark, d):
    """Training-fold z-score statistics of the backend predictors (ddof 1, +1e-8)."""
    return fold_zscore_stats(fe.features(_clean_daily(spark, d), "backend"), _BACK_PREDS, fo.PIPELINE_WF)


@register("model_backend_z")
def q_model_backend_z(spark, d):
    """Backend predictors z-scored per fold, balanced logistic regression."""
    return mo.backtest(_backend(spark, d), _BACK_PREDS, [mo.REGISTRY["LogisticRegressionZ"]])


@register("feature_importance")
def q_feature_importance(spark, d):
    """D-26: random-forest feature importances on the first 70% of dates, descending."""
    df = _pipe_engineered(spark, d).persist()
    cal = fo.calendar(df)
    cut = cal.agg(F.floor(F.count(F.lit(1)) * F.lit(0.7)).cast("int").alias("c")).first()["c"]
    model = mo.fit(mo.REGISTRY["RandomForest"], fo.train_rows(fo.with_date_ordinal(df, cal), cut), PIPE_PREDICTORS)
    rows = mo.feature_importance(model, PIPE_PREDICTORS)
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


@register("sarima_hr")
def q_sarima_hr(spark, d):
    """M22 (re-aimed): seasonal AR(5)(1,1,1)_5 with drift by Hannan-Rissanen regressions, walk-forward."""
    return mo.sarima_hr_backtest(_model_input(spark, d), name="SARIMA")


@register("sarimax_hr")
def q_sarimax_hr(spark, d):
    """M23 (re-aimed): as sarima_hr with the model predictors as exogenous regressors
    (contemporaneous, as the reference uses them)."""
    return mo.sarima_hr_backtest(_model_input(spark, d), exog=PIPE_PREDICTORS, name="SARIMAX")


# ------------------------------------------------------------------ long-series (halo) execution

def _halo_query(profile):
    def q(spark, d):
        return fe.halo_features(_clean_daily(spark, d), profile, rows_per_bucket=HALO_ROWS)
    q.__doc__ = (f"C1-C28 '{profile}' features computed on {HALO_ROWS}-row buckets per series with a "
                 "lookback halo (hot tickers spread over many tasks); equal to the unbucketed result.")
    return q


for _p in ("pipeline", "prep"):
    _sql, _dcols = sq.features(CLEAN_DAILY_SQL, _p)
    register(f"features_{_p}_halo", _sql, [c for c in _dcols if c not in {"Open", "High", "Low", "Close"}])(_halo_query(_p))


@register("features_backend_halo", _bsql, _bcols)
def q_features_backend_halo(spark, d):
    """C2-C21 'backend' features on row buckets with a lookback halo; the running
    OBV adds the step total of earlier buckets. Equal to the unbucketed result."""
    return fe.halo_features(_clean_daily(spark, d), "backend", rows_per_bucket=HALO_ROWS)


# ------------------------------------------------------------------ loader, headline, tails, fallback, evaluation

from candela.plans import evaluate as ev  # noqa: E402

_DEDUP_RAW_SQL = f"""
SELECT Ticker, Date, Open, High, Low, Close, Volume FROM (
  SELECT *, lag({{'d': Date}}) OVER (PARTITION BY Ticker ORDER BY Date, _ord) AS _pd FROM ({RAW_SQL}) r) x
WHERE _pd IS NULL OR _pd.d IS DISTINCT FROM Date"""
_PROC_SQL, _PROC_ROUND = sq.features(_DEDUP_RAW_SQL, "prep")


@register("processed_data", _PROC_SQL, [c for c in _PROC_ROUND if c not in {"Open", "High", "Low", "Close"}])
def q_processed_data(spark, d):
    """Raw bars -> clean_data without outlier removal -> prep-profile features."""
    raw = _raw(spark, d)
    return fe.features(cl.clean_data(raw, remove_outliers=False).drop("_ord"), "prep")


@register("headline", f"""
WITH p AS ({_forecast_sql("pipeline")}), b AS ({PIPE_ENG_SQL})
SELECT Ticker, last_price, end_price, (end_price - last_price) / last_price * 100.0 AS change_pct
FROM (SELECT Ticker, arg_max(Close, Date) AS last_price FROM b GROUP BY Ticker) l
JOIN (SELECT Ticker, arg_max(Close, step) AS end_price FROM p GROUP BY Ticker) e USING (Ticker)""",
          ["end_price", "change_pct"])
def q_headline(spark, d):
    """D-12: last price, forecast end price and change in percent per ticker."""
    df, state, naive = _state_and_naive(spark, d)
    return _headline(df, fc.price_path(state, fc.fixed_directions(state, naive, H), H, "pipeline"))


def _headline(df, path):
    last = df.groupBy("Ticker").agg(F.max_by("Close", "Date").alias("last_price"))
    end = path.groupBy("Ticker").agg(F.max_by("Close", "step").alias("end_price"))
    return last.join(end, "Ticker").withColumn(
        "change_pct", (F.col("end_price") - F.col("last_price")) / F.col("last_price") * 100.0)


@register("pred_vs_actual", f"""
SELECT * EXCLUDE (k) FROM (
  SELECT Ticker, Date, Target, Predictions, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS k
  FROM ({_naive_sql()}) p) x WHERE k <= 100""")
def q_pred_vs_actual(spark, d):
    """D-27: the last 100 back-test rows per ticker, prediction next to the actual label."""
    p = bl.naive_predictions(_prep(spark, d)).select("Ticker", "Date", "Target", "Predictions")
    return stt.tail_n(p, 100)


def _fallback_sql(legacy: bool) -> str:
    base = _forecast_sql("pipeline")
    close = "start * (1.0::DOUBLE + 0.001::DOUBLE * CAST(step AS DOUBLE))"
    if legacy:
        up = "start * (1.0::DOUBLE + 0.011::DOUBLE * CAST(step AS DOUBLE))"
        lo = "start * (1.0::DOUBLE + 0.009::DOUBLE * CAST(step AS DOUBLE))"
    else:
        up = f"{close} * (1.0::DOUBLE + sigma * sqrt(CAST(step AS DOUBLE)))"
        lo = f"{close} * (1.0::DOUBLE - sigma * sqrt(CAST(step AS DOUBLE)))"
    head = base[:base.index("p AS (SELECT steps.*")]
    return head + f"""p AS (SELECT steps.*, st.* FROM steps JOIN st USING (Ticker))
SELECT Ticker, step, Date, {close} AS Close, 1 AS Prediction, 'Up' AS Direction, 0.5::DOUBLE AS Probability,
       {up} AS Upper, {lo} AS Lower FROM p"""


@register("forecast_fallback", _fallback_sql(False), _FC_ROUND)
def q_forecast_fallback(spark, d):
    """F8: model without probabilities -> +0.1% per step, 'Up', with volatility bands."""
    df, state, naive = _state_and_naive(spark, d)
    return fc.fallback_path(state, H)


@register("forecast_fallback_legacy", _fallback_sql(True), _FC_ROUND)
def q_forecast_fallback_legacy(spark, d):
    """F8 parity: the reference's fallback bands (+1.1% / +0.9% per step)."""
    df, state, naive = _state_and_naive(spark, d)
    return fc.fallback_path(state, H, legacy_bands=True)


@register("evaluate_models")
def q_evaluate_models(spark, d):
    """The registry's eleven models evaluated with guards; failures are rows."""
    return ev.evaluate_models(_model_input(spark, d), PIPE_PREDICTORS, mo.PIPELINE_REGISTRY)


# ------------------------------------------------------------------ exact KNN

from candela.operators import knn as kn  # noqa: E402


def _knn_sql(k=10):
    dist = "sqrt(" + " + ".join(f"(te.{c} - tr.{c}) * (te.{c} - tr.{c})" for c in PIPE_PREDICTORS) + ")"
    return f"""
WITH {_fold_sql(PIPE_ENG_SQL, gap=21, min_train=50, min_test=10)},
r AS (SELECT f.*, cal.d FROM f JOIN cal USING (Date)),
te AS (SELECT fk.fold_id, fk.train_end, r.* FROM fk JOIN r ON r.d >= fk.test_start AND r.d < fk.test_end),
pairs AS (SELECT te.fold_id, te.Ticker, te.Date, te.Target, tr.Target AS y, {dist} AS dist,
                 tr.Ticker AS tt, tr.Date AS td
          FROM te JOIN r tr ON tr.d < te.train_end),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, Ticker, Date ORDER BY dist, tt, td) AS rk
                       FROM pairs) x WHERE rk <= {k})
SELECT 'KNN' AS model, fold_id, Ticker, Date, Target, avg(CAST(y AS DOUBLE)) AS probability,
       CAST(avg(CAST(y AS DOUBLE)) >= 0.51 AS INTEGER) AS Predictions
FROM knn GROUP BY fold_id, Ticker, Date, Target"""


@register("knn_vote", _knn_sql(), ["probability"])
def q_knn_vote(spark, d):
    """Exact 10-nearest-neighbour vote (Euclidean, uniform) per walk-forward fold,
    candidates from a multi-resolution grid (no all-pairs join)."""
    return kn.knn_backtest(_model_input(spark, d), PIPE_PREDICTORS, fo.PIPELINE_WF, k=10)


# queries of the rest of the inventory register themselves in the same dictionaries
from candela.plans import more  # noqa: E402, F401
