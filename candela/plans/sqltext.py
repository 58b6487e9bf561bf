"""Building blocks for the DuckDB oracle SQL (text only, for checking).

Each helper writes the SQL form of one rule in ``candela.functions.expr`` with
the same constants, frames and guards, so Spark and the oracle agree to the
last bit where both evaluate the same operations in the same order.
"""

from __future__ import annotations

W = "PARTITION BY Ticker ORDER BY Date"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def fdiv(a: str, b: str) -> str:
    q = f"(({a}) / ({b}))"
    return (f"(CASE WHEN ({b}) = 0 THEN (CASE WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END) "
            f"ELSE (CASE WHEN NOT isnan({q}) THEN {q} END) END)")


def pct(a: str, b: str) -> str:
    return f"({fdiv(a, b)} - 1.0)"


def frame(n: int, shift: int = 0, w: str = W) -> str:
    end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    return f"({w} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"


def roll(fn: str, x: str, n: int, shift: int = 0, w: str = W) -> str:
    fr = frame(n, shift, w)
    return f"(CASE WHEN count({x}) OVER {fr} = {n} THEN {fn}({x}) OVER {fr} END)"


def ema(x: str, span: int, w: str = W) -> str:
    # the whole history: the recursion itself, whatever frame the Spark side takes
    alpha = 2.0 / (span + 1.0)
    return (f"list_reduce(list({x}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"lambda acc, v: {dbl(alpha)} * v + {dbl(1.0 - alpha)} * acc)")


def rsi(ag: str, al: str) -> str:
    return (f"(CASE WHEN {al} = 0 THEN (CASE WHEN {ag} > 0 THEN 100.0::DOUBLE END) "
            f"ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + {ag} / {al}) END)")


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    if not cols:
        return sql
    # + 0.0 turns a rounded -0.0 into 0.0 (IEEE), so both engines print the same zero
    rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _q"


# ---------------------------------------------------------------- bar adapters

BARS_DAILY = """
SELECT l_returnflag AS Ticker, CAST(l_shipdate AS DATE) AS Date,
       arg_min(p, (l_orderkey, l_linenumber, p)) AS Open, max(p) AS High, min(p) AS Low,
       arg_max(p, (l_orderkey, l_linenumber, p)) AS Close,
       CAST(sum(l_quantity) AS BIGINT) AS Volume
FROM (SELECT *, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS p FROM lineitem) t
GROUP BY 1, 2"""

BARS_WIDE = """
SELECT 'P' || lpad(CAST(l_partkey % 16 AS VARCHAR), 2, '0') AS Ticker, CAST(l_shipdate AS DATE) AS Date,
       arg_min(p, (l_orderkey, l_linenumber, p)) AS Open, max(p) AS High, min(p) AS Low,
       arg_max(p, (l_orderkey, l_linenumber, p)) AS Close,
       CAST(sum(l_quantity) AS BIGINT) AS Volume
FROM (SELECT *, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS p FROM lineitem) t
GROUP BY 1, 2"""

BARS_HOURLY = """
SELECT event_type AS Ticker, date_trunc('hour', ts) AS Date,
       arg_min(value, (ts, event_id)) AS Open, max(value) AS High, min(value) AS Low,
       arg_max(value, (ts, event_id)) AS Close, CAST(count(*) AS BIGINT) AS Volume
FROM events GROUP BY 1, 2"""

BARS_SPARSE = """
SELECT o_orderpriority AS Ticker, CAST(o_orderdate AS DATE) AS Date,
       arg_min(o_totalprice, o_orderkey) AS Open, max(o_totalprice) AS High, min(o_totalprice) AS Low,
       arg_max(o_totalprice, o_orderkey) AS Close, CAST(count(*) AS BIGINT) AS Volume
FROM orders GROUP BY 1, 2"""


def with_defects(bars_sql: str) -> str:
    """SQL twin of ``sources.bars.with_defects``."""
    return f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS rn FROM ({bars_sql}) _b),
d AS (
  SELECT Ticker, Date,
    CASE WHEN rn % 103 = 0 THEN NULL WHEN rn % 107 = 0 THEN Open * 10 ELSE Open END AS Open,
    CASE WHEN rn % 107 = 0 THEN High * 10 ELSE High END AS High,
    CASE WHEN rn % 101 = 0 THEN Close * 1.01 WHEN rn % 107 = 0 THEN Low * 10 ELSE Low END AS Low,
    CASE WHEN rn % 107 = 0 THEN Close * 10 ELSE Close END AS Close,
    CASE WHEN rn % 109 = 0 THEN CAST(0 AS BIGINT) ELSE Volume END AS Volume,
    CAST(rn * 2 AS BIGINT) AS _ord, rn
  FROM b)
SELECT Ticker, Date, Open, High, Low, Close, Volume, _ord FROM d
UNION ALL
SELECT Ticker, Date, Open, greatest(High, Close * 1.01) AS High, Low, Close * 1.01 AS Close, Volume,
       _ord + 1 AS _ord
FROM d WHERE rn % 97 = 0"""


def clean(raw_sql: str, has_ord: bool = False) -> str:
    """SQL twin of ``clean_stock_data`` (keep-first by ingest order, OHLC filter, drop nulls)."""
    order = "_ord" if has_ord else "Open, High, Low, Close, Volume"
    nn = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("Open", "High", "Low", "Close"))
    return f"""
SELECT Ticker, Date, Open, High, Low, Close, Volume FROM (
  SELECT *, lag({{'d': Date}}) OVER (PARTITION BY Ticker ORDER BY Date, {order}) AS _pd
  FROM (SELECT * REPLACE ({nn}) FROM ({raw_sql}) _r0) _r
) _c
WHERE (_pd IS NULL OR _pd.d IS DISTINCT FROM Date)
  AND Low <= High AND Low <= Open AND Low <= Close AND High >= Open AND High >= Close
  AND Ticker IS NOT NULL AND Date IS NOT NULL AND Volume IS NOT NULL"""


PROFILE_SPECS = {
    # name: (returns, signal, horizons, trend shift, keep ohlcv, drop all nulls)
    "pipeline": ("Returns", "Signal_Line", (5, 60), 2, False, False),
    "prep": ("returns", "Signal_line", (2, 5, 60, 250), 2, True, True),
    "app": ("Returns", "Signal_Line", (2, 5, 60, 250), 1, False, True),
}


def not_null_all(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def features(bars_sql: str, profile: str) -> tuple[str, list[str]]:
    """SQL twin of ``technical_features``; returns (sql, double columns to round)."""
    ret, sig, hs, k, keep, dropall = PROFILE_SPECS[profile]
    ratio = ",\n    ".join(f"{fdiv('Close', roll('avg', 'Close', h))} AS Close_Ratio_{h}" for h in hs)
    trend = ",\n    ".join(f"CAST({roll('sum', 'Target', h, k)} AS DOUBLE) AS Trend_{h}" for h in hs)
    hcols = []
    for h in hs:
        hcols += [f"Close_Ratio_{h}", f"Trend_{h}"]
    head = ["Ticker", "Date"] + (["Open", "High", "Low", "Close", "Volume"] if keep else ["Close"])
    body = (["Target", ret] if profile == "prep" else [ret])
    body += ["Log_Returns", "High_Low_Pct", "Gap_Pct", "Volume_Pct_Change", "RSI", "MACD", sig,
             "BB_Middle", "BB_Std", "BB_Position", "Volatility_10"]
    if profile != "prep":
        body += ["Target"]
    cols = head + body + hcols + ["Day_of_Week", "Month"]
    sql = f"""
WITH bars AS ({bars_sql}),
s1 AS (SELECT *, lag(Close) OVER w AS pc, lag(Volume) OVER w AS pv, lead(Close) OVER w AS nc
       FROM bars WINDOW w AS ({W})),
s2 AS (SELECT *,
    coalesce(CAST(nc > Close AS INTEGER), 0) AS Target,
    {pct('Close', 'pc')} AS _ret,
    ln({fdiv('Close', 'pc')}) AS Log_Returns,
    {fdiv('High - Low', 'Close')} AS High_Low_Pct,
    {fdiv('Open - pc', 'pc')} AS Gap_Pct,
    {pct('CAST(Volume AS DOUBLE)', 'CAST(pv AS DOUBLE)')} AS Volume_Pct_Change,
    CASE WHEN Close - pc > 0 THEN Close - pc ELSE 0.0::DOUBLE END AS _gain,
    CASE WHEN Close - pc < 0 THEN -(Close - pc) ELSE 0.0::DOUBLE END AS _loss
  FROM s1),
s3 AS (SELECT *,
    {ema('Close', 12)} AS EMA_12,
    {ema('Close', 26)} AS EMA_26,
    {roll('avg', 'Close', 20)} AS BB_Middle,
    {roll('stddev_samp', 'Close', 20)} AS BB_Std,
    {roll('avg', '_gain', 14)} AS _ag,
    {roll('avg', '_loss', 14)} AS _al,
    {roll('stddev_samp', '_ret', 10)} AS Volatility_10,
    {ratio},
    {trend}
  FROM s2),
s4 AS (SELECT *, EMA_12 - EMA_26 AS MACD, {rsi('_ag', '_al')} AS RSI,
    {fdiv('Close - (BB_Middle - BB_Std * 2.0)', '(BB_Middle + BB_Std * 2.0) - (BB_Middle - BB_Std * 2.0)')} AS BB_Position
  FROM s3),
s5 AS (SELECT *, {ema('MACD', 9)} AS {sig}, _ret AS {ret}, isodow(Date) - 1 AS Day_of_Week, month(Date) AS Month
  FROM s4)
SELECT {", ".join(cols)} FROM s5
WHERE {not_null_all([c for c in cols]) if dropall else "Target IS NOT NULL"}"""
    dcols = [c for c in body + hcols if c not in ("Target",)]
    return sql, dcols


BACKEND_RET = (1, 3, 5, 10, 21)
BACKEND_VOL = (5, 10, 21)
BACKEND_MA = (5, 10, 20, 50)


def backend_features(bars_sql: str) -> tuple[str, list[str]]:
    """SQL twin of ``backend_features``."""
    lagc = lambda n: f"lag(Close, {n}) OVER w"
    rets = ",\n    ".join(f"{pct(lagc(1), lagc(1 + k))} AS Returns_{k}d" for k in BACKEND_RET)
    mas = ",\n    ".join(f"{fdiv('Close', roll('avg', 'Close', m))} AS _ma{m}" for m in BACKEND_MA)
    vols = ",\n    ".join(f"{roll('stddev_samp', 'Returns_1d', k, 1)} AS Volatility_{k}d" for k in BACKEND_VOL)
    cols = (["Ticker", "Date", "Close"] + [f"Returns_{k}d" for k in BACKEND_RET] + ["Log_Returns"]
            + [f"Volatility_{k}d" for k in BACKEND_VOL]
            + ["RSI_14", "MACD", "MACD_Signal", "MACD_Hist", "BB_Position", "BB_Width", "Volume_Ratio_20d",
               "OBV", "OBV_Change_5d", "High_Low_Pct", "Gap_Pct"]
            + [f"Close_MA_{m}_Ratio" for m in BACKEND_MA] + ["Target", "Day_of_Week", "Month"])
    sql = f"""
WITH bars AS ({bars_sql}),
s1 AS (SELECT *, lag(Close) OVER w AS pc, lead(Close) OVER w AS nc,
    {rets},
    lag({fdiv('High - Low', 'Close')}) OVER w AS High_Low_Pct
  FROM bars WINDOW w AS ({W})),
s2 AS (SELECT *,
    coalesce(CAST(nc > Close AS INTEGER), 0) AS Target,
    ln({fdiv('Close', 'pc')}) AS Log_Returns,
    CASE WHEN Close - pc > 0 THEN Close - pc ELSE 0.0::DOUBLE END AS _gain,
    CASE WHEN Close - pc < 0 THEN -(Close - pc) ELSE 0.0::DOUBLE END AS _loss,
    coalesce(sign(Close - pc) * CAST(Volume AS DOUBLE), 0.0::DOUBLE) AS _obv_step,
    {fdiv('Open - pc', 'pc')} AS _gap
  FROM s1),
s3 AS (SELECT *,
    {ema('Close', 12)} AS _ema12,
    {ema('Close', 26)} AS _ema26,
    {roll('avg', 'Close', 20)} AS _bb_mid,
    {roll('stddev_samp', 'Close', 20)} AS _bb_std,
    {fdiv('CAST(Volume AS DOUBLE)', roll('avg', 'CAST(Volume AS DOUBLE)', 20))} AS _vol_ratio,
    {mas},
    {vols},
    {rsi(roll('avg', '_gain', 14), roll('avg', '_loss', 14))} AS _rsi,
    sum(_obv_step) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS OBV,
    lag(_gap) OVER ({W}) AS Gap_Pct
  FROM s2),
s4 AS (SELECT *, _ema12 - _ema26 AS _macd,
    {fdiv('Close - (_bb_mid - _bb_std * 2.0)', '(_bb_mid + _bb_std * 2.0) - (_bb_mid - _bb_std * 2.0)')} AS _bb_pos,
    {fdiv('(_bb_mid + _bb_std * 2.0) - (_bb_mid - _bb_std * 2.0)', '_bb_mid')} AS _bb_width
  FROM s3),
s5 AS (SELECT *, {ema('_macd', 9)} AS _signal,
    {pct('lag(OBV, 1) OVER w', 'lag(OBV, 6) OVER w')} AS OBV_Change_5d
  FROM s4 WINDOW w AS ({W})),
s6 AS (SELECT *,
    lag(_rsi) OVER w AS RSI_14, lag(_macd) OVER w AS MACD, lag(_signal) OVER w AS MACD_Signal,
    lag(_macd - _signal) OVER w AS MACD_Hist, lag(_bb_pos) OVER w AS BB_Position,
    lag(_bb_width) OVER w AS BB_Width, lag(_vol_ratio) OVER w AS Volume_Ratio_20d,
    {", ".join(f"lag(_ma{m}) OVER w AS Close_MA_{m}_Ratio" for m in BACKEND_MA)},
    isodow(Date) - 1 AS Day_of_Week, month(Date) AS Month
  FROM s5 WINDOW w AS ({W}))
SELECT {", ".join(cols)} FROM s6 WHERE {not_null_all(cols)}"""
    dcols = [c for c in cols if c not in ("Ticker", "Date", "Close", "Target", "Day_of_Week", "Month")]
    return sql, dcols
