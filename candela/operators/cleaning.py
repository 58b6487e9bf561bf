"""Cleaning and data-quality operators over bar panels (one series per Ticker).

All per-series work uses windows partitioned by ``Ticker``; aggregates are
per ticker. NaN never enters a window: ``nan_to_null`` runs at the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.functions.expr import nan_to_null, quantile_of_sorted, sorted_frame
from candela.operators.quantiles import exact_quantiles
from candela.schema import BAR_COLUMNS, EXPECTED_TYPES, PRICE_COLUMNS


def _order_cols(df: DataFrame) -> list[str]:
    if "_ord" in df.columns:
        return [c for c in ("_block", "_ord") if c in df.columns]
    return ["Date"]


def cast_date(df: DataFrame, col: str = "Date") -> DataFrame:
    """B1: parse ``Date`` to a date (strings that do not parse become null)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.StringType):
        return df.withColumn(col, F.coalesce(F.try_to_date(F.col(col)),
                                             F.to_date(F.try_to_timestamp(F.col(col)))))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(col, F.to_date(F.col(col)))
    return df


def nan_as_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in cols})


def dedup_keep_first(df: DataFrame) -> DataFrame:
    """B2: one row per (Ticker, Date), the first by ingest order (``_ord``).

    Uses the series partitioning (``Ticker``) ordered by (Date, ingest order)
    and keeps a row when the previous row has another date. The following
    feature windows (partitioned by Ticker, ordered by Date) then reuse this
    exchange and sort instead of shuffling again. A null date is a date of its own.
    """
    tie = _order_cols(df) if "_ord" in df.columns else [
        c for c in ("Open", "High", "Low", "Close", "Volume") if c in df.columns]
    w = Window.partitionBy("Ticker").orderBy("Date", *tie)
    # the default marks the first row, so that null dates compare as equal
    prev = F.lag(F.struct("Date"), 1).over(w)
    return (df.withColumn("_prev_date", prev)
              .where(F.col("_prev_date").isNull() | ~F.col("_prev_date.Date").eqNullSafe(F.col("Date")))
              .drop("_prev_date"))


def consistent_mask() -> Column:
    return ((F.col("Low") <= F.col("High")) & (F.col("Low") <= F.col("Open"))
            & (F.col("Low") <= F.col("Close")) & (F.col("High") >= F.col("Open"))
            & (F.col("High") >= F.col("Close")))


def inconsistent_mask() -> Column:
    return ((F.col("Low") > F.col("Open")) | (F.col("High") < F.col("Open"))
            | (F.col("Low") > F.col("Close")) | (F.col("High") < F.col("Close")))


def ohlc_consistent(df: DataFrame) -> DataFrame:
    """Keep rows with a consistent OHLC range (rows with nulls are dropped)."""
    return df.where(consistent_mask())


def inconsistent_rows(df: DataFrame) -> DataFrame:
    """Rows that violate the OHLC range (null comparisons do not count)."""
    return df.where(F.coalesce(inconsistent_mask(), F.lit(False)))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with null or NaN (Infinity is kept)."""
    return df.na.drop(subset=subset)


def clean_stock_data(raw: DataFrame) -> DataFrame:
    """Date cast -> keep-first de-dup -> bar columns -> OHLC filter -> drop nulls."""
    df = nan_as_null(cast_date(raw), PRICE_COLUMNS)
    df = dedup_keep_first(df).select(*BAR_COLUMNS)
    return drop_nulls(ohlc_consistent(df))


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per ticker and column, the number of missing (null or NaN) values."""
    cols = cols or [c for c in df.columns if c not in ("Ticker", "_ord", "_block")]
    def miss(c):
        dt = df.schema[c].dataType
        isna = F.col(c).isNull()
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            isna = isna | F.isnan(c)
        return F.count_if(isna).cast("bigint").alias(c)
    agg = df.groupBy("Ticker").agg(*[miss(c) for c in cols])
    stack = "stack({}, {}) as (column, missing)".format(
        len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    return agg.selectExpr("Ticker", stack)


# What a text must look like to bear a type; a type's bit is its place from 1 on, narrower types first.
TYPE_PATTERNS = [
    ("bigint", r"^[+-]?[0-9]{1,18}$"),
    ("double", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"),
    ("boolean", r"^(true|false|TRUE|FALSE|True|False)$"),
]


def narrowest(mask: Column) -> Column:
    """The narrowest type of a set of types; ``void`` where no value was met (null)."""
    out = F.when(mask.isNull(), F.lit("void"))
    for i, (t, _) in enumerate(TYPE_PATTERNS):
        out = out.when(F.getbit(mask, F.lit(i)) == 1, F.lit(t))
    return out.otherwise(F.lit("string"))


def type_profile(df: DataFrame, part: str, columns: list[str] | None = None) -> DataFrame:
    """B10 over the data: per part (a file, a ticker) and column ``n_values, n_null, narrowest``.

    Each value is a set of the types it bears (its text form, as a file has it); the sets of a part are intersected by one
    aggregate, which combines before the shuffle.
    """
    columns = columns or [c for c in df.columns if c != part]

    def types(c):
        text = F.trim(F.col(c).cast("string"))
        return F.when(F.col(c).isNotNull(), reduce(lambda a, b: a + b, [
            F.when(text.rlike(pattern), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, pattern) in enumerate(TYPE_PATTERNS)]))

    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(F.col(c)).alias(f"_n{i}"), F.count_if(F.col(c).isNull()).alias(f"_u{i}"), F.bit_and(types(c)).alias(f"_t{i}")]
    agg = df.groupBy(F.col(part).cast("string").alias("part")).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n_values"), F.col(f"_u{i}").alias("n_null"), F.col(f"_t{i}").alias("mask"))
                               for i, c in enumerate(columns)])).alias("r")
    return agg.select("part", rows).select("part", "r.column", "r.n_values", "r.n_null", F.col("r.mask").alias("mask"), narrowest(F.col("r.mask")).alias("narrowest"))


def type_drift(df: DataFrame, part: str, expected: dict | None = None) -> DataFrame:
    """Per column the narrowest type that all values of all parts bear, the expected one, whether they
    agree (a narrower integer fits a double), and whether parts differ."""
    expected = expected or EXPECTED_TYPES
    p = type_profile(df, part)
    seen = F.when(F.col("narrowest") != "void", F.col("narrowest"))
    out = p.groupBy("column").agg(F.sum("n_values").alias("n_values"), F.sum("n_null").alias("n_null"), narrowest(F.bit_and("mask")).alias("narrowest"),
                                  (F.count_distinct(seen) > 1).alias("drift"))
    want = F.lit(None).cast("string")
    for c, t in expected.items():
        want = F.when(F.col("column") == c, F.lit(t.simpleString())).otherwise(want)
    out = out.withColumn("expected", want)
    fits = (F.col("narrowest") == F.col("expected")) | ((F.col("narrowest") == "bigint") & (F.col("expected") == "double")) | (F.col("narrowest") == "void")
    return out.select("column", "n_values", "n_null", "narrowest", "expected", F.coalesce(fits, F.lit(True)).alias("fits"), "drift")


def index_validity(df: DataFrame) -> DataFrame:
    """B19 over the data: per ticker, rows without a date and rows whose date lies before the one ingested
    before them; ``valid`` if neither occurs and the column is a date or timestamp."""
    prev = F.lag("Date").over(Window.partitionBy("Ticker").orderBy(*_order_cols(df)))
    x = df.withColumn("_back", F.coalesce(F.col("Date") < prev, F.lit(False)))
    agg = x.groupBy("Ticker").agg(F.count("*").alias("n_rows"), F.count_if(F.col("Date").isNull()).alias("null_dates"), F.count_if("_back").alias("backward"))
    return agg.withColumn("valid", (F.col("null_dates") == 0) & (F.col("backward") == 0) & F.lit(is_time_indexed(df)))


def type_report(df: DataFrame, expected: dict | None = None) -> list[tuple[str, str, str]]:
    """(column, actual, expected) for every mismatch; absent columns report 'missing'."""
    expected = expected or EXPECTED_TYPES
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c, exp in expected.items():
        act = fields.get(c)
        if act is None:
            out.append((c, "missing", exp.simpleString()))
        elif act != exp:
            out.append((c, act.simpleString(), exp.simpleString()))
    return out


def type_report_df(df: DataFrame, expected: dict | None = None) -> DataFrame:
    rows = type_report(df, expected)
    schema = "column string, actual string, expected string"
    return df.sparkSession.createDataFrame(rows, schema)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Per ticker, rows whose (Ticker, Date) was already seen."""
    return (df.groupBy("Ticker")
              .agg((F.count(F.lit(1)) - F.count_distinct(F.struct("Date"))).cast("bigint").alias("duplicate_count")))


def _iqr_bounds(q: Column, k: float = 1.5) -> tuple[Column, Column]:
    q1, q3 = q[0], q[1]
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def iqr_static(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with any column outside [Q1-1.5 IQR, Q3+1.5 IQR] of its ticker.

    Quartiles are exact (linear interpolation) per ticker, by distributed selection: no
    buffer per ticker. The bounds table has one row per ticker; the join is left to the planner,
    and AQE broadcasts it from its measured size.
    """
    columns = columns or PRICE_COLUMNS
    stats = exact_quantiles(df, ["Ticker"], columns, [0.25, 0.75]).select(
        F.col("Ticker").alias("_t"), *[F.array(f"{c}_q0", f"{c}_q1").alias(f"_q_{c}") for c in columns])
    j = df.join(stats, F.col("Ticker").eqNullSafe(F.col("_t"))).drop("_t")
    conds = []
    for c in columns:
        lo, hi = _iqr_bounds(F.col(f"_q_{c}"))
        conds.append(F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)))
    return j.where(reduce(lambda a, b: a | b, conds)).drop(*[f"_q_{c}" for c in columns])


def iqr_rolling_flags(df: DataFrame, columns: list[str] | None = None, window: int = 252,
                      order: list[str] | None = None, keys: tuple = ("Ticker",)) -> DataFrame:
    """``{col}_outlier`` flags against the trailing ``window``-row quartiles.

    A row is flagged only when the frame is complete (S9: comparisons with a
    missing bound are false). Rows are ordered by ingest order when ``_ord``
    exists (the flags are computed before de-duplication), else by Date.
    """
    columns = columns or PRICE_COLUMNS
    order = order or _order_cols(df)
    w = Window.partitionBy(*keys).orderBy(*order)
    # one sorted frame per column, materialised once, then read at fixed positions
    s1 = df.select("*", *[sorted_frame(F.col(c), window, w).alias(f"_arr_{c}") for c in columns])
    s2 = s1.select("*", *[quantile_of_sorted(f"_arr_{c}", window, p).alias(f"_q{i}_{c}")
                          for c in columns for i, p in ((1, 0.25), (3, 0.75))])
    flags = {}
    for c in columns:
        q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
        iqr = q3 - q1
        flag = (F.col(c) < q1 - 1.5 * iqr) | (F.col(c) > q3 + 1.5 * iqr)
        flags[f"{c}_outlier"] = F.coalesce(flag, F.lit(False))
    helpers = [f"_arr_{c}" for c in columns] + [f"_q{i}_{c}" for c in columns for i in (1, 3)]
    return s2.withColumns(flags).drop(*helpers)


def iqr_rolling_flags_halo(df: DataFrame, window: int = 252, rows_per_bucket: int = 4096) -> DataFrame:
    """B12 on ingest-ordered row buckets with a (window - 1)-row halo: equal
    to ``iqr_rolling_flags`` while a hot series is spread over many tasks."""
    from candela.operators.halo import halo_parts
    chunk = F.floor(F.col("_ord") / F.lit(1 << 16))
    parts = halo_parts(df, window - 1, rows_per_bucket, "_ord", chunk, trailing=False)
    flagged = iqr_rolling_flags(parts, window=window, order=["_ord"], keys=("Ticker", "_bucket"))
    return flagged.where(~F.col("_halo")).drop("_bucket", "_halo", "_lead_halo")


def any_flag(columns: list[str]) -> Column:
    """OR over boolean flag columns."""
    return reduce(lambda a, b: a | b, [F.col(c) for c in columns])


def rolling_outliers(df: DataFrame, window: int = 252) -> DataFrame:
    flags = [f"{c}_outlier" for c in PRICE_COLUMNS]
    return iqr_rolling_flags(df, window=window).where(any_flag(flags))


def outlier_bundle(df: DataFrame, window: int = 252) -> DataFrame:
    """Static, rolling and inconsistent rows as one long table with ``kind``."""
    base = [c for c in df.columns]
    return (iqr_static(df).select(F.lit("static").alias("kind"), *base)
            .unionByName(rolling_outliers(df, window).select(F.lit("rolling").alias("kind"), *base))
            .unionByName(inconsistent_rows(df).select(F.lit("inconsistent").alias("kind"), *base)))


def _flags(df: DataFrame, window: int, rows_per_task: int | None) -> DataFrame:
    """Rolling IQR flags; halo-bucketed when a series is longer than ``rows_per_task``."""
    if rows_per_task and "_ord" in df.columns:
        longest = df.groupBy("Ticker").count().agg(F.max("count")).first()[0] or 0
        if longest > rows_per_task:
            return iqr_rolling_flags_halo(df, window=window, rows_per_bucket=rows_per_task)
    return iqr_rolling_flags(df, window=window)


def quality_report(df: DataFrame, window: int = 252, rows_per_task: int | None = None) -> DataFrame:
    """One row per ticker.

    ``missing_total``/``has_missing`` over all value columns, ``duplicate_count``,
    ``outlier_count`` (rolling IQR rows), ``inconsistent_count``, ``type_mismatches``
    (schema check, the same for every ticker) and ``is_clean`` (no missing, no
    type mismatch, no inconsistent row; outliers and duplicates do not count).
    """
    value_cols = [c for c in df.columns if c not in ("Ticker", "_ord", "_block")]
    mismatches = len(type_report(df))
    flagged = _flags(df, window, rows_per_task)
    flags = [f"{c}_outlier" for c in PRICE_COLUMNS]

    def isna(c):
        e = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            e = e | F.isnan(c)
        return e.cast("int")

    missing_row = reduce(lambda a, b: a + b, [isna(c) for c in value_cols])
    rep = flagged.groupBy("Ticker").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(missing_row).cast("bigint").alias("missing_total"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct("Date"))).cast("bigint").alias("duplicate_count"),
        F.count_if(any_flag(flags)).cast("bigint").alias("outlier_count"),
        F.count_if(F.coalesce(inconsistent_mask(), F.lit(False))).cast("bigint").alias("inconsistent_count"),
    )
    return rep.select(
        "Ticker", "n_rows", "missing_total", (F.col("missing_total") > 0).alias("has_missing"),
        "duplicate_count", "outlier_count", "inconsistent_count",
        F.lit(mismatches).cast("bigint").alias("type_mismatches"),
        ((F.col("missing_total") == 0) & F.lit(mismatches == 0)
         & (F.col("inconsistent_count") == 0)).alias("is_clean"))


def clean_data(raw: DataFrame, remove_outliers: bool = True, window: int = 252,
               rows_per_task: int | None = None) -> DataFrame:
    """Rolling-IQR flags (ingest order) -> drop flagged rows -> keep-first de-dup."""
    flags = [f"{c}_outlier" for c in PRICE_COLUMNS]
    flagged = _flags(nan_as_null(raw, PRICE_COLUMNS), window, rows_per_task)
    if remove_outliers:
        flagged = flagged.where(~any_flag(flags))
    return dedup_keep_first(flagged.drop(*flags))


def is_time_indexed(df: DataFrame, col: str = "Date") -> bool:
    """The order column is a date or timestamp."""
    return col in df.columns and isinstance(
        df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def candle_direction(df: DataFrame) -> DataFrame:
    """``up`` when Close >= Open, else ``down``."""
    return df.withColumn("candle", F.when(F.col("Close") >= F.col("Open"), "up").otherwise("down"))


def tag_train_test(df: DataFrame, ratio: float = 0.7, connect: bool = True) -> DataFrame:
    """First floor(n*ratio) rows of each series are ``train``, the rest ``test``.

    With ``connect`` the last train row is repeated as the first point of the
    test segment, so the two chart lines join.
    """
    from candela.operators.features import global_row_index
    # series positions without a whole-series window: chunked counts + offsets
    n = df.groupBy("Ticker").agg(F.count(F.lit(1)).alias("_n"))
    t = (global_row_index(df).withColumnRenamed("_g", "_rn").join(n, "Ticker")
         .withColumn("_cut", F.floor(F.col("_n") * F.lit(ratio))).drop("_n"))
    tagged = t.withColumn("segment", F.when(F.col("_rn") < F.col("_cut"), "train").otherwise("test"))
    if connect:
        joint = tagged.where(F.col("_rn") == F.col("_cut") - 1).withColumn("segment", F.lit("test"))
        tagged = tagged.unionByName(joint)
    return tagged.drop("_rn", "_cut")
