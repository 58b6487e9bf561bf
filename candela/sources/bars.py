"""Bar sources: OHLCV bars from tick tables, and file sources/sinks of bars.

The test tables hold no daily prices, so bars are built from tick-like rows:
Open is the first price and Close the last in (ticker, bucket), by an explicit
order key; High/Low are max/min; Volume is a sum.  The aggregation is a plain
``groupBy`` with partial (map-side) aggregation, so a hot ticker costs one
pre-aggregated row per (bucket, map task) in the shuffle, never its raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.schema import BAR, BAR_COLUMNS, RAW_BAR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_to_bars(ticks: DataFrame, ticker: Column, bucket: Column, price: Column,
                  volume: Column, order: list[Column]) -> DataFrame:
    """OHLCV per (ticker, bucket); Open/Close are first/last by ``order``."""
    key = F.struct(*order)
    # the struct key makes this a sorting aggregate, which compares the first group column most: dates tell more rows apart than tickers
    return (ticks
            .groupBy(bucket.alias("Date"), ticker.alias("Ticker"))
            .agg(F.min_by(price, key).alias("Open"),
                 F.max(price).alias("High"),
                 F.min(price).alias("Low"),
                 F.max_by(price, key).alias("Close"),
                 F.sum(volume).cast("bigint").alias("Volume"))
            .select(*BAR_COLUMNS))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from lineitem: one ticker per return flag."""
    li = table(spark, sf_dir, "lineitem")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return ticks_to_bars(
        li, F.col("l_returnflag"), F.to_date("l_shipdate"), price,
        F.col("l_quantity"), [F.col("l_orderkey"), F.col("l_linenumber"), price])


def bars_wide(spark: SparkSession, sf_dir: str, n_tickers: int = 16) -> DataFrame:
    """Daily bars from lineitem with ``n_tickers`` tickers (part key buckets)."""
    li = table(spark, sf_dir, "lineitem")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    ticker = F.concat(F.lit("P"), F.lpad(F.pmod(F.col("l_partkey"), F.lit(n_tickers)).cast("string"), 2, "0"))
    return ticks_to_bars(
        li, ticker, F.to_date("l_shipdate"), price,
        F.col("l_quantity"), [F.col("l_orderkey"), F.col("l_linenumber"), price])


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from events: one ticker per event type, Date is the hour."""
    ev = table(spark, sf_dir, "events")
    return ticks_to_bars(
        ev, F.col("event_type"), F.date_trunc("hour", F.col("ts")), F.col("value"),
        F.lit(1), [F.col("ts"), F.col("event_id")])


def bars_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from orders (gaps between days): one ticker per priority."""
    o = table(spark, sf_dir, "orders")
    return ticks_to_bars(
        o, F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_totalprice"),
        F.lit(1), [F.col("o_orderkey")])


def with_defects(bars: DataFrame) -> DataFrame:
    """Raw bars with an ingest ordinal ``_ord`` and deliberate defects.

    The defects make the quality operators do real work on derived data:
    duplicate dates, Low above Close, null Open, x10 price outliers and zero
    volume, each placed by the 1-based row number inside its series. The
    duplicate of a row is ingested right after it, with a 1% higher Close.
    """
    rn = F.row_number().over(Window.partitionBy("Ticker").orderBy("Date"))
    b = bars.withColumn("rn", rn)
    x10 = (F.col("rn") % 107) == 0
    defect = b.select(
        "Ticker", "Date",
        F.when((F.col("rn") % 103) == 0, F.lit(None).cast("double"))
         .when(x10, F.col("Open") * 10).otherwise(F.col("Open")).alias("Open"),
        F.when(x10, F.col("High") * 10).otherwise(F.col("High")).alias("High"),
        F.when((F.col("rn") % 101) == 0, F.col("Close") * 1.01)
         .when(x10, F.col("Low") * 10).otherwise(F.col("Low")).alias("Low"),
        F.when(x10, F.col("Close") * 10).otherwise(F.col("Close")).alias("Close"),
        F.when((F.col("rn") % 109) == 0, F.lit(0).cast("bigint")).otherwise(F.col("Volume")).alias("Volume"),
        (F.col("rn") * 2).cast("bigint").alias("_ord"),
        "rn")
    dups = (defect.where((F.col("rn") % 97) == 0)
            .withColumn("Close", F.col("Close") * 1.01)
            .withColumn("High", F.greatest(F.col("High"), F.col("Close")))
            .withColumn("_ord", F.col("_ord") + 1))
    return defect.unionByName(dups).drop("rn")


# ---------------------------------------------------------------- file I/O

def read_bars(spark: SparkSession, path: str, fmt: str = "parquet",
              tickers: list[str] | None = None, start: str | None = None,
              end: str | None = None) -> DataFrame:
    """A1/A2: bars of a ticker universe and date range [start, end).

    The dataset is expected to be partitioned by ``Ticker`` so the ticker
    predicate prunes partitions; the date predicate is pushed to the scan.
    """
    reader = spark.read.schema(BAR)
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd")
    df = reader.format(fmt).load(path)
    if tickers is not None:
        df = df.where(F.col("Ticker").isin(list(tickers)))
    if start is not None:
        df = df.where(F.col("Date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("Date") < F.lit(end).cast("date"))
    return df.select(*BAR_COLUMNS)


def read_bar_csv(spark: SparkSession, path: str, ticker_from_file: bool = True) -> DataFrame:
    """A3: CSV files of ``Date,Open,High,Low,Close,Volume``; one file per ticker.

    The ticker comes from the file name (``<ticker>_stock_data.csv`` or
    ``<ticker>.csv``). ``_ord`` records the ingest position (file, then row
    order inside the file) for keep-first de-duplication.
    """
    fields = [f for f in RAW_BAR.fields if f.name not in ("Ticker", "_ord")]
    from pyspark.sql import types as T
    df = (spark.read.schema(T.StructType(fields))
          .option("header", True).option("mode", "PERMISSIVE").csv(path)
          .select("*", F.col("_metadata.file_name").alias("_file")))
    name = F.regexp_extract(F.col("_file"), r"^([^_.]+)", 1)
    return (df.withColumn("Ticker", F.upper(name) if ticker_from_file else F.lit(None).cast("string"))
            .withColumn("_ord", F.monotonically_increasing_id())
            .select(*BAR_COLUMNS, "_ord"))


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A4: one folder per ticker (``Ticker=<t>``), rows sorted by date inside."""
    (df.repartition("Ticker").sortWithinPartitions("Ticker", "Date")
       .write.mode(mode).partitionBy("Ticker").format(fmt)
       .option("header", True).save(path))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: processed feature table as Parquet."""
    df.write.mode(mode).parquet(path)


def normalise_vendor_columns(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor frame -> bar schema.

    Flattens ``('Close','AAPL')``-style two-level names (already joined as
    ``Close_AAPL`` or ``('Close', 'AAPL')`` strings), title-cases lower-case
    names, keeps the five bar columns and the date.
    """
    out = df
    for c in df.columns:
        base = c
        if c.startswith("(") and "," in c:
            base = c.strip("()").split(",")[0].strip().strip("'\"")
        elif "_" in c and c.split("_")[0].lower() in {"open", "high", "low", "close", "volume", "date"}:
            base = c.split("_")[0]
        base = base[:1].upper() + base[1:].lower() if base.lower() in {
            "open", "high", "low", "close", "volume", "date", "ticker"} else base
        if base != c:
            out = out.withColumnRenamed(c, base)
    if "Ticker" not in out.columns:
        out = out.withColumn("Ticker", F.lit(ticker))
    return out.select(
        F.col("Ticker").cast("string"), F.to_date("Date").alias("Date"),
        *[F.col(c).cast("double").alias(c) for c in ("Open", "High", "Low", "Close")],
        F.col("Volume").cast("bigint").alias("Volume"))
