"""Reference tables: ticker dimension, dimension search, alias map, calendar.

A7  ``default_dimension``: the static symbol/name/sector table.
A8  ``search_dimension``: case-insensitive substring over symbol, name, sector.
A9  ``resolve_aliases``: left join with an alias map, falling back to the symbol.
A10 ``business_days``: the next H weekdays after each series' last date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.schema import ALIAS, DIM

# The default ticker dimension (symbol, name, sector).
DEFAULT_STOCKS = [
    ("AAPL", "Apple Inc.", "Technology"),
    ("MSFT", "Microsoft Corporation", "Technology"),
    ("AMZN", "Amazon.com Inc.", "Consumer Cyclical"),
    ("GOOGL", "Alphabet Inc.", "Technology"),
    ("META", "Meta Platforms Inc.", "Technology"),
    ("NFLX", "Netflix Inc.", "Communication Services"),
    ("NVDA", "NVIDIA Corporation", "Technology"),
    ("AMD", "Advanced Micro Devices", "Technology"),
    ("TSLA", "Tesla Inc.", "Consumer Cyclical"),
    ("CRM", "Salesforce Inc.", "Technology"),
    ("ADBE", "Adobe Inc.", "Technology"),
    ("ORCL", "Oracle Corporation", "Technology"),
    ("INTC", "Intel Corporation", "Technology"),
    ("CSCO", "Cisco Systems Inc.", "Technology"),
    ("IBM", "IBM Corporation", "Technology"),
    ("QCOM", "Qualcomm Inc.", "Technology"),
]

# Vendor symbol aliases (symbol -> vendor symbol).
DEFAULT_ALIASES = [("META", "FB")]


def default_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_STOCKS, DIM)


def default_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_ALIASES, ALIAS)


def search_dimension(dim: DataFrame, query: str) -> DataFrame:
    """Rows whose symbol, name or sector contains ``query`` (any case)."""
    q = F.lower(F.lit(query))
    return dim.where(F.lower("symbol").contains(q) | F.lower("name").contains(q)
                     | F.lower("sector").contains(q))


def resolve_aliases(df: DataFrame, aliases: DataFrame, col: str = "symbol",
                    out: str = "resolved") -> DataFrame:
    """Replace ``col`` by its vendor alias where one exists (left join + coalesce).

    The planner chooses the join from the sizes that adaptive execution measures.
    """
    a = aliases.select(F.col("symbol").alias("_alias_key"), F.col("vendor_symbol").alias("_alias_val"))
    j = df.join(a, df[col] == a["_alias_key"], "left")
    return j.withColumn(out, F.coalesce(F.col("_alias_val"), F.col(col))).drop("_alias_key", "_alias_val")


def business_days(last: DataFrame, horizon: int, date_col: str = "Date") -> DataFrame:
    """Next ``horizon`` weekdays (Mon-Fri, no holidays) after each row's date.

    Input: one row per series with ``Ticker`` and the last date.  Output:
    ``Ticker, step (1-based), Date``.
    """
    span = horizon * 7 // 5 + 7
    days = F.sequence(F.date_add(F.col(date_col), 1), F.date_add(F.col(date_col), span))
    weekdays = F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, horizon)
    return (last.select("Ticker", F.posexplode(weekdays).alias("pos", "Date"))
            .select("Ticker", (F.col("pos") + 1).alias("step"), "Date"))


def supplier_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension derived from the test tables: suppliers with their region as sector."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
             .join(r, n.n_regionkey == r.r_regionkey, "left")
             .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
                     F.col("s_name").alias("name"), F.col("r_name").alias("sector")))


def nation_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias map derived from the test tables: nation name -> region-qualified name."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_name").alias("symbol"),
                     F.concat(F.col("r_name"), F.lit("/"), F.col("n_name")).alias("vendor_symbol")))
