"""Fixed schemas of the engine's tables (never inferred at read time)."""

from pyspark.sql import types as T

PRICE_COLUMNS = ["Open", "High", "Low", "Close"]
BAR_COLUMNS = ["Ticker", "Date", "Open", "High", "Low", "Close", "Volume"]

BAR = T.StructType([
    T.StructField("Ticker", T.StringType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.LongType()),
])

RAW_BAR = T.StructType(BAR.fields + [T.StructField("_ord", T.LongType())])

DIM = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("sector", T.StringType()),
])

ALIAS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("vendor_symbol", T.StringType()),
])

# Expected column types of a raw bar frame, as the quality report checks them.
EXPECTED_TYPES = {
    "Date": T.DateType(),
    "Open": T.DoubleType(),
    "High": T.DoubleType(),
    "Low": T.DoubleType(),
    "Close": T.DoubleType(),
    "Volume": T.LongType(),
}
