"""Recursions ``y_t = a_t * y_(t-1) + b_t`` along a series as a prefix scan of affine maps.

Maps compose: (a2, b2) after (a1, b1) is (a2 a1, a2 b1 + b2). So a row's state is the composition of all maps up to it,
and that is taken from three prefixes: of the row's block (``FAN`` rows), of the blocks before it in its super-block
(``FAN`` blocks), and of the super-blocks before that. Each prefix folds at most ``FAN`` maps, so the work is O(n) whatever the
length, every term counts, and no rows are copied from other blocks.

``spread`` says where the rows lie: False keeps each series in one task (windows by series, block and super-block all reuse its
partitioning and add no shuffle); True partitions rows by block, then by super-block, and scans only one row per
super-block by series, so a series of any length lies in many tasks.

A map is ``(a, b, start)``: ``start`` is the state where no state is before. A row whose map is null keeps the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 64


def affine(a: Column, b: Column, start: Column) -> Column:
    """A map; null where ``b`` is."""
    return F.when(b.isNotNull(), F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), start.cast("double").alias("s")))


def ema_map(c: Column, span: int) -> Column:
    """y = alpha x + (1 - alpha) y, the first value as it is."""
    alpha = 2.0 / (span + 1.0)
    return affine(F.lit(1.0 - alpha), F.lit(alpha) * c, c)


def sum_map(c: Column) -> Column:
    return affine(F.lit(1.0), c, c)


def product_map(c: Column) -> Column:
    return affine(c, c - c, c)  # b is 0, and null with c


def _then(first: Column, second: Column) -> Column:
    """The composition of two maps, of which one may be null."""
    both = F.struct((second["a"] * first["a"]).alias("a"), (second["a"] * first["b"] + second["b"]).alias("b"),
                    (second["a"] * first["s"] + second["b"]).alias("s"))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(both)


def _prefix(m: str, w) -> Column:
    """The composition of the maps in a window's frame."""
    none = F.lit(None).cast("struct<a: double, b: double, s: double>")
    return F.aggregate(F.collect_list(F.col(m)).over(w), none, _then)


def affine_scan(df: DataFrame, maps: dict[str, Column], keys: tuple = ("Ticker",), order: str = "Date", position: str | None = None,
                spread: bool = False) -> DataFrame:
    """``df`` with the state after each row, under the names of ``maps``.

    ``position`` names the 0-based place of each row in its series (``halo.global_row_index``); without it rows are
    numbered by a window over the series, which keeps the series in one task.
    """
    keys = list(keys)
    series = Window.partitionBy(*keys).orderBy(order)
    p = F.col(position) if position else F.row_number().over(series) - 1
    x = df.withColumn("_pos", p.cast("long")).withColumns({f"_m_{n}": m for n, m in maps.items()})
    x = x.withColumns({"_b": F.floor(F.col("_pos") / FAN), "_sb": F.floor(F.col("_pos") / (FAN * FAN))})
    block = Window.partitionBy(*keys, "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_p_{n}": _prefix(f"_m_{n}", block) for n in maps})
    ends = F.col("_pos") % FAN == FAN - 1
    x = x.withColumns({f"_e_{n}": F.when(ends, F.col(f"_p_{n}")) for n in maps})
    above = Window.partitionBy(*keys, "_sb").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"_q_{n}": _prefix(f"_e_{n}", above) for n in maps})
    x = x.withColumns({f"_p_{n}": _then(F.col(f"_q_{n}"), F.col(f"_p_{n}")) for n in maps})
    ends = F.col("_pos") % (FAN * FAN) == FAN * FAN - 1
    if spread:
        # one row per super-block; the last, unfinished one has nothing after it
        tops = x.where(ends).select(*keys, F.col("_sb"), *[F.col(f"_p_{n}").alias(f"_t_{n}") for n in maps])
        before = Window.partitionBy(*keys).orderBy("_sb").rowsBetween(Window.unboundedPreceding, 0)
        tops = tops.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_sb") + 1).alias("_next"), *[_prefix(f"_t_{n}", before).alias(f"_r_{n}") for n in maps])
        same = F.col("_sb") == F.col("_next")
        for k in keys:  # a null key is a series too
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        x = x.join(tops, same, "left")
    else:
        x = x.withColumns({f"_t_{n}": F.when(ends, F.col(f"_p_{n}")) for n in maps})
        before = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumns({f"_r_{n}": _prefix(f"_t_{n}", before) for n in maps})
    return x.select(*df.columns, *[_then(F.col(f"_r_{n}"), F.col(f"_p_{n}"))["s"].alias(n) for n in maps])
