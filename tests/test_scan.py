"""Affine scans against the plain recursion, on short, hostile and very long series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import scan
from candela.operators.halo import global_row_index


def recursion(x, step, first):
    y, out = None, []
    for v in x:
        if v is not None:
            y = first(v) if y is None else step(y, v)
        out.append(y)
    return out


MAPS = {
    "e": (lambda c: scan.ema_map(c, 12), lambda y, v: 2 / 13 * v + 11 / 13 * y, lambda v: v),
    "s": (scan.sum_map, lambda y, v: y + v, lambda v: v),
    "p": (lambda c: scan.product_map(1 + c / 1000), lambda y, v: y * (1 + v / 1000), lambda v: 1 + v / 1000),
}


@pytest.mark.parametrize("spread", [False, True])
def test_short_and_hostile_series(spark, monkeypatch, spread):
    monkeypatch.setattr(scan, "FAN", 3)  # many levels
    rng = np.random.default_rng(1)
    series = {"a": [1.0], "b": [None, None, 4.0, None, 5.0], "c": [None] * 7, "d": list(rng.normal(0, 5, 100)), "e": [3.0] * 27, "": list(rng.normal(0, 1, 28))}
    series["f"] = [None if rng.uniform() < 0.4 else float(v) for v in rng.normal(0, 1, 200)]
    rows = [(k, i, float(v) if v is not None else None) for k, x in series.items() for i, v in enumerate(x)]
    rows += [(None, i, float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "Ticker string, Date int, v double").repartition(4)
    placed = df.withColumn("place", F.col("Date").cast("long")) if spread else df
    got = scan.affine_scan(placed, {n: m[0](F.col("v")) for n, m in MAPS.items()}, position="place" if spread else None, spread=spread)
    assert got.columns == placed.columns + list(MAPS)
    found = {(r.Ticker, r.Date): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, x in [*series.items(), (None, [float(i) for i in range(11)])]:
        for n, (_, step, first) in MAPS.items():
            for i, want in enumerate(recursion(x, step, first)):
                have = found[k, i][n]
                assert (have is None) == (want is None) and (want is None or abs(have - want) <= 1e-9 * max(1, abs(want))), (k, i, n)
    assert scan.affine_scan(placed.limit(0), {"e": scan.ema_map(F.col("v"), 9)}, position="place" if spread else None, spread=spread).count() == 0


def test_a_million_rows_in_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("T").alias("Ticker"), F.timestamp_seconds(F.col("id") * 60).alias("Date"),
                               (100 + 10 * F.sin(F.col("id") / 7) + F.pmod(F.hash("id"), F.lit(1000)) / 500).alias("v"), "id")
    placed = global_row_index(df, "Date", F.date_trunc("day", "Date"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = scan.affine_scan(placed, {"e": scan.ema_map(F.col("v"), 26)}, position="_g", spread=True).withColumn("part", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = got.sort_values("id")
    x, e = got["v"].to_numpy().tolist(), np.empty(n)
    y = x[0]
    for i, v in enumerate(x):
        y = v if i == 0 else 2 / 27 * v + 25 / 27 * y
        e[i] = y
    np.testing.assert_allclose(got["e"], e, rtol=1e-12)
    assert got.groupby("part").size().max() < 0.5 * n
