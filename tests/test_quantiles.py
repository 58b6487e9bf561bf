"""Distributed selection against numpy: many groups, ties, outliers, and a group that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import quantiles as qt

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def check(df, keys, columns, probs=PROBS):
    got = qt.exact_quantiles(df, keys, columns, probs).toPandas()
    pdf = df.toPandas()
    wanted = {k if isinstance(k, tuple) else (k,): g for k, g in pdf.groupby(keys, dropna=False)}
    assert len(got) == len(wanted)
    for _, r in got.iterrows():
        key = tuple(None if v is None or v != v else v for v in r[keys])
        g = next(g for k, g in wanted.items() if tuple(None if v is None or v != v else v for v in k) == key)
        for c in columns:
            v = g[c].dropna().to_numpy(float)
            assert r[f"{c}_n"] == len(v)
            for j, p in enumerate(probs):
                have = r[f"{c}_q{j}"]
                if not len(v):
                    assert have is None or have != have
                else:
                    want = np.quantile(v, p) if np.isfinite(v).all() else np.sort(v)[int(p * (len(v) - 1))]
                    assert have == pytest.approx(want, rel=1e-12, abs=1e-300), (key, c, p)


@pytest.mark.parametrize("rows", [3, 40, 50_000])
def test_groups_columns_ties_and_outliers(spark, monkeypatch, rows):
    monkeypatch.setattr(qt, "TASK_ROWS", rows)
    monkeypatch.setattr(qt, "BINS", 8)
    rng = np.random.default_rng(1)
    data = []
    for t, n in (("a", 1), ("b", 2), (None, 300), ("d", 400), ("e", 5), ("f", 333)):
        for i in range(n):
            x = float(rng.normal())
            y = float(rng.integers(0, 3)) if t != "e" else None
            if t == "d" and i < 2:
                x = 1e300 * (-1) ** i
            if t == "f":
                x, y = 5.0, (float("nan") if i % 3 else float(i))
            data.append((t, i % 2, x, y))
    df = spark.createDataFrame(data, "t string, k int, x double, y double").repartition(3)
    check(df, ["t"], ["x", "y"])
    check(df, ["t", "k"], ["y"], [0.5])
    assert qt.exact_quantiles(df.limit(0), ["t"], ["x"], PROBS).count() == 0


def test_infinite_values(spark):
    df = spark.createDataFrame([("a", v) for v in [float("inf")] * 3 + [1.0, 2.0]], "t string, x double")
    check(df, ["t"], ["x"], [0.0, 0.25, 0.5, 1.0])


def test_a_large_group_is_spread(spark, monkeypatch):
    seen = []
    plain = qt.written
    monkeypatch.setattr(qt, "written", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    df = spark.range(2_000_000).select(F.lit("t").alias("t"), (F.pmod(F.hash("id"), F.lit(1_000_003)) / 7 + F.when(F.col("id") == 5, 1e12).otherwise(0)).alias("x"))
    check(df, ["t"], ["x"], [0.25, 0.5, 0.75])
    kept = [x.count() for name, x in seen if name == "values"]
    assert kept[0] == 2_000_000 and kept[-1] < 200_000
