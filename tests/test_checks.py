"""Type lattice over data, index checks, ROC-AUC of scores: edge cases against plain versions."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from candela.operators import cleaning as cl
from candela.operators import metrics as me


def test_type_lattice_and_drift(spark):
    rows = [("a", "1", "2020-01-01", "x", None, "true", "1"), ("a", "-2", "2020-02-30", None, None, "False", "2.5"),
            ("b", "3", "2020-01-01 10:00:00", "1", None, "true", "7"), ("b", "+4", None, "y", None, None, "8"), (None, "12345678901234567890", None, "z", None, None, "9")]
    df = spark.createDataFrame(rows, "part string, i string, d string, s string, n string, b string, x string")
    got = {r.column: r for r in cl.type_drift(df, "part", {}).collect()}
    assert {c: r.narrowest for c, r in got.items()} == {"i": "double", "d": "timestamp", "s": "string", "n": "void", "b": "boolean", "x": "double"}
    assert {c for c, r in got.items() if r.drift} == {"i", "d", "x"}
    assert (got["d"].n_values, got["d"].n_null) == (3, 2) and got["n"].n_null == 5
    prof = {(r.part, r.column): r.narrowest for r in cl.type_profile(df, "part").collect()}
    assert prof["b", "x"] == "bigint" and prof["a", "x"] == "double" and prof["a", "d"] == "date" and prof["b", "d"] == "timestamp" and prof[None, "i"] == "double"
    assert cl.type_drift(df.limit(0), "part", {}).count() == 0


def test_expected_types(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 5)], "Ticker string, Date date, Close double, Volume long")
    got = {r.column: (r.narrowest, r.expected, r.fits) for r in cl.type_drift(df, "Ticker").collect()}
    assert got == {"Date": ("date", "date", True), "Close": ("double", "double", True), "Volume": ("bigint", "bigint", True)}
    got = {r.column: r.fits for r in cl.type_drift(df.withColumn("Date", F.lit("soon")), "Ticker").collect()}
    assert got["Date"] is False


def test_index_validity(spark):
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("good", d(0), 0), ("good", d(1), 1), ("good", d(1), 2), ("back", d(3), 0), ("back", d(1), 1), ("none", None, 0), ("none", d(2), 1)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, _ord long")
    assert {r.Ticker: (r.n_rows, r.null_dates, r.backward, r.valid) for r in cl.index_validity(df).collect()} == {
        "good": (3, 0, 0, True), "back": (2, 0, 1, False), "none": (2, 1, 0, False)}
    assert not cl.index_validity(df.withColumn("Date", F.col("Date").cast("string"))).where("valid").count()


def test_roc_auc_with_ties_infinities_and_one_class(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m, n, levels in (("ties", 500, 4), ("fine", 700, 10_000), (None, 300, 30)):
        for _ in range(n):
            s = float(rng.integers(0, levels)) / 7
            rows.append((m, int(rng.uniform() < 0.3 + 0.4 * s / (levels / 7)), s))
    rows += [("fine", 1, float("inf")), ("fine", 0, float("inf")), ("fine", 0, float("-inf")), ("fine", 1, None), ("fine", 1, float("nan")), ("fine", None, 1.0), ("one", 1, 0.5), ("same", 1, 2.0), ("same", 0, 2.0)]
    df = spark.createDataFrame(rows, "model string, Target int, s double").repartition(3)
    got = {r.model: r for r in me.roc_auc(df, "s", chunks=16).collect()}
    for m in ("ties", "fine", None, "same"):
        mine = [(y, s) for k, y, s in rows if k == m and y is not None and s is not None and s == s]
        pos, neg = [s for y, s in mine if y == 1], [s for y, s in mine if y == 0]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[m].auc - want) < 1e-12 and (got[m].n_pos, got[m].n_neg) == (len(pos), len(neg)), m
    assert got["one"].auc is None and got["same"].auc == 0.5
    assert me.roc_auc(df.limit(0), "s").count() == 0
