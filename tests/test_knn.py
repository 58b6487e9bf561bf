"""Grid-pruned k-NN equals brute force (Manhattan, inverse-distance weights, k=15)."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from candela.operators import knn as kn
from candela.plans import catalog


def test_knn_manhattan_distance_weights_match_brute_force(spark):
    df = catalog._pipe_engineered(spark, SF_SMALL).select("Ticker", "Date", "Target", *catalog.PIPE_PREDICTORS)
    cut = df.agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY Close_Ratio_5)")).first()[0]
    train = df.where(F.col("Close_Ratio_5") < cut)
    test = df.where(F.col("Close_Ratio_5") >= cut).select("Ticker", "Date", *catalog.PIPE_PREDICTORS)
    got = {(r["Ticker"], r["Date"]): r["probability"] for r in
           kn.knn_fold(train, test, catalog.PIPE_PREDICTORS, k=15, metric="manhattan", weights="distance").collect()}
    tr = train.orderBy("Ticker", "Date").collect()
    X = np.array([[r[c] for c in catalog.PIPE_PREDICTORS] for r in tr])
    y = np.array([r["Target"] for r in tr], dtype=float)
    keys = [(r["Ticker"], r["Date"]) for r in tr]
    for q in test.collect():
        d = np.abs(X - np.array([q[c] for c in catalog.PIPE_PREDICTORS])).sum(axis=1)
        order = sorted(range(len(d)), key=lambda i: (d[i], keys[i]))[:15]
        dd, yy = d[order], y[order]
        if (dd == 0).any():
            p = yy[dd == 0].mean()
        else:
            p = (yy / dd).sum() / (1 / dd).sum()
        assert abs(got[(q["Ticker"], q["Date"])] - p) < 1e-9
    assert len(got) == test.count()
