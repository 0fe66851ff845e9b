"""Exact quantiles and ranks against numpy, also on one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glacierlens.functions import quantiles as qn


def midpoint(values, p):
    a = np.sort(values)
    pos = min(max(p * len(a) + 0.5, 1), len(a))
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    return a[lo - 1] + (a[hi - 1] - a[lo - 1]) * (pos - lo)


def frame():
    rng = np.random.default_rng(3)
    parts = [
        pd.DataFrame({"k": "hot", "v": rng.normal(0, 60, 20000)}),
        pd.DataFrame({"k": "ties", "v": np.repeat([0.0, 0.0, 1.5, -2.0], 500)}),
        pd.DataFrame({"k": "tiny", "v": [4.0]}),
        pd.DataFrame({"k": "two", "v": [-1.0, 7.0]}),
        pd.DataFrame({"k": "narrow", "v": 1000 + rng.random(3000) * 1e-6}),
        pd.DataFrame({"k": "wide", "v": rng.choice([-1, 1], 2000) * 10.0 ** rng.uniform(-9, 9, 2000)}),
    ]
    return pd.concat(parts, ignore_index=True)


PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


@pytest.mark.parametrize("limit", [2_000_000, 50])
@pytest.mark.parametrize("kind", ["linear", "midpoint"])
def test_group_quantiles(spark, monkeypatch, kind, limit):
    # a low limit forces the refining passes
    monkeypatch.setattr(qn, "CANDIDATES", limit)
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(7)
    got = qn.group_quantiles(df, ["k"], "v", PROBS, kind=kind).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.loc[k, "n"] == len(g)
        for name, p in PROBS.items():
            want = np.quantile(g.v, p) if kind == "linear" else midpoint(g.v.to_numpy(), p)
            assert got.loc[k, name] == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_quantiles_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (10.0,)], "v double")
    row = qn.group_quantiles(df, [], "v", {"m": 0.5}).first()
    assert (row["n"], row["m"]) == (3, 3.0)


def test_percentile_from_a_key_column(spark):
    df = spark.createDataFrame([(k, p, float(i)) for k, p in (("a", 0.25), ("b", 0.75)) for i in range(5)], "k string, p double, v double")
    got = {r["k"]: r["q"] for r in qn.group_quantiles(df, ["k", "p"], "v", {"q": F.col("p")}).collect()}
    assert got == {"a": 1.0, "b": 3.0}


def test_bucket_keeps_order():
    from tests.oracle import session

    spark = session()
    v = sorted([-1e12, -5.0, -1e-9, 0.0, 1e-9, 0.3, 0.30001, 7.0, 1e12])
    for res in (8, 8 * 256, 8 * 256**3):
        b = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(qn.order_bucket(F.col("v"), res)).collect()]
        assert b == sorted(b)


def test_group_ranks(spark):
    pdf = frame().query("k in ['hot', 'ties', 'two']")
    got = qn.group_ranks(spark.createDataFrame(pdf), ["k"], "v", "rk").toPandas()
    got["want"] = got.groupby("k")["v"].rank(method="average")
    assert (got.rk == got.want).all()
