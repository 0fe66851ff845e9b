"""Statistics from partial aggregates against those of the multiplied rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glacierlens.operators import altimetry as alt
from glacierlens.operators import lattice
from glacierlens.operators import timewindows as tw

REF = "2000-01-01"


def footprints(seed, n):
    """Clusters, ties, values at the screen's border, missing ones, and a region with two values far apart."""
    rng = np.random.default_rng(seed)
    dh = np.concatenate([rng.normal(10, 40, n), rng.choice([-75.0, 0.0, 75.0, 149.99, 150.0], n), rng.uniform(-300, 300, n)])
    pdf = pd.DataFrame({
        "dh": dh, "lon": rng.uniform(70, 74, len(dh)), "lat": rng.uniform(30, 32, len(dh)), "obs_day": rng.integers(0, 1461, len(dh)),
        "slope_deg": rng.choice([5.0, 41.0], len(dh), p=[0.9, 0.1]), "quality_flag": rng.choice([0, 1], len(dh), p=[0.9, 0.1]),
        "region22": rng.choice([1, 2, 3], len(dh), p=[0.8, 0.15, 0.05]), "elev_ref": rng.uniform(2000, 9000, len(dh)),
    })
    pdf["region15"], pdf["tp_flag"] = pdf.region22 // 2, (pdf.region22 == 1).astype(int)
    lone = pdf.iloc[:2].assign(region22=9, region15=9, dh=[-149.0, 149.0], slope_deg=1.0, quality_flag=0, obs_day=3)
    out = pd.concat([pdf, lone])
    out.loc[out.index[::50], "dh"] = np.nan
    return out


def frame(spark, seed, n):
    df = spark.createDataFrame(footprints(seed, n))
    return df.withColumns({"dh": F.when(~F.isnan("dh"), F.col("dh")), "obs_day": F.col("obs_day").cast("int")})


def rounded(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).fillna(-1e9).collect())


@pytest.mark.parametrize("min_n, n", [(1, 400), (101, 400), (1, 12)])
def test_states_give_what_rows_give(spark, min_n, n):
    screen = alt.Screen(150, 75, min_n, True)
    df = frame(spark, n, n).repartition(4)
    win = tw.annual_windows(spark, REF, "2004-01-01", REF)
    keys = ["hier", "region_id", "win_kind", "win_id"]
    want = alt.robust_stats(tw.window_join(alt.hierarchies(df.where(screen.base())), win, REF), keys, screen)
    rows = alt.with_cell(tw.with_month(df, REF))
    levels = [(alt.hierarchies, ["hier", "region_id", "month"]), (lambda d: tw.month_join(d, win, REF), keys)]
    assert rounded(lattice.robust_stats(rows, ["month", *alt.finest()], levels, screen)) == rounded(want)
    one = [(alt.hierarchies, ["hier", "region_id"])]
    want = alt.robust_stats(alt.hierarchies(df.where(screen.base())), ["hier", "region_id"], screen)
    assert rounded(lattice.robust_stats(rows, alt.finest(), one, screen)) == rounded(want)


def test_bands_from_states(spark):
    df = frame(spark, 3, 500)
    win = tw.annual_windows(spark, REF, "2004-01-01", REF).where("win_kind = 'y1'")
    keys = ["hier", "region_id", "win_id", "band_center"]
    want = alt.band_stats(tw.window_join(alt.hierarchies(df), win, REF), keys[:3])
    rows = alt.in_bands(alt.with_cell(tw.with_month(df, REF)))
    got = lattice.band_stats(rows, ["month", "band_center", *alt.finest()], [(lambda d: alt.hierarchies(tw.month_join(d, win, REF)), keys)])
    assert rounded(got) == rounded(want)


def test_no_rows(spark):
    df = frame(spark, 1, 5).where("false")
    rows = alt.with_cell(tw.with_month(df, REF))
    assert lattice.robust_stats(rows, alt.finest(), [(alt.hierarchies, ["hier", "region_id"])], alt.PHOTON).count() == 0


def test_windows_within_months_are_refused(spark):
    win = tw.campaign_windows(spark, REF)
    with pytest.raises(ValueError, match="begin and end"):
        tw.month_join(spark.createDataFrame([(1,)], "month int"), win, REF)
    first = dt.date(2000, 1, 1)
    assert tw.annual_windows(spark, str(first), "2002-01-01", REF).count() == 4


def test_other_screens_are_refused(spark):
    with pytest.raises(ValueError, match="survivors"):
        lattice.robust_stats(spark.range(1), ["id"], [(lambda d: d, ["id"])], alt.LASER)
