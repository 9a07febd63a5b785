"""The whole workload at full width: all window features, fits and sweeps of many series, and the four model variants. No SQL solves these; tests hold them against plain NumPy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.jobs.panel_jobs import BANK, CADENCE, cuts, rounded, scaled
from panelcast.operators import evaluate as V
from panelcast.operators import features as X
from panelcast.operators import linear as L
from panelcast.operators import online as O
from panelcast.operators import protocol as B
from panelcast.sources import panels
from panelcast.sources.storage import kept, stored, table

#: Features: 6 statistics, 96 lags, 8 bins and 2 of the phase are 112.
LOOKBACK, BINS, LAM = 96, 8, 1e-3
HORIZON = 3


def daily(spark, d):
    """The scaled daily panel per supplier (many series), and its cuts."""

    def make():
        p = stored(panels.supplier_daily(spark, d), "dense")  # read for its length, its statistics and its values
        return B.zscore(p, cuts(p)[0])

    p = kept(spark, d, "suppliers", make)
    return p, cuts(p)


def d11(spark, d):
    z, (tr, _, _) = daily(spark, d)
    return O.fit_series(z, tr, 1, LOOKBACK, CADENCE, BINS, LAM).select("series_id", "r", F.posexplode("w").alias("i", "w")).withColumn("w", F.round("w", 6))


def d14(spark, d):
    z, (tr, te, n) = daily(spark, d)
    return rounded(O.sweep(z, tr, te, n, 1, LOOKBACK, CADENCE, BINS, LAM, False), "yhat")


def d14_chunks(spark, d):
    """The same by chunks, for few long series: features as a table, sums merged across tasks, one product a chunk."""
    z, (tr, te, n) = scaled(spark, d)
    features = stored(X.feature_blocks(z, LOOKBACK, CADENCE, BINS, 500), "features")
    return rounded(L.forecast(features, L.fit_ridge(features, tr, HORIZON, LOOKBACK, LAM), te, n, 500), "yhat")


def e2(spark, d):
    z, (tr, te, n) = daily(spark, d)
    return rounded(O.sweep(z, tr, te, n, 1, LOOKBACK, CADENCE, BINS, LAM), "yhat")


def e2_long(spark, d, horizon=24):
    """Scores of the full-width online sweep 1 to ``horizon`` steps ahead, as the published work has them."""
    z, (tr, te, n) = daily(spark, d)
    return rounded(O.sweep_scores(z, tr, te, n, horizon, LOOKBACK, CADENCE, BINS, LAM), "mse", "mae", digits=5)


def e4_chunks(spark, d):
    """The online pass by chunks of time, at full width: no task holds a whole series, nor all sums of one."""
    z, (tr, te, n) = scaled(spark, d)
    features = stored(X.feature_blocks(z, LOOKBACK, CADENCE, BINS, 500), "features")
    return rounded(O.online_by_chunk(features, tr, LAM, HORIZON, LOOKBACK, te, n, 250, 4), "yhat")


def e5(spark, d):
    """Static and online, with and without the oscillators' context, over the panel per nation."""
    z, (tr, te, n) = scaled(spark, d)
    out = None
    for name, online, bank in (("static", False, None), ("rls", True, None), ("s2", False, BANK), ("s2rls", True, BANK)):
        errs = V.errors(O.sweep(z, tr, te, n, HORIZON, 7, CADENCE, 3, LAM, online, bank), z)
        one = V.total_score(errs).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mse", "mae", digits=5)


def e9(spark, d):
    """A region's nations as signals of one series: one model on the lifted embedding for all regions, and five steps fed back."""
    z, (tr, te, _) = scaled(spark, d)
    n, r = (table(spark, d, x) for x in ("nation", "region"))
    of = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("series_id"), "r_name")  # as many rows as nations
    signals = z.join(F.broadcast(of), "series_id").groupBy(F.col("r_name").alias("series_id"), "t").agg(F.sort_array(F.collect_list(F.struct("series_id", "value"))).alias("s"))
    rows = signals.select("series_id", "t", F.transform("s", lambda x: x["value"]).alias("u"))
    lifted = X.delay_signals(rows, 1).withColumn("phi", X.quadratic_lift(F.col("phi"))).withColumn("y", F.lead("u").over(Window.partitionBy("series_id").orderBy("t")))
    w = L.fit_shared(lifted.where(F.col("t") < tr - 1).select("phi", "y"), 1e-3).first()["w"]
    out = O.free_run_signals(rows, w, 1, 1, te, 5)
    return out.select("series_id", "t", F.posexplode("yhat").alias("i", "v")).withColumn("v", F.round("v", 6))


JOBS = {"e9_free_run_signals": (e9, None), "d11_full_fit": (d11, None), "d14_full_forecast": (d14, None), "d14_full_forecast_by_chunk": (d14_chunks, None), "e2_full_sweep": (e2, None), "e2_full_24_ahead": (e2_long, None), "e4_full_by_chunk": (e4_chunks, None), "e5_all_variants": (e5, None)}
