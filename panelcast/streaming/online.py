"""Recursive least squares over a stream, keyed by series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "last long, phis array<double>, preds array<double>, w array<double>, inv array<double>"
OUT = "series_id string, t long, r int, yhat double, err double"


def online_stream(rows: DataFrame, horizon: int, features: int, lam: float, first: int) -> DataFrame:
    """(series_id, t, r, yhat, err) of update-then-forecast over streamed (series_id, t, value, phi), each as soon as its target is seen, for origins from ``first``.

    Every step ahead has weights that start at 0 with a ridge penalty ``lam``. A series' state is the features and forecasts of its last ``horizon``
    steps, its weights and inverses, so it is of fixed size. Steps of a series must come without gaps; rows at or before the last step seen are dropped.
    """
    import pandas as pd

    def run(key, batches, state):
        import numpy as np

        from panelcast.functions import kernels

        g = pd.concat(list(batches)).drop_duplicates("t").sort_values("t")
        if state.exists:
            last, *arrays = state.get
            phis, preds, w, inv = (np.array(a, dtype=float) for a in arrays)
        else:
            last, phis, preds, w, inv = -1, np.empty(0), np.empty(0), np.zeros(horizon * features), np.tile(np.eye(features) / lam, (horizon, 1, 1)).ravel()
        g = g[g["t"] > last]
        if not len(g):
            return
        held = phis.reshape(-1, features)
        t0, t = int(g["t"].iloc[0]) - len(held), g["t"].to_numpy()
        if t[-1] - t[0] + 1 != len(t) or last >= 0 and t[0] != last + 1:
            raise ValueError(f"series {key[0]}: steps are missing before {t[-1]}")
        phi = np.concatenate([held, np.array(g["phi"].tolist(), dtype=float)])
        x = np.concatenate([np.full(len(held), np.nan), g["value"].to_numpy(dtype=float)])
        ahead = np.arange(1, horizon + 1)
        made, w, inv = kernels.online_pass(x, phi, ahead, w.reshape(horizon, features), inv.reshape(horizon, features, features), len(held), len(phi))
        yhat = np.concatenate([preds.reshape(-1, horizon), made])
        target = np.arange(len(phi))[:, None] + ahead
        i, j = np.nonzero((target >= len(held)) & (target < len(phi)) & (t0 + np.arange(len(phi))[:, None] >= first))
        keep = slice(max(0, len(phi) - horizon), None)
        state.update((int(t[-1]), phi[keep].ravel().tolist(), yhat[keep].ravel().tolist(), w.ravel().tolist(), inv.ravel().tolist()))
        yield pd.DataFrame({"series_id": pd.Series([key[0]] * len(i), dtype=object), "t": t0 + i, "r": ahead[j], "yhat": yhat[i, j], "err": yhat[i, j] - x[target[i, j]]})

    keyed = rows.select("series_id", "t", "value", "phi").groupBy("series_id")
    return keyed.applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def error_sums(errs: DataFrame) -> DataFrame:
    """One row of sums to score from, which add up over micro-batches."""
    return errs.agg(F.sum(F.col("err") * F.col("err")).alias("sq"), F.sum(F.abs("err")).alias("ab"), F.count("err").alias("n"))


def running_score(partials: DataFrame) -> DataFrame:
    n = F.sum("n")
    return partials.agg((F.sum("sq") / n).alias("mse"), (F.sum("ab") / n).alias("mae"), n.alias("n"))
