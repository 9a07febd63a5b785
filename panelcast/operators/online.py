"""Update-then-forecast passes by recursive least squares, and recursive multi-step forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 1024  # rows before the first step that a pass is given: more than any step ahead


def delayed_pairs(features: DataFrame, horizon: int) -> DataFrame:
    """(series_id, t, r, phi_then, observed): at step t the value just seen meets the features of r steps before."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("t")
    lagged = F.array(*[F.lag("phi", r).over(w) for r in range(1, horizon + 1)])
    out = features.withColumn("_p", lagged).select("series_id", "t", F.col("value").alias("observed"), F.posexplode("_p").alias("r", "phi_then"))
    return out.where("phi_then IS NOT NULL").select("series_id", "t", (F.col("r") + 1).alias("r"), "phi_then", "observed")


def no_forecasts():
    import pandas as pd

    return pd.DataFrame({"series_id": pd.Series([], dtype=object), "t": pd.Series([], dtype="int64"), "r": pd.Series([], dtype="int32"), "yhat": pd.Series([], dtype="float64")})


def stacked(model):
    """Rows (r, w, a_inv) of a series' model -> arrays r, w (r, F) and a_inv (r, F, F)."""
    import numpy as np

    w = np.array(model["w"].tolist(), dtype=float)
    return model["r"].to_numpy(dtype=int), w, np.array(model["a_inv"].tolist(), dtype=float).reshape(len(w), w.shape[1], w.shape[1])


def _before(first: int, r, n: int, steps: int):
    """Of n origins from ``first`` and the steps ahead r, the pairs whose target lies before ``steps``."""
    import numpy as np

    return np.nonzero(first + np.arange(n)[:, None] + r[None, :] < steps)


def _in_order(g):
    """The values of an Arrow table (t, value) in order of t; nulls are NaN."""
    import numpy as np

    return g["value"].to_numpy().astype(float)[np.argsort(g["t"].to_numpy(), kind="stable")]


def long_forecasts(series_id, first: int, r, yhat, steps: int):
    """Forecasts (origins, r) -> rows (series_id, t, r, yhat) whose target lies before ``steps``."""
    import pandas as pd

    i, j = _before(first, r, len(yhat), steps)
    return pd.DataFrame({"series_id": pd.Series([series_id] * len(i), dtype=object), "t": first + i, "r": r[j], "yhat": yhat[i, j]})


def _run(g, m, first: int, last: int):
    """One series' (or chunk's) pass over the steps first..last - 1; its rows may start later than step 0. Returns r, forecasts, w, a_inv."""
    import numpy as np

    from panelcast.functions import kernels

    g = g.sort_values("t")
    t0 = int(g["t"].iloc[0])
    r, w, inv = stacked(m)
    if r.max() > HELD:
        raise ValueError(f"steps ahead may be {HELD} at most")
    phi = np.array(g["phi"].tolist(), dtype=float)
    return (r, *kernels.online_pass(g["value"].to_numpy(dtype=float), phi, r, w, inv, first - t0, min(last, t0 + len(g)) - t0))


def online_forecast(features: DataFrame, model: DataFrame, first: int, steps: int) -> DataFrame:
    """(series_id, t, r, yhat) of update-then-forecast from ``first``; series run in parallel, all r of one at once."""
    import pandas as pd

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(m):
            return no_forecasts()
        r, yhat, _, _ = _run(g, m, first, steps)
        return long_forecasts(g["series_id"].iloc[0], first, r, yhat, steps)

    rows = features.where(F.col("t") >= first - HELD).select("series_id", "t", "value", "phi")
    return rows.groupBy("series_id").cogroup(model.groupBy("series_id")).applyInPandas(run, "series_id string, t long, r int, yhat double")


def online_state(features: DataFrame, model: DataFrame, first: int, last: int) -> DataFrame:
    """(series_id, r, w, a_inv) after the updates of steps first..last - 1: a model table to go on from."""
    import pandas as pd

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(m):
            return m[["series_id", "r", "w", "a_inv"]]
        r, _, w, inv = _run(g, m, first, last)
        return pd.DataFrame({"series_id": m["series_id"].iloc[0], "r": r, "w": list(w), "a_inv": list(inv.reshape(len(r), -1))})

    rows = features.where(F.col("t") >= first - HELD).select("series_id", "t", "value", "phi")
    return rows.groupBy("series_id").cogroup(model.groupBy("series_id")).applyInPandas(run, "series_id string, r int, w array<double>, a_inv array<double>")


def online_by_chunk(features: DataFrame, train_end: int, lam: float, horizon: int, lookback: int, first: int, steps: int, chunk: int, fan: int = 16) -> DataFrame:
    """The same forecasts for few long series, fit included: with unit weights RLS equals ridge on all rows so far, so the Gram sums of
    time chunks are added up by ``prefix_sums``, solved at each chunk's start, and the chunks run in parallel.

    One sum phi phi' a chunk travels, over the chunk's own steps. What the r-th step ahead has more or less of it are r rows: before the test start, before the chunk
    and at the train end; a chunk gets those (``horizon`` rows of each), the last ``horizon`` rows of the chunk before as its halo.
    """
    import pandas as pd

    from panelcast.operators.linear import prefix_sums, train_pairs, whole_sums
    from panelcast.sources.storage import stored

    n_chunks = max(1, -(-(steps - first) // chunk))
    t = F.col("t")
    of = lambda t: F.floor((t - first) / chunk).cast("long")
    both = F.array_distinct(F.array(of(t), of(t + horizon)))
    rows = features.select("series_id", "t", "value", "phi")
    near = rows.where(t >= first - horizon).select("*", F.explode(both).alias("chunk")).where((F.col("chunk") >= 0) & (F.col("chunk") < n_chunks))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<long>"))
    edges = rows.where(((t >= train_end - horizon) & (t < train_end - 1)) | ((t >= first - horizon) & (t < first))).select("*", every.alias("chunk"))

    def own(g: pd.DataFrame) -> pd.DataFrame:
        """The chunk's sums: phi phi' of its own steps, and phi y of the targets inside it, features r steps before."""
        import numpy as np

        g = g.sort_values("t")
        t0, a = int(g["t"].iloc[0]), first + int(g["chunk"].iloc[0]) * chunk
        phi, x = np.array(g["phi"].tolist(), dtype=float), g["value"].to_numpy(dtype=float)
        p, b = phi[a - t0 :], []
        for r in range(1, horizon + 1):
            at = np.arange(max(a, t0 + r), t0 + len(g)) - t0
            b.append(phi[at - r].T @ x[at])
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "chunk": int(g["chunk"].iloc[0]), "a": [(p.T @ p).ravel()], "b": [np.concatenate(b)]})

    sums = near.groupBy("series_id", "chunk").applyInPandas(own, "series_id string, chunk long, a array<double>, b array<double>")
    train = stored(whole_sums(train_pairs(features, train_end, horizon, lookback), horizon), "train-sums").select("series_id", F.col("a").alias("train_a"), F.col("b").alias("train_b"))
    starts = prefix_sums(sums, ("series_id",), "chunk", ("a", "b"), n_chunks, fan).join(train, "series_id")
    both_rows = near.withColumn("edge", F.lit(False)).unionByName(edges.withColumn("edge", F.lit(True)))

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from panelcast.functions import kernels

        if not len(g) or not len(m):
            return no_forecasts()
        edge, g = g[g["edge"]], g[~g["edge"]].sort_values("t")
        at_edge = dict(zip(edge["t"], edge["phi"], strict=True))
        phi, x, t0 = np.array(g["phi"].tolist(), dtype=float), g["value"].to_numpy(dtype=float), int(g["t"].iloc[0])
        f, a = phi.shape[1], first + int(m["chunk"].iloc[0]) * chunk
        outer = lambda ts, rows: (p := np.array([rows[k] for k in ts if k in rows], dtype=float).reshape(-1, f)).T @ p
        here = {t0 + k: phi[k] for k in range(min(horizon, len(phi)))}  # the halo
        train_a, now = (np.array(m[c].iloc[0]).reshape(f, f) for c in ("train_a", "a"))
        b = np.array(m["train_b"].iloc[0]).reshape(horizon, f) + np.array(m["b"].iloc[0]).reshape(horizon, f)
        ahead, w, inv = np.arange(1, horizon + 1), [], []
        for r in ahead:
            fit = train_a - outer(range(train_end - r, train_end - 1), at_edge)
            fit += lam * np.trace(fit) / f * np.eye(f)
            got = kernels.relative_ridge(fit + now + outer(range(first - r, first), at_edge) - outer(range(a - r, a), here), b[r - 1], 0.0)
            w.append(got[0])
            inv.append(got[1])
        yhat, _, _ = kernels.online_pass(x, phi, ahead, np.array(w), np.array(inv), a - t0, min(a + chunk, steps, t0 + len(g)) - t0)
        return long_forecasts(g["series_id"].iloc[0], a, ahead, yhat, steps)

    return both_rows.groupBy("series_id", "chunk").cogroup(starts.groupBy("series_id", "chunk")).applyInPandas(run, "series_id string, t long, r int, yhat double")


def _features(x, train_end: int, lookback: int, cadence: int, bins: int, bank):
    """One series' features (row i is step i + lookback - 1); None for a series that ends before the train rows do."""
    import numpy as np

    from panelcast.functions import kernels

    if len(x) < train_end:
        return None
    phi = kernels.window_features(x, lookback, cadence, 0, bins)
    if bank:
        turns = np.array([r * np.exp(1j * a) for r, a, _ in bank])
        h = kernels.recurred(x[:, None] * np.array([b for _, _, b in bank]), turns)[lookback - 1 :]
        phi = np.concatenate([phi, h.real, h.imag], axis=1)
    return phi


def _fits(x, phi, train_end: int, ahead, lookback: int, lam: float):
    """Weights and inverses of the ridge on the train rows for every step ahead."""
    import numpy as np

    from panelcast.functions import kernels

    w, inv = [], []
    most = train_end - lookback  # origins whose next step is a train row; a step further ahead lacks the last few
    whole = phi[:most].T @ phi[:most]
    for r in ahead:
        n = most + 1 - r
        got = kernels.relative_ridge(whole - phi[n:most].T @ phi[n:most], phi[:n].T @ x[lookback - 1 + r : lookback - 1 + r + n], lam)
        w.append(got[0])
        inv.append(got[1])
    return np.array(w), np.array(inv)


def _spread(panel: DataFrame) -> DataFrame:
    """Whole series dealt over all shuffle partitions, and 8 a core at least: their bytes are few for the work they make, so they must not be put together by size, nor may all wait for the slowest core."""
    n = max(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * panel.sparkSession.sparkContext.defaultParallelism)
    return panel.select("series_id", "t", "value").repartition(n, "series_id").groupBy("series_id")


def _has_rows(train_end: int, horizon: int, lookback: int) -> None:
    if train_end - horizon < lookback:
        raise ValueError("the train rows hold no window with a target for every step ahead")


def fit_series(panel: DataFrame, train_end: int, horizon: int, lookback: int, cadence: int, bins: int = 8, lam: float = 1e-3, bank: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(series_id, r, w, a_inv): the fit of ``sweep`` alone, a model table to go on from; what ``fit_ridge`` gives on ``feature_blocks``. A series without all train rows has null weights."""
    import pandas as pd

    _has_rows(train_end, horizon, lookback)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("t")["value"].to_numpy(dtype=float)
        phi = _features(x, train_end, lookback, cadence, bins, bank)
        if phi is None:
            none = pd.Series([None] * horizon, dtype=object)
            return pd.DataFrame({"series_id": g["series_id"].iloc[0], "r": range(1, horizon + 1), "w": none, "a_inv": none})
        ahead = range(1, horizon + 1)
        w, inv = _fits(x, phi, train_end, ahead, lookback, lam)
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "r": ahead, "w": list(w), "a_inv": list(inv.reshape(len(inv), -1))})

    return _spread(panel.where(F.col("t") < train_end)).applyInPandas(run, "series_id string, r int, w array<double>, a_inv array<double>")


def sweep(panel: DataFrame, train_end: int, first: int, steps: int, horizon: int, lookback: int, cadence: int, bins: int = 8, lam: float = 1e-3, online: bool = True, bank: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(series_id, t, r, yhat): fit on the train rows and forecast from ``first``, for panels of many series.

    Only a series' values travel; features (with the oscillators of ``bank``, if given), the fit and the pass are made where the
    series is. ``online`` updates before each forecast; without it the fitted weights stay. A series without all train rows and a test row
    gets null forecasts, one that ends early forecasts as far as it goes. For few very long series use
    ``feature_blocks``, ``fit_ridge`` and ``forecast`` or ``online_by_chunk``, which cut them into chunks.
    """
    import pyarrow as pa

    _has_rows(train_end, horizon, lookback)

    def run(g: pa.Table) -> pa.Table:
        import numpy as np

        got = _swept(_in_order(g), train_end, first, steps, horizon, lookback, cadence, bins, lam, online, bank)
        ahead, yhat = (np.arange(1, horizon + 1), np.full((max(0, steps - first), horizon), np.nan)) if got is None else got
        i, j = _before(first, ahead, len(yhat), steps)
        return pa.table({"series_id": pa.repeat(g["series_id"][0], len(i)), "t": first + i, "r": ahead[j].astype("int32"), "yhat": pa.array(yhat[i, j], from_pandas=True)})

    return _spread(panel).applyInArrow(run, "series_id string, t long, r int, yhat double")


def _swept(x, train_end: int, first: int, steps: int, horizon: int, lookback: int, cadence: int, bins: int, lam: float, online: bool, bank):
    """Steps ahead and forecasts (origins from ``first``, steps ahead) of one series; None if it is too short."""
    import numpy as np

    from panelcast.functions import kernels

    phi = _features(x, train_end, lookback, cadence, bins, bank)
    if phi is None or len(x) <= first:
        return None
    ahead, values, begin, last = np.arange(1, horizon + 1), x[lookback - 1 :], first - lookback + 1, min(steps - lookback, len(phi))
    together = min(horizon, kernels.SHARED)
    if not (online and together >= kernels.FEW and phi.shape[1] >= kernels.WIDE and first >= train_end and lam >= 1e-9):
        together = 0
    made = [kernels.shared_pass(values, phi, together, train_end - lookback, lam, begin, last)] if together else []
    if together < horizon:
        w, inv = _fits(x, phi, train_end, ahead[together:], lookback, lam)
        made.append(kernels.online_pass(values, phi, ahead[together:], w, inv, begin, last)[0] if online else phi[begin:last] @ w.T)
    return ahead, np.concatenate(made, axis=1)


def sweep_scores(panel: DataFrame, train_end: int, first: int, steps: int, horizon: int, lookback: int, cadence: int, bins: int = 8, lam: float = 1e-3, online: bool = True, bank: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(r, mse, mae, n) per step ahead: the scores of ``sweep`` for long horizons, whose forecasts stay in the tasks; a series leaves ``horizon`` rows of sums. Wide features: the first 24 steps ahead are passed together (``kernels.shared_pass``), others one by one."""
    import pyarrow as pa

    _has_rows(train_end, horizon, lookback)

    def run(g: pa.Table) -> pa.Table:
        import numpy as np

        x = _in_order(g)
        got = _swept(x, train_end, first, steps, horizon, lookback, cadence, bins, lam, online, bank)
        rows = []
        for r, yhat in zip(got[0], got[1].T, strict=True) if got is not None else ():
            n = max(0, min(len(yhat), min(steps, len(x)) - r - first))
            e = yhat[:n] - x[first + r : first + r + n]
            rows.append({"r": int(r), "sq": float(e @ e), "ab": float(np.abs(e).sum()), "n": n})
        return pa.Table.from_pylist(rows, pa.schema([("r", pa.int32()), ("sq", pa.float64()), ("ab", pa.float64()), ("n", pa.int64())]))

    sums = _spread(panel).applyInArrow(run, "r int, sq double, ab double, n long")
    n = F.sum("n")
    return sums.groupBy("r").agg((F.sum("sq") / n).alias("mse"), (F.sum("ab") / n).alias("mae"), n.alias("n"))


def free_run(panel: DataFrame, weights: DataFrame, order: int, start: int, n: int) -> DataFrame:
    """(series_id, t, yhat): n steps from ``start``, each prediction fed back into the delay embedding [1, x_t, ...]. weights: (series_id, w)."""
    import pandas as pd

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = g.sort_values("t")
        past, w, out = g["value"].tolist(), np.array(m["w"].iloc[0]), []
        for _ in range(n):
            past.append(float(np.concatenate([[1.0], past[: -order - 2 : -1]]) @ w))
            out.append(past[-1])
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "t": np.arange(start, start + n), "yhat": out})

    history = panel.where((F.col("t") < start) & (F.col("t") >= start - order - 1)).select("series_id", "t", "value")
    return history.groupBy("series_id").cogroup(weights.groupBy("series_id")).applyInPandas(run, "series_id string, t long, yhat double")


def free_run_signals(rows: DataFrame, w: list[float], order: int, lag: int, start: int, n: int) -> DataFrame:
    """(series_id, t, yhat ARRAY): the same for several signals a step, (series_id, t, u ARRAY), on the lifted ``delay_signals`` embedding with
    weights that all series share (row-major, a column a signal)."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        past = list(np.array(g.sort_values("t")["u"].tolist(), dtype=float))
        out, weights = [], np.array(w).reshape(-1, len(past[0]))
        for _ in range(n):
            phi = np.concatenate([[1.0], *past[: -order * lag - 2 : -lag]])
            i, j = np.triu_indices(len(phi))
            past.append(np.concatenate([phi, phi[i] * phi[j]]) @ weights)
            out.append(past[-1])
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "t": np.arange(start, start + n), "yhat": out})

    history = rows.where((F.col("t") < start) & (F.col("t") >= start - order * lag - 1)).select("series_id", "t", "u")
    return history.groupBy("series_id").applyInPandas(run, "series_id string, t long, yhat array<double>")
