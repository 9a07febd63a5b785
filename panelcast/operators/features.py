"""Causal window features of a panel (series_id, t, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(first: int | None = None):
    w = Window.partitionBy("series_id").orderBy("t")
    return w if first is None else w.rowsBetween(first, 0)


def window_stats(panel: DataFrame, lookback: int) -> DataFrame:
    """Mean, std (population), min and max of the last rows, mean absolute step and last step; early rows use what there is."""
    v, w = F.col("value"), _w(-(lookback - 1))
    stepped = panel.withColumn("trend", v - F.lag("value").over(_w()))
    return stepped.select(
        "series_id", "t", "value", F.avg(v).over(w).alias("mean"), F.stddev_pop(v).over(w).alias("std"), F.min(v).over(w).alias("min"), F.max(v).over(w).alias("max"),
        F.avg(F.abs("trend")).over(_w(-(lookback - 2))).alias("avgdiff"), "trend",
    )


def lag_vector(panel: DataFrame, lookback: int, fill: float | None = None, name: str = "lags") -> DataFrame:
    """Add ``lags`` (or another name): the last ``lookback`` values, oldest first; ``fill`` stands for those before the start."""
    seen = F.collect_list("value").over(_w(-(lookback - 1)))
    pad = F.array_repeat(F.lit(fill).cast("double"), F.lit(lookback) - F.size("_seen"))
    return panel.withColumn("_seen", seen).withColumn(name, F.concat(pad, "_seen")).drop("_seen")


def bins_of(lookback: int, most: int = 8) -> int:
    return min(most, max(lookback - 1, 1))


def spectrum(panel: DataFrame, lookback: int, most: int = 8) -> DataFrame:
    """Add ``bins``: magnitudes of the window's discrete Fourier transform at 1..b, divided by their sum; missing history is 0."""
    b = bins_of(lookback, most)
    turn = 2 * math.pi / lookback

    def magnitudes(window: Column) -> Column:
        part = lambda k, f: sum((F.get(window, j) * F.lit(f(turn * k * j)) for j in range(lookback)), F.lit(0.0))
        return F.array(*[F.hypot(part(k, math.cos), part(k, math.sin)) for k in range(1, b + 1)])

    # Transforms of one-element arrays bind the window, and the magnitudes, so that each is computed once a row.
    bound = F.transform(F.transform(F.array("_l"), magnitudes), lambda m: F.transform(m, lambda x: x / (F.aggregate(m, F.lit(0.0), lambda a, y: a + y) + F.lit(1e-9))))
    return lag_vector(panel, lookback, 0.0, "_l").withColumn("bins", bound[0]).drop("_l")


def phase(t: Column, cadence: int) -> tuple[Column, Column]:
    angle = F.pmod(t, F.lit(cadence)) * F.lit(2 * math.pi / cadence)
    return F.sin(angle), F.cos(angle)


def feature_rows(panel: DataFrame, lookback: int, cadence: int, most: int = 8) -> DataFrame:
    """(series_id, t, value, phi): six statistics, the lags, the spectrum and the phase. Windows share one partitioning."""
    whole = spectrum(lag_vector(window_stats(panel, lookback), lookback), lookback, most)
    s, c = phase(F.col("t"), cadence)
    six = F.array("mean", "std", "min", "max", "avgdiff", "trend")
    return whole.select("series_id", "t", "value", F.concat(six, "lags", "bins", F.array(s, c)).alias("phi"))


def feature_blocks(panel: DataFrame, lookback: int, cadence: int, most: int = 8, chunk: int = 4096) -> DataFrame:
    """``feature_rows`` of the steps with a whole window, for long lookbacks: NumPy on time chunks with a halo of ``lookback - 1`` rows."""
    import pandas as pd

    from panelcast.functions import kernels
    from panelcast.sources.panels import with_halo

    bins = bins_of(lookback, most)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        if len(g) < lookback:
            return pd.DataFrame({"series_id": pd.Series([], dtype=object), "t": pd.Series([], dtype="int64"), "value": pd.Series([], dtype="float64"), "phi": pd.Series([], dtype=object)})
        phi = kernels.window_features(g["value"].to_numpy(dtype=float), lookback, cadence, int(g["t"].iloc[0]), bins)
        return g[["series_id", "t", "value"]].iloc[lookback - 1 :].assign(phi=list(phi))

    return with_halo(panel, chunk, lookback).groupBy("series_id", "chunk").applyInPandas(run, "series_id string, t long, value double, phi array<double>")


def feature_names(lookback: int, most: int = 8) -> list[str]:
    return ["mean", "std", "min", "max", "avgdiff", "trend", *(f"x_lag{i}" for i in range(lookback)), *(f"fft{i}" for i in range(bins_of(lookback, most))), "phase_sin", "phase_cos"]


def feature_slice(panel: DataFrame, first: int, n: int, lookback: int, cadence: int, most: int = 8) -> DataFrame:
    """``feature_rows`` for n steps from ``first``, read from those and the ``lookback - 1`` before them alone."""
    if first < lookback - 1:
        raise ValueError("the slice has no full history")
    part = panel.where((F.col("t") >= first - lookback + 1) & (F.col("t") < first + n))
    return feature_rows(part, lookback, cadence, most).where(F.col("t") >= first)


def targets(panel: DataFrame, horizon: int) -> DataFrame:
    """Add ``y``: the values 1..horizon steps ahead, null past the end."""
    return panel.withColumn("y", F.array(*[F.lead("value", r).over(_w()) for r in range(1, horizon + 1)]))


def by_horizon(panel: DataFrame, horizon: int) -> DataFrame:
    """One row per origin and step r with its target, where there is one."""
    out = targets(panel, horizon).select("series_id", "t", "value", F.posexplode("y").alias("r", "target"))
    return out.where("target IS NOT NULL").withColumn("r", F.col("r") + 1)


def _recurrence(rows: DataFrame, modes: list[tuple[float, float]], inputs, chunk: int | None, imaginary: bool) -> DataFrame:
    """(series_id, t, out) of (series_id, t, x ARRAY): a series in order, or, with ``chunk``, chunks of it in parallel.

    Chunks run from 0; their last states are combined in order (one row a chunk), and lambda^(k+1) times the carried state is
    added inside each.
    """
    import numpy as np
    import pandas as pd

    from panelcast.functions import kernels

    lam = np.array([r * np.exp(1j * a) for r, a in modes])
    gain, m = np.array(inputs, dtype=float).T, len(modes)
    parted = rows.select("series_id", F.floor(F.col("t") / (chunk or 1)).cast("long").alias("chunk") if chunk else F.lit(0).cast("long").alias("chunk"), "t", "x")

    def local(g: pd.DataFrame):
        return kernels.recurred(np.array(g["x"].tolist(), dtype=float) @ gain, lam)

    def flat(h):
        return list(np.concatenate([h.real, h.imag], axis=1) if imaginary else h.real)

    schema = "series_id string, t long, out array<double>"
    if chunk is None:

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("t")
            return pd.DataFrame({"series_id": g["series_id"], "t": g["t"], "out": flat(local(g))})

        return parted.groupBy("series_id").applyInPandas(run, schema)

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        h = local(g.sort_values("t"))[-1]
        return pd.DataFrame({"series_id": [g["series_id"].iloc[0]], "chunk": [g["chunk"].iloc[0]], "n": [len(g)], "h": [np.concatenate([h.real, h.imag])]})

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        h, out = np.zeros(m, dtype=complex), []
        for n, v in zip(g["n"], g["h"], strict=True):
            out.append(np.concatenate([h.real, h.imag]))
            h = lam**n * h + (np.array(v[:m]) + 1j * np.array(v[m:]))
        return g.assign(h=out)[["series_id", "chunk", "h"]]

    last = parted.groupBy("series_id", "chunk").applyInPandas(ends, "series_id string, chunk long, n long, h array<double>")
    carried = last.groupBy("series_id").applyInPandas(carry, "series_id string, chunk long, h array<double>")

    def finish(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        if not len(g):
            return pd.DataFrame({"series_id": g["series_id"], "t": g["t"], "out": pd.Series([], dtype=object)})
        v = np.array(c["h"].iloc[0])
        h = local(g) + lam ** (np.arange(len(g))[:, None] + 1) * (v[:m] + 1j * v[m:])
        return pd.DataFrame({"series_id": g["series_id"], "t": g["t"], "out": flat(h)})

    return parted.groupBy("series_id", "chunk").cogroup(carried.groupBy("series_id", "chunk")).applyInPandas(finish, schema)


def linear_recurrence(rows: DataFrame, modes: list[tuple[float, float]], inputs: list[list[float]], chunk: int | None = None) -> DataFrame:
    """(series_id, t, out): the real part of h_t = lambda h_{t-1} + B x_t for modes of (radius, angle); ``inputs`` is B, a row a mode, and ``rows`` hold arrays x."""
    return _recurrence(rows, modes, inputs, chunk, False)


def oscillators(panel: DataFrame, bank: list[tuple[float, float, float]], chunk: int | None = None) -> DataFrame:
    """(series_id, t, context): h_t = lambda h_{t-1} + b x_t from h = 0 for every (radius, angle, b) of the bank: real parts, then imaginary parts.

    A recurrence over a series in order; NumPy runs all modes at once, in the task that holds the series.
    """
    x = panel.select("series_id", "t", F.array("value").alias("x"))
    return _recurrence(x, [(r, a) for r, a, _ in bank], [[b] for _, _, b in bank], chunk, True).withColumnRenamed("out", "context")


def oscillators_by_chunk(panel: DataFrame, bank: list[tuple[float, float, float]], chunk: int) -> DataFrame:
    """The same for long series, in parallel chunks."""
    return oscillators(panel, bank, chunk)


def with_context(features: DataFrame, context: DataFrame) -> DataFrame:
    """Append the context columns to phi."""
    return features.join(context.select("series_id", "t", "context"), ["series_id", "t"]).withColumn("phi", F.concat("phi", "context")).drop("context")


def delay_embedding(panel: DataFrame, order: int, lag: int = 1) -> DataFrame:
    """``phi`` = [1, u_t, u_{t-lag}, ...]; whole rows of the first ``order * lag`` steps are 0."""
    values = F.array(F.lit(1.0), *[F.coalesce(F.lag("value", i * lag).over(_w()), F.lit(0.0)) for i in range(order + 1)])
    return panel.withColumn("phi", F.when(F.col("t") < order * lag, F.array_repeat(F.lit(0.0), order + 2)).otherwise(values))


def delay_signals(rows: DataFrame, order: int, lag: int = 1) -> DataFrame:
    """The same for (series_id, t, u ARRAY) of several signals a step; the first ``order * lag`` steps are left out."""
    past = [F.lag("u", i * lag).over(_w()) for i in range(1, order + 1)]
    return rows.withColumn("phi", F.concat(F.array(F.lit(1.0)), "u", *past)).where(F.col("phi").isNotNull())


def quadratic_lift(phi: Column) -> Column:
    """The entries, then the products of every two, row by row from the diagonal."""
    return F.concat(phi, F.flatten(F.transform(phi, lambda x, i: F.transform(F.slice(phi, i + 1, F.size(phi) - i), lambda y: x * y))))


def padded(phi: Column, block: int) -> Column:
    """Nulls to 0, and zeros up to a multiple of the block size."""
    filled = F.transform(phi, lambda x: F.coalesce(x, F.lit(0.0)))
    return F.concat(filled, F.array_repeat(F.lit(0.0), F.pmod(-F.size(phi), F.lit(block)).cast("int")))


def to_blocks(df: DataFrame, column: str, block: int) -> DataFrame:
    """One row per block of ``block`` entries: block_id and the entries."""
    cut = F.transform(F.sequence(F.lit(0), (F.size(column) / block).cast("int") - 1), lambda k: F.slice(column, k * block + 1, F.lit(block)))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(cut).alias("block_id", column))
