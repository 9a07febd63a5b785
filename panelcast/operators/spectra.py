"""Discrete Fourier transforms, periodograms and autocorrelations of series of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.sources.panels import steps, with_halo

MOST = 1 << 20
COMPLEX = "series_id string, k long, re double, im double"


def factors(n: int, most: int) -> tuple[int, int] | None:
    """The most even split of n into two factors, if both are within ``most``."""
    low = next(d for d in range(int(n**0.5), 0, -1) if n % d == 0)
    return (low, n // low) if n // low <= most else None


def fourier(rows: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """(series_id, k, re, im): the transform of each series (series_id, t, re, im) of n steps; steps without a row are 0.

    A series of up to ``most`` steps is transformed in one go. A longer one of n = n1 n2 steps is cut into columns of every n2-th step: the columns' transforms, turned
    by exp(-2 pi i c k1 / n), are dealt to rows of equal k1, whose transforms are the result. A task holds ``most`` values of a series at a time; one shuffle lies
    between. A length without two factors within ``most`` (a prime, say) is brought to one that has them, as a convolution with a chirp.
    """
    import numpy as np
    import pandas as pd

    def turn(x):
        """exp(-2 pi i x / n) for whole x, however large."""
        return np.exp(-2j * np.pi * (x % n) / n)

    if n <= most:

        def whole(g: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros(n, dtype=complex)
            x[g["t"].to_numpy()] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
            y = np.fft.fft(x)
            return pd.DataFrame({"series_id": g["series_id"].iloc[0], "k": np.arange(n), "re": y.real, "im": y.imag})

        return rows.groupBy("series_id").applyInPandas(whole, COMPLEX)
    found = factors(n, most)
    if found is None:
        return _by_chirp(rows, n, most)
    n1, n2 = found
    width, height = max(1, most // n1), max(1, most // n2)  # columns, and rows, that a task holds

    def columns(g: pd.DataFrame) -> pd.DataFrame:
        t = g["t"].to_numpy()
        c = np.unique(t % n2)
        x = np.zeros((len(c), n1), dtype=complex)
        x[np.searchsorted(c, t % n2), t // n2] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
        y = np.fft.fft(x, axis=1) * turn(c[:, None] * np.arange(n1))
        out = [(int(a), int(v), y[i, a * height : (a + 1) * height]) for i, v in enumerate(c) for a in range(-(-n1 // height))]
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "block": [a for a, _, _ in out], "c": [v for _, v, _ in out], "re": [p.real for _, _, p in out], "im": [p.imag for _, _, p in out]})

    def across(g: pd.DataFrame) -> pd.DataFrame:
        block = int(g["block"].iloc[0])
        x = np.zeros((len(g["re"].iloc[0]), n2), dtype=complex)
        x[:, g["c"].to_numpy()] = (np.array(g["re"].tolist()) + 1j * np.array(g["im"].tolist())).T
        y = np.fft.fft(x, axis=1)
        k = (block * height + np.arange(len(y)))[:, None] + n1 * np.arange(n2)
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "k": k.ravel(), "re": y.real.ravel(), "im": y.imag.ravel()})

    dealt = rows.withColumn("part", F.floor(F.pmod(F.col("t"), F.lit(n2)) / width))
    turned = dealt.groupBy("series_id", "part").applyInPandas(columns, "series_id string, block long, c long, re array<double>, im array<double>")
    return turned.groupBy("series_id", "block").applyInPandas(across, COMPLEX)


def _by_chirp(rows: DataFrame, n: int, most: int) -> DataFrame:
    """X_k = q_k sum_t (x_t q_t) / q_(k - t) with q_t = exp(-pi i t^2 / n): a convolution, by three transforms of a length with even factors."""
    side = int((2 * n) ** 0.5) + 1
    if side > most:
        raise ValueError(f"{n} steps need tasks that hold {side} values")
    m = side * side
    # t^2 modulo 2 n is exact in 64 bits up to 3 * 10^9 steps.
    angle = lambda t: F.pmod(t * t, F.lit(2 * n)) * F.lit(float(-3.141592653589793 / n))
    times = lambda a, b, c, d: ((a * c - b * d).alias("re"), (a * d + b * c).alias("im"))
    q = lambda t: (F.cos(angle(t)), F.sin(angle(t)))
    at = F.col("t")
    x = rows.select("series_id", "t", *times(F.col("re"), F.col("im"), *q(at)))
    # 1 / q at 0 .. n - 1, and at the same distances below 0, which are the last places of the circle.
    near = F.least(at, F.lit(m) - at)
    chirp = rows.sparkSession.range(m).select(F.lit("").alias("series_id"), F.col("id").alias("t")).where((at < n) | (at > m - n)).select("series_id", "t", F.cos(angle(near)).alias("re"), (-F.sin(angle(near))).alias("im"))
    a, b = fourier(x, m, most), fourier(chirp, m, most).select("k", F.col("re").alias("c"), F.col("im").alias("d"))
    product = a.join(b, "k").select("series_id", "k", *times(F.col("re"), F.col("im"), F.col("c"), F.col("d")))
    # The inverse transform is the transform of the conjugate, conjugated.
    back = fourier(product.select("series_id", F.col("k").alias("t"), "re", (-F.col("im")).alias("im")), m, most).where(F.col("k") < n)
    return back.select("series_id", "k", *times(F.col("re") / m, -F.col("im") / m, *q(F.col("k"))))


def centred(panel: DataFrame) -> DataFrame:
    means = panel.groupBy("series_id").agg(F.avg("value").alias("_m"))
    return panel.join(means, "series_id").select("series_id", "t", (F.col("value") - F.col("_m")).alias("value"))


def periodogram(panel: DataFrame, most: int = MOST) -> DataFrame:
    """(series_id, k, power) of the centred series; frequency k / T for k up to T / 2."""
    n = steps(panel)
    rows = centred(panel).select("series_id", "t", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return fourier(rows, n, most).where(F.col("k") <= n // 2).select("series_id", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def autocorrelation(panel: DataFrame, lags: int, chunk: int = 4096) -> DataFrame:
    """(series_id, lag, acf): biased, over the centred series. Chunks of time with a halo of ``lags`` rows leave one row of sums each; values are not copied a lag."""
    import pandas as pd

    from panelcast.operators.linear import added

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = g.sort_values("t")
        x, halo = g["value"].to_numpy(dtype=float), int(g["halo"].sum())
        own = x[halo:]
        s = [own[max(0, k - halo) :] @ x[max(0, halo - k) : len(x) - k] if k < len(x) else 0.0 for k in range(lags + 1)]
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "s": [np.array(s)]})

    chunk = max(chunk, lags)
    parts = with_halo(centred(panel), chunk, lags + 1).groupBy("series_id", "chunk").applyInPandas(run, "series_id string, s array<double>")
    sums = added(parts, ("series_id",), ("s",))
    return sums.select("series_id", F.get("s", 0).alias("_zero"), F.posexplode("s").alias("lag", "_s")).select("series_id", "lag", (F.col("_s") / F.col("_zero")).alias("acf"))
