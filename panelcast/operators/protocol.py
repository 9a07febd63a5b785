"""Splits, train-only scaling and clipping of a panel (series_id, t, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.quantiles import exact_quantiles

CONSTANT = 1e-9


def fraction_borders(n: int, train: float = 0.2, val: float = 0.05) -> list[tuple[str, int, int]]:
    """Phases (name, first, end) of n steps, cut by truncation."""
    a, b = int(n * train), int(n * train) + int(n * val)
    return [("train", 0, a), ("val", a, b), ("test", b, n)]


def calendar_borders(month: int, lookback: int, months: tuple[int, int, int] = (4, 1, 15)) -> list[tuple[str, int, int]]:
    """Phases by months of ``month`` steps; val and test start ``lookback`` steps early, so they overlap the phase before."""
    a, b, c = month * months[0], month * (months[0] + months[1]), month * sum(months)
    return [("train", 0, a), ("val", a - lookback, b), ("test", b - lookback, c)]


def with_phase(panel: DataFrame, borders: list[tuple[str, int, int]]) -> DataFrame:
    """One row per row and phase that holds it; overlapping phases copy rows. Built from literals: no join."""
    phases = F.filter(F.array(*[F.when((F.col("t") >= a) & (F.col("t") < b), F.lit(p)) for p, a, b in borders]), lambda p: p.isNotNull())
    return panel.withColumn("phase", F.explode(phases))


def phase_counts(panel: DataFrame, borders: list[tuple[str, int, int]]) -> DataFrame:
    return with_phase(panel, borders).groupBy("phase").agg(F.count_distinct("t").alias("n_steps"))


def trim(panel: DataFrame, n: int, tail: bool = False) -> DataFrame:
    """The first or last n steps, renumbered from 0."""
    if not tail:
        return panel.where(F.col("t") < n)
    last = panel.agg(F.max("t").alias("_last"))
    return panel.join(F.broadcast(last)).where(F.col("t") > F.col("_last") - n).select("series_id", (F.col("t") - (F.col("_last") - n + 1)).alias("t"), "value")


def shape_report(panel: DataFrame, n_series: int, n_steps: int) -> DataFrame:
    """One row: the shape found and whether it is the one expected."""
    found = panel.agg(F.count_distinct("series_id").alias("n_series"), (F.max("t") + 1).alias("n_steps"), F.count("*").alias("n_rows"))
    return found.withColumn("matches", (F.col("n_series") == n_series) & (F.col("n_steps") == n_steps) & (F.col("n_rows") == n_series * n_steps))


def of_shape(panel: DataFrame, n_series: int, n_steps: int) -> DataFrame:
    """The panel, if it has the shape expected; else an error that says what it has."""
    r = shape_report(panel, n_series, n_steps).first()  # one row
    if not r["matches"]:
        raise ValueError(f"expected {n_series} series of {n_steps} steps, found {r['n_series']} of {r['n_steps']} with {r['n_rows']} rows")
    return panel


def train_stats(panel: DataFrame, train_end: int) -> DataFrame:
    """mean, std (population; 1 for a constant series) and the largest magnitude of the train rows, per series."""
    x = F.when(F.col("t") < train_end, F.col("value"))
    raw = panel.groupBy("series_id").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("_std"), F.max(F.abs(x)).alias("train_max_abs"))
    return raw.select("series_id", "mean", F.when(F.col("_std") < CONSTANT, 1.0).otherwise(F.col("_std")).alias("std"), F.col("_std").alias("raw_std"), "train_max_abs")


def zscore(panel: DataFrame, train_end: int, eps: float | None = None) -> DataFrame:
    """Scale by train statistics. ``eps``: divide by std + eps instead of guarding constant series."""
    by = (F.col("value") - F.col("mean")) / (F.col("raw_std") + eps if eps else F.col("std"))
    stats = train_stats(panel, train_end).hint("shuffle_hash")  # a row a series: the panel need not be sorted to meet it
    return panel.join(stats, "series_id").select("series_id", "t", by.alias("value"))


def _capped(panel: DataFrame, train_end: int, factor: float) -> DataFrame:
    top = panel.groupBy("series_id").agg(F.max(F.when(F.col("t") < train_end, F.abs("value"))).alias("_top"))
    cap = F.col("_top") * factor
    return panel.join(top, "series_id").withColumn("_cap", F.when(cap < CONSTANT, F.lit(float("inf"))).otherwise(cap))


def clip_spikes(panel: DataFrame, train_end: int, factor: float) -> DataFrame:
    """Keep the sign and cap the magnitude at ``factor`` times the largest of the train rows."""
    return _capped(panel, train_end, factor).select("series_id", "t", (F.signum("value") * F.least(F.abs("value"), F.col("_cap"))).alias("value"))


def clip_report(panel: DataFrame, train_end: int, factor: float) -> DataFrame:
    over = F.abs("value") > F.col("_cap")
    return _capped(panel, train_end, factor).agg(F.count_if(over).alias("n_points"), F.count_distinct(F.when(over, F.col("series_id"))).alias("n_series"))


def burn_split(panel: DataFrame, n_train: int, gap: int) -> DataFrame:
    """train: t < n_train; test: t >= n_train + gap; the rows between are dropped."""
    part: Column = F.when(F.col("t") < n_train, "train").when(F.col("t") >= n_train + gap, "test")
    return panel.withColumn("part", part).where("part IS NOT NULL")


def range_conflict(z: DataFrame, train_end: int, test_start: int) -> DataFrame:
    """Per series: the largest value and magnitude and the 99th percentile of magnitude in train, and the largest magnitude in test."""
    train, test, m = F.col("t") < train_end, F.col("t") >= test_start, F.abs("value")
    tops = z.groupBy("series_id").agg(
        F.max(F.when(train, F.col("value"))).alias("train_max"),
        F.max(F.when(train, m)).alias("train_max_abs"),
        F.max(F.when(test, m)).alias("test_max_abs"),
    )
    p99 = exact_quantiles(z.where(train).select("series_id", m.alias("m")), "m", 0.99, ("series_id",))
    return tops.join(p99, "series_id", "left").select("series_id", "train_max", "train_max_abs", F.col("quantile").alias("train_p99_abs"), "test_max_abs")


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) with bins numbered from 1; 0 and bins + 1 take what lies outside."""
    return values.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


def fill_leading(panel: DataFrame) -> DataFrame:
    """Missing rows before the first value of a series take that value; others stay missing."""
    first = panel.where("value IS NOT NULL").groupBy("series_id").agg(F.min_by("value", "t").alias("_v"), F.min("t").alias("_t"))
    return panel.join(first, "series_id", "left").select("series_id", "t", F.when(F.col("t") < F.col("_t"), F.col("_v")).otherwise(F.col("value")).alias("value"))
