"""Error tables, resampling intervals and diagnostics.

Forecast tables are (series_id, t, r, yhat); ``errors`` joins the value that came true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.quantiles import exact_quantiles
from panelcast.sources.storage import stored

CHUNK = 1536


def errors(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """(series_id, t, r, err): forecast less value, an equi-join on the target step."""
    truth = panel.select("series_id", F.col("t").alias("target"), "value")
    due = forecasts.withColumn("target", F.col("t") + F.col("r"))
    return due.join(truth, ["series_id", "target"]).select("series_id", "t", "r", (F.col("yhat") - F.col("value")).alias("err"))


def _metrics():
    return F.avg(F.col("err") * F.col("err")).alias("mse"), F.avg(F.abs("err")).alias("mae"), F.count("*").alias("n")


def total_score(errs: DataFrame) -> DataFrame:
    return errs.agg(*_metrics())


def step_scores(errs: DataFrame) -> DataFrame:
    return errs.groupBy("r").agg(*_metrics())


def result_rows(errs: DataFrame, dataset: str, horizon: int, model: str, clip: float | None = None) -> DataFrame:
    """One result row with its by_step map r -> [mse, mae, n]."""
    per = step_scores(errs).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("r").cast("string"), F.array("mse", "mae", F.col("n").cast("double")))))).alias("by_step"))
    head = F.lit(dataset).alias("dataset"), F.lit(horizon).alias("pred_len"), F.lit(model).alias("model")
    return total_score(errs).join(F.broadcast(per)).select(*head, "mse", "mae", "n", "by_step", F.lit(clip).cast("double").alias("clip_spikes"))


def error_chunks(errs: DataFrame, first: int, length: int = CHUNK) -> DataFrame:
    """(chunk_id, r, sq, ab, n): sums over all series of ``length`` origins, numbered by step, then time."""
    sums = errs.groupBy("r", F.floor((F.col("t") - first) / length).alias("c")).agg(F.sum(F.col("err") * F.col("err")).alias("sq"), F.sum(F.abs("err")).alias("ab"), F.count("*").alias("n"))
    # One row a chunk: a numbering over the whole small table.
    return sums.select((F.row_number().over(Window.orderBy("r", "c")) - 1).cast("long").alias("chunk_id"), "r", "sq", "ab", "n")


def bootstrap(chunks: DataFrame, n_chunks: int, nboot: int = 200, block: int = 4, seed: int = 0) -> DataFrame:
    """One row: the errors over all chunks, and their standard errors and 5 % and 95 % points over block resamples of the chunks.

    Draw (rep, draw) starts at md5(seed|rep|draw) modulo the possible starts; a resample's statistic is a ratio of sums. With as many
    chunks as a block holds there is one resample only, which ``degenerate`` tells.
    """
    spark = chunks.sparkSession
    b = min(block, n_chunks)
    draws = -(-n_chunks // b)
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "draw")), 1, 8), 16, 10).cast("long") % (n_chunks - b + 1)
    grid = spark.range(nboot * draws).select(F.expr(f"id div {draws}").alias("rep"), (F.col("id") % draws).alias("draw"))
    picked = grid.select("rep", F.explode(F.sequence(start, start + (b - 1))).alias("chunk_id"))
    stats = picked.join(chunks, "chunk_id").groupBy("rep").agg((F.sum("sq") / F.sum("n")).alias("mse"), (F.sum("ab") / F.sum("n")).alias("mae"))
    out = []
    for m in ("mse", "mae"):
        out += [F.stddev_samp(m).alias(f"{m}_se"), F.percentile(m, 0.05).alias(f"{m}_p5"), F.percentile(m, 0.95).alias(f"{m}_p95")]
    whole = chunks.agg((F.sum("sq") / F.sum("n")).alias("mse"), (F.sum("ab") / F.sum("n")).alias("mae"))  # one row
    return stats.agg(*out).join(F.broadcast(whole)).withColumns({"nboot": F.lit(nboot), "block": F.lit(block), "nchunks": F.lit(n_chunks), "degenerate": F.lit(n_chunks <= block)})


def seed_summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def nmse(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Of (value, yhat): mean squared error over the variance of the values."""
    e = F.avg((F.col("value") - F.col("yhat")) ** 2) / F.greatest(F.var_pop("value"), F.lit(1e-12))
    return (pairs.groupBy(by) if by else pairs.groupBy()).agg(e.alias("nmse"))


def first_crossing(errs: DataFrame, sigma: DataFrame, dt: float, rate: float) -> DataFrame:
    """The first step whose RMSE over all outputs exceeds sigma (one row), and the horizon in units of 1 / rate; null if none does."""
    per = errs.groupBy("t").agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))
    return per.join(F.broadcast(sigma)).agg(F.min(F.when(F.col("rmse") > F.col("sigma"), F.col("t"))).alias("step")).withColumn("horizon", F.col("step") * dt * rate)


def persistence(panel: DataFrame, first: int, steps: int, horizon: int = 1) -> DataFrame:
    """x[t] as the forecast of all steps ahead."""
    rows = panel.where(F.col("t") >= first).select("series_id", "t", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("r"), F.col("value").alias("yhat"))
    return rows.where(F.col("t") + F.col("r") < steps)


def seasonal(panel: DataFrame, first: int, steps: int, cadence: int, horizon: int = 1) -> DataFrame:
    """The value one cadence before the target."""
    past = panel.select("series_id", (F.col("t") + cadence).alias("target"), F.col("value").alias("yhat"))
    due = persistence(panel, first, steps, horizon).select("series_id", "t", "r", (F.col("t") + F.col("r")).alias("target"))
    return due.join(past, ["series_id", "target"]).select("series_id", "t", "r", "yhat")


def outlier_energy(errs: DataFrame, share: float = 0.995) -> DataFrame:
    """The share of squared error, and of points, above a percentile, which is exact and found by counting."""
    se = stored(errs.select((F.col("err") * F.col("err")).alias("se")), "squares")
    cut = exact_quantiles(se, "se", share).select(F.col("quantile").alias("cut"))  # one row
    over = F.col("se") > F.col("cut")
    return se.join(F.broadcast(cut)).agg((F.sum(F.when(over, F.col("se")).otherwise(0.0)) / F.sum("se")).alias("energy"), (F.count_if(over) / F.count("*")).alias("points"))
