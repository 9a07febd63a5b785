"""Result rows against published cells.

Rows: (dataset, pred_len, model, mse, mae, n, clip_spikes, file). Cells: (dataset, method, h, mode, mse).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-9


def latest_rows(rows: DataFrame) -> DataFrame:
    """One row per key (clip factor included): those with a count first, then the last file."""
    w = Window.partitionBy("dataset", "pred_len", "model", F.coalesce("clip_spikes", F.lit(0.0))).orderBy(F.col("n").isNotNull().desc(), F.col("file").desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def untested(rows: DataFrame) -> DataFrame:
    return rows.where("n IS NULL OR n <= 0")


def corrected(row_clip: Column | None = None) -> Column:
    """Rows on clipped data are listed, not ranked."""
    return F.coalesce(F.col("clip_spikes") if row_clip is None else row_clip, F.lit(0.0)) > 0


def against_published(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Each of our rows with every published cell of its dataset and horizon; rows without any fall out."""
    theirs = cells.select("dataset", F.col("h").alias("pred_len"), "method", "mode", F.col("mse").alias("published"))
    return rows.join(theirs, ["dataset", "pred_len"])


def best_published(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dataset", "h").agg(F.min(F.struct("mse", "method", "mode")).alias("b")).select("dataset", "h", "b.method", "b.mode", "b.mse")


def beats(pairs: DataFrame) -> DataFrame:
    """Per row: published cells beaten (strictly), tied and in all."""
    d = F.col("mse") - F.col("published")
    tie = F.abs(d) < TIE
    return pairs.groupBy("dataset", "pred_len", "model").agg(F.count_if((d < 0) & ~tie).alias("beaten"), F.count_if(tie).alias("tied"), F.count("*").alias("total"))


def ranked(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rank of each of our rows, one at a time, among the published cells of its dataset and horizon."""
    below = F.count_if(F.col("published") < F.col("mse"))
    return against_published(rows, cells).groupBy("dataset", "pred_len", "model").agg((below + 1).alias("rank"), (F.count("*") + 1).alias("of"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") == 1).alias("n_first"), F.count_if(F.col("rank") == 2).alias("n_second"), F.count("*").alias("n"))


def best_model(rows: DataFrame, order: list[str]) -> DataFrame:
    """Our best model per dataset and horizon; of equal ones the first in ``order``."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return rows.where(F.col("model").isin(order)).groupBy("dataset", "pred_len").agg(F.min(F.struct("mse", place.alias("p"), "model")).alias("b")).select("dataset", "pred_len", "b.model", "b.mse")


def relative_difference(pairs: DataFrame) -> DataFrame:
    """Percent over each published cell, a column per mode."""
    p = pairs.withColumn("diff", (F.col("mse") - F.col("published")) / F.col("published") * 100)
    return p.groupBy("dataset", "pred_len", "model", "method").pivot("mode", ["batch", "dsof"]).agg(F.first("diff"))


def model_delta(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Percent change of the error from model a to b with the combined standard error. rows carry mse_se."""
    x = rows.where(F.col("model") == a).select("dataset", "pred_len", F.col("mse").alias("ma"), F.col("mse_se").alias("sa"))
    y = rows.where(F.col("model") == b).select("dataset", "pred_len", F.col("mse").alias("mb"), F.col("mse_se").alias("sb"))
    return x.join(y, ["dataset", "pred_len"]).select("dataset", "pred_len", ((F.col("mb") - F.col("ma")) / F.col("ma") * 100).alias("delta"), (F.sqrt(F.col("sa") ** 2 + F.col("sb") ** 2) / F.col("ma") * 100).alias("delta_se"))


def damping(rows: DataFrame) -> DataFrame:
    """Per model: error on raw and on clipped data and their ratio."""
    kind = F.when(corrected(), "clipped").otherwise("raw")
    p = rows.withColumn("kind", kind).groupBy("dataset", "pred_len", "model").pivot("kind", ["raw", "clipped"]).agg(F.first("mse"))
    return p.withColumn("ratio", F.col("raw") / F.col("clipped"))


def horizon_sweep(rows: DataFrame, pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per row: error, cells beaten and resampling interval, side by side."""
    own = rows.select("dataset", "pred_len", "model", "mse")
    return own.join(beats(pairs), ["dataset", "pred_len", "model"], "left").join(seeds.select("dataset", "pred_len", "model", "mse_p5", "mse_p95"), ["dataset", "pred_len", "model"], "left").select("dataset", "pred_len", "model", "mse", "beaten", "mse_p5", "mse_p95")


def whiskers(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distances from each row's error to its interval, floored at 0; the key has the clip factor."""
    s = seeds.select("dataset", "pred_len", "model", F.coalesce("clip_spikes", F.lit(0.0)).alias("_c"), "mse_p5", "mse_p95")
    r = rows.withColumn("_c", F.coalesce("clip_spikes", F.lit(0.0)))
    out = r.join(s, ["dataset", "pred_len", "model", "_c"], "left")
    return out.select("dataset", "pred_len", "model", F.col("_c").alias("clip"), F.greatest(F.col("mse") - F.col("mse_p5"), F.lit(0.0)).alias("down"), F.greatest(F.col("mse_p95") - F.col("mse"), F.lit(0.0)).alias("up"))


def mode_pairs(cells: DataFrame) -> DataFrame:
    """Per method: its batch and streamed error in one row."""
    return cells.groupBy("dataset", "h", "method").pivot("mode", ["batch", "dsof"]).agg(F.first("mse"))
