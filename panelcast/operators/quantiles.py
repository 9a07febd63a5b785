"""Exact quantiles of columns of any size, by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.storage import stored

BINS, SMALL = 1024, 4096


def exact_quantiles(values: DataFrame, column: str, q: float, keys: tuple[str, ...] = (), bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(keys, quantile): what ``percentile`` gives, interpolated between neighbours, without a buffer of all values; nulls and NaN don't count.

    Each pass counts the values of every key's range in ``bins`` equal parts (tasks send one row a part: count, least and largest value) and goes on with the part that
    holds the rank, between its least and largest value, until a part has ``small`` values or one value only. Ranges split in two at least, so the passes
    end; ordinary data take two or three.
    """
    by = list(keys) or ["_all"]
    v = F.col(column).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(k) if keys else F.lit(0).alias(k) for k in by], v.alias("_v"))
    rows = stored(rows, "values")  # read once a pass
    place = F.lit(float(q)) * (F.col("_n") - 1)
    ranges = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    ranges = ranges.select(*by, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), F.floor(place).alias("_k"), (place - F.floor(place)).alias("_part"), F.lit(None).cast("double").alias("_above"))
    done, open_ = F.col("_lo") == F.col("_hi"), (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > small)
    ranges = stored(ranges, "ranges")
    while ranges.where(open_).limit(1).count():
        ranges = stored(ranges.where(~open_).unionByName(_narrowed(rows, ranges.where(open_), by, bins)), "ranges")
    few = rows.join(ranges.where(~done), by).where("_v BETWEEN _lo AND _hi").groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_s"))  # ``small`` values a key at most
    at = F.col("_k") - F.col("_below")
    whole = ranges.join(few, by, "left")
    here = F.when(done, F.col("_lo")).otherwise(F.get("_s", at.cast("int")))
    inside = F.when(done, F.col("_lo")).otherwise(F.get("_s", (at + 1).cast("int")))
    after = F.when(at + 1 < F.col("_inside"), inside).otherwise(F.coalesce("_above", here))
    return whole.select(*keys, (here + F.when(F.col("_part") > 0, (after - here) * F.col("_part")).otherwise(0.0)).alias("quantile"))


def _narrowed(rows: DataFrame, ranges: DataFrame, by: list[str], bins: int) -> DataFrame:
    """The part of each range that holds its rank, and the least value known above it."""
    span, off = F.col("_hi") - F.col("_lo"), F.col("_v") - F.col("_lo")
    wide = span == float("inf")
    share = F.when(wide, (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)).otherwise(off / span)
    inside = rows.join(ranges.select(*by, "_lo", "_hi"), by).where("_v BETWEEN _lo AND _hi").withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    parts = inside.groupBy(*by, "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
    w = Window.partitionBy(*by).orderBy("_bin")  # ``bins`` rows a key at most
    told = parts.select(*by, "_c", "_l", "_h", F.sum("_c").over(w).alias("_upto"), F.lead("_l").over(w).alias("_next"))
    hit = told.join(ranges, by).where((F.col("_k") >= F.col("_below") + F.col("_upto") - F.col("_c")) & (F.col("_k") < F.col("_below") + F.col("_upto")))
    return hit.select(*by, F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_inside"), "_k", "_part", F.coalesce("_next", "_above").alias("_above"))
