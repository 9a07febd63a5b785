"""Dense panels (series_id, t, value) from fact rows: aggregate per series and step, fill the grid with zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.sources.storage import stored, table


def dense_panel(facts: DataFrame, step: str = "day") -> DataFrame:
    """From (series_id, at, amount) rows: the sum per series and step (to 4 decimals), 0 where there is none, with t counted from the first step of all.

    Only the sums are shuffled and sorted; each makes the empty steps since the one before where it is, and a last row a series those up to the end.
    """
    unit = F.date_trunc(step, F.col("at").cast("timestamp"))
    sums = stored(facts.groupBy("series_id", unit.alias("at")).agg(F.round(F.sum("amount"), 4).alias("value")), "sums")  # read three times below
    span = sums.agg(F.unix_micros(F.min("at")).alias("lo"), F.unix_micros(F.max("at")).alias("hi")).first()  # one row
    lo, hi = (F.timestamp_micros(F.lit(span[c]).cast("long")) for c in ("lo", "hi"))
    grid = sums.sparkSession.range(1).select(lo.alias("lo"), hi.alias("hi")).select(F.posexplode(F.expr(f"sequence(lo, hi, interval 1 {step})")).alias("t", "at"))  # a row a step
    n = grid.count()
    known = sums.where("series_id IS NOT NULL").join(F.broadcast(grid), "at").select("series_id", F.col("t").cast("long"), "value")
    ends = sums.select("series_id").distinct().select("series_id", F.lit(n).cast("long").alias("t"), F.lit(None).cast("double").alias("value"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy("series_id").orderBy("t")), F.lit(-1).cast("long"))
    last = F.least("at", F.lit(n - 1))
    rows = known.unionByName(ends).select("series_id", F.col("t").alias("at"), "value", before.alias("before")).where(F.col("before") < last)
    filled = rows.select("series_id", "at", "value", F.explode(F.sequence(F.col("before") + 1, last)).alias("t"))
    return filled.select("series_id", "t", F.when(F.col("t") == F.col("at"), F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("value"))


def nation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per supplier nation and day."""
    l, s, n = (table(spark, sf_dir, x) for x in ("lineitem", "supplier", "nation"))
    rows = l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return dense_panel(rows.select(F.col("n_name").alias("series_id"), F.col("l_shipdate").alias("at"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount")))


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed value per event type and hour."""
    e = table(spark, sf_dir, "events")
    return dense_panel(e.select(F.col("event_type").alias("series_id"), F.col("ts").alias("at"), F.col("value").alias("amount")), "hour")


def supplier_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per supplier and week: many series."""
    l = table(spark, sf_dir, "lineitem")
    return dense_panel(l.select(F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").alias("at"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount")), "week")


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per supplier and day: many long series."""
    l = table(spark, sf_dir, "lineitem")
    return dense_panel(l.select(F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").alias("at"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount")))


def steps(panel: DataFrame) -> int:
    """The number of steps T; panels are dense, so it is the last t plus one."""
    return (panel.agg(F.max("t")).first()[0] or -1) + 1


def with_halo(panel: DataFrame, chunk: int, lookback: int) -> DataFrame:
    """Deal a panel into time chunks (series_id, chunk, t, value, halo): the last ``lookback - 1`` rows of a chunk are copied into the next as its halo."""
    c = F.floor(F.col("t") / chunk)
    in_tail: Column = F.pmod(F.col("t"), F.lit(chunk)) >= chunk - (lookback - 1)
    copies = F.when(in_tail, F.array(F.struct(c.alias("chunk"), F.lit(False).alias("halo")), F.struct((c + 1).alias("chunk"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(c.alias("chunk"), F.lit(False).alias("halo"))))
    return panel.select("series_id", "t", "value", F.explode(copies).alias("c")).select("series_id", "c.chunk", "t", "value", "c.halo")
