"""Reading and writing series files, result rows and published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources.storage import stored

RESULTS = "dataset string, pred_len int, model string, mse double, mae double, n long, by_step map<string, array<double>>, clip_spikes double"
CELLS = "map<string, map<string, map<string, struct<batch: double, dsof: double>>>>"


def read_timed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header: the first column is a timestamp and goes, the rest are doubles; t is the row's place. One file, as its row order is the time axis."""
    schema = T.StructType([T.StructField("at", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in columns])
    return indexed(spark.read.csv(path, header=True, schema=schema).drop("at"))


def read_numeric_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: only the columns that read as numbers are kept."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return indexed(df.select([F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, T.NumericType)]))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Headerless text, plain or gzip; comma separated if the line has a comma, else by white space. Columns c000, c001, ..."""
    line = F.trim("value")
    parts = F.when(line.contains(","), F.split(line, r"\s*,\s*")).otherwise(F.split(line, r"\s+"))
    rows = indexed(spark.read.text(path).where(line != "").select(F.transform(parts, lambda x: x.cast("double")).alias("v")))
    return rows.select("t", F.posexplode("v").alias("i", "value")).select(F.format_string("c%03d", "i").alias("series_id"), "t", "value")


def indexed(df: DataFrame) -> DataFrame:
    """Add t, the 0-based place of each row in file order, without gathering rows: an offset per partition (two numbers each come to the driver) plus the place in it."""
    tagged = stored(df.withColumn("_id", F.monotonically_increasing_id()), "tagged")  # written, so that both reads below see the same places
    part = F.shiftright("_id", 33)
    starts, n = {}, 0
    for p, c in sorted(tuple(r) for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        starts[p], n = n, n + c
    rows = df.sparkSession.createDataFrame(list(starts.items()), "_p long, _start long")
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn("_p", part).join(F.broadcast(rows), "_p").withColumn("t", F.col("_start") + local).drop("_p", "_id", "_start")


def to_long(wide: DataFrame) -> DataFrame:
    """(t, c0, c1, ...) -> (series_id, t, value)."""
    return wide.unpivot(["t"], [c for c in wide.columns if c != "t"], "series_id", "value").select("series_id", "t", "value")


def to_wide(panel: DataFrame, series: list[str]) -> DataFrame:
    """(series_id, t, value) -> (t, one column a series)."""
    return panel.groupBy("t").pivot("series_id", series).agg(F.first("value"))


def write_results(rows: DataFrame, path: str, wrapped: bool = False) -> None:
    """Result rows as JSON: a line per row, or one object {"rows": [...]}, for a table of a leaderboard's size."""
    if wrapped:
        rows.agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).coalesce(1).write.json(path)
    else:
        rows.write.json(path)


def read_results(spark: SparkSession, plain: str | list[str], wrapped: str | list[str] | None = None) -> DataFrame:
    """Result rows of both layouts in one table, each with ``origin``, the file it was read from."""
    origin = F.col("_metadata.file_path").alias("origin")
    a = spark.read.json(plain, schema=RESULTS).select("*", origin)
    if wrapped is None:
        return a
    row = a.drop("origin").schema.simpleString().removeprefix("struct")
    b = spark.read.json(wrapped, schema=f"rows array<struct{row}>").select(F.explode("rows").alias("r"), origin).select("r.*", "origin")
    return a.unionByName(b, allowMissingColumns=True)


def folder_of(origin: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.regexp_extract(origin, r"([^/]+)/[^/]+$", 1)


def flatten_published(df: DataFrame, column: str = "json") -> DataFrame:
    """A column of nested JSON dataset -> method -> horizon -> {batch, dsof} as cells (dataset, method, h, mode, mse)."""
    d = df.select(F.explode(F.from_json(column, CELLS)).alias("dataset", "m")).select("dataset", F.explode("m").alias("method", "hs"))
    h = d.select("dataset", "method", F.explode("hs").alias("h", "c"))
    return h.select("dataset", "method", F.col("h").cast("int").alias("h"), F.expr("stack(2, 'batch', c.batch, 'dsof', c.dsof) AS (mode, mse)")).where("mse IS NOT NULL")
