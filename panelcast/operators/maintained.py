"""Additive sums kept as a table: rows come and go, and a model is solved from what is there when it is wanted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.linear import added


class SumTable:
    """Sums per key of batches of rows, each batch under an id of its own: (keys, arrays, numbers), as ``gram`` or ``block_sums`` make them.

    A batch recorded again replaces itself, so that one that is run again after a failure counts once. Rows that go are retracted by recording their sums with a
    minus. ``compact`` adds up all batches into one row a key, in a new generation of the table beside the old; ids that went into it are
    remembered, and recording one of them again changes nothing. One writer at a time; readers see the newest whole generation.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("series_id", "r"), arrays: tuple[str, ...] = ("a", "b"), numbers: tuple[str, ...] = ("n",)):
        self.spark, self.path, self.keys, self.arrays, self.numbers = spark, path, keys, arrays, numbers

    def _ids(self) -> DataFrame | None:
        """(generation, id) of what the generations have taken in, or None if there is none yet."""
        try:
            return self.spark.read.schema("id string, generation int").parquet(f"{self.path}/taken")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def generation(self) -> int:
        ids = self._ids()
        return 0 if ids is None else ids.agg(F.max("generation")).first()[0]

    def record(self, sums: DataFrame, batch: str, retract: bool = False) -> None:
        """Take in the sums of a batch, or, with ``retract``, take them out."""
        ids = self._ids()
        if ids is not None and ids.where(F.col("id") == batch).limit(1).count():
            return
        turned = sums.select(*self.keys, *self.arrays, *self.numbers)
        if retract:
            turned = turned.withColumns({a: F.transform(a, lambda x: -x) for a in self.arrays} | {n: -F.col(n) for n in self.numbers})
        turned.write.mode("overwrite").parquet(f"{self.path}/sums/generation={self.generation()}/batch={batch}")

    def _parts(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/sums").parquet(f"{self.path}/sums/generation={self.generation()}").withColumn("batch", F.col("batch").cast("string"))

    def current(self) -> DataFrame:
        """One row a key: the sums over all that is there."""
        return added(self._parts(), self.keys, self.arrays, self.numbers)

    def compact(self) -> None:
        """Add up what is there into one batch of a new generation, which holds once its ids are written."""
        new, parts = self.generation() + 1, self._parts()
        self.current().write.mode("overwrite").parquet(f"{self.path}/sums/generation={new}/batch=base-{new}")
        ids = parts.where(~F.col("batch").startswith("base-")).select(F.col("batch").alias("id")).distinct().withColumn("generation", F.lit(new))
        ids.unionByName(self.spark.createDataFrame([(f"base-{new}", new)], "id string, generation int")).coalesce(1).write.mode("append").parquet(f"{self.path}/taken")
