"""Running a stream over what its source holds now, with its progress in the shared folder.

Every run takes the folder of an earlier one to go on from: what was read, the state and what was put out are all there, so a stream that was stopped, or that
lost its driver, continues with the next rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelcast.sources.storage import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started in here keep their state in RocksDB, beside the heap, as keyed processors with timers must; a restart needs the same."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """New Parquet files under ``path`` as a stream, oldest first, ``files`` of them a micro-batch if given. A path to one file is read as its folder would be."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    folder, _, name = path.rpartition("/")
    if name.endswith(".parquet") and folder and is_file(spark, path):
        return reader.option("pathGlobFilter", "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in name)).parquet(folder)
    return reader.parquet(path)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether the path names one file, asked of the file system it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).isFile()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, over the micro-batches whose progress the query still has."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_appended(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run an append-mode stream to the end of what is there; its whole output so far as a table. ``folder``: where to go on, or to begin, instead of a new one."""
    out, _ = append(stream, name, folder)
    return out


def append(stream: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """``run_appended`` that also gives the ended query."""
    spark = stream.sparkSession
    out = folder or shared_path(spark, name)
    with state_on_disk(spark):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def run_partials(stream: DataFrame, summed, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream whose every micro-batch leaves the few rows ``summed(batch)``; a batch that is run again after a failure replaces its own rows."""
    spark = stream.sparkSession
    out = folder or shared_path(spark, name)

    def leave(batch: DataFrame, n: int) -> None:
        summed(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    with state_on_disk(spark):
        stream.writeStream.foreachBatch(leave).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def run_versions(stream: DataFrame, start: DataFrame, step, name: str, folder: str | None = None) -> DataFrame:
    """Carry a small table over a stream: each micro-batch makes the next version, ``step(version, batch)``, exactly once.

    Version k + 1 is what batch k made of version k. A batch that is run again finds its version stored (a finished write leaves ``_SUCCESS``) and changes nothing; an
    unfinished one is written over. All versions stay, with their number as the column ``version``; ``start`` is version 0.
    """
    spark = stream.sparkSession
    out = folder or shared_path(spark, name)
    stored = lambda k: f"{out}/version={k}"

    def there(k: int) -> bool:
        try:
            spark.read.format("binaryFile").load(f"{stored(k)}/_SUCCESS").schema  # noqa: B018
            return True
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    if not there(0):
        start.write.mode("overwrite").parquet(stored(0))

    def leave(batch: DataFrame, n: int) -> None:
        if not there(n + 1):
            step(spark.read.parquet(stored(n)), batch).write.mode("overwrite").parquet(stored(n + 1))

    stream.writeStream.foreachBatch(leave).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def run_sums(stream: DataFrame, summed, sums, name: str, folder: str | None = None) -> DataFrame:
    """Record what ``summed(batch)`` gives for each micro-batch in a ``maintained.SumTable``, each once under its number, and give the sums of all that is there."""
    progress = f"{folder or shared_path(stream.sparkSession, name)}-progress"
    query = stream.writeStream.foreachBatch(lambda batch, n: sums.record(summed(batch), f"stream-{n}")).option("checkpointLocation", progress)
    query.trigger(availableNow=True).start().awaitTermination()
    return sums.current()


def latest(versions: DataFrame) -> DataFrame:
    """The rows of the newest version."""
    newest = versions.agg(F.max("version").alias("_v")).first()["_v"]
    return versions.where(F.col("version") == newest).drop("version")
