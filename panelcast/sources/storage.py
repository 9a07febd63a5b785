"""Tables and scratch folders of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_kept: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a session on one machine (tests) gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-panelcast-")
        base = _fallback[app]
    return f"{base}/panelcast/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored table that the session's jobs share, made at first use from the tables in ``sf_dir``; made anew once any file there is another, or has been written again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    now = fingerprint(spark, sf_dir)
    if _kept.get(key, (None,))[0] != now:
        _kept[key] = now, stored(make(), "kept")
    return _kept[key][1]


def fingerprint(spark: SparkSession, folder: str) -> tuple:
    """Path, size and time of every file under a folder, asked of the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
