"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a session on one machine (tests) gets a new one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-panelcast-")
    return _fallback[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelcast/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty), under fixed names; further columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def per_text(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], fields: str, more: tuple[str, ...] = (), inputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """Map every text, Arrow batch by batch: ``make()`` runs once a task and gives the function from the
    batch's texts (of several ``inputs``: a list of each) to the new columns named in ``fields``. ``doc_id`` (and ``more``) pass through as they are, nulls included."""
    import pyarrow as pa

    keep = ["doc_id", *more]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out_schema = f"{head}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            given = [b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]
            got = f(given[0] if len(given) == 1 else given)
            cols = {c: b.column(b.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(cols | {k: v if isinstance(v, pa.Array) else pa.array(v, type=types.get(k)) for k, v in got.items()})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = {f.split()[0] for f in re.split(r",\s*(?![^<]*>)", fields)}
    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(out_schema)) if f.name in names}
    return docs.mapInArrow(run, out_schema)
