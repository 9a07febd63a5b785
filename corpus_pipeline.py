"""The corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage works on all that its predecessor kept, and its decisions take effect: rejected documents go, later repeated
runs of lines leave the texts, one document of each near-duplicate class stays, documents that hold a benchmark item go, and what
is left is packed. All stages but the last return the columns of ``documents``, whatever their names and types.

A null or empty text fails the quality rules, so it goes there. Rows of one id and text are equal copies, of which near-dedup keeps one; a null id
sorts first, so its lines and its row stay. Texts of any length are treated whole. An empty table gives an empty result; an empty ``benchmark`` drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import decontaminate, lines, neardup, packing, quality
from panelcast.llm.common import table, written


#: A document of which line dedup would take more than this share of the words is a copy as a whole: it stays whole there, and near-dedup decides.
COPY_SHARE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated(docs, most=COPY_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express ICWS near-dedup or the packing search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every result but the last is written into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
