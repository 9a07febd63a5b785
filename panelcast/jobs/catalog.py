"""Registry of the forecasting queries: name -> (Spark job, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.jobs import full_jobs, model_jobs, panel_jobs, stream_jobs

ALL = {**panel_jobs.JOBS, **model_jobs.JOBS, **full_jobs.JOBS, **stream_jobs.JOBS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: job for k, (job, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in ALL.items() if text}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_jobs.JOBS["f2_step_scores"][0](spark, sf_dir)
