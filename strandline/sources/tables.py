"""Chunk and vector tables, stored by project: a project's rows are one folder, so filters on it read that folder only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandline.streaming.jobs import shared_path


def write_projects(df: DataFrame, path: str) -> None:
    """Write a table by project. Rows are dealt by project first; adaptive execution splits what is too large for a task."""
    df.hint("rebalance", "project_id").write.partitionBy("project_id").mode("overwrite").parquet(path)


def replace_projects(df: DataFrame, path: str) -> None:
    """Replace the folders of the projects that df has; all others stay. The folder is the unit that is committed."""
    df.hint("rebalance", "project_id").write.partitionBy("project_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
