"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.staging import shared_dir, staged

__all__ = ["bucketed", "helpers", "shared_dir", "staged"]


def helpers(df: DataFrame) -> str:
    """A beginning of names that no column of ``df`` has, for columns that an operator adds for a while."""
    start = "__"
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``staged`` in buckets of ``key``, so that what groups by it later doesn't shuffle these rows again; an external table of the session's catalog."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", f"{shared_dir(spark)}/{table}")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    return spark.table(table)
