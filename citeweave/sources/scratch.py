"""Materialised intermediate tables in the cluster's shared checkpoint folder.

A table written here cuts lineage and survives lost executors: every task
rereads whole Parquet files from storage that all of them see.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = os.path.join(tempfile.gettempdir(), "checkpoints", f"citeweave-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the reread table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path  # noqa: SLF001  lets discard() drop superseded tables
    return table


def once(rows: DataFrame, key: str, shape: Callable[[DataFrame], DataFrame], name: str, how: str = "inner", values: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns that ``shape`` gives their distinct ``key`` values; rows whose value it drops go, unless ``how`` is left.

    A value that many rows share is worked out once. The table of values is
    written first, so its measured size decides how the join is done. ``values``
    are the distinct ones if there is a cheaper way to them.
    """
    known = materialize(shape(rows.select(key).distinct() if values is None else values), name)
    return rows.join(known, key, how).select(*[rows[c] for c in rows.columns], *[known[c] for c in known.columns if c != key])


def discard(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    path = getattr(table, "_scratch_path", None)
    if path:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
