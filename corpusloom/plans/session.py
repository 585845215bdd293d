"""Session helpers: reading tables, and cutting lineage through shared storage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, which any Spark store may hold."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies beside the driver.

    On a cluster the package is installed or sent with ``--py-files``; a path that
    an executor does not have is simply an unused entry of its search path.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all of Spark runs on this machine, as in tests, a folder
    is made for it; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors, so later stages never recompute ``df``.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Scratch:
    """Paths of tables written within a ``scratch`` block."""

    paths: list[str] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame) -> DataFrame:
        """Marks a table, and all that it reads, as still needed after the block."""
        self.kept.append(df)
        return df


_scopes: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes at its end what was materialized within, but for what kept tables read."""
    own = Scratch()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        read = {f.rsplit("/", 1)[0] for df in own.kept for f in df.inputFiles()}
        needed = [p for p in own.paths if any(f.endswith(p.split(":", 1)[-1]) for f in read)]
        for path in own.paths:
            if path not in needed:
                drop_path(spark, path)
        if _scopes:
            _scopes[-1].paths += needed


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, time of the last change) of a file or folder, whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getContentSummary(at).getLength(), store.getFileStatus(at).getModificationTime()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
