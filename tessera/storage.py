"""Session helpers and shared storage for intermediate tables.

Iterative operators cut their lineage by writing a table to the folder that
the cluster names in ``spark.checkpoint.dir`` and reading it back: the files
outlive any executor, keep column statistics and are read through Spark's own
readers, so the folder may be on any store Spark can reach. Files stay as long
as lazy results may read them; :func:`scratch_files` deletes those of a finished step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def build_session(app: str = "tessera", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the defaults this engine expects; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app).master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a URI without a trailing slash.

    It is ``spark.checkpoint.dir`` (or the directory set on the context). Only a
    local session in which neither is set gets a folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_on_context = sc._jsc.sc().getCheckpointDir()
        found = set_on_context.get() if set_on_context.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    for paths in _scopes.get()[-1:]:
        paths.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file anywhere Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch_files(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end all files that were written to the shared folder in between.

    What is read later has to be written elsewhere, or handed on with :func:`hand_on`.
    """
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield _scopes.get()[-1]
    finally:
        paths = _scopes.get()[-1]
        _scopes.reset(token)
        for path in paths:
            _delete(spark, path)


def hand_on(df: DataFrame) -> DataFrame:
    """Keep a materialised table beyond the innermost :func:`scratch_files`; the next one around it owns it."""
    scopes, path = _scopes.get(), getattr(df, "_tessera_path", None)
    if scopes and path in scopes[-1]:
        scopes[-1].remove(path)
        for paths in scopes[-2:-1]:
            paths.append(path)
    return df
