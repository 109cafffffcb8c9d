"""Shared storage for intermediate tables and binary files.

Everything lands below the folder that the session names in ``spark.checkpoint.dir``, which the driver
and all executors see. Only a session on one machine may leave it unset; it gets ``/tmp/checkpoints``.
"""

from __future__ import annotations

import os
import re
import uuid
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """Root of the shared folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return (named or "/tmp/checkpoints").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{base_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


#: Tables written and not dropped yet, the latest last, by thread, so that pipelines side by side keep apart.
_kept: dict[int, list[str]] = {}


def _tables() -> list[str]:
    return _kept.setdefault(get_ident(), [])


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _tables().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> frozenset[str]:
    """The tables that this thread wrote so far, for ``release``."""
    return frozenset(_tables())


def release(spark: SparkSession, before: frozenset[str]) -> None:
    """Delete the tables of this thread but for those of ``before`` and the last; what was made of the others must be written by then."""
    tables = _tables()
    for p in [p for p in tables[:-1] if p not in before]:
        remove(spark, p)
        tables.remove(p)


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``save`` that nothing will read again."""
    if df is None:
        return
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/lodestone/" in f:
            remove(spark, f)
            _tables()[:] = [p for p in _tables() if os.path.basename(p) != os.path.basename(f)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _filesystem(path: str):
    """A pyarrow filesystem and the path inside it; plain paths and file: URIs are local (shared) files."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, chunks) -> int:
    """Write byte chunks to ``path`` on shared storage: a temporary name, then a rename, so retries are safe."""
    filesystem, name = _filesystem(path)
    filesystem.create_dir(os.path.dirname(name), recursive=True)
    part, size = f"{name}.{uuid.uuid4().hex}.tmp", 0
    with filesystem.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    filesystem.move(part, name)
    return size


def open_bytes(path: str):
    """Random-access reader for a file on shared storage."""
    filesystem, name = _filesystem(path)
    return filesystem.open_input_file(name)
