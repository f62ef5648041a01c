"""Helpers that the training-data operators share: lineage cuts, Arrow passes, tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a
    session on a local master (one machine, as in tests) gets a folder of its own; any other is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brightloom-"))
        folder = context.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's file systems close."""
    path = f"{shared_folder(spark).rstrip('/')}/brightloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


_scopes: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are cut inside, for ``release`` once what reads them is written."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not paths]  # equal lists are other scopes


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete cut tables and forget their paths."""
    while paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: lineage ends there, so a lost
    executor costs no more than the tasks after it."""
    path = new_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added to those that ``df`` has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Code points of a piece of ``chunked``.
CHUNK = 4096


def chunked(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, from which ``between`` reads places far into it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from place ``start`` (from 0), in time of the length, wherever they stand."""
    first = F.floor(start / CHUNK)
    few = F.concat_ws("", F.slice(chunks, (first + 1).cast("int"), (F.floor((start + length - 1) / CHUNK) - first + 1).cast("int")))
    return F.when(length > 0, F.substr(few, (start - first * CHUNK + 1).cast("int"), length.cast("int"))).otherwise(F.lit(""))


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings have about ``limit`` bytes, or one longer row; a task
    then holds the words of so much text at once, whatever Spark puts into a batch."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_pass(df: DataFrame, schema: str, rows: Callable[[list[list]], dict]) -> DataFrame:
    """Run ``rows`` on the columns (as Python lists) of slices of each batch; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = rows([part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)
