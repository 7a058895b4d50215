"""Reading input tables, and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one.

    The fallback is local to this machine, is kept in the session's own configuration object, so that one session
    uses one folder, and goes when the program ends.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("spark.docloom.scratch", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = f"file://{folder}"
        spark.conf.set("spark.docloom.scratch", own)
    return own


class _Made(threading.local):
    """Paths of tables that written() made, by scratch(): the innermost last; the first list is the program's."""

    def __init__(self) -> None:
        self.scopes: list[list[tuple[SparkSession, str]]] = [[]]


_made = _Made()


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and readable after executors are lost.

    It goes with the scratch() around, or, if keep, with the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom/{label}-{uuid.uuid4().hex}"
    _made.scopes[max(0, len(_made.scopes) - 1 - keep)].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written within are deleted at the end, but for those written with keep."""
    _made.scopes.append([])
    try:
        yield
    finally:
        for spark, path in _made.scopes.pop():
            _delete(spark, path)


def clear() -> None:
    """Deletes all tables written so far and not yet deleted. DataFrames that operators returned can't be read any more
    then, so a long-lived session calls this when it has stored its results."""
    done, _made.scopes[0] = _made.scopes[0], []
    for spark, path in done:
        _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the session may be gone by then
        clear()


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by written(); of another, nothing."""
    spark = df.sparkSession
    read = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for scope in _made.scopes:
        for entry in [e for e in scope if any(f.endswith(e[1].rsplit("/", 1)[1]) for f in read)]:
            scope.remove(entry)
            _delete(spark, entry[1])


#: Bytes of text handed to Python code at a time, so that many long texts don't meet in memory.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts with about SLICE_BYTES of its text and binary columns, of one row at least."""
    sizes = None
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = n if sizes is None else sizes + n
    if sizes is None or sizes.sum() <= SLICE_BYTES:
        yield batch
        return
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Hands memory that Python and Arrow have freed back to the machine; a worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow of a function from one record batch to one; no state between batches, so tasks can be run again.

    after: called once at the end of each task, to give back memory that the worker would keep for later stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch):
                    yield function(part)
        if after:
            after()
        give_back()

    return df.mapInArrow(run, schema)
