"""Helpers of the operators: tables in the cluster's shared folder, text columns as numpy bytes."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; larger ones go through Spark's shuffle joins.
BROADCAST_ROWS = 1_000_000
#: Bytes of text worked on at once; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 20
#: The same where many arrays of eight bytes for each byte are made: a worker keeps the memory of its largest ones.
WIDE_CHUNK_BYTES = 1 << 18
_OWN_FOLDER: list[str] = []
_SHIPPED: set[str] = set()
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship_package(spark: SparkSession) -> None:
    """Send this library's code to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="code-")) / package.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
        _SHIPPED.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset, a temporary one if Spark runs in this process only, else
    an error: executors elsewhere would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="stored-"))
    return _OWN_FOLDER[0]


#: Spark then deletes a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: lineage ends here, and columns are still pruned. The files that the
    write shuffled are deleted with it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `stored` returned, once whatever is made of them is stored itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """A side to be broadcast if its counted rows are few enough, else left to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def quoted(column: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def row_of(df: DataFrame) -> Column:
    """All columns of a row as one struct, which no column that an operator adds can clash with."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_chunks(
    texts: pa.Array, most: int = CHUNK_BYTES
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a string column without nulls, with their UTF-8 bytes and the offsets of each row in them."""
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield slice(start, end), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end
