"""Shared parts of the training-data operators: tables, lineage cuts, ranks, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Bytes of text that one slice of an Arrow batch aims to hold.
SLICE_BYTES = 8 << 20
#: What separates words: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a join by plain shuffle may hold at most, and the share of all rows from which a key counts as hot.
PLAIN_ROWS, HOT_SHARE = 4096, 1000

#: What was written and is still there: session, path, and the table's name where it has one.
Made = tuple[SparkSession, str, str]
_made: list[Made] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master, whose executors share the driver's disk, may leave
    it unset; then it is a temporary folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints-{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: one evaluation, lineage cut, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path, ""))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df as a table in buckets of key in the shared folder, so that later joins by key don't move its rows."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _made.append((spark, path, name))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


@atexit.register
def _clean() -> None:
    for entry in _made:
        try:
            _drop(entry)
        except Exception:  # the JVM may already be gone
            return


def _drop(entry: Made) -> None:
    spark, path, name = entry
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(df: DataFrame) -> None:
    """Delete the table behind a settled frame that nothing will read again."""
    files = df.inputFiles()[:1]
    release([x for x in _made if any(x[1].rsplit("/", 1)[-1] in f for f in files)])


def release(entries: list[Made]) -> None:
    for entry in entries:
        if entry in _made:
            _made.remove(entry)
            _drop(entry)


@contextmanager
def scope() -> Iterator[list[Made]]:
    """Lists the tables that are made inside, so that they can be released when their reader is done."""
    before, made = list(_made), []
    yield made
    made += [x for x in _made if x not in before]


def release_all_but(made: list[Made], *kept: DataFrame) -> None:
    """Release the tables of a scope but those that the kept frames read directly."""
    files = [f for df in kept for f in df.inputFiles()]
    release([x for x in made if not any(x[1].rsplit("/", 1)[-1] in f for f in files)])


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner", plain: int = PLAIN_ROWS) -> DataFrame:
    """Join (inner or left) of many rows a key with one row a key, where one key may hold a third of the left side.

    Keys with more than rows / HOT_SHARE of the left rows are fewer than HOT_SHARE, so their right rows are
    broadcast and their left rows stay where they are; all other keys go by shuffle. rows: those of left.
    Both sides are read more than once; null keys meet nothing.
    """
    if rows <= plain:
        return left.join(right, key, how)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(1, rows // HOT_SHARE)).filter(F.col(key).isNotNull()).select(key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    crowd = left.join(F.broadcast(hot), key, "left_semi") if how == "left" else left
    return crowd.join(F.broadcast(few), key, how).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def hash60(*parts: Column) -> Column:
    """60 bits of MD5 over the parts (null: the word null) as a long; plain SQL can repeat it."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about so many bytes of the column (one row at least)."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < len(lengths):
            yield batch.slice(start)


def give_back() -> None:
    """Hand memory that an earlier operator has freed in this worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(f, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
