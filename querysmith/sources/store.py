"""Tables that grow by committed generations, so that runs beside each other add each key once.

A generation is a small manifest that lists the folders of rows it consists of. Rows are written first, into a folder
of their own; the manifest, under the next number, is written last and never over another. A reader takes the manifest
with the highest number. A writer whose number was taken meanwhile drops the keys that others have committed, and
tries the next number. Files that no manifest lists are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import listed


@dataclass(frozen=True)
class Generation:
    """What a manifest says: its number, the folders of rows, their schema (JSON), and notes of the table's owner."""

    number: int
    folders: tuple[str, ...]
    schema: str
    notes: dict | None = None


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def newest(spark: SparkSession, folder: str) -> Generation | None:
    """The last committed generation; None for a table that has none."""
    names = sorted(p for p in listed(spark, f"{folder}/manifests") if p.endswith(".json"))
    if not names:
        return None
    row = spark.read.text(names[-1], wholetext=True).first()
    known = json.loads(row[0])
    return Generation(known["number"], tuple(known["folders"]), known["schema"], known["notes"])


def _commit(spark: SparkSession, folder: str, made: Generation) -> bool:
    """Write the manifest under its number, unless another run has it already."""
    system, path = _path(spark, f"{folder}/manifests/{made.number:010d}.json")
    text = json.dumps({"number": made.number, "folders": made.folders, "schema": made.schema, "notes": made.notes})
    try:
        out = system.create(path, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def rows(spark: SparkSession, folder: str, at: Generation | None = None) -> DataFrame | None:
    """All rows of a generation (the newest one); partition folders keep the types of the schema."""
    at = at or newest(spark, folder)
    if at is None or not at.folders:
        return None
    schema = StructType.fromJson(json.loads(at.schema))
    found = spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(*(f"{folder}/{f}" for f in at.folders))
    return found.select(*schema.names)


def add(df: DataFrame, folder: str, key: str, partitions: tuple[str, ...] = (), per_file: int = 0, notes: dict | None = None, before: Callable[[], None] | None = None) -> Generation:
    """Commit the rows of df whose key is new (one for each key, null keys none); gives the generation that has them.

    Rows go to partition folders where asked for, in files of at most per_file rows. notes go to the first
    generation and stay. before runs just ahead of each commit (for tests).
    """
    spark = df.sparkSession
    base = newest(spark, folder)
    fresh = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    known = rows(spark, folder, base)
    if known is not None:
        fresh = fresh.join(known.select(key), key, "left_anti")
    written = ""
    while True:
        name = f"rows/commit=c{uuid.uuid4().hex}"
        shaped = fresh.select(*df.columns)
        if partitions:
            shaped = shaped.hint("rebalance", *partitions)
        writer = shaped.write.option("maxRecordsPerFile", per_file)
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{folder}/{name}")
        schema = StructType([*(f for f in df.schema.fields if f.name not in partitions), *(df.schema[p] for p in partitions)]).json()
        mine = Generation(1, (name,), schema, notes)
        if rows(spark, folder, mine).isEmpty():
            mine = replace(mine, folders=())
        if base is not None:
            if not mine.folders:
                return base
            mine = replace(mine, number=base.number + 1, folders=(*base.folders, name), schema=base.schema, notes=base.notes)
        if before is not None:
            before()
        if _commit(spark, folder, mine):
            return mine
        # Another run was first: keep what it hasn't committed, from the rows as they were written.
        if written:
            _drop(spark, f"{folder}/{written}")
        written = name
        taken = newest(spark, folder)
        others = [f for f in taken.folders if base is None or f not in base.folders]
        ours = rows(spark, folder, replace(mine, folders=(name,), schema=schema))
        fresh = ours.join(rows(spark, folder, replace(taken, folders=tuple(others))).select(key), key, "left_anti") if others else ours
        base = taken


def _drop(spark: SparkSession, name: str) -> None:
    system, path = _path(spark, name)
    system.delete(path, True)


def swept(spark: SparkSession, folder: str, older_seconds: float = 86_400.0) -> int:
    """Delete folders of rows that no manifest lists and that are older than a day (a run may still write younger
    ones); gives their number."""
    import time

    kept = {f for p in listed(spark, f"{folder}/manifests") for f in json.loads(spark.read.text(p, wholetext=True).first()[0])["folders"]}
    gone = 0
    for p in listed(spark, f"{folder}/rows"):
        system, path = _path(spark, p)
        if f"rows/{p.rsplit('/', 1)[-1]}" not in kept and system.getFileStatus(path).getModificationTime() / 1000 < time.time() - older_seconds:
            system.delete(path, True)
            gone += 1
    return gone


def answered(wanted: DataFrame, folder: str, key: str, answer: Callable[[DataFrame], DataFrame], before: Callable[[], None] | None = None) -> DataFrame:
    """wanted with the columns that answer adds: keys that are stored under folder are read, each other key is answered
    once, and the answers are committed.

    answer gets one row for each missing key (that of the least row) and keeps its key; rows with the same key share
    an answer; rows without a key or an answer are left out. Two runs may answer the same key at the same time; the
    first commit counts for both, so a key never has two answers.
    """
    spark = wanted.sparkSession
    known = rows(spark, folder)
    others = [c for c in wanted.columns if c != key]
    misses = wanted if known is None else wanted.join(known.select(key), key, "left_anti")
    one = misses.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("row")).select(key, "row.*") if others else misses.filter(F.col(key).isNotNull()).distinct()
    made = answer(one.select(*wanted.columns))
    new = made.select(key, *(c for c in made.columns if c not in wanted.columns))
    stored = rows(spark, folder, add(new, folder, key, before=before))
    return wanted.join(new.limit(0) if stored is None else stored, key)
