"""Readers and writers of sample files, stage checkpoints, caches and configurations."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import listed

SAMPLE = "question string, SQL string, db_id string, evidence string, difficulty string"
CHAT = "messages array<struct<role:string,content:string>>, task_type string, schema_type string, error_type string, db_id string"


def read_array(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """A JSON file that is one array of objects; anything else raises."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)).first()
    if head is None or head[0] != "[":
        raise ValueError(f"{path} is not a JSON array")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """A JSON object a line; blank lines are skipped, a bad line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str, out: str = "idx") -> DataFrame:
    """idx (from 0) and value of the lines that aren't blank, in the order of the files' names and of their lines.

    Files are split for reading, and any task may read any split. A line's place within its split, the split's
    place in its file and the counts of all splits before add up to its number: only a row for each split is
    put in order, never the lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"))
    full = lines.filter(F.trim("value") != "")
    within = Window.partitionBy("file", "at").orderBy("place")
    local = settled(full.withColumn("nth", F.row_number().over(within)).select("value", "file", "at", "nth"))
    splits = local.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    ahead = splits.select("file", "at", (F.sum("n").over(Window.orderBy("file", "at")) - F.col("n")).alias("ahead"))
    return local.join(ahead, ["file", "at"]).select((F.col("ahead") + F.col("nth") - 1).alias(out), "value")


def read_numbered(spark: SparkSession, path: str, schema: str = SAMPLE, out: str = "idx") -> DataFrame:
    """JSON objects of lines with their number; a line that is no object has nulls."""
    return numbered_lines(spark, path, out).select(out, F.from_json("value", schema).alias("o")).select(out, "o.*")


def write_lines(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; single: one part file, for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def sql_column(df: DataFrame) -> DataFrame:
    """A sample's query under the name SQL, whichever of SQL, sql and query it came as."""
    given = [c for c in df.columns if c.lower() in ("sql", "query")]
    if given == ["SQL"]:
        return df
    return df.select(*(c for c in df.columns if c not in given), F.coalesce(*map(F.col, given)).alias("SQL"))


def usable(samples: DataFrame) -> DataFrame:
    """Samples whose question, SQL and db_id are present and not empty."""
    need = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("question", "SQL", "db_id")]
    return samples.filter(need[0] & need[1] & need[2])


def load_samples(train: DataFrame, dev: DataFrame | None, databases: DataFrame, most: int | None = None) -> DataFrame:
    """Usable samples of both sets whose database exists; the first `most` by idx if asked for."""
    both = train if dev is None else train.unionByName(dev, allowMissingColumns=True)
    known = usable(both).join(databases.select("db_id"), "db_id", "left_semi")
    return known if most is None else known.orderBy("idx").limit(most)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path with anything in it."""
    return next((p for p in paths if listed(spark, p)), None)


def dev_samples(spark: SparkSession, place: str, schema: str = SAMPLE) -> DataFrame:
    """Samples with their place in the file (idx) of the first of place/dev.json, place/questions.json and place itself
    that is there."""
    found = first_existing(spark, [f"{place}/dev.json", f"{place}/questions.json", place])
    if found is None:
        raise FileNotFoundError(f"no dev samples at {place}")
    raw = spark.read.text(found, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("idx", "o"))
    return raw.select(F.col("idx").cast("long"), "o.*")


def first_filled(frames: list[Callable[[], DataFrame]]) -> DataFrame | None:
    """The first frame that can be read and has a row."""
    for make in frames:
        try:
            df = make()
            if not df.isEmpty():
                return df
        except Exception as e:  # a stage that was never written
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    return None


def first_examples(spark: SparkSession, folder: str, raw: str | None = None, stages: tuple[str, ...] = ("semantic", "executed", "loaded")) -> DataFrame | None:
    """question, SQL, db_id, evidence, stripped and not empty, of the first stage under folder with such a row,
    else of JSON-lines files there, else of the raw array file; None where none has any."""

    def tidy(df: DataFrame) -> DataFrame:
        df = sql_column(df)
        note = F.col("evidence") if "evidence" in df.columns else F.lit("")
        return usable(df.select(*(F.trim(F.col(c).cast("string")).alias(c) for c in ("question", "SQL", "db_id")), F.coalesce(note, F.lit("")).alias("evidence")))

    places = [lambda s=s: tidy(spark.read.parquet(f"{folder}/{s}")) for s in stages]
    places.append(lambda: tidy(spark.read.json(f"{folder}/*.jsonl")))
    if raw:
        places.append(lambda: tidy(read_array(spark, raw)))
    return first_filled(places)


def newest(spark: SparkSession, folder: str) -> str | None:
    """The path in a folder that was changed last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().toString()) for s in system.listStatus(path)] if system.exists(path) else []
    return max(found)[1] if found else None


def total_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files under a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(path).getLength() if system.exists(path) else 0


def cached(spark: SparkSession, folder: str, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result stored under a key of its source's files (paths, sizes, times), made anew when they change."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks, files = [], system.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        marks.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    stage = f"{name}-{hashlib.sha256(repr(sorted(marks)).encode()).hexdigest()[:16]}"
    found = resume(spark, folder, stage)
    return checkpoint(make(), folder, stage) if found is None else found


def checkpoint(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Write a stage's rows and read them back: lineage ends here, and a later run can resume."""
    path = f"{folder}/{stage}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resume(spark: SparkSession, folder: str, stage: str) -> DataFrame | None:
    """A stage's rows if it was finished and can be read, else None, so that it is made again."""
    path = f"{folder}/{stage}"
    if not any(p.endswith("/_SUCCESS") for p in listed(spark, path)):
        return None
    try:
        return spark.read.parquet(path)
    except Exception as e:  # footers that can't be read
        if "CANNOT_READ_FILE_FOOTER" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "is not a Parquet file" in str(e):
            return None
        raise


def split_cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose answer is cached, with it, and rows that are still to be made."""
    return wanted.join(cache, keys), wanted.join(cache, keys, "left_anti")


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Column descriptions, wrapped in enrichments or bare: table, column, description."""
    kind = "map<string,map<string,struct<description:string>>>"
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"enrichments {kind}")["enrichments"]
    tables = raw.select(F.coalesce(wrapped, F.from_json("value", kind)).alias("m")).select(F.explode("m").alias("table", "columns"))
    return tables.select("table", F.explode("columns").alias("column", "d")).select("table", "column", "d.description")


def write_enrichment(profile: DataFrame, path: str) -> None:
    """table, column, description and statistics as one JSON object a database."""
    profile.write.mode("overwrite").partitionBy("db_id").json(path)


def merged(base: dict, over: dict) -> dict:
    """Nested configuration with over on top of base."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def config(path: str, preset: str | None = None) -> dict:
    """A JSON or YAML configuration file with a preset on top."""
    import json

    def load(p: str) -> dict:
        with open(p) as f:
            text = f.read()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text) or {}

    return merged(load(path), load(preset)) if preset else load(path)


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


_settled: list[tuple[SparkSession, str]] = []


def passing_folder(spark: SparkSession, name: str = "stage") -> str:
    """A new folder where all executors see it (spark.checkpoint.dir), which goes when the driver ends. Only a local
    master may leave that setting out."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"{tempfile.gettempdir()}/checkpoints-{spark.sparkContext.applicationId}"
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    _settled.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """df written to a passing folder and read back: one evaluation, and lineage ends there."""
    path = passing_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _settled:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the JVM may already be gone
            return
