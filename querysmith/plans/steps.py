"""The steps of the data pipeline, as functions of a configuration, and a runner that can start at any of them."""

from __future__ import annotations

import json
import os
import shutil
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect, schema_text, text
from ..functions.text import word_count
from ..operators import evaluate, lsh, profile, stats
from ..sources import catalog, files, store
from . import dataset, execute, predict, training

Config = dict


def check_setup(spark: SparkSession, config: Config) -> dict[str, bool]:
    """Which needs are met: packages, samples, databases, room on the disk, and an estimate of training time."""
    import importlib.util

    met = {f"package {p}": importlib.util.find_spec(p) is not None for p in ("pyspark", "pyarrow", "pandas", "numpy")}
    met["java"] = shutil.which("java") is not None or bool(os.environ.get("JAVA_HOME"))
    met["samples"] = bool(config.get("samples")) and bool(catalog.listed(spark, config["samples"]))
    met["databases"] = bool(config.get("root")) and bool(catalog.find_databases(spark, config["root"]))
    met["room"] = shutil.disk_usage(config.get("out", ".") if os.path.isdir(config.get("out", ".")) else ".").free > 10 << 30
    for name, good in met.items():
        print(f"{'ok  ' if good else 'MISS'} {name}")
    if memory := config.get("memory_gb"):
        print("training:", spark.range(1).select(stats.hours(F.lit(float(memory)), config.get("model", "14B"))).first()[0])
    return met


def enriched(spark: SparkSession, db_id: str, place: str, folder: str, describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Profile, describe (table, column, description from a model, cached), index text values and write a database's
    schema texts under folder/db_id; gives the described profile."""
    db = catalog.Database.at(spark, place)
    tables = {t: db.table(t) for t in db.names}
    rows = files.cached(spark, f"{folder}/profiles", db_id, place, lambda: profile.profiles(tables))
    if describe is not None:
        keyed = rows.withColumn("key", text.cache_key(F.lit(db_id), F.col("table"), F.col("column"), F.col("min"), F.col("max")))
        rows = store.answered(keyed, f"{folder}/descriptions", "key", describe).drop("key")
    else:
        rows = rows.withColumn("description", F.lit(""))
    columns = catalog.column_keys(db.columns(), db.foreign_keys()).join(rows.select("table", "column", "description"), ["table", "column"], "left")
    whole = schema_text.whole(schema_text.ddl(columns)).select(F.lit(db_id).alias("db_id"), "schema_text")
    files.checkpoint(lsh.index(profile.text_values(tables)), f"{folder}/{db_id}", "index")
    files.write_enrichment(rows.withColumn("db_id", F.lit(db_id)), f"{folder}/{db_id}/profile")
    files.checkpoint(whole, f"{folder}/{db_id}", "schema")
    return rows


def prepare_schemas(spark: SparkSession, config: Config, describe: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, str]:
    """Enrich all databases under root that have no schema yet; one that fails is named and the others go on."""
    done: dict[str, str] = {}
    for place in catalog.find_databases(spark, config["root"]):
        db_id = place.rsplit("/", 1)[-1]
        if files.resume(spark, f"{config['out']}/{db_id}", "schema") is not None:
            done[db_id] = "there"
            continue
        try:
            enriched(spark, db_id, place, config["out"], describe)
            done[db_id] = "made"
        except Exception as e:  # the next run tries it again
            done[db_id] = f"failed: {str(e)[:200]}"
    print(json.dumps(done))
    return done


def schemas(spark: SparkSession, folder: str) -> DataFrame | None:
    """db_id and schema_text of all enriched databases."""
    found = [p for p in catalog.listed(spark, folder) if files.resume(spark, p, "schema") is not None]
    return spark.read.parquet(*(f"{p}/schema" for p in found)) if found else None


def clean_data(spark: SparkSession, config: Config) -> DataFrame:
    db = catalog.Database.at(spark, config["root"]).register()
    samples = files.read_array(spark, config["samples"]).withColumn("idx", F.monotonically_increasing_id())
    schemas = {config["root"].rstrip("/").rsplit("/", 1)[-1]: dialect.schema_of(spark, db.names)} if config.get("dialect") == "sqlite" else None
    out = dataset.clean(samples, config["out"], schemas=schemas)
    stats.stage_statistics(out, "question", "SQL", "db_id").crossJoin(stats.stage_details(out)).show(truncate=False)  # one row each
    return out


def build_dataset(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    samples = spark.read.parquet(config["samples"])
    if "schema_text" not in samples.columns:
        known = schemas(spark, config["schemas"]) if config.get("schemas") else None
        samples = samples.withColumn("schema_text", F.lit("")) if known is None else samples.join(F.broadcast(known), "db_id", "left").fillna("", ["schema_text"])
    out = dataset.build(samples, config["out"])
    out["stats"].show(truncate=False)
    return out


def analyze_data(spark: SparkSession, config: Config) -> None:
    train, val = (files.read_lines(spark, f"{config['records']}/{s}", files.CHAT) for s in ("train", "val"))
    table = stats.analysis(train, val)
    turns = train.unionByName(val).withColumn("idx", F.monotonically_increasing_id()).select("idx", F.explode("messages").alias("m")).select("idx", "m.role", "m.content")
    lengths = stats.word_lengths(turns, "idx", "role", "content")
    files.write_lines(table, f"{config['out']}/analysis", single=True)
    files.write_lines(lengths, f"{config['out']}/lengths", single=True)
    table.show(50, truncate=False)
    print(turns.agg(F.sum(word_count(F.col("content"))).alias("words")).first()["words"], "words")


def train_sft(spark: SparkSession, config: Config) -> None:
    """The texts of a fine-tuning run; the run itself is up to an outside program."""
    records = training.chosen_records(files.read_lines(spark, config["records"], files.CHAT), config.get("tasks"), config.get("schema_types"))
    training.texts(records).write.mode("overwrite").json(f"{config['out']}/texts")


def train_rl(spark: SparkSession, config: Config) -> None:
    """The prompts of a reinforcement run; the run itself is up to an outside program."""
    chats = files.read_lines(spark, config["records"], files.CHAT) if config.get("records") else None
    raw = files.read_array(spark, config["samples"]) if config.get("samples") else None
    known = schemas(spark, config["schemas"]) if config.get("schemas") else None
    training.prompts(chats, raw, known).write.mode("overwrite").json(f"{config['out']}/prompts")


def predict_all(spark: SparkSession, config: Config, generators: list[predict.Generator] | None = None) -> DataFrame:
    """Predictions for questions (qid, question, db_id, evidence), as JSON lines, or for the samples at config['dev'].
    Without generators, replies are read from config['replies'] (qid, reply)."""
    catalog.Database.at(spark, config["root"]).register()
    if config.get("dev"):
        questions = files.dev_samples(spark, config["dev"]).select(F.col("idx").alias("qid"), "question", "db_id", "evidence")
    else:
        questions = spark.read.schema("qid long, question string, db_id string, evidence string").json(config["questions"])
    generators = generators or [lambda q: q.select("qid").join(spark.read.schema("qid long, reply string").json(config["replies"]), "qid")]
    made = predict.Predictor(spark, generators, schemas(spark, config["schemas"]) if config.get("schemas") else None, method=config.get("method", "tournament"))
    out = made.predict_batch(questions)
    files.write_lines(out, f"{config['out']}/predictions")
    print(json.dumps(made.timing))
    return out


def evaluate_all(spark: SparkSession, config: Config) -> str:
    """Judge pairs, and write the log of predictions, the results and the report under out. With dialect "sqlite" both
    queries of a pair run as Spark's rewriting of them, and the log shows that."""
    db = catalog.Database.at(spark, config["root"]).register()
    pairs = spark.read.schema("idx int, pred_sql string, gold_sql string, difficulty string, db_id string, question string").json(config["pairs"])
    if config.get("dialect") == "sqlite":
        for side in ("pred_sql", "gold_sql"):
            pairs = dialect.rewritten(pairs, side, {"": dialect.schema_of(spark, db.names)})
    facts = files.checkpoint(pairs.join(execute.judged(spark, pairs), "idx").withColumnRenamed("pred_status", "status"), config["out"], "facts")
    shown = execute.previews(spark, pairs.select(F.explode(F.array("pred_sql", "gold_sql")).alias("sql")).distinct().select(F.col("sql").alias("key"), "sql"), "key", "sql").drop("error").withColumnRenamed("key", "sql")
    samples = evaluate.per_sample(facts, shown)
    rows, errors = evaluate.accuracy(facts), evaluate.error_taxonomy(facts)
    files.write_lines(samples, f"{config['out']}/predictions")
    evaluate.results(rows, errors).coalesce(1).write.mode("overwrite").text(f"{config['out']}/eval_results")
    report = evaluate.report(rows.collect(), errors.collect(), evaluate.first_wrong(samples).collect())
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{config['out']}/report")
    print(report)
    return report


def outside(spark: SparkSession, config: Config) -> None:
    raise SystemExit("models are merged and served by outside programs; this engine prepares their data and judges their answers")


#: All steps in order, and those that a whole run takes.
STEPS: dict[str, Callable] = {
    "check-setup": check_setup, "prepare-schemas": prepare_schemas, "clean-data": clean_data, "build-dataset": build_dataset, "analyze-data": analyze_data, "train-sft": train_sft,
    "train-rl": train_rl, "merge-model": outside, "predict": predict_all, "evaluate": evaluate_all, "serve": outside,
}
WHOLE = ("check-setup", "prepare-schemas", "clean-data", "build-dataset", "analyze-data", "train-sft", "train-rl", "evaluate")


def run(spark: SparkSession, config: Config, skip_to: str | None = None, steps: tuple[str, ...] = WHOLE) -> list[tuple[str, float]]:
    """All steps from skip_to on, each with config[step] on top of the rest; a step that fails ends the run, and
    the message names it, so that the next run can start there. Gives the seconds of each."""
    if skip_to is not None and skip_to not in steps:
        raise ValueError(f"no step {skip_to}; steps: {', '.join(steps)}")
    took = []
    for name in steps[steps.index(skip_to) if skip_to else 0 :]:
        start = time.time()
        try:
            STEPS[name](spark, files.merged({k: v for k, v in config.items() if k not in STEPS}, config.get(name, {})))
        except Exception:
            print(f"step {name} failed; resume with --skip-to {name}", file=sys.stderr)
            raise
        took.append((name, round(time.time() - start, 1)))
        print(f"step {name}: {took[-1][1]} s")
    return took
