"""Running queries that are stored as data: once each, beside each other, with time limits and a status."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import ERROR_KEY, result_key, same_results

#: Seconds for a query, and for a query of a candidate or a mutation; queries that run beside each other; stored queries of a page.
LIMIT, SHORT_LIMIT, WORKERS, PAGE = 30.0, 15.0, 8, 1000


@dataclass
class Outcome:
    """What became of a query: ok, error or timeout, what was asked of its result, and the error."""

    status: str
    value: object = None
    error: str = ""


def limited(spark: SparkSession, work: Callable[[], object], seconds: float | None = LIMIT) -> Outcome:
    """Run work, whose jobs are cancelled after the limit; the caller doesn't wait for stragglers.

    What a limit cuts off depends on the machine and the size of the tables; without one (None), results don't.
    """
    tag = f"limited-{uuid.uuid4().hex}"
    box: list[Outcome] = []

    def body() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            box.append(Outcome("ok", work()))
        except Exception as e:
            box.append(Outcome("error", error=str(e)))
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = threading.Thread(target=body, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        spark.sparkContext.cancelJobsWithTag(tag)
        return Outcome("timeout", error=f"no result after {seconds:g} s")
    return box[0]


def pages(df: DataFrame) -> Iterable[list]:
    """The rows of a frame of stored queries, PAGE at a time; only one partition is on the driver at once."""
    page = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) >= PAGE:
            yield page
            page = []
    if page:
        yield page


def gathered(spark: SparkSession, parts: Iterable[list[tuple]], schema: str) -> DataFrame:
    """Facts of all pages as one frame; each page leaves the driver as an Arrow batch."""
    frames = [spark.createDataFrame(p, schema) for p in parts if p]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def each(spark: SparkSession, queries: Iterable[str], ask: Callable[[DataFrame], object], seconds: float | None = LIMIT, workers: int = WORKERS) -> dict[str, Outcome]:
    """ask of each distinct query's result, by query. ask has to reduce the result in Spark (a count, a key)."""
    distinct = list(dict.fromkeys(queries))

    def one(sql: str) -> Outcome:
        return limited(spark, lambda: ask(spark.sql(sql.rstrip().rstrip(";"))), seconds)

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(distinct, pool.map(one, distinct), strict=True))


def validated(spark: SparkSession, samples: DataFrame, sql: str, key: str, seconds: float | None = LIMIT) -> DataFrame:
    """key, status, n_rows, error of each sample's query; queries, not data, reach the driver, a page at a time."""

    def one(page: list) -> list[tuple]:
        found = each(spark, (r[1] for r in page), lambda df: df.count(), seconds)
        return [(r[0], found[r[1]].status, found[r[1]].value or 0, found[r[1]].error[:500]) for r in page]

    kind = samples.schema[key].dataType.simpleString()
    return gathered(spark, map(one, pages(samples.select(key, sql))), f"{key} {kind}, status string, n_rows long, error string")


@dataclass
class Known:
    """What is known of a query's result: status, rows, result key, the error, and the result itself, kept on the executors."""

    status: str
    rows: int
    key: str
    error: str = ""
    frame: DataFrame | None = None


def fingerprints(spark: SparkSession, queries: Iterable[str], seconds: float | None = SHORT_LIMIT, keep: bool = False) -> dict[str, Known]:
    """Each distinct query's result key from one run of it. With keep, results stay persisted (memory, then
    disk; a lost part is computed again), so that later questions don't run the query anew; see forget."""

    def ask(df: DataFrame) -> tuple[str, DataFrame]:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df
        return result_key(kept), kept

    out = {}
    for sql, o in each(spark, queries, ask, seconds).items():
        if o.status == "ok":
            key, frame = o.value
            out[sql] = Known("ok", 0 if key.startswith("__") else int(key.split("-", 1)[0]), key, frame=frame if keep else None)
        else:
            out[sql] = Known(o.status, 0, ERROR_KEY, o.error[:500])
    return out


def forget(known: dict[str, Known]) -> None:
    for k in known.values():
        if k.frame is not None:
            k.frame.unpersist()


JUDGED = "idx int, pred_status string, gold_status string, n_rows long, correct boolean, error string"


def judged(spark: SparkSession, pairs: DataFrame, seconds: float | None = LIMIT, workers: int = WORKERS) -> DataFrame:
    """idx, pred_status, gold_status, n_rows, correct, error for pairs (idx, pred_sql, gold_sql).

    Distinct queries of a page run once for their key. A prediction is right only if both queries ran; equal
    keys are equal results, and only pairs with unequal keys are compared with the tolerance, on the kept
    results. A comparison that fails or runs out of time is not right, and its error says so.
    """

    def page_facts(page: list) -> list[tuple]:
        known = fingerprints(spark, [q for r in page for q in (r["pred_sql"], r["gold_sql"])], seconds, keep=True)

        def one(r) -> tuple:
            p, g = known[r["pred_sql"]], known[r["gold_sql"]]
            both = p.status == g.status == "ok"
            right, error = both and p.key == g.key, p.error or g.error
            if both and not right and p.rows == g.rows and p.rows:
                found = limited(spark, lambda: same_results(p.frame, g.frame, sizes=(p.rows, g.rows), unequal=True), seconds)
                right, error = found.status == "ok" and bool(found.value), found.error[:500]
            return (r["idx"], p.status, g.status, p.rows, bool(right), error)

        with ThreadPoolExecutor(workers) as pool:
            facts = list(pool.map(one, page))
        forget(known)
        return facts

    return gathered(spark, map(page_facts, pages(pairs.select("idx", "pred_sql", "gold_sql"))), JUDGED)


def previews(spark: SparkSession, queries: DataFrame, key: str, sql: str, rows: int = 3, seconds: float | None = SHORT_LIMIT) -> DataFrame:
    """key, status, total, preview, error: each result's number of rows and its first rows, as a JSON array of arrays of texts.

    A query runs once. Its own order counts where it has one at its end, else the first rows are the least ones.
    """

    def ask(df: DataFrame) -> tuple[int, str]:
        in_order = is_sorted(df)
        kept = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            total = kept.count()
            first = kept if in_order else kept.orderBy(*kept.columns)
            cells = first.limit(rows).select(F.array(*(F.col(c).cast("string") for c in kept.columns)).alias("r"))
            return total, json.dumps([r["r"] for r in cells.collect()], ensure_ascii=False)
        finally:
            kept.unpersist()

    def one(page: list) -> list[tuple]:
        found = each(spark, (r[1] for r in page), ask, seconds)
        return [(r[0], found[r[1]].status, *(found[r[1]].value or (0, "[]")), found[r[1]].error[:500]) for r in page]

    kind = queries.schema[key].dataType.simpleString()
    return gathered(spark, map(one, pages(queries.select(key, sql))), f"{key} {kind}, status string, total long, preview string, error string")


def is_sorted(df: DataFrame) -> bool:
    """Whether a query ends with an order of all its rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "GlobalLimit", "LocalLimit", "Offset") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "Sort"


def refine(spark: SparkSession, queries: DataFrame, key: str, sql: str, rounds: int = 3, fix: Callable | None = None, seconds: float | None = SHORT_LIMIT) -> DataFrame:
    """Queries after up to `rounds` rounds of repair of those that fail: key, sql, status, rounds.

    fix(sql column, error column) gives the next text; a repaired query counts only if it runs.
    """
    from ..functions.sql_text import repaired

    fix = fix or repaired
    kind = queries.schema[key].dataType.simpleString()

    def one(page: list) -> list[tuple]:
        done, waiting = [], [(r[0], r[1]) for r in page]
        for turn in range(rounds + 1):
            found = each(spark, (q for _, q in waiting), lambda df: df.limit(1).count(), seconds)
            done += [(k, q, "ok", turn) for k, q in waiting if found[q].status == "ok"]
            failed = [(k, q, found[q].error) for k, q in waiting if found[q].status != "ok"]
            if not failed or turn == rounds:
                done += [(k, q, found[q].status, turn) for k, q, _ in failed]
                break
            frame = spark.createDataFrame(failed, f"{key} {kind}, sql string, error string")
            waiting = [(r[0], r[1] or r[2]) for r in frame.select(key, fix(F.col("sql"), F.col("error")), "sql").collect()]
        return done

    return gathered(spark, map(one, pages(queries.select(key, sql))), f"{key} {kind}, sql string, status string, rounds int")


def mutated(spark: SparkSession, samples: DataFrame, key: str, sql: str, seconds: float | None = SHORT_LIMIT) -> DataFrame:
    """For each sample the first mutation (in a seeded order) that runs and gives another result: key, error_type, wrong_sql.

    One round for each place in the order; only samples that have none yet go on. Each query of a page runs once.
    """
    from ..functions.sql_text import MUTATIONS

    made = samples.select(key, F.col(sql).alias("gold"), *(f(F.col(sql)).alias(n) for n, f in MUTATIONS.items()))
    names = F.array(*map(F.lit, MUTATIONS))
    order = F.array_sort(F.transform(names, lambda n: F.struct(F.md5(F.concat(F.col(key).cast("string"), n)).alias("h"), n.alias("n"))))

    def one(page: list) -> list[tuple]:
        done, waiting = [], page
        known: dict[str, Known] = {}
        for place in range(len(MUTATIONS)):
            tries = [(r, r["order"][place], r[r["order"][place]]) for r in waiting if r[r["order"][place]]]
            known |= fingerprints(spark, [q for r, _, m in tries for q in (r["gold"], m) if q not in known], seconds)
            hit = {r[key]: (n, m) for r, n, m in tries if known[m].status == known[r["gold"]].status == "ok" and known[m].key != known[r["gold"]].key}
            done += [(k, n, m) for k, (n, m) in hit.items()]
            waiting = [r for r in waiting if r[key] not in hit]
            if not waiting:
                break
        return done

    kind = samples.schema[key].dataType.simpleString()
    rows = made.withColumn("order", F.transform(order, lambda s: s["n"]))
    return gathered(spark, map(one, pages(rows)), f"{key} {kind}, error_type string, wrong_sql string")
