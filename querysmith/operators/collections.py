"""Stored collections of texts with vectors: build, append, ensure, and search by their metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import question_skeleton
from ..sources import files, store
from . import nearest, profile, vectors

#: Entries of a file of a collection, cells of a part at most, and folders that a search names one by one.
BATCH, CENTRES, FOLDERS = 5000, 64, 4096
Embed = Callable[[Column], Column]


def cell_values(tables: dict[str, DataFrame], most: int | None = 500, longest: int | None = 500) -> DataFrame:
    """Distinct stripped values of all columns of any type in their text form, the `most` smallest of each
    column (None: all), of 1 to `longest` characters: table, column, value."""
    shown = {t: df.select(*(profile.shown(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)) for t, df in tables.items()}
    return profile.text_values(shown, most, longest)


def cells(tables: dict[str, DataFrame], embed: Embed, most: int | None = 500) -> DataFrame:
    """Entries for values: id, document (the value), table, column, v."""
    values = cell_values(tables, most)
    return values.select(F.md5(F.concat_ws("\u0001", "table", "column", "value")).alias("id"), F.col("value").alias("document"), "table", "column", embed(F.col("value")).alias("v"))


def examples(samples: DataFrame, embed: Embed) -> DataFrame:
    """Entries for examples: id, document (the question's skeleton), question, sql, db_id, v."""
    rows = samples.withColumn("document", question_skeleton(F.col("question")))
    return rows.select(F.md5(F.concat_ws("\u0001", "db_id", "question", "SQL")).alias("id"), "document", "question", F.col("SQL").alias("sql"), "db_id", embed(F.col("document")).alias("v"))


def append(entries: DataFrame, folder: str, batch: int = BATCH, by: str | None = None) -> None:
    """Add entries (id, v and others) to a stored collection as one commit; entries whose id is there stay as they are.

    The collection is an inverted list: entries lie in partition folders by `by` (a database, a table; as text) and
    by the cell of the nearest of the centres that the first entries gave, in files of at most `batch`. Entries
    without a usable vector have no direction and are left out.
    """
    spark = entries.sparkSession
    base = store.newest(spark, folder)
    if base is None:
        middle = nearest.sampled(entries, max(1, min(CENTRES, entries.count() // nearest.PER_CENTRE)))
        notes = {"centres": [x.tolist() for c in middle for x in c], "by": by}
    else:
        notes = base.notes
        middle = centres_of(notes)
        if notes["by"] != by:
            raise ValueError(f"the collection is kept by {notes['by']}")
    part = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = nearest.placed(entries.withColumn("v", F.col("v").cast("array<double>")), "id", "v", middle, every=False).withColumn("part", part)
    store.add(rows, folder, "id", partitions=("part", "cell"), per_file=batch, notes=notes)


def centres_of(notes: dict) -> list[np.ndarray]:
    found: dict[int, list] = {}
    for x in notes["centres"]:
        found.setdefault(len(x), []).append(np.array(x))
    return [np.stack(x) for x in found.values()]


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """A collection that was built and has entries, else None."""
    found = store.rows(spark, folder)
    return None if found is None or found.isEmpty() else found


def ensure(spark: SparkSession, folder: str, build: Callable[[], DataFrame | None], cache: dict[str, DataFrame] | None = None, by: str | None = None) -> DataFrame | None:
    """The collection at hand, else the stored one, else a new one from build; None where that gives nothing."""
    cache = {} if cache is None else cache
    if folder not in cache:
        found = stored(spark, folder)
        if found is None and (entries := build()) is not None:
            append(entries, folder, by=by)
            found = stored(spark, folder)
        if found is None:
            return None
        cache[folder] = found
    return cache[folder]


def hits(collection: DataFrame, queries: DataFrame, embed: Embed, k: int, same: str | None = None) -> DataFrame:
    """The k nearest entries of a frame for each query (qid, text and, where asked for, the column same): qid, id, distance, rank."""
    asked = queries.select("qid", embed(F.col("text")).alias("q"), *([same] if same else []))
    entries = collection.select("id", "v", *([same] if same else []))
    return vectors.top_k_or_any(entries, asked, k, same) if same else vectors.top_k(entries, asked, k)


@dataclass
class StoredSearch(nearest.Search):
    """A search that reads only the folders of the cells that are visited."""

    def entries_of(self, visits: DataFrame) -> DataFrame:
        wanted = visits.select("group", "cell").distinct()
        few = wanted.limit(FOLDERS + 1).collect()
        if len(few) > FOLDERS:  # Spark prunes folders by the joined keys while it runs
            on = [F.col("cell") == F.col("w_cell"), F.col("group") == F.col("w_group")]
            return self.entries.join(wanted.select(F.col("group").alias("w_group"), F.col("cell").alias("w_cell")), on, "left_semi").select("id", "v", "place")
        cells: dict[str, list[int]] = {}
        for r in few:
            cells.setdefault(r["group"], []).append(r["cell"])
        by: dict[tuple, list[str]] = {}
        for group, numbers in cells.items():
            by.setdefault(tuple(sorted(numbers)), []).append(group)
        chosen = [F.col("cell").isin(*numbers) & (F.col("part").isin(*groups) if self.grouped else F.lit(True)) for numbers, groups in by.items()]
        return self.entries.filter(reduce(lambda a, b: a | b, chosen, F.lit(False))).select("id", "v", "place")

    grouped: bool = False


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, same: bool = False, report: dict | None = None) -> DataFrame | None:
    """The k nearest entries of a stored collection for each query (qid, q and, with same, part): qid, id, distance, rank.

    With same, only entries of the query's part are hits. Radii and sizes of cells come from the angles alone (one
    narrow column); vectors are read from the folders of those cells that the query's bounds leave. See
    nearest.search for the method and for odd vectors. None where nothing is stored.
    """
    at = store.newest(spark, folder)
    found = store.rows(spark, folder, at)
    if found is None:
        return None
    middle = centres_of(at.notes)
    group = F.col("part") if same else F.lit("")
    place = F.xxhash64("group", "dim", "cell").alias("place")
    own = found.select("id", "v", "part", "cell", "angle", "dim", group.alias("group"))
    own = own.select("*", place)
    own, queries = nearest.same_kind(own, queries)
    asked = queries.filter("qid IS NOT NULL").select("qid", F.col("q").cast("array<double>").alias("v"), (F.coalesce(F.col("part").cast("string"), F.lit("")) if same else F.lit("")).alias("group"))
    cells = files.settled(nearest.cell_sizes(own).withColumn("blocks", F.ceil(F.col("size") / nearest.BLOCK)))
    return StoredSearch(own, asked.select("qid", "v"), cells, nearest.asking(asked, cells, middle), k, grouped=same).hits(report)
