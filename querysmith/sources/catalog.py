"""Namespaces of Parquet tables: discovery, views, columns, declared keys, and resolution of ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that the Parquet files of the sales tables can't declare: table -> columns, and (table, column, table, column).
PRIMARY_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"]}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "BLOB"}
#: Folders under a root in which databases lie, in order of preference (fixed values); a database is a folder there,
#: or one of the same name inside that.
PLACES = ("train/train_databases/", "dev/dev_databases/", "train/", "dev/", "train_databases/", "dev_databases/", "databases/", "database/", "train/databases/", "dev/databases/", "")
LAYOUTS = tuple(f"{place}{inside}" for inside in ("{id}/{id}", "{id}") for place in PLACES)
COLUMNS = "table string, cid int, column string, type string, notnull boolean, default string, pk boolean"
LINKS = "from_table string, from_column string, to_table string, to_column string, place int"


@dataclass
class Database:
    """Tables of one folder by name, with declared keys."""

    spark: SparkSession
    root: str
    names: list[str]
    primary_keys: dict[str, list[str]] = field(default_factory=lambda: PRIMARY_KEYS)
    links: list[tuple[str, str, str, str]] = field(default_factory=lambda: FOREIGN_KEYS)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def at(cls, spark: SparkSession, root: str, names: list[str] | None = None, **keys) -> Database:
        """The tables <name>.parquet of a folder (all, or the named ones), sorted."""
        if names is None:
            names = sorted(p.rsplit("/", 1)[-1].removesuffix(".parquet") for p in listed(spark, root) if p.endswith(".parquet"))
        return cls(spark, root, names, **keys)

    @classmethod
    def of(cls, frames: dict[str, DataFrame], primary_keys: dict[str, list[str]], links: list[tuple[str, str, str, str]]) -> Database:
        """A database of frames at hand."""
        spark = next(iter(frames.values())).sparkSession
        return cls(spark, "", sorted(frames), primary_keys, links, dict(frames))

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.frames[name]

    def register(self) -> Database:
        """Temporary views of all tables, so stored queries can name them."""
        for name in self.names:
            self.table(name).createOrReplaceTempView(name)
        return self

    def columns(self) -> DataFrame:
        """A row for each column of each table."""
        rows = [
            (t, i, f.name, SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()), not f.nullable, f.metadata.get("default"), f.name in self.primary_keys.get(t, ()))
            for t in self.names
            for i, f in enumerate(self.table(t).schema.fields)
        ]
        return self.spark.createDataFrame(rows, COLUMNS)

    def foreign_keys(self) -> DataFrame:
        """Declared links in their order (place)."""
        return self.spark.createDataFrame([(*x, i) for i, x in enumerate(self.links) if x[0] in self.names], LINKS)


def listed(spark: SparkSession, root: str) -> list[str]:
    """Paths in a folder of any file system that Spark reads; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in files.listStatus(path)) if files.exists(path) else []


def find_databases(spark: SparkSession, root: str) -> list[str]:
    """Folders under a root that hold Parquet tables themselves, sorted."""
    found, waiting = [], [root]
    while waiting:
        at = waiting.pop()
        inside = listed(spark, at)
        if any(p.endswith(".parquet") for p in inside):
            found.append(at)
        else:
            waiting += [p for p in inside if "." not in p.rsplit("/", 1)[-1]]
    return sorted(found)


def resolve(spark: SparkSession, root: str, db_id: str, *more: str) -> str | None:
    """The first place of LAYOUTS under the roots that holds tables, else the first folder of that name anywhere."""
    for base in (root, *more):
        for layout in LAYOUTS:
            place = f"{base}/{layout.format(id=db_id)}"
            if any(p.endswith(".parquet") for p in listed(spark, place)):
                return place
    return next((p for p in find_databases(spark, root) if p.rsplit("/", 1)[-1] == db_id), None)


def column_keys(columns: DataFrame, links: DataFrame) -> DataFrame:
    """columns with key: FK->table.column by the first declared link, else PK, else empty."""
    first = links.groupBy("from_table", "from_column").agg(F.min(F.struct("place", "to_table", "to_column")).alias("to"))
    met = columns.join(F.broadcast(first), (F.col("table") == F.col("from_table")) & (F.col("column") == F.col("from_column")), "left")
    link = F.concat(F.lit("FK->"), F.col("to.to_table"), F.lit("."), F.col("to.to_column"))
    return met.withColumn("key", F.coalesce(link, F.when(F.col("pk"), "PK"), F.lit(""))).drop("from_table", "from_column", "to")


def orphans(db: Database) -> DataFrame:
    """For each declared link, rows with a partner and rows without (null references count as without)."""
    out = None
    for from_table, from_column, to_table, to_column in db.links:
        if from_table not in db.names or to_table not in db.names:
            continue
        left, right = db.table(from_table).select(F.col(from_column).alias("k")), db.table(to_table).select(F.col(to_column).alias("k"))
        name = f"{from_table}.{from_column}"
        met = left.join(right.withColumn("hit", F.lit(1)), "k", "left")
        row = met.agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("orphans")).select(F.lit(name).alias("link"), "matched", "orphans")
        out = row if out is None else out.unionByName(row)
    return out
