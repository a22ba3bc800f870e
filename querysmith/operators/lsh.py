"""Character MinHash of values: signatures, similarity, and exact look-up by an inverted index. All are built-in expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

#: Size of the hash family's field, hashes of a signature, characters of a shingle, seed (fixed values).
PRIME, HASHES, SHINGLE, SEED = (1 << 31) - 1, 100, 3, 42

#: Entries from which a posting is put off, and keys over which its entries are spread when it is needed after all.
CROWDED, SALTS = 4096, 64


def coefficients(n: int = HASHES) -> list[tuple[int, int]]:
    """(a, b) of h -> (a h + b) mod PRIME; all of a are drawn before all of b."""
    rng = random.Random(SEED)
    a = [rng.randint(1, PRIME - 1) for _ in range(n)]
    return list(zip(a, [rng.randint(0, PRIME - 1) for _ in range(n)], strict=True))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct character shingles of the lower-cased, trimmed text; a shorter text is one shingle."""
    t = F.lower(F.trim(text))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (size - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(size)))
    return F.array_distinct(F.when(F.length(t) < size, F.array(t)).otherwise(parts))


def shingle_hash(shingle: Column) -> Column:
    """The first 32 bits of MD5."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("bigint")


def signature(text: Column, hashes: int = HASHES) -> Column:
    """The least value of each hash function over the shingles."""
    hashed = F.transform(shingles(text), shingle_hash)
    family = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in coefficients(hashes)))
    return F.transform(family, lambda c: F.array_min(F.transform(hashed, lambda h: (c["a"] * h + c["b"]) % F.lit(PRIME))))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal places, to four digits."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.round(same / F.size(a), 4)


def index(values: DataFrame, value: str = "value", hashes: int = HASHES) -> DataFrame:
    """values with their signatures; each distinct value is hashed once."""
    once = values.select(value).distinct().withColumn("signature", signature(F.col(value), hashes))
    return values.join(once, value)


def postings(signed: DataFrame, key: str) -> DataFrame:
    """A row for each place of a signature: key, place, h."""
    return signed.select(key, F.posexplode("signature").alias("place", "h"))


def counted(entries: DataFrame, asked: DataFrame, salts: int = 1) -> DataFrame:
    """How many places of each query (qid, place, h) an entry shares: qid, value, n. With salts, a posting's entries
    are spread over so many keys, which its queries all visit."""
    theirs = postings(entries, "value")
    on = ["place", "h"]
    if salts > 1:
        theirs = theirs.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)))
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        on.append("salt")
    return theirs.join(asked, on).groupBy("qid", "value").agg(F.count(F.lit(1)).alias("n"))


def look_up(entries: DataFrame, queries: DataFrame, k: int = 5, crowded: int = CROWDED, salts: int = SALTS) -> DataFrame:
    """The k most similar entries of each query (ties: the smaller value): qid, value, similarity, rank.

    entries hold each value once; queries are (qid, signature). An inverted index of (place, least hash) finds, by
    equality, all entries that share a place with a query; their shared places are counted with partial sums. An
    entry that shares none has similarity 0, so only the least values can fill up a query's hits then.

    Postings of more than `crowded` entries are put off. An entry that is met in those alone shares at most as many
    places as the query has of them, and one met elsewhere at most so many more. So the entries that can still be
    among the k best are compared whole, and only queries whose k-th hit doesn't beat that bound go on to their
    crowded postings, which are spread over `salts` keys. Nothing is dropped: both ways give the same hits.
    """
    entries, queries = files.settled(entries.select("value", "signature")), files.settled(queries.select("qid", "signature"))  # hashed once
    asked = postings(queries, "qid")
    whole = queries.select("qid", F.size("signature").alias("places"))
    sizes = postings(entries, "value").join(asked.select("place", "h").distinct(), ["place", "h"], "left_semi").groupBy("place", "h").agg(F.count(F.lit(1)).alias("size"))
    many = sizes.filter(F.col("size") > crowded).select("place", "h")
    if many.isEmpty():
        return _best(counted(entries, asked), whole, entries, k)
    few = files.settled(counted(entries, asked.join(many, ["place", "h"], "left_anti")))
    put_off = files.settled(asked.join(many, ["place", "h"], "left_semi"))
    late = put_off.groupBy("qid").agg(F.count(F.lit(1)).alias("late"))
    order = Window.partitionBy("qid").orderBy(F.desc("n"))
    kth = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("qid").agg(F.when(F.count("r") == k, F.min("n")).alias("kth"))
    open_ = few.join(kth, "qid").join(late, "qid", "left").filter(F.col("n") + F.coalesce("late", F.lit(0)) >= F.coalesce("kth", F.lit(0)))
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    near = open_.join(entries.select("value", F.col("signature").alias("t")), "value").join(queries.select("qid", F.col("signature").alias("s")), "qid")
    exact = files.settled(near.select("qid", "value", same.cast("long").alias("n")))
    # Settled: the k-th hit shares more places than any entry that only crowded postings know.
    held = exact.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("qid", F.col("n").alias("kth"))
    done = late.join(held, "qid").filter(F.col("kth") > F.col("late")).select("qid")
    rest = put_off.join(done, "qid", "left_anti")
    more = few.join(rest.select("qid").distinct(), "qid", "left_semi").unionByName(counted(entries, rest, salts)).groupBy("qid", "value").agg(F.sum("n").alias("n"))
    return _best(exact.join(rest.select("qid").distinct(), "qid", "left_anti").unionByName(more), whole, entries, k)


def _best(shared: DataFrame, whole: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k best of counted entries, filled up by the least values (2 k of them are enough, as k can be hits)."""
    least = [r[0] for r in entries.select("value").filter("value IS NOT NULL").distinct().orderBy("value").limit(2 * k).collect()]
    fill = F.explode(F.array(*map(F.lit, least)).cast("array<string>")).alias("value")
    both = shared.unionByName(whole.filter("places > 0").select("qid", fill, F.lit(0).cast("long").alias("n"))).groupBy("qid", "value").agg(F.max("n").alias("n"))
    scored = both.join(whole, "qid").select("qid", "value", F.round(F.col("n") / F.col("places"), 4).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "value"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
