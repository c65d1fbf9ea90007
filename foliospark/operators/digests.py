"""Order-free digests of key ranges: two tables are compared by their digests, and rows only where those differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 4096  # leaves of the tree of ranges


def row_hash(*columns: str | Column) -> Column:
    """48 bits of the MD5 of the columns' text; a null is told from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\t", *parts)), 1, 12), 16, 10).cast("long")


def stored_hash(*columns: str) -> Column:
    """48 bits of the columns' hash as they are stored, arrays and bytes too; quicker than by their text."""
    return F.xxhash64(*columns).bitwiseAND((1 << 48) - 1)


def range_digests(rows: DataFrame, place: Column, *columns: str, hashed: Callable[..., Column] = row_hash) -> DataFrame:
    """(place, n, total, mixed) of each range: how many rows, and the sum and exclusive or of their hashes of 48 bits.

    A partial aggregate: what is shuffled is a row for each task and range, whatever the order of the rows.
    """
    rows = rows.select(place.alias("place"), hashed(*columns).alias("h"))
    halves = (F.sum(F.shiftright("h", 24)).alias("high"), F.sum(F.col("h").bitwiseAND(0xFFFFFF)).alias("low"))  # sums of longs; 2^39 rows don't overflow them
    found = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), *halves, F.bit_xor("h").alias("mixed"))
    total = F.col("high").cast("decimal(20,0)") * F.lit(1 << 24).cast("decimal(10,0)") + F.col("low").cast("decimal(20,0)")
    return found.select("place", "n", total.cast("decimal(38,0)").alias("total"), "mixed")


def rolled_up(digests: DataFrame, fan: int) -> DataFrame:
    """The next level of the tree: digests of `fan` neighbouring ranges as one."""
    above = digests.withColumn("place", F.floor(F.col("place") / fan))
    return above.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed"))


def unequal_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(place) of the ranges whose digests differ, or which one side lacks."""
    a = left.select("place", F.struct("n", F.col("total").cast("decimal(38,0)"), "mixed").alias("a"))
    b = right.select("place", F.struct("n", F.col("total").cast("decimal(38,0)"), "mixed").alias("b"))
    return a.join(b, "place", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("place")


def in_unequal_ranges(left: DataFrame, right: DataFrame, place: Column, *columns: str, hashed: Callable[..., Column] = row_hash) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the ranges that differ; RANGES numbers at most go through the driver."""
    apart = unequal_ranges(range_digests(left, place, *columns, hashed=hashed), range_digests(right, place, *columns, hashed=hashed))
    wanted = [r["place"] for r in apart.limit(RANGES + 1).collect()]
    if len(wanted) >= RANGES:
        return left, right
    return left.where(place.isin(wanted)), right.where(place.isin(wanted))


def difference(left: DataFrame, right: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, columns, side) of the distinct rows that one table has and the other lacks; side is left or right.

    Ranges are hashes of the key, so a frequent key is one range; equal ranges are read and not shuffled.
    """
    place = F.pmod(F.xxhash64(key), F.lit(RANGES))
    a, b = in_unequal_ranges(left.select(key, *columns), right.select(key, *columns), place, key, *columns)
    every = [key, *columns]
    marked = a.distinct().withColumn("side", F.lit(1)).unionByName(b.distinct().withColumn("side", F.lit(2)))
    sides = marked.groupBy(*every).agg(F.sum("side").alias("s"))
    return sides.where("s < 3").select(*every, F.when(F.col("s") == 1, "left").otherwise("right").alias("side"))


def first_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(line, left, right) of the first unequal row of two stored tables of (line, value): sets.first_difference
    without a shuffle of the lines that lie in equal ranges. Ranges are runs of lines from the lowest to the highest."""
    from foliospark.operators import sets

    ends = left.select("line").unionByName(right.select("line")).agg(F.min("line"), F.max("line")).first()
    if ends[0] is None:
        return sets.first_difference(left, right)
    width = max(1, -(-(ends[1] - ends[0] + 1) // RANGES))
    place = F.floor((F.col("line") - ends[0]) / width)
    apart = unequal_ranges(range_digests(left, place, "line", "value"), range_digests(right, place, "line", "value"))
    first = apart.agg(F.min("place")).first()[0]
    here = place == (F.lit(-1) if first is None else F.lit(first))
    return sets.first_difference(left.where(here), right.where(here))
