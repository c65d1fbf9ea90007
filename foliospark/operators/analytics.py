"""Comparison of languages: comparability, composite scores, spreads, storage flow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import labels

LEAST_POSITIVE = 2.2250738585072014e-308
CPU_FLOOR = 1.0
TIME_FLOOR = 5e-7


def multi_language_tests(frame: DataFrame, least: int = 2) -> DataFrame:
    """Rows of the tests that at least `least` languages measured."""
    tests = frame.groupBy("test_name").agg(F.countDistinct("language").alias("n")).where(F.col("n") >= least).select("test_name")
    return frame.join(tests, "test_name", "left_semi")


def shared_by_all(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key every language of the frame measured."""
    every = frame.agg(F.countDistinct("language").alias("every"))
    per = frame.groupBy(*keys).agg(F.countDistinct("language").alias("n"))
    good = per.crossJoin(F.broadcast(every)).where("n = every").select(*keys)  # one row
    return frame.join(good, list(keys), "left_semi")


def avg_rounds(frame: DataFrame, numbers: Sequence[str]) -> DataFrame:
    return frame.groupBy("language", "test_name").agg(*[F.avg(c).alias(c) for c in numbers])


def geo_mean(frame: DataFrame, column: str, name: str = "geo_mean", least: float = LEAST_POSITIVE) -> DataFrame:
    """Geometric mean of the values, raised to `least`; nulls do not count. With 0 for `least` a zero makes the mean 0."""
    raised = F.when(F.col(column).isNotNull(), F.greatest(F.col(column), F.lit(least)))
    log = F.when(raised == 0, F.lit(float("-inf"))).otherwise(F.ln(raised))
    return frame.groupBy("language").agg(F.exp(F.avg(log)).alias(name))


def mean_cpu(frame: DataFrame) -> DataFrame:
    return frame.groupBy("language").agg(F.greatest(F.avg("cpu_percent"), F.lit(CPU_FLOOR)).alias("mean_cpu"))


def clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def reliability(frame: DataFrame) -> DataFrame:
    rate = 1 - F.greatest(F.col("lost") + F.col("duplicated"), F.lit(0)) / F.col("total_books")
    return frame.groupBy("language").agg(F.avg(clipped(rate)).alias("reliability"))


def integrity(frame: DataFrame) -> DataFrame:
    done = F.col("processed_before_interruption") + F.col("processed_after_resume")
    return frame.withColumn("integrity_ok", (done == F.col("total_books")) & (F.col("duplicated") == 0) & (F.col("lost") == 0))


def recovery_verdict(frame: DataFrame) -> DataFrame:
    return integrity(frame).groupBy("language").agg(
        F.when(F.bool_and("integrity_ok"), "PASS").otherwise("FAIL").alias("verdict"), F.count(F.lit(1)).alias("scenarios"),
        F.sum("lost").alias("lost"), F.sum("duplicated").alias("duplicated"),
    )


def ratio_to_best(frame: DataFrame, column: str, higher: bool, name: str) -> DataFrame:
    """value / max or min / value over the whole (small) frame."""
    best = frame.agg((F.max if higher else F.min)(column).alias("_best"))
    score = F.col(column) / F.col("_best") if higher else F.col("_best") / F.col(column)
    return frame.crossJoin(F.broadcast(best)).withColumn(name, score).drop("_best")  # one row


def radar_table(throughput: DataFrame, statistics: DataFrame, scalability: DataFrame, recovery: DataFrame) -> DataFrame:
    """Raw values and scores of the languages that have all five."""
    spark = throughput.sparkSession
    parts = [
        geo_mean(shared_by_all(throughput, ["test_name"]), "items_per_second", "throughput"),
        geo_mean(shared_by_all(statistics, ["test_name"]), "mean_seconds", "latency"),
        mean_cpu(shared_by_all(scalability, ["test_name", "batch_size"])),
        reliability(recovery),
        spark.createDataFrame(list(labels.PRODUCTIVITY.items()), "language string, productivity double"),
    ]
    raw = reduce(lambda a, b: a.join(b, "language", "full"), parts).dropna()
    scored = ratio_to_best(raw, "throughput", True, "throughput_score")
    scored = ratio_to_best(scored, "latency", False, "latency_score")
    scored = ratio_to_best(scored, "mean_cpu", False, "cpu_score")
    return scored.withColumn("reliability_score", clipped(F.col("reliability"))).withColumn("productivity_score", clipped(F.col("productivity")))


def speed_spread(frame: DataFrame, size: str = "batch_size") -> DataFrame:
    """Per test: the largest size every language ran, the fastest and slowest language there, and their ratio."""
    langs = frame.groupBy("test_name").agg(F.countDistinct("language").alias("every"))
    cover = frame.groupBy("test_name", size).agg(F.countDistinct("language").alias("n")).join(langs, "test_name").where("n = every")
    top = cover.groupBy("test_name").agg(F.max(size).alias(size))
    key = lambda c: F.struct(c, "language")
    seen = frame.join(top, ["test_name", size]).groupBy("test_name", size)
    return seen.agg(
        F.min_by("language", key("elapsed_seconds")).alias("fastest"), F.max_by("language", F.struct("elapsed_seconds", "language")).alias("slowest"),
        (F.max("elapsed_seconds") / F.min("elapsed_seconds")).alias("ratio"),
    )


def peak_memory(frame: DataFrame, order: str) -> DataFrame:
    """Per test the row of the highest memory; the first of equal ones by `order`."""
    rest = [c for c in frame.columns if c != "test_name"]
    first = F.min_by(F.struct(*rest), F.struct((-F.col("memory_mb")).alias("m"), order)).alias("_row")
    return frame.where("memory_mb IS NOT NULL").groupBy("test_name").agg(first).select("test_name", *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*frame.columns)


def storage_flow(usage: DataFrame) -> DataFrame:
    """(language, source, target, size_mb): raw corpus to layouts, and each layout's share of each index.

    Languages need rows of both layers.
    """
    placed = usage.withColumn("c", labels.classify_path(F.col("path"))).select("language", "c.layer", "c.component", "size_mb")
    lake = placed.where("layer = 'Datalake'").select("language", F.col("component").alias("layout"), F.col("size_mb").alias("raw_mb"))
    index = placed.where("layer = 'Index'").select("language", F.col("component").alias("store"), F.col("size_mb").alias("index_mb"))
    both = lake.join(index.select("language").distinct(), "language", "left_semi")
    n = both.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    down = both.select("language", F.lit("Raw corpus").alias("source"), F.col("layout").alias("target"), F.col("raw_mb").alias("size_mb"))
    across = both.join(index, "language").join(n, "language").select("language", F.col("layout").alias("source"), F.col("store").alias("target"), (F.col("index_mb") / F.col("n")).alias("size_mb"))
    return down.unionByName(across)


def error_bounds(frame: DataFrame) -> DataFrame:
    mean = F.greatest(F.col("mean_seconds"), F.lit(TIME_FLOOR))
    low = F.greatest(F.col("mean_seconds") - F.col("stdev_seconds"), F.col("min_seconds"))
    return frame.withColumn("plotted_mean", mean).withColumn("lower_bound", F.least(F.greatest(low, F.lit(TIME_FLOOR)), mean)).withColumn("upper_bound", mean + F.col("stdev_seconds"))


def stage_winner(frame: DataFrame, column: str, lowest: bool) -> DataFrame:
    """Rows that are best in their test. The frame is worked out once: a mean that is summed again may differ in its last bit."""
    best = (F.min if lowest else F.max)(column).over(Window.partitionBy("test_name"))
    return frame.withColumn("_best", best).where(F.col(column) == F.col("_best")).select(*frame.columns)


def stage_means(frame: DataFrame, column: str, stages) -> DataFrame:
    return frame.withColumn("stage", labels.stage_of_test(F.col("test_name"), stages)).groupBy("stage", "language").agg(F.avg(column).alias(column))


def order_tests(frame: DataFrame) -> DataFrame:
    """(test_name, place): known tests in pipeline order, others by name behind them."""
    names = frame.select("test_name").distinct().withColumn("rank", labels.rank_in(F.col("test_name"), labels.TEST_ORDER))
    return names.withColumn("place", F.row_number().over(Window.orderBy("rank", "test_name"))).select("test_name", "place")  # few names


def consolidated(metrics: dict[str, DataFrame]) -> DataFrame:
    """All tables in one, by metric, language order, test and size."""
    from foliospark.operators.measures import union_metrics

    merged = union_metrics([f if "metric" in f.columns else f.withColumn("metric", F.lit(m)) for m, f in sorted(metrics.items())])
    sizes = [c for c in ("test_name", "batch_size") if c in merged.columns]
    return merged.orderBy("metric", labels.rank_in(F.col("language"), labels.LANGUAGE_ORDER), *sizes)
