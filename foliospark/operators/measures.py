"""Measurements: aggregates of runs, cleaning, and files of fixed form."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.schemas import Measurement


def deviation(c: str) -> Column:
    """Sample standard deviation, 0 for one value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def aggregate_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Mean, deviation and number of runs(.., elapsed_seconds, memory_mb, cpu_percent, peak_rss_mb), and the highest peak."""
    return runs.groupBy(*keys).agg(
        F.avg("elapsed_seconds").alias("elapsed_seconds"), deviation("elapsed_seconds").alias("stdev_seconds"), F.count(F.lit(1)).alias("repetitions"),
        F.avg("memory_mb").alias("memory_mb"), F.avg("cpu_percent").alias("cpu_percent"), F.max("peak_rss_mb").alias("peak_rss_mb"),
    )


def duration_stats(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.count("seconds").alias("iterations"), F.avg("seconds").alias("mean_seconds"), deviation("seconds").alias("stdev_seconds"),
        F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"),
    )


def throughput(items: Column, seconds: Column, checked: bool = True) -> Column:
    """Items a second to four places; an error for no time or a negative count.

    Unchecked, as IEEE divides: no time at all gives an infinite rate of the zero's sign, a null gives null. It is
    rounded as the SQL's round_even rounds: ten thousand times the rate, worked out as a double, goes to the nearest
    integer. `bround` rounds the rate's decimal digits, which gives others near ties and above some 10^12.
    """
    if not checked:
        rate = F.when(seconds == 0, items * F.pow(seconds, F.lit(-1))).otherwise(F.try_divide(items, seconds))
        scaled = rate * 10_000.0
        return F.when(F.abs(scaled) == float("inf"), rate).otherwise(F.rint(scaled) / 10_000.0)
    good = (seconds > 0) & (items >= 0)
    return F.when(good, F.bround(items / seconds, 4)).otherwise(F.raise_error(F.lit("throughput needs seconds > 0 and items >= 0")).cast("double"))


def standardize(frame: DataFrame) -> DataFrame:
    names = [c.strip().lower() for c in frame.columns]
    return frame.toDF(*["test_name" if n == "function_name" else n for n in names])


def coerce_types(frame: DataFrame, schema: Measurement) -> DataFrame:
    """Numbers and timestamps by try-casts (bad values become null), text keys stripped."""
    out = frame
    for c in dict.fromkeys([*schema.required, *(k for k in schema.written if k in frame.columns)]):
        out = out.withColumn(c, F.expr(f"try_cast(trim(`{c}`) AS double)"))
    for k in schema.keys:
        if k not in schema.written:
            out = out.withColumn(k, F.trim(k))
    return out.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp").cast("string"))) if "timestamp" in frame.columns else out


def drop_invalid(frame: DataFrame, keys: Sequence[str], numbers: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    out = frame.dropna(subset=list(dict.fromkeys([*keys, *numbers])))
    for c in positive:
        out = out.where(F.col(c) > 0)
    return out


def keep_latest(frame: DataFrame, keys: Sequence[str], at: str, order: str) -> DataFrame:
    """Of each key the row with the latest time; a null time counts as the latest, then the later row wins.

    The greatest (time is null, time, place) is found while rows are read, so one row a key and task is shuffled.
    """
    place = F.struct(F.col(at).isNull(), F.col(at), F.col(order))
    rest = [c for c in frame.columns if c not in keys]
    best = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*frame.columns)


def clean(frame: DataFrame, language: str, metric: str, schema: Measurement) -> DataFrame:
    """One raw table, tagged and cleaned; ValueError where a column is missing. `row` numbers the raw rows."""
    table = standardize(frame)
    missing = [c for c in [*schema.keys, *schema.required, "timestamp"] if c not in table.columns]
    if missing:
        raise ValueError(f"{metric}: no column {', '.join(missing)}")
    if "row" not in table.columns:
        table = table.withColumn("row", F.monotonically_increasing_id())
    typed = coerce_types(table.withColumn("language", F.lit(language)).withColumn("metric", F.lit(metric)), schema)
    return keep_latest(drop_invalid(typed, schema.keys, schema.required, schema.positive), schema.keys, "timestamp", "row").drop("row")


def no_rows(spark: SparkSession, schema: Measurement) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*dict.fromkeys([*schema.keys, *schema.written]), "timestamp"]) + ", row long")


def read_csv(spark: SparkSession, path: str, schema: Measurement) -> DataFrame:
    """A table of text columns with `row`. One task reads a file in order.

    A file that is missing, unreadable or empty gives a warning and an empty table of the metric's columns.
    """
    try:
        frame = spark.read.csv(path, header=True, mode="PERMISSIVE")
    except AnalysisException as error:
        warnings.warn(f"{path} can't be read: {error.getCondition()}", stacklevel=2)
        return no_rows(spark, schema)
    if not frame.columns:
        warnings.warn(f"{path} is empty", stacklevel=2)
        return no_rows(spark, schema)
    return frame.withColumn("row", F.monotonically_increasing_id())


def fixed_decimals(number: Column, places: int) -> Column:
    """A number as text; inf, -inf and nan as C and Python write them, null stays null."""
    n = number.cast("double")
    odd = F.when(F.isnan(n), "nan").when(n == float("inf"), "inf").when(n == float("-inf"), "-inf")
    return F.when(n.isNotNull(), F.coalesce(odd, F.format_string(f"%.{places}f", n)))


def csv_text(frame: DataFrame, schema: Measurement) -> DataFrame:
    """Numbers with their fixed decimals as text, times in ISO form with six places."""
    text = [c if c not in schema.written else fixed_decimals(F.col(c), schema.written[c]).alias(c) for c in schema.columns]
    return frame.select(*text, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))


def union_metrics(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; a column that a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
