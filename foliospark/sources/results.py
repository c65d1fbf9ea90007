"""A tree of measurement files, <root>/<language>/<metric>.csv: finding, reading, appending, exporting."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import labels
from foliospark.operators import analytics, measures
from foliospark.schemas import METRICS, Measurement
from foliospark.sources.atomic import write_text

#: Columns of the consolidated table that are whole numbers.
WHOLE = ("batch_size", "base_size", "repetitions", "iterations", "item_count", "file_count", "dir_count", "total_books", "processed_before_interruption", "processed_after_resume", "duplicated", "lost")


def language_folders(root: str) -> list[str]:
    """The known languages, in their order, that have a folder with a measurement file."""
    have = set(os.listdir(root)) if os.path.isdir(root) else set()
    return [x for x in labels.LANGUAGE_ORDER if x in have and any(n.endswith(".csv") for n in os.listdir(f"{root}/{x}"))]


def metric_files(root: str, language: str) -> dict[str, str]:
    """Path by metric of a language's core tables; files of other names are reported and left alone."""
    names = sorted(n[:-4] for n in os.listdir(f"{root}/{language}") if n.endswith(".csv"))
    for other in (n for n in names if n not in METRICS):
        warnings.warn(f"{language}/{other}.csv is no core table and is ignored", stacklevel=2)
    return {n: f"{root}/{language}/{n}.csv" for n in names if n in METRICS}


def read_tree(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """By metric the cleaned rows of all languages; a metric that no language has is an empty table."""
    found: dict[str, list[DataFrame]] = {m: [] for m in METRICS}
    for language in language_folders(root):
        for metric, path in metric_files(root, language).items():
            found[metric].append(measures.clean(measures.read_csv(spark, path, METRICS[metric]), language, metric, METRICS[metric]))
    empty = lambda m: measures.clean(measures.no_rows(spark, METRICS[m]), "", m, METRICS[m])
    return {m: measures.union_metrics(parts) if parts else empty(m) for m, parts in found.items()}


def append_rows(frame: DataFrame, schema: Measurement, path: str) -> None:
    """Appends a few rows to one CSV file, with its header once; a file appears with its header or not at all.

    Measurements are a handful of rows, so they are written by the driver.
    """
    text = measures.csv_text(frame, schema)
    if not os.path.exists(path) or not os.path.getsize(path):
        write_text(path, ",".join(text.columns) + "\r\n")
    line = F.to_csv(F.struct(*text.columns), {"emptyValue": "", "nullValue": ""})
    with open(path, "a", encoding="utf-8", newline="") as out:
        out.writelines(f"{r[0]}\r\n" for r in text.select(line).toLocalIterator())
        out.flush()
        os.fsync(out.fileno())


def write_consolidated(metrics: dict[str, DataFrame], path: str) -> None:
    """All tables in one CSV file in the order of `consolidated`; whole numbers stay whole."""
    table = analytics.consolidated(metrics)
    table = table.select(*[F.col(c).cast("long").alias(c) if c in WHOLE else F.col(c) for c in table.columns])
    line = F.to_csv(F.struct(*table.columns), {"emptyValue": "", "nullValue": ""})
    write_text(path, [",".join(table.columns) + "\r\n", *(f"{r[0]}\r\n" for r in table.select(line).toLocalIterator())])


def six_digits(value: float) -> str:
    return f"{value:.6g}"


def write_radar(table: DataFrame, path: str) -> None:
    """The composite scores, one language a line in the known order, numbers with six significant digits."""
    rows = table.orderBy(labels.rank_in(F.col("language"), labels.LANGUAGE_ORDER), "language").toLocalIterator()
    lines = (",".join(six_digits(x) if isinstance(x, float) else str(x) for x in r) + "\n" for r in rows)
    write_text(path, [",".join(table.columns) + "\n", *lines])
