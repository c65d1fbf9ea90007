"""What the training-data operators share: table access, the shared work folder, session-safe writes."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's 10,000: texts are long, and a batch is held twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


_noted: ContextVar[list[DataFrame] | None] = ContextVar("noted", default=None)


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The list of all tables that stored() writes within it, for a release() when what was made of them is stored, too."""
    made: list[DataFrame] = []
    token = _noted.set(made)
    try:
        yield made
    finally:
        _noted.reset(token)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes a table into the shared folder and reads it again.

    A lost executor costs one task of the writing job, never what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    if (made := _noted.get()) is not None:
        made.append(kept)
    return kept


def release(*tables: DataFrame | None) -> None:
    """Deletes what stored() has written once nothing reads it any more, and lets Spark drop what led to it.

    Only for tables whose readers have all ended in another stored table or on the driver. Spark deletes
    shuffle files when the driver's garbage is collected, which a long run of small jobs may never cause.
    """
    for kept in tables:
        if kept is not None and (path := getattr(kept, "_stored_at", None)):
            session = kept.sparkSession
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes the shuffle files of a query when the query ends.

    For queries that end in a stored table or on the driver, whose shuffles nothing reads again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are stored.

    Listeners hold a query for a moment after its end, and what they hold can't be collected.
    """
    gc.collect()
    time.sleep(0.5)
    spark._jvm.System.gc()


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo a number: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def digest(spans):
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(spans.cast("binary"), 256)


def rendered(spans, kinds: list[str]):
    """kind:start:end of an array of spans, by start, then by the order of kinds, joined with commas."""
    place = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("n")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["n"], s["a"], s["b"])), ",")
