"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the
others as named users and system turns as they are. Masks are the stretches that the assistant wrote.

A conversation is rendered in segments of SEGMENT turns, in order; segments of one perspective, put
together, are the whole dialogue. So one conversation that holds a third of all turns is many rows of
bounded size. Turns are numbered without gathering a conversation: a range partitioning sorts all turns,
each partition numbers its own, and the few counts of (conversation, partition) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import stored

SEGMENT = 256
SYSTEM = "system"
NOBODY = "unknown"


def _numbered(turns: DataFrame) -> DataFrame:
    """turns(c, t, role, text) with `at`, each turn's place (from 0) in its conversation."""
    order = [F.col("c"), F.col("t").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    placed = stored(placed, "turns")
    heads = placed.groupBy("c", "p").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.withColumn("before", before)
    return placed.join(heads.drop("n"), ["c", "p"]).withColumn("at", F.col("i") - F.col("first") + F.col("before")).drop("p", "i", "first", "before")


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, segment, n_turns, text, masks) from conversations(conv_id, turn, role, text, ...).

    Turns stand in the order of turn (nulls last), role and text; repeated rows are turns of their own. A
    null text is empty. A null role speaks as 'unknown' and is no participant; 'system' neither, so a
    conversation of those alone gives no row. Turns without conv_id are left out. '<|' inside a text is
    written '<\\|', so that no text can open a turn. masks lists start:end (code points, end exclusive) of
    each assistant turn's text and its end mark within the segment's text. Other columns are ignored. An
    empty table gives an empty table.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("text")
    )
    numbered = _numbered(turns).withColumn("segment", F.floor(F.col("at") / SEGMENT))
    speakers = turns.where((F.col("role") != SYSTEM) & F.col("role").isNotNull()).select("c", F.col("role").alias("who")).distinct()

    def rendered(x: Column) -> Column:
        own = x["role"].eqNullSafe(F.col("who"))
        name = F.coalesce(x["role"], F.lit(NOBODY))
        head = F.when(own, F.lit("<|assistant|>\n")).when(name == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user|> "), name, F.lit("\n")))
        return F.struct(head.alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body"), own.alias("own"))

    # a segment's turns gather once, before speakers multiply them
    segments = numbered.groupBy("c", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    rows = segments.join(speakers, "c").select("c", "who", "segment", F.transform("turns", rendered).alias("turns"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"])
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("masks")),
        lambda s, x: F.struct(
            (s["end"] + size(x)).alias("end"),
            F.when(x["own"], F.array_append(s["masks"], F.concat_ws(":", s["end"] + F.length(x["head"]), s["end"] + size(x)))).otherwise(s["masks"]).alias("masks"),
        ),
    )
    return rows.select(
        F.col("c").alias("conv_id"),
        F.col("who").alias("perspective"),
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.array_join(walked["masks"], ",").alias("masks"),
    )
