"""Gaps, spans, hash chains and knowledge cutoffs over ordered rows."""

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def contiguity(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """(group, n, first, last, contiguous) of the distinct ordinals of each group."""
    out = rows.groupBy(group).agg(F.countDistinct(ordinal).alias("n"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"))
    return out.withColumn("contiguous", (F.col("last") - F.col("first") + 1) == F.col("n"))


def missing_ordinals(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """(group, ordinal) that lie between a group's ordinals and are not there, from the gaps between neighbours."""
    own = rows.select(group, ordinal).distinct()
    after = F.lead(ordinal).over(Window.partitionBy(group).orderBy(ordinal))
    gaps = own.withColumn("after", after).where(F.col("after") > F.col(ordinal) + 1)
    return gaps.select(group, F.explode(F.sequence(F.col(ordinal) + 1, F.col("after") - 1)).alias(ordinal))


def overlaps(spans: DataFrame, group: str, start: str, end: str, tie: Sequence[str] = ()) -> DataFrame:
    """``spans`` with ``adjacent_overlap`` (with the span before) and ``running_overlap`` and ``gap`` (with all spans before)."""
    order = Window.partitionBy(group).orderBy(start, end, *tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumns({
        "adjacent_overlap": F.coalesce(F.lag(end).over(order) > F.col(start), F.lit(False)),
        "running_overlap": F.coalesce(reach > F.col(start), F.lit(False)),
        "gap": F.greatest(F.lit(0), F.coalesce(F.col(start) - reach, F.lit(0))).cast("long"),
    })


def linked(rows: DataFrame, group: str, order: str, entry: Column) -> DataFrame:
    """``rows`` with ``digest`` of each entry and ``previous``, the digest of the one before it in its group."""
    return rows.withColumn("digest", F.sha2(entry, 256)).withColumn("previous", F.lag("digest").over(Window.partitionBy(group).orderBy(order)))


def chain_heads(rows: DataFrame, group: str, order: str, entry: str) -> DataFrame:
    """(group, n, head): each entry is hashed with the digest so far, from the empty string on; a null entry makes the head null.

    Chains are sequential, so a group's entries pass through one task; they are
    sorted there and streamed, and nothing but the running digest is kept.
    """
    out = StructType([rows.schema[group], StructField("n", LongType()), StructField("head", StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [group, "n", "head"]
        key_type, begun, key, n, head = None, False, None, 0, ""
        for batch in batches:
            key_type, done = batch.schema.field(0).type, []
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not begun or own != key:
                    if begun:
                        done.append((key, n, head))
                    begun, key, n, head = True, own, 0, ""
                n += 1
                x = x.as_py()
                head = None if x is None or head is None else hashlib.sha256(head.encode() + b"|" + x).hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (key_type, pa.int64(), pa.string()), strict=True)], names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array([n], pa.int64()), pa.array([head], pa.string())], names)

    own = rows.select(group, order, F.col(entry).cast("binary").alias("chain_entry"))
    return own.repartition(group).sortWithinPartitions(group, order, "chain_entry").select(group, "chain_entry").mapInArrow(fold, out)


def known_as_of(facts: DataFrame, key: str, effective: str, available: str, cutoff: str, value: str) -> DataFrame:
    """(key, value, n): the value with the latest effective time among facts available by the cutoff, and how many there are."""
    seen = facts.where(F.col(available) <= F.lit(cutoff).cast("timestamp"))
    return seen.groupBy(key).agg(F.max_by(value, F.struct(effective, available, value)).alias(value), F.count("*").alias("n"))
