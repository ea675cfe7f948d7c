"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are dealt into ranges of doc_id and sorted within them; a written table fixes that order. Each range's totals are
summed into offsets, one row a range; a second pass over the written table adds its own running sum and cuts at equal
targets: a row goes to the shard that holds the middle of its bytes. Texts stay where they are read: only sizes move.

Edge cases: null text has no bytes (size 1, crc of nothing); null doc_ids come first; ties are ordered by size and crc,
and equal rows are interchangeable; fewer rows than shards leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netquarry.llm.runtime import map_arrow, stored

SHARDS = 8


def _running(batches):
    """place and before: rows and bytes ahead of a row in its range. The input is one sorted range a task."""
    rows = size = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        place = rows + np.arange(len(sizes))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(size + total - sizes, pa.int64())], [*batch.schema.names, "place", "before"])
        rows += len(sizes)
        size += int(total[-1]) if len(total) else 0


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and docs' columns named in carry (such as text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(c).alias(f"_{c}") for c in carry])
    # One pass sizes the rows, so that the ranges' bounds are sampled from small rows.
    sized = stored(sized, "sizes")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = sized.repartitionByRange(ranges, "doc_id", "size", "text_crc32").sortWithinPartitions("doc_id", "size", "text_crc32").withColumn("part", F.spark_partition_id())
    placed = stored(map_arrow(dealt, _running, StructType([*dealt.schema.fields, StructField("place", LongType()), StructField("before", LongType())])), "placed")
    totals = placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    # A row a range: its size is the number of shuffle partitions.
    bound = spark.createDataFrame(_offsets(totals), "part int, rows_before long, bytes_before long, all_bytes long")
    whole = placed.join(F.broadcast(bound), "part")
    middle = (F.col("bytes_before") + F.col("before")) * 2 + F.col("size")
    cut = whole.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (F.col("all_bytes") * 2))).cast("int")).withColumn("index", F.col("rows_before") + F.col("place"))
    first = cut.groupBy("shard").agg(F.min("index").alias("first"))
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_{c}").alias(c) for c in carry])


def _offsets(totals: DataFrame) -> list[tuple[int, int, int, int]]:
    found = sorted(tuple(r) for r in totals.collect())
    total, rows, size, out = sum(r[2] for r in found), 0, 0, []
    for part, n, b in found:
        out.append((part, rows, size, total))
        rows, size = rows + n, size + b
    return out
