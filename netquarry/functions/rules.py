"""Confidences and rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence(n: Column, d: Column) -> Column:
    """n / d to three places, rounded half up on integers; null unless d > 0."""
    return F.when(d > 0, F.floor((n * 2000 + d) / (d * 2)) / 1000.0)


def filter_confidence(rules: DataFrame, c: float = 1.0, n: int = 1, d: int = 1) -> DataFrame:
    return rules.where(F.col("c").isNotNull() & (F.col("c") >= c) & (F.col("n") >= n) & (F.col("d") >= d))


def rule_items(text: Column) -> Column:
    """Map of feature to value of "('a=>1', 'b=>0')"."""
    items = F.regexp_extract_all(text, F.lit(r"'([^']+)'"), F.lit(1))
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.substring_index(x, "=>", 1), F.substring_index(x, "=>", -1))))


def rule_group(text: Column) -> Column:
    """The last character of a group text, as a number."""
    return F.substr(text, F.length(text)).try_cast("int")


def additional_metrics(rules: DataFrame) -> DataFrame:
    """f1, and 10 * precision + frequency / largest frequency + 2 * f1."""
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    most = rules.agg(F.max("frequency").alias("most"))
    # One row is broadcast.
    return rules.crossJoin(F.broadcast(most)).withColumn("f1", f1).withColumn("weighted", 10 * F.col("precision") + F.col("frequency") / F.col("most") + 2 * F.col("f1")).drop("most")
