"""Differences of dated snapshots and what is counted over them.

A snapshot is a table (device, stanza, element, attr, val). Change tables are long sets (period, col); wide matrices are
made on export only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("device", "stanza", "element")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """device, stanza, element, change, attr, old, new.

    An element that comes or goes is one row (attr null); in others, attributes are added, deleted or modified. Stanzas
    that the later snapshot of a device lacks, and those named AAA*, are left out.
    """
    b = before.select(*KEY, "attr", F.col("val").alias("old"), F.lit(True).alias("was"))
    a = after.select(*KEY, "attr", F.col("val").alias("new"), F.lit(True).alias("is"))
    both = b.join(a, [*KEY, "attr"], "full").where(~F.startswith("stanza", F.lit("AAA")))
    element, stanza = Window.partitionBy(*KEY), Window.partitionBy("device", "stanza")
    seen = both.withColumn("had", F.max("was").over(element)).withColumn("has", F.max("is").over(element)).withColumn("stays", F.max("is").over(stanza)).where("stays")
    changed = seen.where(F.col("was").isNull() | F.col("is").isNull() | ~F.equal_null("old", "new"))
    whole = F.col("had").isNull() | F.col("has").isNull()
    change = F.when(F.col("was").isNull(), "Addition").when(F.col("is").isNull(), "Deletion").otherwise("Modification")
    rows = changed.select(*KEY, change.alias("change"), *[F.when(whole, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("attr", "old", "new")])
    return rows.distinct()


def diff_kinds(before: DataFrame, after: DataFrame) -> DataFrame:
    """device, stanza, kind by numbers of attributes: Newly Added, Deleted, Addition, Deletion or Modification (same number, other values)."""
    summed = lambda df, n, h: df.groupBy("device", "stanza").agg(F.count("*").alias(n), F.sum(F.xxhash64("element", "attr", "val").cast("decimal(20,0)")).alias(h))
    both = summed(before, "n0", "h0").join(summed(after, "n1", "h1"), ["device", "stanza"], "full")
    kind = F.when(F.col("n0").isNull(), "Newly Added").when(F.col("n1").isNull(), "Deleted").when(F.col("n1") > F.col("n0"), "Addition").when(F.col("n1") < F.col("n0"), "Deletion").when(F.col("h0") != F.col("h1"), "Modification")
    return both.select("device", "stanza", kind.alias("kind")).where("kind is not null")


def date_pairs(dates: DataFrame) -> DataFrame:
    """date, next: each date with the one after it (a row a date: few)."""
    return dates.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date"))).where("next is not null")


def diff_series(snapshots: DataFrame) -> DataFrame:
    """All diffs of consecutive dates of a table (date, device, stanza, element, attr, val) in one job."""
    pairs = date_pairs(snapshots)
    before = snapshots.join(F.broadcast(pairs), "date").withColumn("device", F.struct("next", "device"))
    after = snapshots.withColumnRenamed("date", "next").join(F.broadcast(pairs.select("next")), "next").withColumn("device", F.struct("next", "device"))
    return snapshot_diff(before, after).select("device.next", "device.device", "stanza", "element", "change", "attr", "old", "new")


def change_columns(diffs: DataFrame, level: str = "stanza") -> DataFrame:
    """period, col of a diff table: stanza, stanza:attr, or device."""
    col = {"stanza": F.col("stanza"), "attribute": F.concat_ws(":", "stanza", "attr"), "device": F.col("device").cast("string")}[level]
    return diffs.select("period", col.alias("col")).distinct()


def change_matrix(changes: DataFrame, periods: DataFrame) -> DataFrame:
    """period, col, changed (0 or 1) for every period, also those without a change."""
    cols = changes.select("col").distinct()
    marked = changes.select("period", "col").distinct().withColumn("changed", F.lit(1))
    return periods.select("period").distinct().crossJoin(cols).join(marked, ["period", "col"], "left").select("period", "col", F.coalesce("changed", F.lit(0)).alias("changed"))


def wide_matrix(changes: DataFrame, periods: DataFrame, cols: list[str]) -> DataFrame:
    """A row a period and a 0/1 column for each of the named columns."""
    wide = changes.groupBy("period").pivot("col", cols).agg(F.lit(1))
    return periods.select("period").distinct().join(wide, "period", "left").fillna(0, cols)


def change_frequency(changes: DataFrame) -> DataFrame:
    """col, periods, most frequent first; equal counts all stay."""
    return changes.groupBy("col").agg(F.count_distinct("period").alias("periods")).orderBy(F.desc("periods"), "col")


def _pairs(changes: DataFrame) -> DataFrame:
    """a, b, both, na, nb for all pairs of columns (a <= b), also those never changed together."""
    one = changes.select("period", "col").distinct()
    n = one.groupBy("col").agg(F.count("*").alias("n"))
    met = one.select("period", F.col("col").alias("a")).join(one.select("period", F.col("col").alias("b")), "period").where("a <= b").groupBy("a", "b").agg(F.count("*").alias("both"))
    # Columns are names of stanzas: their number does not grow with the snapshots.
    every = n.select(F.col("col").alias("a"), F.col("n").alias("na")).join(n.select(F.col("col").alias("b"), F.col("n").alias("nb")), F.col("a") <= F.col("b"))
    return every.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("both", F.lit(0)).alias("both"), "na", "nb")


def co_changes(changes: DataFrame) -> DataFrame:
    """a, b, together (and), apart (xor)."""
    return _pairs(changes).select("a", "b", F.col("both").alias("together"), (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("apart"))


def point_frequencies(changes: DataFrame, periods: DataFrame) -> DataFrame:
    """a, b (a < b) and the number of periods with each pair of values."""
    total = periods.select("period").distinct().agg(F.count("*").alias("total"))
    p = _pairs(changes).where("a < b").join(F.broadcast(total))
    return p.select("a", "b", (F.col("total") - F.col("na") - F.col("nb") + F.col("both")).alias("n00"), (F.col("nb") - F.col("both")).alias("n01"), F.col("both").alias("n11"), (F.col("na") - F.col("both")).alias("n10"))


def rank_correlation(values: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """a, b, rho: Spearman's rank correlation of all pairs of columns of a long table, ties at their mean rank."""
    w = Window.partitionBy(col)
    ranked = values.select(F.col(row).alias("r"), F.col(col).alias("c"), (F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(col, value)) - 1) / 2).alias("k"))
    left, right = ranked.select("r", F.col("c").alias("a"), F.col("k").alias("x")), ranked.select("r", F.col("c").alias("b"), F.col("k").alias("y"))
    return left.join(right, "r").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("rho"))


def regressions(matrix: DataFrame) -> DataFrame:
    """a, b, slope, intercept, r2, together: simple regressions of column a on column b over a long 0/1 matrix (period, col, changed)."""
    left, right = matrix.select("period", F.col("col").alias("a"), F.col("changed").alias("y")), matrix.select("period", F.col("col").alias("b"), F.col("changed").alias("x"))
    return left.join(right, "period").where("a <> b").groupBy("a", "b").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.sum(F.col("x") * F.col("y")).alias("together"))


def presence_class(present: list[Column]) -> Column:
    """When something seen in the first of four periods went: fixed 1, fixed 2, fixed 3, not fixed; other for all else."""
    a, b, c, d = present
    return F.when(a & ~b & ~c & ~d, "fixed 1").when(a & b & ~c & ~d, "fixed 2").when(a & b & c & ~d, "fixed 3").when(a & b & c & d, "not fixed").otherwise("other")


def lifetimes(found: DataFrame, periods: list) -> DataFrame:
    """class, n of a table (thing, period) over four periods."""
    per = found.groupBy("thing").agg(*[F.max(F.col("period") == p).alias(f"p{k}") for k, p in enumerate(periods)])
    return per.select(presence_class([F.col(f"p{k}") for k in range(4)]).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def parse_matrix(text: DataFrame, *keys: str) -> DataFrame:
    """The keys of a matrix, row ("T1"...), col (from 0), value of a column "text" that holds a list of lists of numbers."""
    rows = text.select(*keys, F.posexplode(F.from_json("text", "array<array<int>>")).alias("r", "xs"))
    return rows.select(*keys, F.concat(F.lit("T"), F.col("r") + 1).alias("row"), F.posexplode("xs").alias("col", "value"))


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) without (b, a)."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def snapshot_of(keys: DataFrame) -> DataFrame:
    """Snapshot (device, stanza, element, attr, val) of documents stanza / element / attr, from their key table; unreadable documents have no rows."""
    at = lambda i: F.get("parent", F.lit(i))
    return keys.where((F.size("parent") == 2) & F.col("container").isNull()).select(F.col("doc").alias("device"), at(0).alias("stanza"), at(1).alias("element"), F.col("key").alias("attr"), F.col("leaf").alias("val"))
