"""Line de-duplication by overlapping windows of three lines, in built-in functions only.

Lines are split at "\\n"; those without a word (a character outside space and 0x09-0x0D) take no part and stay. Every
three consecutive lines of a document are hashed (128 bits); of a window that occurs more than once anywhere, the first
occurrence by (doc_id, text hash, position) stays and all lines covered by later ones go.

Edge cases: null text stays null and has no lines; fewer than three lines: nothing is removed; repeated rows (equal texts
under one doc_id) are occurrences like any others, so all but one of them lose every line that a window covers; null
doc_ids sort first; empty tables give empty results; extra columns pass through, but one that is named like a column of
ADDED is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.runtime import join_keyed, stored, text_rows

WINDOW = 3
KEY = ["none", "id", "hash"]
#: Columns beside those of the documents.
ADDED = ("_n_lines", "_removed_lines", "_changed")


def text_hash(text: Column) -> Column:
    """Sixty bits of md5, which orders the texts of a doc_id."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _spoken(lines: Column) -> Column:
    """Zero-based positions of the lines that have a word."""
    return F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, k (window number), h1, h2."""
    lines = F.split("text", "\n", -1)
    told = docs.where("text is not null").select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines")).where(F.size("lines") >= window)
    hashed = told.select("doc_id", "text_hash", F.transform("lines", lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))).alias("lines"))
    shifted = [F.slice("lines", k + 1, F.size("lines") - window + 1) for k in range(window)]
    zipped = F.arrays_zip(*[s.alias(f"l{k}") for k, s in enumerate(shifted)])
    exploded = hashed.select("doc_id", "text_hash", F.posexplode(zipped).alias("k", "w"))
    fields = [F.col("w")[f"l{k}"] for k in range(window)]
    return exploded.select("doc_id", "text_hash", "k", F.xxhash64(*[f["a"] for f in fields]).alias("h1"), F.xxhash64(*[f["b"] for f in fields]).alias("h2"))


def later_windows(windows: DataFrame) -> DataFrame:
    """The windows that are not the first of their kind."""
    place = F.struct("doc_id", "text_hash", "k")
    firsts = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    joined = join_keyed(windows, stored(firsts, "firsts"), ["h1", "h2"], "n")
    return joined.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "k")


def _numbered_copies(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows with copy: 1 for one row of each (none, id, hash), more for the others.

    Only rows whose windows begin more than once have others; each of them draws a number that a written table fixes, and the
    smallest one of a key is the first: partial minima, so no task gets the rows of a key.
    """
    again = windows.where("k = 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = stored(again.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"), "n"), "again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(1))
    told = join_keyed(rows, again, KEY, "n", "left")
    repeated = stored(told.where("n is not null").withColumn("number", F.monotonically_increasing_id()), "repeated")
    firsts = stored(repeated.groupBy(*KEY).agg(F.min("number").alias("first"), F.count("*").alias("weight")), "firsts")
    placed = join_keyed(repeated, firsts, KEY, "weight").withColumn("copy", F.when(F.col("number") == F.col("first"), 1).otherwise(2))
    return told.where("n is null").drop("n").withColumn("copy", F.lit(1)).unionByName(placed.drop("n", "number", "first", "weight"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text cut, and the columns of ADDED: number of lines, removed lines (zero-based positions), whether any was."""
    windows = stored(line_windows(text_rows(docs), window), "windows")
    # As many rows share a key as the most frequent window number of the key tells.
    later = later_windows(windows).groupBy("doc_id", "text_hash").agg(F.collect_set("k").alias("gone"), F.count("*").alias("later"))
    found = later.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"), "gone", (F.ceil(F.col("later") / F.size("gone")) + 1).alias("rows"))
    # The row travels as one struct, so that no column of it can clash with ours.
    text, doc_id = F.col("doc.text").cast("string"), F.col("doc.doc_id").cast("long")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc")).withColumns({"none": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)), "hash": F.coalesce(text_hash(text), F.lit(-1))})
    # The same join at every size: what goes grows with the documents, so it is never broadcast as a whole.
    joined = _numbered_copies(join_keyed(packed, stored(found, "gone").hint("merge"), KEY, "rows", "left"), windows)
    lines = F.split(text, "\n", -1)
    # A repeated row has no window that was not met before.
    joined = joined.withColumns({"lines": lines, "spoken": F.when(F.col("gone").isNotNull() | (F.col("copy") > 1), _spoken(lines))})
    every = F.when(F.size("spoken") >= window, F.sequence(F.lit(0), F.size("spoken") - window))
    joined = joined.withColumn("gone", F.when(F.col("copy") > 1, every).otherwise(F.col("gone")))
    # Window numbers become line positions by a hash-based difference, so that long texts stay linear.
    numbers = F.flatten(F.transform("gone", lambda k: F.sequence(k, k + (window - 1))))
    joined = joined.withColumn("numbers", F.array_distinct(numbers))
    picked = F.array_sort(F.transform("numbers", lambda k: F.get(F.col("spoken"), k)))
    joined = joined.withColumn("removed", F.coalesce(picked, F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    cut = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    columns = [F.col(f"doc.{c}").alias(c) if c != "text" else cut.alias("text") for c in docs.columns if c.lower() not in ADDED]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long")
    return joined.select(*columns, n_lines.alias(ADDED[0]), F.col("removed").alias(ADDED[1]), F.col("gone").isNotNull().alias(ADDED[2]))


def line_digests(deduped: DataFrame) -> DataFrame:
    """doc_id, line counts, the removed positions and a digest of the text that stays."""
    return deduped.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.size("_removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("_removed_lines").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
