"""Quality rules: per-document rules, then cross-document line frequency by host. Built-in functions only.

Lines are normalised (lower case, digits as 0, outer spaces cut) and hashed; a line in more documents of its host than
the limit, exact copies of a text being one document, is removed, and a document that loses most of its characters so is rejected.

Edge cases: null or empty texts have no words and fail the base rules; a null host is a host of its own; every row is a
document of its own (repeated rows and null doc_ids too); extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.runtime import join_keyed, stored

WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: A line is removed when it is in more different texts of its host than this, whatever the host's size.
MOST_TEXTS = 2
#: A document is depleted when more than this percentage of its lines' characters is removed.
DEPLETED_PERCENT = 75


def _window_hashes(words: str, width: int) -> Column:
    n = F.size(words) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: str, width: int) -> Column:
    """Number of words inside windows that occur more than once: sorted hashes, equal neighbours, merged spans."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(hashes)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(placed, 1, size - 1))
    after = F.slice(placed, 2, size)
    marked = F.zip_with(placed, before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("seen")))
    repeated = F.zip_with(marked, after, lambda a, b: F.when(a["seen"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]))
    at = F.array_sort(F.filter(repeated, lambda i: i.isNotNull()))
    steps = F.zip_with(at, F.slice(at, 2, size), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    many = F.size(F.array_distinct(hashes)) < size
    return F.when(many, F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)).otherwise(F.lit(0))


def document_metrics(docs: DataFrame, *more: str) -> DataFrame:
    """One row a document: row, doc_id, t (hash of the text), counts, its normalised lines (hashes with the host, characters), and the columns in more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"), *more)
    split = base.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)))
    hashed = split.withColumn("hashes", _window_hashes("words", WINDOW))
    normal = F.filter(F.split(F.regexp_replace(F.lower("text"), "[0-9]", "0"), "\n"), lambda line: line.rlike(WORD))
    return hashed.select(
        "row",
        "doc_id",
        F.xxhash64("text").alias("t"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered("hashes", WINDOW).cast("long").alias("n_repeat_words"),
        F.transform(normal, lambda line: F.struct(_line_key(F.col("host"), F.trim(line))["h1"].alias("h1"), _line_key(F.col("host"), F.trim(line))["h2"].alias("h2"), F.length(F.trim(line)).alias("chars"))).alias("lines"),
        *more,
    )


def _line_key(host: Column, line: Column) -> Column:
    """Two hashes of a host and a normalised line."""
    return F.struct(F.xxhash64(host.isNull(), host, line).alias("h1"), F.xxhash64(F.lit("second"), host.isNull(), host, line).alias("h2"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Metrics of every document with removed_lines, removed_chars, base_failed and kept."""
    return _judged(stored(document_metrics(docs), "metrics"))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """docs with the frequent lines of their host cut out of text, and kept (as in quality_rules); a column named kept is replaced."""
    told = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), *[F.col(c) for c in ("doc_id", "source", "text")])
    judged = _judged(stored(document_metrics(told, "doc"), "metrics"), "doc", "removed")
    text = F.col("doc.text").cast("string")
    lines = F.split(text, "\n", -1)
    # Removed lines are numbered among those with a word.
    spoken = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    gone = F.transform("removed", lambda k: F.get(spoken, k))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cut = F.when(F.size("removed") == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return judged.select(*[F.col(f"doc.{c}").alias(c) if c != "text" else cut.alias("text") for c in docs.columns if c.lower() != "kept"], "kept")


def _judged(metrics: DataFrame, *more: str) -> DataFrame:
    lines = metrics.select("row", "t", F.posexplode("lines").alias("at", "line")).select("row", "t", "at", "line.h1", "line.h2", "line.chars")
    # Copies of a text count once; they are one row before the shuffle.
    texts = lines.select("h1", "h2", "t").distinct().groupBy("h1", "h2").agg(F.count("*").alias("texts")).where(F.col("texts") > MOST_TEXTS)
    rows = lines.groupBy("h1", "h2").agg(F.count("*").alias("rows"))
    frequent = stored(texts.join(rows, ["h1", "h2"]).select("h1", "h2", "rows"), "frequent")
    found = join_keyed(lines, frequent, ["h1", "h2"], "rows")
    removed = found.groupBy("row").agg(F.count("*").alias("removed_lines"), F.sum("chars").alias("removed_chars"), *([F.collect_list("at").alias("removed")] if "removed" in more else []))
    line_chars = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["chars"])
    out = metrics.withColumn("line_chars", line_chars).drop("lines").join(removed, "row", "left").fillna(0, ["removed_lines", "removed_chars"])
    if "removed" in more:
        out = out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    depleted = F.col("removed_chars") * 100 > F.col("line_chars") * DEPLETED_PERCENT
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), "removed_lines", "removed_chars", "line_chars", *more)
