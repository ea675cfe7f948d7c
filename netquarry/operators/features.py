"""Feature frames of interfaces and ACLs as long tables, and contrast sets learnt from them without a pivot.

A frame is (row, feature, value), one row a feature that a row has; the zeros of one-hot features are not stored. Sources
(neighbours of a type, frequent words, prefix ladders, first octets, single attributes) are unioned, so a frame with a hundred
thousand columns costs no more than its ones. Counts of rules with zeros follow from those with ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netquarry.functions import ip as ipf
from netquarry.session import stored

#: Lengths of the prefix ladder, and how many words are columns.
LADDER, TOP_WORDS = (20, 31), 14


def frame(*parts: DataFrame) -> DataFrame:
    """(row, feature, value) of several sources."""
    return reduce(DataFrame.unionByName, parts)


def neighbor_features(adj: DataFrame, kind: str, nbr_kind: str, flags: bool = False) -> DataFrame:
    """One-hot features "<type>_<neighbour>"; with flags also has_<type>s, 1 or 0, for every node of the kind."""
    own = adj.where((F.col("type") == kind) & (F.col("nbr_type") == nbr_kind)).select(F.col("id").alias("row"), F.concat(F.lit(f"{nbr_kind}_"), "nbr").alias("feature"), F.lit("1").alias("value")).distinct()
    if not flags:
        return own
    every = adj.where(F.col("type") == kind).groupBy(F.col("id").alias("row")).agg(F.max((F.col("nbr_type") == nbr_kind).cast("int")).cast("string").alias("value"))
    return own.unionByName(every.select("row", F.lit(f"has_{nbr_kind}s").alias("feature"), "value"))


def vocabulary(words: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """word, count of the n most frequent words of (word, seq); of equally frequent ones those that were seen first."""
    kind = words.schema["seq"].dataType
    if isinstance(kind, StructType):
        # The least struct of a word would sort all rows; least last fields are hashed, and few rows are left to compare.
        *head, last = kind.names
        parts = words.select("word", *[F.col(f"seq.{c}").alias(f"_{c}") for c in kind.names]).groupBy("word", *[f"_{c}" for c in head]).agg(F.count("*").alias("n"), F.min(f"_{last}").alias(f"_{last}"))
        counted = parts.groupBy("word").agg(F.sum("n").alias("count"), F.min(F.struct(*[f"_{c}" for c in kind.names])).alias("first"))
    else:
        counted = words.groupBy("word").agg(F.count("*").alias("count"), F.min("seq").alias("first"))
    return counted.orderBy(F.desc("count"), "first", "word").limit(n).select("word", "count")


def word_features(words: DataFrame, known: DataFrame) -> DataFrame:
    """One-hot features of the words (row, word) that are in known."""
    # The vocabulary has as many rows as vocabulary() was asked for.
    return words.join(known.select("word"), "word", "left_semi").select("row", F.col("word").alias("feature"), F.lit("1").alias("value")).distinct()


def prefix_features(subnets: DataFrame, lo: int = LADDER[0], hi: int = LADDER[1]) -> DataFrame:
    """Features "subnet_/<length>" of (row, ip): the supernets of a row's address, or n where it has none or several."""
    one = subnets.groupBy("row").agg(F.count_distinct("ip").alias("n"), F.min("ip").alias("ip")).select("row", F.when(F.col("n") == 1, F.col("ip")).alias("ip"))
    rungs = F.transform(ipf.supernets(F.col("ip"), lo, hi), lambda net, k: F.struct(F.concat(F.lit("subnet_/"), (k + lo).cast("string")).alias("feature"), net.alias("value")))
    return one.select("row", F.explode(rungs).alias("x")).select("row", "x.feature", "x.value")


def drop_equal_prefixes(ladder: DataFrame) -> DataFrame:
    """The ladder without lengths that split the rows as a shorter length does: a longer prefix only refines, so that is where both have equally many values."""
    values = ladder.groupBy("feature").agg(F.count_distinct("value").alias("n"))
    length = F.regexp_extract("feature", r"(\d+)$", 1).cast("int")
    first = values.groupBy("n").agg(F.min_by("feature", length).alias("feature")).select("feature")
    return ladder.join(F.broadcast(first), "feature", "left_semi").select("row", "feature", "value")


def octet_features(lines: DataFrame) -> DataFrame:
    """One-hot features "octet_<first octet>" of the source addresses of (row, ip)."""
    return lines.select("row", F.concat(F.lit("octet_"), ipf.octet(F.col("ip"), 1)).alias("feature"), F.lit("1").alias("value")).distinct()


def attribute_features(rows: DataFrame, *names: str) -> DataFrame:
    """A feature for each named column of rows, none where it is null or empty."""
    told = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none")).alias("value")) for c in names])
    return rows.select("row", F.explode(told).alias("x")).select("row", "x.feature", "x.value")


def items(long: DataFrame) -> DataFrame:
    """row, item."""
    return long.select("row", F.concat("feature", F.lit("=>"), "value").alias("item"))


def learn_items(held: DataFrame, groups: DataFrame, depth: int, least: int = 1) -> DataFrame:
    """rule, grp, a: rows of each group that have all items of a rule, for every set of up to depth items that at least so many rows have.

    Sets grow by one item at a time from those that are frequent; a row's longer sets are its shorter ones joined to its later items.
    """
    rows = held.join(groups, "row").select("row", "grp", "item").distinct()
    frequent = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = stored(rows.join(frequent.select("item"), "item", "left_semi").select("row", "grp", "item"), "items")
    level, out = rows.select("row", "grp", F.array("item").alias("rule")), []
    for size in range(1, depth + 1):
        if size > 1:
            longer = level.join(rows.select("row", "item"), "row").where(F.col("item") > F.element_at("rule", -1))
            level = longer.select("row", "grp", F.concat("rule", F.array("item")).alias("rule"))
            if least > 1:
                often = level.groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") >= least)
                level = level.join(often.select("rule"), "rule", "left_semi").select("row", "grp", "rule")
            if size < depth:
                level = stored(level, "level")
        out.append(level.groupBy("rule", "grp").agg(F.count("*").alias("a")))
    return frame(*out)


def learn_one_hot(ones: DataFrame, groups: DataFrame, known: DataFrame) -> DataFrame:
    """rule, grp, a of all rules of one or two one-hot features of known (feature), zeros included: f=>1, f=>0, and the four of each pair.

    Only ones are counted; a zero's count is what is left of the group. known is a vocabulary, so its pairs are few.
    """
    totals = groups.groupBy("grp").agg(F.count("*").alias("total"))
    learned = stored(learn_items(ones.join(known, "feature", "left_semi").select("row", F.col("feature").alias("item")), groups, 2), "ones")
    single = F.broadcast(known).crossJoin(totals).join(learned.where(F.size("rule") == 1).select(F.get("rule", F.lit(0)).alias("feature"), "grp", "a"), ["feature", "grp"], "left").select("feature", "grp", "total", F.coalesce("a", F.lit(0)).alias("a"))
    single = stored(single, "single")
    two = learned.where(F.size("rule") == 2).select(F.get("rule", F.lit(0)).alias("f"), F.get("rule", F.lit(1)).alias("g"), "grp", "a")
    pair = single.select(F.col("feature").alias("f"), "grp", "total", F.col("a").alias("nf")).join(single.select(F.col("feature").alias("g"), "grp", F.col("a").alias("ng")), "grp").where("f < g")
    pair = pair.join(two, ["f", "g", "grp"], "left").withColumn("both", F.coalesce("a", F.lit(0)))
    item = lambda c, v: F.concat(F.col(c), F.lit(f"=>{v}"))
    case = lambda c, n: F.struct(F.array(*c).alias("rule"), n.alias("a"))
    ones_zeros = F.array(case([item("feature", 1)], F.col("a")), case([item("feature", 0)], F.col("total") - F.col("a")))
    n, nf, ng = F.col("both"), F.col("nf"), F.col("ng")
    four = F.array(case([item("f", 1), item("g", 1)], n), case([item("f", 1), item("g", 0)], nf - n), case([item("f", 0), item("g", 1)], ng - n), case([item("f", 0), item("g", 0)], F.col("total") - nf - ng + n))
    spread = lambda df, cases: df.select("grp", F.explode(cases).alias("x")).select("x.rule", "grp", "x.a")
    return spread(single, ones_zeros).unionByName(spread(pair, four)).where("a > 0")


def wide(long: DataFrame, features: list[str], absent: str | Column = "0") -> DataFrame:
    """One row a row and a column a feature, for export of a frame with few features."""
    found = long.where(F.col("feature").isin(*features)).groupBy("row").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])
    return found.select("row", *[F.coalesce(F.col(f"`{f}`"), F.lit(absent) if isinstance(absent, str) else absent).alias(f) for f in features])
