"""Near-duplicate classes by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence is one shingle; no words: empty,
linked with nothing). Equal sets collapse to a node. The k smallest hashes are the sketch; inverted lists of retained
values generate overlaps. A node with too few values in lists of two or more cannot have a link and leaves. The rest
("suspects") are paired with the first member of each of their lists, estimated from the sketch of the union, verified on
full sets, and contracted to components. Then every pair that shares a list and still lies in two components is looked
at: lists of up to COLD members by all pairs; those whose sketch is mostly in longer lists by the rarest shingles of their
full sets. No list is capped or dropped and copies are never expanded into pairs.

Sketches and candidates use one 64-bit hash of a shingle; full sets and their intersections use a second, independent one,
and equal sets are equal in a 128-bit digest of both. Values that very many nodes share are joined apart (join_keyed).

Edge cases: null text counts as empty. Rows are told apart by doc_id and set: rows that share a doc_id but not a text are
nodes of their own, linked only if their texts are. component_id is the smallest doc_id reachable that is not null; a row
with a null doc_id is linked like any other, its component_id is null and it is kept if nothing that it is linked with has
a doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.components import connected_components
from netquarry.llm.runtime import join_keyed, map_arrow, settled, stored, text_rows
from netquarry.llm.words import chunks, shingle_hashes, word_hashes

WIDTH = 5
SKETCH = 32
#: A link shares at least 0.75 of the union's sketch in expectation; fewer shared values than this has a chance of 4e-10.
LEAST_SHARED = 8
#: Lists with more members are searched by rare prefixes instead of by all pairs.
COLD = 32
#: A link leaves a quarter of the union's sketch unshared in expectation: a sketch with more than this many of its
#: 32 values outside long lists shares one of those with every link (chance of a miss under 1e-6).
COLD_ENOUGH = 22
#: Estimate below which a pair is not verified (11 or fewer of 32: a chance of 1.5e-6 at 0.75).
LEAST_ESTIMATE = 0.35
_ROW = ["doc_id", "t1", "t2"]


def document_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Of each row: sorted distinct shingle hashes, and the second hashes of the same shingles in the same order."""
    hashes, at, _, _ = word_hashes(raw, offsets)
    others, _, _, _ = word_hashes(raw, offsets, seed=1)
    for i in range(len(offsets) - 1):
        pair = [h[at[i] : at[i + 1]] for h in (hashes, others)]
        n = len(pair[0])
        if n >= width:
            values, second = (shingle_hashes(w, width) for w in pair)
            order = np.argsort(values)
            values = values[order]
            first = np.ones(len(values), bool)
            first[1:] = values[1:] != values[:-1]
            yield values[first], second[order[first]]
        elif n:
            yield tuple(shingle_hashes(np.append(w, np.uint64(n)), n + 1) for w in pair)
        else:
            yield tuple(pair)


def _longs(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))


def _digest(values: np.ndarray, second: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(values.tobytes() + second.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketches(width: int, k: int):
    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                n, h1, h2, kept = [], [], [], []
                for values, second in document_sets(raw, offsets, width):
                    x, y = _digest(values, second)
                    n.append(len(values))
                    h1.append(x)
                    h2.append(y)
                    kept.append(values[:k])
                own = [batch.column(c)[a:b] for c in _ROW]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _longs(kept)], [*_ROW, "n", "h1", "h2", "sketch"])

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0)):
                sets = list(document_sets(raw, offsets, width))
                digests = [_digest(*s) for s in sets]
                members = _longs([np.sort(second) for _, second in sets])
                yield pa.RecordBatch.from_arrays([*[pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)], members], ["h1", "h2", "members"])

    return run


def _estimate(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Share of the union's k smallest values that both sketches hold. Hashes order as unsigned."""
    union = F.slice(F.array_sort(F.transform(F.array_union(a, b), lambda x: x.bitwiseXOR(F.lit(-(2**63))))), 1, k)
    both = F.transform(F.array_intersect(a, b), lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    return F.size(F.array_intersect(union, both)) / F.greatest(F.size(union), F.lit(1))


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _lists(listed: DataFrame, *more: Column) -> DataFrame:
    """One row a value that several nodes have, with their number in df."""
    return listed.groupBy("v").agg(F.count("*").alias("df"), *more).where("df > 1")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """Of each row: doc_id, t1 and t2 (hash of its text), n_shingles, node (of its set; null without words), root (the node that stands for its class) and component_id."""
    spark = docs.sparkSession
    rows = text_rows(docs).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    sketches = stored(map_arrow(rows.select("text", *_ROW), _sketches(width, SKETCH), "doc_id long, t1 long, t2 long, n long, h1 long, h2 long, sketch array<long>"), "sketches")
    # Nodes are numbered as they are written; the table fixes the numbers.
    nodes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = settled(spark, "links", lambda: _links(rows, nodes, width, percent))
    joined = settled(spark, "classes", lambda: connected_components(links, "a", "b"))
    placed = nodes.select("h1", "h2", "node", "rep", "copies").join(joined, "node", "left").withColumn("class", F.coalesce("component", "node"))
    # The smallest doc_id of a class, and the node that has it; nodes without any doc_id come last.
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("node").alias("node")))
    linked = placed.where("component is not null").groupBy("class").agg(first.alias("first")).select("class", F.col("first.node").alias("root"), F.col("first.rep").alias("smallest"))
    named = placed.join(linked, "class", "left").select("h1", "h2", "copies", "node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("smallest")).alias("component_id"))
    named = stored(named, "named")
    whole = join_keyed(sketches.select(*_ROW, F.col("n").alias("n_shingles"), "h1", "h2"), named, ["h1", "h2"], "copies", "left")
    return whole.select(*_ROW, "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    kept = F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("doc_id").isNotNull() | F.col("node").eqNullSafe(F.col("root")))
    return classes(docs, width, percent).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), kept.alias("kept"))


def _links(rows: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that reach the similarity, enough of them to connect all that are connected."""
    postings = nodes.select("node", F.explode("sketch").alias("v"))
    shared = join_keyed(postings, stored(_lists(postings), "shared"), ["v"], "df")
    needed = F.least(F.lit(LEAST_SHARED), F.ceil(F.col("n") * (percent / 100)))
    counts = shared.groupBy("node").agg(F.count("*").alias("overlap"))
    suspects = stored(nodes.join(counts, "node").where(F.col("overlap") >= needed).select("node", "rep", "h1", "h2", "n", "sketch"), "suspects")

    # One text a suspect: those of its first doc_id, then one of each set.
    wanted = suspects.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    texts = rows.where("doc_id is not null").join(wanted, "doc_id", "left_semi").select("text")
    if suspects.where("rep is null").limit(1).count():
        texts = texts.unionByName(rows.where("doc_id is null").select("text"))
    members = map_arrow(texts, _full_sets(width), "h1 long, h2 long, members array<long>").dropDuplicates(["h1", "h2"])
    full = stored(members.join(suspects, ["h1", "h2"]).select("node", "n", "sketch", "members"), "members")

    listed = suspects.select("node", "rep", F.explode("sketch").alias("v"))
    # The node of the smallest doc_id is the first of most of its lists, so that few nodes are.
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    lists = stored(_lists(listed, first.alias("first")).select("v", "df", F.col("first.node").alias("hub")), "lists")
    listed = listed.drop("rep")
    listed = stored(join_keyed(listed, lists, ["v"], "df"), "listed")

    stars = listed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(_verified(stars, full, percent), "links")
    comp = connected_components(first, "a", "b")

    placed = full.select("node", "n", "sketch").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = stored(listed.join(placed, "node"), "placed")
    mixed = stored(spread.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("v", "rows"), "mixed")
    spread = stored(join_keyed(spread, mixed, ["v"], "rows"), "spread")
    hot_count = listed.where(F.col("df") > COLD).groupBy("node").agg(F.count("*").alias("hot"))
    left = spread.where(F.col("df") <= COLD).select("v", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    right = left.select("v", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ca").alias("cb"))
    apart = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _sizes_allow(F.col("na"), F.col("nb"), percent)
    cold = left.join(right, "v").where(apart).select("a", "b")

    hot = _rare_prefix_pairs(spread, hot_count, full, percent)
    second = _verified(cold.unionByName(hot).distinct(), full, percent)
    return first.unionByName(second)


def _rare_prefix_pairs(spread: DataFrame, hot_count: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among those whose sketches are mostly in long lists, by the prefixes of their full sets.

    All their shingles are ordered rarest first (ties by value). Two sets of the similarity meet within their first
    n - overlap + 1 shingles, so that what a large group shares comes last and brings nobody together. No pair is missed.
    """
    warm = spread.where(F.col("df") > COLD).join(hot_count, "node").where((F.size("sketch") - F.col("hot") <= COLD_ENOUGH) | (F.col("n") < SKETCH)).select("node", "component").distinct()
    shingles = stored(full.join(warm, "node").select("node", "n", "component", F.explode("members").alias("v")), "shingles")
    counts = stored(shingles.groupBy("v").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1"), "counts")
    own = Window.partitionBy("node")
    shared = join_keyed(shingles, counts, ["v"], "df").withColumn("alone", F.col("n") - F.count("*").over(own)).withColumn("i", F.col("alone") + F.row_number().over(own.orderBy("df", "v")))
    prefix = stored(shared.where((F.col("lo") != F.col("hi")) & ((F.col("n") - F.col("i") + 1) * 100 >= F.col("n") * percent)).select("v", "node", "n", "i", "component"), "prefixes")
    sizes = prefix.groupBy("v", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("v").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("components"), F.sum("c").alias("rows")).where("components > 1").select("v", "main", "rows")
    listed = join_keyed(prefix, stored(main, "main"), ["v"], "rows")
    left = listed.where("component <> main").select("v", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("component").alias("ca"))
    right = listed.select("v", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("component").alias("cb"), "main")
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))
    enough = (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    met = left.join(right, "v").where((F.col("ca") != F.col("cb")) & once & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; the union's sketch is looked at first."""
    small = full.select(F.col("node"), "n", "sketch")
    left = small.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = small.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    likely = pairs.join(left, "a").join(right, "b").where(_sizes_allow(F.col("na"), F.col("nb"), percent) & (_estimate(F.col("sa"), F.col("sb")) >= LEAST_ESTIMATE)).select("a", "b", "na", "nb")
    left = full.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    right = full.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    both = likely.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("ma", "mb")))
    return both.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each near-duplicate class; columns unchanged.

    The one that stays has the smallest doc_id, and of texts under one doc_id the first by hash; repeated rows leave one.
    Documents without words all stay.
    """
    placed = classes(docs).where("node is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    key = ["__none", "__id", "__t1", "__t2"]
    stays = placed.groupBy("root").agg(F.min(order).alias("first")).select("first.*").select(F.col("none").alias(key[0]), F.coalesce("doc_id", F.lit(0)).alias(key[1]), F.col("t1").alias(key[2]), F.col("t2").alias(key[3]))
    text, doc_id = F.col("doc.text").cast("string"), F.col("doc.doc_id").cast("long")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    values = (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit("second"), text))
    keyed = packed.where(worded).withColumns(dict(zip(key, values, strict=True)))
    # Repeated rows are one before they are shuffled.
    one = keyed.dropDuplicates(key).join(stays, key, "left_semi")
    return one.select("doc").unionByName(packed.where(~worded)).select(*[F.col(f"doc.{c}").alias(c) for c in docs.columns])
