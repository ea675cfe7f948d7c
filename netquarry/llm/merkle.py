"""Merkle manifest of a table: a forest of 16-ary trees, one a source, under one root; proofs for every row.

Leaves are numbered by (source, doc_id) without gathering a source. A `Forest` is a monoid: unresolved nodes keyed by
(tree, level, index) and the sizes of the trees that are known. Adding or merging puts nodes together, and whenever all siblings of
a run are there (16, or what the tree's size leaves for its last run) their digest becomes a node one level up; a tree's
single node is a leaf of the tree over all sources. Partitions build forests of their own leaves, which are joined a
few at a time in rounds, neighbours first, until one is left (`tree_reduce`); what a forest holds unresolved are the ends of its
ranges, so it stays small. The completed runs of siblings are the proofs; every run learns the runs above it level by level, from the root down.

Edge cases: null values hash as "-"; a null source is a source of its own and comes first; null doc_ids come first in their
source, are never tampered with, and rows of one doc_id are ordered by their leaf (equal rows are interchangeable); a table of one row
has the leaf as root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.ordered import numbered
from netquarry.llm.runtime import map_arrow, stored

ARITY = 16
#: Neighbouring fragments that one task of a round of tree_reduce merges.
FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over all sources.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "kind string, tree long, level int, index long, label int, hashes array<string>, single boolean"


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each with its length in bytes before it."""
    told = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


class Forest:
    """Unresolved nodes and the known sizes of unfinished trees. All operations commute, so forests merge in any order."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.arity = arity
        self.sizes: dict[int, tuple[int, int]] = {TOP: (trees, 0)}
        self.open: dict[tuple[int, int, int], dict[int, tuple[str, int]]] = defaultdict(dict)
        self.done: list[tuple] = []

    def nodes(self, tree: int, level: int) -> int:
        """Nodes of a level of a tree of known size."""
        n = self.sizes[tree][0]
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def add(self, tree: int, level: int, index: int, digest: str, label: int) -> None:
        """A node; label is the range that its first leaf lies in."""
        while True:
            run, most = index // self.arity, self.arity
            if tree in self.sizes:
                nodes = self.nodes(tree, level)
                if nodes == 1:
                    if not level:
                        self.done.append(("run", tree, 0, 0, label, [digest], True))
                    if tree == TOP:
                        self.done.append(("root", TOP, None, None, label, [digest], None))
                        return
                    del self.sizes[tree]
                    tree, level, index = TOP, 0, tree
                    continue
                most = min(most, nodes - run * self.arity)
            siblings = self.open[tree, level, run]
            siblings[index] = (digest, label)
            if len(siblings) < most:
                return
            del self.open[tree, level, run]
            own = [siblings[k] for k in sorted(siblings)]
            hashes, label = [d for d, _ in own], own[0][1]
            self.done.append(("run", tree, level, run, label, hashes, False))
            digest, index, level = sha256("".join(hashes).encode()).hexdigest(), run, level + 1

    def close(self, tree: int, size: int, label: int) -> None:
        """The tree has so many leaves: a level's last run may be short, and its only node is the tree's."""
        self.sizes[tree] = (size, label)
        level = 0
        while tree in self.sizes:
            nodes = self.nodes(tree, level)
            key = (tree, level, (nodes - 1) // self.arity)
            held = self.open.get(key, {})
            if len(held) == nodes - key[2] * self.arity:
                index, (digest, own) = held.popitem()
                if not held:
                    del self.open[key]
                self.add(tree, level, index, digest, own)
            if nodes == 1:
                return
            level += 1

    def take(self) -> list[tuple]:
        """Rows of the runs completed since the last call."""
        done, self.done = self.done, []
        return done

    def rest(self) -> list[tuple]:
        """Rows of all that is unresolved."""
        nodes = [("node", tree, level, index, label, [digest], None) for (tree, level, _), own in self.open.items() for index, (digest, label) in own.items()]
        return nodes + [("size", tree, None, size, label, None, None) for tree, (size, label) in self.sizes.items() if tree != TOP]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = ["kind", "tree", "level", "index", "label", "hashes", "single"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _leaves(trees: int, arity: int):
    def run(batches):
        forest = Forest(trees, arity)
        for batch in batches:
            for tree, place, leaf, last, part in zip(*[batch.column(c).to_pylist() for c in ("group_no", "place", "leaf", "last", "part")], strict=True):
                forest.add(tree, 0, place, leaf, part)
                if last:
                    forest.close(tree, place + 1, part)
            yield _batch(forest.take())
        yield _batch(forest.rest())

    return run


def _merged(trees: int, arity: int):
    def run(batches):
        forest = Forest(trees, arity)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == "node":
                    forest.add(r["tree"], r["level"], r["index"], r["hashes"][0], r["label"])
                else:
                    forest.close(r["tree"], r["index"], r["label"])
            yield _batch(forest.take())
        yield _batch(forest.rest())

    return run


def tree_reduce(leaves: DataFrame, trees: int, arity: int = ARITY, fan: int = FAN) -> DataFrame:
    """All completed runs (and the root) of numbered leaves: the fragments of neighbouring ranges are merged, fan at a time."""
    found = stored(map_arrow(leaves.select("group_no", "place", "leaf", "last", "part"), _leaves(trees, arity), _NODES), "fragments")
    runs, fragments = found.where("kind in ('run', 'root')"), int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        fragments = -(-fragments // fan)
        unresolved = found.where("kind in ('node', 'size')").withColumn("label", F.floor(F.col("label") / fan).cast("int"))
        found = stored(map_arrow(unresolved.repartition(fragments, "label"), _merged(trees, arity), _NODES), "fragments")
        runs = runs.unionByName(found.where("kind in ('run', 'root')"))
        if fragments == 1:
            return runs


def _paths(runs: DataFrame, arity: int) -> DataFrame:
    """Of each lowest run of a source's tree: tree, run, hashes, single, subroot, and above: (pos, hashes, single) of each run from the next level to the root."""
    runs = runs.where("kind = 'run'").select("tree", "level", F.col("index").alias("run"), "hashes", "single")
    firsts = runs.where("run = 0").groupBy("tree").agg(F.max("level").alias("height"))
    heights = {bool(r["top"]): r["h"] for r in firsts.groupBy((F.col("tree") == TOP).alias("top")).agg(F.max("height").alias("h")).collect()}
    # Only a tree's first run of a level can be its last level's.
    told = runs.where("run = 0").join(firsts, "tree").withColumn("ends", F.col("level") == F.col("height")).drop("height")
    runs = stored(told.unionByName(runs.where("run > 0").withColumn("ends", F.lit(False))), "runs")
    up = F.when(F.col("ends"), F.struct(F.lit(TOP).cast("long").alias("t"), F.lit(0).alias("l"), F.floor(F.col("tree") / arity).alias("r")))
    up = up.otherwise(F.struct(F.col("tree").alias("t"), (F.col("level") + 1).alias("l"), F.floor(F.col("run") / arity).alias("r")))
    runs = runs.withColumns({"pos": F.when(F.col("ends"), F.col("tree") % arity).otherwise(F.col("run") % arity).cast("int"), "up": up})

    step = "array<struct<pos:int,hashes:array<string>,single:boolean>>"
    top = runs.where(f"tree = {TOP}")
    placed = top.where("ends").select("tree", "level", "run", "hashes", "single", F.array().cast(step).alias("above"), F.lit(None).cast("string").alias("subroot"))

    def below(rows: DataFrame, parents: DataFrame) -> DataFrame:
        known = parents.select(F.struct(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("run").alias("r")).alias("up"), F.col("hashes").alias("h"), F.col("single").alias("s"), F.col("above").alias("a"), F.col("subroot").alias("b"))
        joined = rows.join(known, "up")
        own = F.array(F.struct("pos", F.col("h").alias("hashes"), F.col("s").alias("single")))
        return joined.select("tree", "level", "run", "hashes", "single", F.concat(own, "a").alias("above"), F.when(F.col("ends"), F.get("h", F.col("pos"))).otherwise(F.col("b")).alias("subroot"))

    for level in range(heights[True] - 1, -1, -1):
        placed = below(top.where(F.col("level") == level), placed)
    sources, over = runs.where(f"tree <> {TOP}"), placed
    placed = below(sources.where(F.col("level") == heights[False]), over)
    for level in range(heights[False] - 1, -1, -1):
        placed = below(sources.where(F.col("level") == level), placed.unionByName(over))
    return placed.drop("level")


def _others(s: Column, arity: int) -> tuple[Column, Column]:
    """Hashes of a run before and behind a place, joined."""
    return F.array_join(F.slice(s["hashes"], F.lit(1), s["pos"]), ""), F.array_join(F.slice(s["hashes"], s["pos"] + 2, F.lit(arity)), "")


def siblings_text(steps: Column, arity: int = ARITY) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(*_others(s, arity))), "")


def folded(leaf: Column, steps: Column, arity: int = ARITY) -> Column:
    """The root that a leaf gives with the siblings of steps."""

    def one(digest: Column, s: Column) -> Column:
        before, behind = _others(s, arity)
        return F.when(s["single"], digest).otherwise(F.sha2(F.concat(before, digest, behind).cast("binary"), 256))

    return F.aggregate(steps, leaf, one)


def manifest(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", arity: int = ARITY, checked: Column | None = None, fan: int = FAN) -> DataFrame:
    """key, leaf, subroot, root, steps (the proof: pos, hashes, single of each run up to the root), proof_sha256, folded_root, verified.

    folded_root is of the digest in checked where that is not null (what a row hashes to now), else of the leaf.
    """
    spark = rows.sparkSession
    leaf = leaf_digest(*[F.col(c) for c in columns])
    checked = F.lit(None).cast("string") if checked is None else checked
    leaves = rows.select(F.col(group).cast("string").alias("_group"), F.col(key).cast("long").alias("_key"), leaf.alias("leaf"), checked.alias("checked"))
    leaves, trees = numbered(leaves, "_group", ["_key", "leaf"], "leaves")
    schema = "doc_id long, leaf string, subroot string, root string, steps array<struct<pos:int,hashes:array<string>,single:boolean>>, proof_sha256 string, folded_root string, verified boolean"
    if not trees:
        return spark.createDataFrame([], schema)
    runs = tree_reduce(leaves, trees, arity, fan)
    root = runs.where("kind = 'root'").first()["hashes"][0]
    own = leaves.select(F.col("group_no").alias("tree"), F.floor(F.col("place") / arity).alias("run"), (F.col("place") % arity).cast("int").alias("pos"), F.col("_key").alias("doc_id"), "leaf", "checked")
    joined = own.join(_paths(runs, arity), ["tree", "run"])
    steps = F.concat(F.array(F.struct("pos", "hashes", "single")), F.col("above"))
    told = joined.select("doc_id", "leaf", "checked", "subroot", F.lit(root).alias("root"), steps.alias("steps"))
    proofs = told.withColumns({"proof_sha256": F.sha2(siblings_text(F.col("steps"), arity).cast("binary"), 256), "folded_root": folded(F.coalesce("checked", "leaf"), F.col("steps"), arity)})
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root")).drop("checked")


def tampered(docs: DataFrame) -> Column:
    """Where 5 divides the crc of doc_id: the leaf of the row with its text's letters A-Z in lower case; else null."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return F.when(hit, leaf_digest(*[text if c == "text" else F.col(c) for c in COLUMNS]))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """The manifest's columns without the proofs themselves, folded with the tampered rows."""
    return manifest(docs, checked=tampered(docs)).drop("steps")
