"""Trie of conversation prefixes by rolling fingerprints, exact by verification, rolled up to the root by doubling.

A conversation's prefix of d turns has the polynomial F(d) = F(d-1) + h(d) * B^(d-1) in two prime fields, h being a hash of role
and text. Turns are dealt into ranges of (conversation, place); numpy scans every range, and one row a range carries the value of a
conversation that a range's end cuts, so no conversation is gathered. Equal (depth, F) are candidates for one node.

Every candidate group is verified turn by turn: what each member has at this depth (role, whole text, and the fingerprint
before it) is compared with what its representative, the smallest conversation, has, as a minimum and a maximum that are
combined before the shuffle; groups that are pure down to the root are prefixes that are equal in full. Where a group is mixed,
members that differ from the representative get the number of their kind, which one more polynomial carries on from that turn, and
all is scanned and verified again until every group is pure: no collision is left, whatever the hashes.

Sums over subtrees use pointer doubling: after k steps a node knows its ancestor 2^k levels up and the sum over descendants
less than 2^k levels down; so a trie of depth D takes log2 D rounds, each one aggregate and one join.

Edge cases: null role or text is empty; null turns come first; ties are ordered by role, then text; repeated rows are
turns; rows with a null conv_id are one conversation, which is rebuilt from its own turns, is the smallest member only of nodes that
no other one has (conv_id and parent_conv_id are null there), and is left out of ends_sha256; c % 5 is never negative; extra columns are
ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.ordered import Polynomial, numbered
from netquarry.llm.runtime import join_keyed, map_arrow, settled, stored

PRIMES = (2147483647, 2147483629)
BASES = (1318231217, 987654103)
#: Rounds of verification after which collisions count as an error.
ROUNDS = 30
#: Every so many conversations there is one whose first turns the next ones take over: fewer than so many turns.
BORROW_EVERY, BORROW_MOST = 5, 9
#: Bytes of the id lists that are joined before they are hashed in order.
CHUNK = 1 << 16


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place of the turn, from 0), role, text."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    placed, _ = numbered(rows, "conv_id", ["turn", "role", "text"], "turns")
    return placed.select("conv_id", F.col("place").alias("i"), "role", "text")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, own, i, role, text; conversations: conv_id): each conversation c begins with the first crc32(c) % 9 turns of
    c - c % 5 (own is false) and goes on with its own turns after as many. (own, i) is the order of its turns."""
    placed = turn_rows(conversations)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BORROW_EVERY))
    borrowed = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROW_MOST, F.lit(0))
    convs = stored(placed.where("i = 0").select("conv_id", base.alias("base"), borrowed.alias("h")), "conversations")
    # A base has fewer than BORROW_MOST turns to give, to BORROW_EVERY conversations.
    first = placed.where((F.col("i") < BORROW_MOST - 1) & (F.pmod("conv_id", F.lit(BORROW_EVERY)) == 0)).select(F.col("conv_id").alias("base"), "i", "role", "text")
    taken = convs.join(first, "base").where("i < h").select("conv_id", F.lit(False).alias("own"), "i", "role", "text")
    rest = placed.where(F.col("i") >= borrowed).select("conv_id", F.lit(True).alias("own"), "i", "role", "text")
    return taken.unionByName(rest), convs.select("conv_id")


def fingerprints(turns: DataFrame, order: list[str], salts: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv_id, depth, role, text, last, f (of the turns up to this one) and g (of those before it)."""
    hashes = {f"h{k}": F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(p - 1)) + 1 for k, p in enumerate(primes)}
    rows = turns.select("conv_id", *order, "role", "text").withColumns(hashes)
    polynomials = [Polynomial(f"h{k}", BASES[k] % p, p) for k, p in enumerate(primes)]
    if salts is not None:
        keyed = salts.select(F.col("conv_id").alias("_conv"), *[F.col(c).alias(f"_{c}") for c in order], "salt")
        same = [F.equal_null(F.col(c), F.col(k)) for c, k in zip(["conv_id", *order], ["_conv", *[f"_{c}" for c in order]], strict=True)]
        rows = rows.join(keyed, same, "left").select("conv_id", *order, "role", "text", "h0", "h1", F.coalesce("salt", F.lit(0)).alias("salt"))
        polynomials.append(Polynomial("salt", BASES[0], PRIMES[1]))
    scanned, _ = numbered(rows, "conv_id", order, "prefixes", tuple(polynomials))
    whole = {c: F.shiftleft(F.col(f"{c}0"), 31) + F.col(f"{c}1") for c in "fg"}
    if salts is not None:
        whole = {c: F.when(F.col(f"{c}2") == 0, v).otherwise(F.xxhash64(v, f"{c}2")) for c, v in whole.items()}
    return scanned.select("conv_id", (F.col("place") + 1).alias("depth"), *order, "role", "text", "last", *[v.alias(c) for c, v in whole.items()])


def verified_nodes(turns: DataFrame, order: list[str], primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """(nodes: depth, f, g, conv_id, n_convs, bytes; ends: conv_id, depth, f), equal fingerprints being equal prefixes."""
    salts = None
    for _ in range(ROUNDS):
        scanned = fingerprints(turns, order, salts, primes)
        what = F.struct("g", "role", "text")
        groups = scanned.groupBy("depth", "f").agg(F.min(what).alias("lo"), F.max(what).alias("hi"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        groups = stored(groups.select("depth", "f", F.col("lo.g").alias("g"), "conv_id", "n_convs", F.octet_length("lo.text").cast("long").alias("bytes"), (F.col("lo") != F.col("hi")).alias("mixed")), "groups")
        mixed = groups.where("mixed")
        if not mixed.limit(1).count():
            return groups.drop("mixed"), scanned.where("last").select("conv_id", "depth", "f")
        salts = stored(_salts(scanned, mixed, order, salts), "salts")
    raise RuntimeError(f"fingerprints still collide after {ROUNDS} rounds")


def _salts(scanned: DataFrame, mixed: DataFrame, order: list[str], before: DataFrame | None) -> DataFrame:
    """Of each member of a mixed group that differs from its representative: the number of its kind, beside earlier ones."""
    members = scanned.join(mixed.select("depth", "f"), ["depth", "f"])
    kind = ["depth", "f", "g", "role", "text"]
    kinds = members.groupBy(*kind).agg(F.min("conv_id").alias("first"))
    # The representative's kind has number 1. There are as few kinds in a group as collisions.
    kinds = kinds.withColumn("number", F.row_number().over(Window.partitionBy("depth", "f").orderBy(F.col("first").asc_nulls_last(), "g", "role", "text")))
    new = members.join(kinds.where("number > 1"), kind).select("conv_id", *order, F.col("number").cast("long").alias("salt"))
    both = new if before is None else new.unionByName(before)
    return both.groupBy("conv_id", *order).agg(F.pmod(F.xxhash64(F.sort_array(F.collect_list("salt"))), F.lit(PRIMES[1])).alias("salt"))


def _chunks(batches):
    """Id lists of stretches of a node's sorted rows."""
    key, ids, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["depth", "f", "first", "ids"])

    for batch in batches:
        for depth, f, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "f", "conv_id")], strict=True):
            if key != (depth, f) or size > CHUNK:
                if ids:
                    yield out()
                key, ids, size, first = (depth, f), [], 0, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _hashed(batches):
    """Digest of each node's sorted stretches, one after another."""
    key, digest, rows = None, None, []
    for batch in batches:
        for depth, f, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "f", "ids")], strict=True):
            if key != (depth, f):
                if key:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (depth, f), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digest_batch(rows)
        rows = []
    if key:
        yield _digest_batch([(*key, digest.hexdigest())])


def _digest_batch(rows):
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "f", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, f, ends_sha256: of the conversations that end at a node. Lists are joined in stretches where they lie, then hashed in order."""
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["depth", "f", "conv_id"]
    listed = ends.where("conv_id is not null").select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = map_arrow(listed, _chunks, "depth long, f long, first long, ids string")
    gathered = chunks.repartition(parts, "depth", "f").sortWithinPartitions("depth", "f", "first")
    return map_arrow(gathered, _hashed, "depth long, f long, ends_sha256 string")


def roll_up(tree: DataFrame, depth: int) -> DataFrame:
    """id, n_leaves and saved_tokens over subtrees, of a tree (id, parent, leaves, saved) that is so many levels deep."""
    spark = tree.sparkSession
    state = tree.select("id", F.col("parent").alias("up"), F.col("leaves").cast("long").alias("leaves"), F.col("saved").cast("long").alias("saved"))
    for _ in range(depth.bit_length()):
        state = settled(spark, "doubled", lambda now=state: _doubled(now))
    return state.select("id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _doubled(now: DataFrame) -> DataFrame:
    """Ancestors twice as far up, and sums over twice as many levels."""
    sums = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("below"))
    met = stored(now.join(sums, "id", "left").select("id", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), "below"), "met")
    far = met.where("below is not null").select(F.col("id").alias("up"), F.col("up").alias("far"), "below")
    moved = join_keyed(met.where("up is not null").select("id", "up", "leaves", "saved"), far, ["up"], "below").select("id", F.col("far").alias("up"), "leaves", "saved")
    return moved.unionByName(met.where("up is null").select("id", "up", "leaves", "saved"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, order: list[str], primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row a distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv_id, role, text and the columns of order; conversations names all of them, with turns or without.
    """
    nodes, ends = verified_nodes(turns, order, primes)
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("f"), zero.alias("g"), "conv_id", "n_convs", zero.alias("bytes"))
    turnless = conversations.join(ends.select(F.col("conv_id").alias("ended")), F.equal_null("conv_id", "ended"), "left_anti")
    ends = ends.unionByName(turnless.select("conv_id", zero.alias("depth"), zero.alias("f")))
    every = nodes.unionByName(root)
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("g").alias("f")).agg(F.count("*").alias("n_children"))
    # Nodes are numbered as they are written; the table fixes the numbers.
    every = every.join(kids, ["depth", "f"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    every = stored(every.join(end_digests(ends), ["depth", "f"], "left").withColumn("id", F.monotonically_increasing_id()), "nodes")
    parents = every.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f").alias("g"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    placed = join_keyed(every.where("depth > 0"), parents, ["depth", "g"], "siblings").drop("siblings")
    none = F.lit(None).cast("long")
    tree = stored(placed.unionByName(every.where("depth = 0").withColumns({"parent": none, "parent_conv_id": none})), "tree")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    sums = roll_up(tree.select("id", "parent", (F.col("n_children") == 0).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), int(deepest))
    empty = F.lit(hashlib.sha256().hexdigest())
    return tree.join(sums, "id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def trie_digests(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The trie of rebuilt conversations."""
    turns, convs = found
    return prefix_trie(turns, convs, ["own", "i"])
