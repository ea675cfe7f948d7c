"""Typed property graphs: construction, pruning, coalescing, similarity, suggestions.

A graph is a table of edges (src, src_type, dst, dst_type, etype), undirected and simple, and `adjacency` is its symmetric
view (id, type, nbr, nbr_type). Ties are always ordered by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netquarry.functions import ip as ipf
from netquarry.functions.text import group_name, keywords
from netquarry.operators.numbering import numbered_in
from netquarry.session import one_blas_thread, parts_for, ship, stored


def _edges(df: DataFrame, src: Column, src_type: str, dst: Column, dst_type: str, etype: Column | None = None) -> DataFrame:
    kept = df.where(src.isNotNull() & dst.isNotNull())
    return kept.select(src.cast("string").alias("src"), F.lit(src_type).alias("src_type"), dst.cast("string").alias("dst"), F.lit(dst_type).alias("dst_type"), (F.lit(None) if etype is None else etype).cast("string").alias("etype"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: one edge a pair of nodes; of parallel edges the one with the largest seq (last writer) gives the type."""
    forward = F.col("src") <= F.col("dst")
    turned = edges.select(*[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("src", "dst"), ("src_type", "dst_type"))], *[F.when(forward, F.col(b)).otherwise(F.col(a)).alias(b) for a, b in (("src", "dst"), ("src_type", "dst_type"))], "etype", "seq")
    return turned.groupBy("src", "src_type", "dst", "dst_type").agg(F.max_by("etype", "seq").alias("etype"))


def config_graph(configs: DataFrame) -> DataFrame:
    """Edges of configuration documents (name, interfaces, acls): ACL with its networks, interface with subnet, VLANs and ACLs.

    Interfaces named Vlan<n> belong to the whole network; the others are <device>_<interface>. An ACL that is applied but
    not defined is a node of type acl all the same.
    """
    ifaces = configs.select(F.col("name").alias("device"), F.explode("interfaces").alias("key", "i"))
    is_vlan = F.col("key").rlike("^Vlan")
    node = F.when(is_vlan, F.col("key")).otherwise(F.concat_ws("_", "device", "key"))
    ifaces = ifaces.select("device", node.alias("node"), F.when(is_vlan, "vlan").otherwise("interface").alias("kind"), "i")
    acls = configs.select(F.col("name").alias("device"), F.explode("acls").alias("acl", "a")).select("device", F.concat_ws("_", "device", "acl").alias("node"), F.posexplode("a.lines").alias("line_no", "line"))
    nets = acls.select("node", "line_no", "line.action", F.expr("stack(2, 'src', line.srcIps, 'dst', line.dstIps)").alias("side", "cidr")).where("cidr is not null")
    nets = nets.withColumn("net", ipf.strict_network(F.col("cidr"))).where("net is not null and net.length > 0")
    net_text = F.concat(ipf.format_ip(F.col("net.lo")), F.lit("/"), F.col("net.length").cast("string"))
    address = F.col("i.address")
    own_net = F.concat(ipf.format_ip(ipf.network(ipf.address_of(address), ipf.prefix_of(address))), F.lit("/"), ipf.prefix_of(address).cast("string"))
    vlans = ifaces.where("kind = 'interface'").select("node", F.explode("i.allowed_vlans").alias("v"))
    parts = [
        _edges(nets, F.col("node"), "acl", net_text, "subnet", F.concat_ws(",", "action", "side")),
        _edges(ifaces.where("kind = 'interface'"), F.col("node"), "interface", own_net, "subnet"),
        _edges(ifaces.where("kind = 'vlan'"), F.col("node"), "vlan", own_net, "subnet"),
        _edges(vlans, F.col("node"), "interface", F.concat(F.lit("Vlan"), F.col("v").cast("string")), "vlan", F.lit("allowed")),
    ]
    for side in ("in", "out"):
        for kind in ("interface", "vlan"):
            parts.append(_edges(ifaces.where(F.col("kind") == kind), F.col("node"), kind, F.when(F.col(f"i.{side}_acl").isNotNull(), F.concat_ws("_", "device", f"i.{side}_acl")), "acl", F.lit(side)))
    return union(*[p.withColumn("seq", F.lit(k)) for k, p in enumerate(parts)])


def keyword_edges(documents: DataFrame) -> DataFrame:
    """Edges of keyword documents (name, interfaces, acls) from owners to words."""
    i = documents.select(F.col("name").alias("device"), F.explode("interfaces").alias("key", "words")).select("device", "key", F.explode("words").alias("word"))
    node = F.when(F.col("key").rlike("^Vlan"), F.col("key")).otherwise(F.concat_ws("_", "device", "key"))
    a = documents.select(F.col("name").alias("device"), F.explode("acls").alias("key", "words")).select("device", "key", F.explode("words").alias("word"))
    return union(
        _edges(i.where(~F.col("key").rlike("^Vlan")), node, "interface", F.col("word"), "keyword"),
        _edges(i.where(F.col("key").rlike("^Vlan")), node, "vlan", F.col("word"), "keyword"),
        _edges(a, F.concat_ws("_", "device", "key"), "acl", F.col("word"), "keyword"),
    ).withColumn("seq", F.lit(100))


def keyword_document_edges(configs: DataFrame) -> DataFrame:
    """Edges to the words of interface descriptions and ACL names, straight from configurations."""
    i = configs.select(F.col("name").alias("device"), F.explode("interfaces").alias("key", "i")).select("device", "key", F.explode(keywords(F.col("i.description"))).alias("word"))
    return _edges(i, F.concat_ws("_", "device", "key"), "interface", F.col("word"), "keyword").withColumn("seq", F.lit(100))


def union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for more in rest:
        first = first.unionByName(more)
    return first


def adjacency(edges: DataFrame) -> DataFrame:
    there = edges.select(F.col("src").alias("id"), F.col("src_type").alias("type"), F.col("dst").alias("nbr"), F.col("dst_type").alias("nbr_type"))
    back = edges.select(F.col("dst").alias("id"), F.col("dst_type").alias("type"), F.col("src").alias("nbr"), F.col("src_type").alias("nbr_type"))
    return there.union(back).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.col("src_type").alias("type")).union(edges.select("dst", "dst_type")).distinct()


#: Nodes that a round of prune_degree_one removes without dealing the edges anew.
MANY_LOW = 100_000


def prune_degree_one(edges: DataFrame, kind: str | None = None, max_rounds: int = 1000) -> DataFrame:
    """Edges left when nodes of degree 0 or 1 (of one type only, if given) are removed again and again: the 2-core."""
    now = stored(edges)
    parts = parts_for(now.count(), edges.sparkSession)
    for _ in range(max_rounds):
        ends = now.select(F.col("src").alias("id"), F.col("src_type").alias("type")).unionAll(now.select("dst", "dst_type"))
        low = ends.groupBy("id", "type").agg(F.count("*").alias("degree")).where("degree < 2")
        low = stored((low if kind is None else low.where(F.col("type") == kind)).select("id"))
        gone = low.count()
        if not gone:
            return now
        for end in ("src", "dst"):
            # Few low nodes are broadcast; for many, edges are sorted in parts that do not grow with the graph.
            dealt = now if gone < MANY_LOW else now.repartition(parts, end)
            now = dealt.join(low.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
        now = stored(now)
    raise RuntimeError("pruning did not settle")


def neighbors(adj: DataFrame, kind: str | None = None, nbr_kind: str | None = None) -> DataFrame:
    """id, n: number of neighbours, by type."""
    kept = adj if kind is None else adj.where(F.col("type") == kind)
    kept = kept if nbr_kind is None else kept.where(F.col("nbr_type") == nbr_kind)
    return kept.groupBy("id").agg(F.count_distinct("nbr").alias("n"))


#: Nodes of a block whose pairs one task makes; those of a block with more are dealt over the pairs of so many parts.
PAIRED_AT_ONCE = 4_096
#: A block is so many 64-bit words of neighbours.
WORDS = 4


def neighbor_bits(of: DataFrame, least: int = 2) -> DataFrame:
    """nbr, block, bit: a place for each neighbour of (id, nbr) that at least so many ids have.

    Neighbours are numbered by how many ids they have, most first, so hubs share a block of words: two nodes that have many of them in
    common meet in a few rows, not once for each. Where a block would bring more pairs together than its neighbours do one
    by one, each of them has a block of its own, numbered below zero.
    """
    sizes = of.groupBy("nbr").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # The number within a range of the order is the bit; ranges have blocks of their own.
    ordered = sizes.repartitionByRange(F.desc("n"), "nbr").sortWithinPartitions(F.desc("n"), "nbr").withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered.select("nbr", "n", "at", F.floor(F.col("at") / (64 * WORDS)).alias("block")), "bits")
    nodes = of.select("id").distinct().agg(F.count("*").alias("nodes"))
    # One row is broadcast. A block has no more nodes than its neighbours have in sum, nor than there are.
    dense = ordered.groupBy("block").agg(F.sum("n").cast("double").alias("most"), F.sum(F.col("n").cast("double") * F.col("n")).alias("apart")).join(F.broadcast(nodes)).where(F.least("most", F.col("nodes").cast("double")) ** 2 <= F.col("apart")).select("block", F.lit(True).alias("dense"))
    placed = ordered.join(dense, "block", "left")
    return stored(placed.select("nbr", F.when(F.col("dense"), F.col("block")).otherwise(-1 - F.col("at")).alias("block"), F.when(F.col("dense"), F.col("at") % (64 * WORDS)).otherwise(0).cast("int").alias("bit")), "bits")


def neighbor_words(of: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """id, block, w0, w1, ...: the neighbours of each id, of (id, nbr), as bits. A neighbour of one id only has no bit, nothing can be
    shared through it, unless bits, of neighbor_bits, say otherwise."""
    one = F.expr("shiftleft(1L, bit % 64)")
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, one).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return of.distinct().join(neighbor_bits(of) if bits is None else bits, "nbr").groupBy("id", "block").agg(*words)


def _overlap(one: str, other: str) -> Column:
    return sum((F.bit_count(F.col(f"{one}{k}").bitwiseAND(F.col(f"{other}{k}"))) for k in range(WORDS)), F.lit(0))


def _words(words: DataFrame, node: str, letter: str, *more: Column) -> DataFrame:
    return words.select("block", F.col("id").alias(node), *more, *[F.col(f"w{k}").alias(f"{letter}{k}") for k in range(WORDS)])


def _meeting(words: DataFrame, *own: str) -> DataFrame:
    """Rows of two nodes a < b that share a neighbour of a block, with the number of these as overlap; the columns in own of each are
    a_<name> and b_<name>. The nodes of a block are cut into parts by hash, and each pair of parts is a group of its own."""
    sizes = stored(words.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    dealt = words.join(sizes, "block").withColumn("parts", F.ceil(F.col("n") / PAIRED_AT_ONCE).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = _words(dealt, "a", "x", *[F.col(c).alias(f"a_{c}") for c in own], F.col("mine").alias("i"), others.alias("j"))
    right = _words(dealt, "b", "y", *[F.col(c).alias(f"b_{c}") for c in own], F.col("mine").alias("j"), others.alias("i"))
    return left.join(right, ["block", "i", "j"]).where("a < b").withColumn("overlap", _overlap("x", "y")).where("overlap > 0")


#: Nodes of a side of a cell at most, about: a cell makes all pairs of its two sides at once.
CELL_SIDE = 2_048
#: Cells are dealt over so many tasks at most.
MOST_TASKS = 2_000


def _is_dense(of: DataFrame) -> bool:
    """Whether two nodes meet at many neighbours on average: one hub alone, however large, is not dense."""
    meetings = of.groupBy("nbr").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    return meetings > 16 * of.select("id").distinct().count() ** 2


def _words_of_parts(parts: list[DataFrame], bits: list[DataFrame | None]) -> DataFrame:
    """id, part, degree, blocks, words: the neighbours of each node of the parts (id, nbr) as bits, blocks in their order."""
    rows = []
    for k, (of, own) in enumerate(zip(parts, bits, strict=True)):
        listed = F.array_sort(F.collect_list(F.struct("block", F.array(*[f"w{w}" for w in range(WORDS)]).alias("w"))))
        words = neighbor_words(of, own).groupBy("id").agg(listed.alias("x"))
        degree = of.groupBy("id").agg(F.count("*").alias("degree"))
        rows.append(words.join(degree, "id").select("id", F.lit(k).alias("part"), "degree", F.col("x.block").alias("blocks"), F.flatten("x.w").alias("words")))
    return union(*rows)


def _dealt_to_cells(nodes: DataFrame) -> DataFrame:
    """i, j, left and the columns of nodes: each node in the cells of its group with every group."""
    groups = max(1, -(-nodes.select("id").distinct().count() // CELL_SIDE))
    mine, other = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.col("other")
    dealt = nodes.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # A cell is little data and much work: Spark must not put many into one task by their size.
    tasks = min(groups * (groups + 1) // 2, MOST_TASKS)
    return dealt.select(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), (F.col("mine") <= other).alias("left"), *nodes.columns).repartition(tasks, "i", "j")


def _side(table: pa.Table, ids: np.ndarray, part: int):
    """Degrees of the nodes ids in a part, and where their words are: node, block, words."""
    own = table.filter(pc.equal(table["part"], part))
    at = np.searchsorted(ids, own["id"].to_numpy(zero_copy_only=False))
    degree = np.zeros(len(ids), np.int64)
    degree[at] = own["degree"].to_numpy()
    blocks = own["blocks"].combine_chunks()
    node = np.repeat(at, pc.list_value_length(blocks).to_numpy(zero_copy_only=False))
    return degree, node, blocks.flatten().to_numpy(), own["words"].combine_chunks().flatten().to_numpy().reshape(-1, WORDS)


def _shared(n: int, m: int, left, right) -> np.ndarray:
    """How many neighbours each node of one side shares with each of the other: a product of bits, some blocks at a time."""
    counts = np.zeros((n, m), np.float32)
    both = np.intersect1d(left[2], right[2])
    for k in range(0, len(both), 16):
        some = both[k : k + 16]
        tables = []
        for size, (_, node, block, words) in ((n, left), (m, right)):
            at = np.minimum(np.searchsorted(some, block), len(some) - 1)
            kept = some[at] == block
            bits = np.zeros((size, len(some), 64 * WORDS), np.float32)
            bits[node[kept], at[kept]] = np.unpackbits(np.ascontiguousarray(words[kept]).view(np.uint8), axis=1)
            tables.append(bits.reshape(size, -1))
        counts += tables[0] @ tables[1].T
    return counts


def _sides(table: pa.Table) -> tuple[bool, list[pa.Table], list[np.ndarray]]:
    """Whether a cell is of one group, its two sides, and the ids of each in their order."""
    same = table["i"][0].as_py() == table["j"][0].as_py()
    sides = [table.filter(table["left"]), table.filter(pc.invert(table["left"]))]
    if same:
        sides[1] = sides[0]
    return same, sides, [np.unique(s["id"].to_numpy(zero_copy_only=False)) if len(s) else np.array([], object) for s in sides]


def _shares(sides: list[pa.Table], ids: list[np.ndarray], weights: list[float]) -> list[np.ndarray]:
    """The weighted shares that each node of one side has in common with each of the other: of its own neighbours, and of the other's."""
    share = [np.zeros((len(ids[0]), len(ids[1]))), np.zeros((len(ids[0]), len(ids[1])))]
    for part, weight in enumerate(weights):
        first, second = (_side(s, x, part) for s, x in zip(sides, ids, strict=True))
        common = _shared(len(ids[0]), len(ids[1]), first, second).astype(np.float64)
        share[0] += common / np.maximum(first[0], 1)[:, None] * weight
        share[1] += common / np.maximum(second[0], 1)[None, :] * weight
    return share


def _alike(share: list[np.ndarray], threshold: float) -> np.ndarray:
    return (share[0] >= threshold) & (share[1] >= threshold) & ~((share[0] == 1) & (share[1] == 1))


def _cell_pairs(weights: list[float] | None, threshold: float, kind: pa.DataType):
    """Pairs of a cell: with the counts of one part, or with the weighted shares of all parts that reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        one_blas_thread()
        same, sides, ids = _sides(table)
        n, m = map(len, ids)
        if not n or not m:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        if weights is None:
            first, second = (_side(s, x, 0) for s, x in zip(sides, ids, strict=True))
            common = _shared(n, m, first, second)
            kept = common > 0
        else:
            share = _shares(sides, ids, weights)
            kept = _alike(share, threshold)
        if same:
            kept = np.triu(kept, 1)
        x, y = np.nonzero(kept)
        every = np.unique(np.concatenate(ids))
        places = [np.searchsorted(every, side) for side in ids]
        a, b = places[0][x], places[1][y]
        turned = a > b
        a, b = np.minimum(a, b), np.maximum(a, b)
        pool = pa.array(every.tolist(), kind)
        out = [pool.take(pa.array(a)), pool.take(pa.array(b))]
        one, other = (first[0][x], second[0][y]) if weights is None else (share[0][x, y], share[1][x, y])
        out += [pa.array(common[x, y].astype(np.int64))] if weights is None else []
        out += [pa.array(np.where(turned, other, one)), pa.array(np.where(turned, one, other))]
        return pa.table(dict(zip(names, out, strict=True)))

    names = {"a": kind, "b": kind} | ({"common": pa.int64(), "da": pa.int64(), "db": pa.int64()} if weights is None else {"pa": pa.float64(), "pb": pa.float64()})
    return run


def _in_cells(parts: list[DataFrame], weights: list[float] | None = None, threshold: float = 0.0) -> DataFrame:
    """Pairs of nodes that are made, counted and chosen in one task each, so no shuffle holds them: a, b (a < b), and common, da, db of the one
    part, or pa, pb of the weighted parts. Nodes are dealt into groups, a cell is two of these, and its nodes come to it as bits."""
    ship(parts[0].sparkSession)
    kind = parts[0].schema["id"].dataType
    more = "common long, da long, db long" if weights is None else "pa double, pb double"
    run = _cell_pairs(weights, threshold, to_arrow_type(kind))
    nodes = stored(_words_of_parts(parts, [None] * len(parts)), "nodes")
    return _dealt_to_cells(nodes).groupBy("i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, {more}")


def _offered(near: np.ndarray, likes, rows: int) -> dict[int, np.ndarray]:
    """By block, the bits that a node's like ones (near: node, like) have between them, as a table of 0 and 1 with `rows` rows."""
    _, node, block, words = likes
    out = {}
    x, y = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(x):
        return out
    place = np.full(near.shape[1], -1)
    place[y] = np.arange(len(y))
    kept = place[node] >= 0
    node, block, words = place[node[kept]], block[kept], words[kept]
    few = near[np.ix_(x, y)].astype(np.float32)
    every = np.unique(block)
    for k in range(0, len(every), 16):
        some = every[k : k + 16]
        at = np.minimum(np.searchsorted(some, block), len(some) - 1)
        own = some[at] == block
        bits = np.zeros((len(y), len(some), 64 * WORDS), np.float32)
        bits[node[own], at[own]] = np.unpackbits(np.ascontiguousarray(words[own]).view(np.uint8), axis=1)
        met = (few @ bits.reshape(len(y), -1) > 0).reshape(len(x), len(some), -1)
        for j, b in enumerate(some):
            out[int(b)] = np.zeros((rows, 64 * WORDS), np.uint8)
            out[int(b)][x] = met[:, j]
    return out


def _cell_offers(weights: list[float], threshold: float, grid: list[float], kind: pa.DataType):
    """node, level, block, x0, x1, ...: of each node of a cell, the bits that its like ones there have and it lacks. A level is how many scores of the
    grid a pair reaches; the last part has the neighbours to offer, and tells by their number who offers to whom."""
    names = ["node", "level", "block", *[f"x{k}" for k in range(WORDS)]]

    def run(table: pa.Table) -> pa.Table:
        one_blas_thread()
        same, sides, ids = _sides(table)
        out = [(pa.array([], kind), *[np.zeros(0, np.int64)] * (2 + WORDS))]
        if all(map(len, ids)):
            share = _shares(sides, ids, weights)
            kept = _alike(share, threshold)
            if same:
                np.fill_diagonal(kept, False)
            # A score counts in nine places.
            score = np.minimum(share[0], share[1])
            level = np.zeros(kept.shape, np.int8)
            for t in grid:
                level += score >= t - 5e-10
            del share, score
            wholes = [_side(s, x, len(weights)) for s, x in zip(sides, ids, strict=True)]
            ways = [(0, 1, kept & (wholes[0][0][:, None] <= wholes[1][0][None, :]))]
            if not same:
                ways.append((1, 0, (kept & (wholes[1][0][None, :] <= wholes[0][0][:, None])).T))
            for node, like, near in ways:
                levels = level if node == 0 else level.T
                _, place, block, words = wholes[node]
                for at in np.unique(levels[near]):
                    for b, bits in _offered(near & (levels == at), wholes[like], len(ids[node])).items():
                        told = np.packbits(bits, axis=1).view(np.int64)
                        own = block == b
                        told[place[own]] &= ~words[own]
                        some = np.flatnonzero(told.any(1))
                        out.append((pa.array(ids[node][some].tolist(), kind), np.full(len(some), at, np.int64), np.full(len(some), b, np.int64), *told[some].T))
        columns = [pa.concat_arrays([x[0] for x in out]), *[pa.array(np.concatenate([x[k] for x in out])) for k in range(1, 3 + WORDS)]]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def similar_links(adj: DataFrame, kind: str, weights: dict[str, float], threshold: float, grid: list[float] | None = None) -> DataFrame:
    """node, suggestion, score: what scored_links gives for similar_nodes; a score is the largest of the ascending grid that a pair reaches (null: none).

    Where nodes meet more often than there are pairs, a cell folds its pairs to what its nodes lack, so no pair leaves it: a row a node, level and
    block of bits. Nodes with the same neighbours are one there, as they are like the same nodes and offer one another nothing.
    """
    grid = [float(t) for t in grid or []]
    adj = stored(adj.where(F.col("type") == kind), "adjacency")
    main = max(_needed(weights, threshold), key=_needed(weights, threshold).get, default=None)
    if main is None or _needed(weights, threshold)[main] <= 0 or not _is_dense(_of(adj, kind, main)):
        reached = F.array_max(F.filter(F.array(*map(F.lit, grid)).cast("array<double>"), lambda t: t <= F.round(F.least("pa", "pb"), 9)))
        return scored_links(adj, similar_nodes(adj, kind, weights, threshold).select("a", "b", reached.alias("score")))
    ship(adj.sparkSession)
    whole = adj.select("id", "nbr")
    bits = neighbor_bits(whole, 1)
    words = stored(_words_of_parts([*(_of(adj, kind, k) for k in weights), whole], [None] * len(weights) + [bits]), "words")
    own = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in words.columns if c != "id"]))).alias("parts"))
    own = stored(own.withColumn("hash", F.xxhash64("parts")), "own")
    # Equal hashes are told apart by the words themselves. Neighbours of one node only have no bit in the weighted parts, but in the whole.
    classes = stored(own.groupBy("hash", "parts").agg(F.min("id").alias("cls")), "classes")
    members = own.join(classes, ["hash", "parts"]).select("id", "cls")
    nodes = stored(classes.select(F.col("cls").alias("id"), F.inline("parts")), "nodes")
    name = whole.schema["id"].dataType
    run = _cell_offers([float(w) for w in weights.values()], threshold, grid, to_arrow_type(name))
    fields = ", ".join(f"x{k} long" for k in range(WORDS))
    offers = _dealt_to_cells(nodes).groupBy("i", "j").applyInArrow(run, f"node {name.simpleString()}, level long, block long, {fields}")
    lacking = offers.groupBy("node", "level", "block").agg(*[F.bit_or(f"x{k}").alias(f"x{k}") for k in range(WORDS)])
    links = stored(_named_bits(lacking.withColumn("told", F.array(*[f"x{k}" for k in range(WORDS)])), bits, "level"), "links")
    each = links.groupBy("node", "suggestion").agg(F.max("level").alias("level"))
    score = F.get(F.array(*map(F.lit, grid)).cast("array<double>"), F.col("level").cast("int") - 1)
    return members.withColumnRenamed("cls", "node").join(each, "node").where("id <> suggestion").select(F.col("id").alias("node"), "suggestion", score.alias("score"))


def shared_counts(of: DataFrame) -> DataFrame:
    """a, b (a < b), common: the pairs of ids that have neighbours in common, of (id, nbr), and how many."""
    of = stored(of.distinct(), "of")
    if _is_dense(of):
        return _in_cells([of]).select("a", "b", "common")
    return _meeting(stored(neighbor_words(of), "words")).groupBy("a", "b").agg(F.sum("overlap").alias("common"))


def common_neighbors(adj: DataFrame, kind: str, nbr_kind: str | None = None) -> DataFrame:
    """a, b (a < b, both of one type), common, da, db: neighbours in common and of each. Pairs without any do not appear."""
    kept = stored(_of(adj, kind, nbr_kind), "of")
    if _is_dense(kept):
        return _in_cells([kept])
    return _with_degrees(shared_counts(kept), kept)


def _of(adj: DataFrame, kind: str, nbr_kind: str | None) -> DataFrame:
    kept = adj.where(F.col("type") == kind)
    return (kept if nbr_kind is None else kept.where(F.col("nbr_type") == nbr_kind)).select("id", "nbr")


def _with_degrees(pairs: DataFrame, of: DataFrame) -> DataFrame:
    degree = of.groupBy("id").agg(F.count("*").alias("degree"))
    for end in "ab":
        pairs = pairs.join(degree.select(F.col("id").alias(end), F.col("degree").alias(f"d{end}")), end)
    return pairs.select("a", "b", "common", "da", "db")


def pairs_above(of: DataFrame, share: float) -> DataFrame:
    """a, b (a < b): all pairs, and some more, that have at least this share of each one's neighbours in common.

    A node's neighbours are ordered by how many nodes they have, fewest first. Two nodes of a pair meet within the part of
    their lists that leaves fewer behind than they must share, so a hub, which comes last, brings nobody together but nodes with
    nearly nothing else; and neither has so many more neighbours that the share is out of reach.
    """
    sizes = of.groupBy("nbr").agg(F.count("*").alias("n"))
    listed = of.join(sizes, "nbr").select("id", "nbr", F.struct("n", "nbr").alias("place"))
    degree = of.groupBy("id").agg(F.count("*").alias("degree"))
    slack = F.col("degree") - F.ceil(F.col("degree") * share - 1e-9)
    front = numbered_in(listed, "id", "place").join(degree, "id").where(F.col("k") <= slack).select("id", "nbr")
    words = neighbor_words(stored(front, "fronts")).join(degree, "id")
    met = _meeting(stored(words, "words"), "degree")
    return met.where(F.least("a_degree", "b_degree") >= F.greatest("a_degree", "b_degree") * share - 1e-9).select("a", "b").distinct()


def similarity_proportions(adj: DataFrame, kind: str, nbr_kind: str | None = None) -> DataFrame:
    """a, b, pa, pb: share of each node's neighbours that the other has too."""
    return common_neighbors(adj, kind, nbr_kind).select("a", "b", (F.col("common") / F.col("da")).alias("pa"), (F.col("common") / F.col("db")).alias("pb"))


def _needed(weights: dict[str, float], threshold: float) -> dict[str, float]:
    """The share of the neighbours of each type that similar nodes have in common at least, as the other types cannot make up for it."""
    return {k: (threshold - sum(weights.values()) + w) / w for k, w in weights.items() if w > 0}


def similar_nodes(adj: DataFrame, kind: str, weights: dict[str, float], threshold: float) -> DataFrame:
    """Pairs whose weighted proportions both reach the threshold, and are not both exactly 1.

    Where the other types cannot make up for it, a pair must share some part of the neighbours of one type: only the pairs that can
    are made (pairs_above) and counted, for each type.
    """
    needed = _needed(weights, threshold)
    main = max(needed, key=needed.get, default=None)
    if main is None or needed[main] <= 0:
        parts = [common_neighbors(adj, kind, k).withColumn("weight", F.lit(float(w))) for k, w in weights.items()]
    else:
        adj = stored(adj.where(F.col("type") == kind), "adjacency")
        of_main = _of(adj, kind, main)
        if _is_dense(of_main):
            return _in_cells([_of(adj, kind, k) for k in weights], [float(w) for w in weights.values()], threshold)
        pairs = stored(pairs_above(of_main, needed[main]), "pairs")
        parts = []
        for k, w in weights.items():
            of = _of(adj, kind, k)
            words = stored(neighbor_words(of), "words")
            both = pairs.join(_words(words, "a", "x"), "a").join(_words(words, "b", "y"), ["b", "block"])
            counted = both.groupBy("a", "b").agg(F.sum(_overlap("x", "y")).alias("common")).where("common > 0")
            parts.append(_with_degrees(counted, of).withColumn("weight", F.lit(float(w))))
    share = lambda d: F.sum(F.col("common") / F.col(d) * F.col("weight"))
    whole = union(*parts).groupBy("a", "b").agg(share("da").alias("pa"), share("db").alias("pb"))
    return whole.where((F.col("pa") >= threshold) & (F.col("pb") >= threshold) & ~((F.col("pa") == 1) & (F.col("pb") == 1)))


def suggest_links(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, suggestion: the neighbours of a similar node that has at least as many, and that the node itself lacks."""
    return scored_links(adj, pairs.select("a", "b", F.lit(None).cast("double").alias("score"))).select("node", "suggestion")


def scored_links(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """suggest_links with score: the largest one of the pairs (a, b, score) that suggest a link.

    What a node's like ones offer is the union of their neighbours, as words of bits, for each score: rows are as many as scores a node has and
    blocks, not as the neighbours of all its like ones. Scores of few values make few rows.
    """
    of = stored(adj.select("id", "nbr"), "of")
    bits = neighbor_bits(of, 1)
    words = stored(neighbor_words(of, bits), "words")
    degree = of.groupBy("id").agg(F.count("*").alias("degree"))
    ends = pairs.select("a", "b", "score").join(degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    way = lambda node, like: F.struct(F.col(node).alias("node"), F.col(like).alias("like"))
    ways = F.array_compact(F.array(F.when(F.col("da") <= F.col("db"), way("a", "b")), F.when(F.col("db") <= F.col("da"), way("b", "a"))))
    towards = ends.select(F.explode(ways).alias("x"), "score").select("x.node", "x.like", "score")
    offered = towards.join(_words(words, "like", "x"), "like").groupBy("node", "score", "block").agg(*[F.bit_or(f"x{k}").alias(f"x{k}") for k in range(WORDS)])
    lacking = offered.join(_words(words, "node", "y"), ["node", "block"], "left")
    told = F.array(*[F.col(f"x{k}").bitwiseAND(F.bitwise_not(F.coalesce(f"y{k}", F.lit(0).cast("long")))) for k in range(WORDS)])
    named = _named_bits(lacking.withColumn("told", told), bits, "score")
    return named.where("node <> suggestion").groupBy("node", "suggestion").agg(F.max("score").alias("score"))


def _named_bits(rows: DataFrame, bits: DataFrame, more: str) -> DataFrame:
    """node, more, suggestion: the names of the bits that are set in told, the words of a block."""
    places = F.filter(F.sequence(F.lit(0), F.lit(64 * WORDS - 1)), lambda p: F.call_function("shiftright", F.get("told", F.floor(p / 64).cast("int")), p % 64).bitwiseAND(F.lit(1)) == 1)
    named = rows.select("node", more, "block", F.explode(places).alias("bit")).join(bits.withColumnRenamed("nbr", "suggestion"), ["block", "bit"])
    return named.select("node", more, "suggestion")


def rank_suggestions(adj: DataFrame, suggestions: DataFrame, kind: str, most: int = 0) -> DataFrame:
    """Suggestions by the number of neighbours of a type that the suggested node has; the first `most` of each node (0: all)."""
    weight = adj.where(F.col("nbr_type") == kind).groupBy(F.col("id").alias("suggestion")).agg(F.count("*").alias("weight"))
    scored = suggestions.join(weight, "suggestion", "left").select("node", "suggestion", F.coalesce("weight", F.lit(0)).alias("weight"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "suggestion")))
    return ranked if not most else ranked.where(F.col("rank") <= most)


def precision_recall(removed: DataFrame, suggested: DataFrame) -> DataFrame:
    """One row: hits, suggested, removed, precision, recall, over undirected links (src, dst)."""
    key = lambda df: df.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    both = key(removed).withColumn("r", F.lit(1)).join(key(suggested).withColumn("s", F.lit(1)), ["u", "v"], "full")
    counts = both.agg(F.count_if(F.col("r").isNotNull() & F.col("s").isNotNull()).alias("hits"), F.count("s").alias("suggested"), F.count("r").alias("removed"))
    return counts.withColumn("precision", F.try_divide("hits", "suggested")).withColumn("recall", F.try_divide("hits", "removed"))


def precision_recall_curve(removed: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, hits, suggested, precision, recall for each of ascending thresholds, of links (src, dst) removed and (src, dst, score) suggested.

    A link counts for every threshold up to its score, so all thresholds are one count by the highest one that it reaches, summed from
    the top: one pass, however many thresholds there are.
    """
    ends = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")]
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    best = scored.groupBy(*ends).agg(F.max("score").alias("score"))
    gone = removed.select(*ends).distinct().withColumn("gone", F.lit(1))
    level = F.size(F.filter(grid, lambda t: t <= F.col("score")))
    counted = best.join(gone, ["u", "v"], "left").groupBy(level.alias("level")).agg(F.count("*").alias("s"), F.count("gone").alias("h"))
    # A row a threshold from here on.
    rows = gone.agg(F.count("*").alias("removed")).select("removed", F.posexplode(grid).alias("at", "threshold")).withColumn("level", F.col("at") + 1)
    above = Window.orderBy(F.desc("level"))
    whole = rows.join(counted, "level", "left").select("threshold", "removed", F.sum(F.coalesce("h", F.lit(0))).over(above).alias("hits"), F.sum(F.coalesce("s", F.lit(0))).over(above).alias("suggested"))
    return whole.select("threshold", "hits", "suggested", F.try_divide("hits", "suggested").alias("precision"), F.try_divide("hits", "removed").alias("recall"))


def remove_edges(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n edges by a seeded hash: a sample without replacement that is the same each time."""
    return edges.orderBy(F.md5(F.concat_ws("|", "src", "dst", F.lit(str(seed)))), "src", "dst").limit(n)


def coalesce_type(edges: DataFrame, kind: str) -> DataFrame:
    """Edges where nodes of a type with the same neighbours are one node with a joint name.

    Edges are folded onto the smallest member of a group; its name, which is as long as the group, is made once and joined to what is left.
    """
    adj = adjacency(edges)
    own = adj.where(F.col("type") == kind).groupBy("id").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))
    groups = stored(own.groupBy("nbrs").agg(F.collect_set("id").alias("members")).where(F.size("members") > 1).select(F.array_min("members").alias("one"), "members"), "groups")
    of, names = groups.select("one", F.explode("members").alias("id")), groups.select("one", group_name(F.lit(kind), F.col("members")).alias("name"))
    out = edges.select("src", "src_type", "dst", "dst_type")
    for end in ("src", "dst"):
        out = out.join(of.select(F.col("id").alias(end), "one"), end, "left").withColumn(end, F.coalesce("one", end)).drop("one")
    out = out.distinct()
    for end in ("src", "dst"):
        out = out.join(names.select(F.col("one").alias(end), "name"), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    # Two groups may have one name.
    return out.select("src", "src_type", "dst", "dst_type").distinct().withColumn("etype", F.lit(None).cast("string"))


def coalesce_vertices(edges: DataFrame, kinds: tuple[str, ...] = ("vlan", "keyword", "interface", "subnet", "acl")) -> DataFrame:
    """All types in turn, each on the graph that the one before it left."""
    for kind in kinds:
        edges = stored(coalesce_type(edges, kind))
    return edges


def add_supernets(edges: DataFrame, length: int) -> DataFrame:
    """Edges from every subnet to its supernet of a length."""
    subnets = nodes(edges).where("type = 'subnet'").select("id")
    net = F.concat(ipf.format_ip(ipf.network(ipf.address_of(F.col("id")), F.lit(length))), F.lit(f"/{length}"))
    longer = subnets.where(ipf.prefix_of(F.col("id")) > length)
    return edges.unionByName(longer.select(F.col("id").alias("src"), F.lit("subnet").alias("src_type"), net.alias("dst"), F.lit("subnet").alias("dst_type"), F.lit("supernet").alias("etype")), allowMissingColumns=True)


def met_in_place(rows: DataFrame, at_once: int) -> DataFrame:
    """a, b: all pairs (a.id < b.id) of rows (id, via, more) that have an element of the arrays via in common, each pair once.

    The rows of an element are cut into lists of about at_once; two lists are a row that is dealt as such, and its pairs are made where it
    lies, so no shuffle holds a pair.
    """
    spread = rows.where("id is not null").select(F.explode("via").alias("key"), F.struct(*rows.columns).alias("node"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / at_once).cast("int"))
    dealt = spread.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("node.id"), F.col("parts")).cast("int"))
    lists = stored(dealt.groupBy("key", "i", "parts").agg(F.collect_list("node").alias("nodes")), "lists")
    left = lists.select("key", "i", F.explode(F.sequence("i", F.col("parts") - 1)).alias("j"), F.col("nodes").alias("left"))
    cells = sizes.agg(F.sum(F.col("parts") * (F.col("parts") + 1.0) / 2)).first()[0] or 1
    both = left.join(lists.select("key", F.col("i").alias("j"), F.col("nodes").alias("right")), ["key", "j"]).repartition(int(min(MOST_TASKS, cells)), "key", "i", "j")
    pairs = both.select("key", "i", "j", F.explode("left").alias("x"), "right").select("key", "i", "j", "x", F.explode("right").alias("y"))
    ordered = F.col("x.id") < F.col("y.id")
    first = (F.size("x.via") == 1) | (F.size("y.via") == 1) | (F.array_min(F.array_intersect("x.via", "y.via")) == F.col("key"))
    pairs = pairs.where((ordered | ((F.col("i") < F.col("j")) & (F.col("x.id") != F.col("y.id")))) & first)
    return pairs.select(F.when(ordered, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ordered, F.col("y")).otherwise(F.col("x")).alias("b"))


def _two_kinds(adj: DataFrame, kind: str, via: str, other: str) -> DataFrame:
    """id, via, others, any, bare: the neighbours of two types of each node that has one of the first; whether it has any of the second, and an unnamed one."""
    own = lambda k: F.when(F.col("nbr_type") == k, F.col("nbr"))
    mine = F.col("nbr_type") == other
    seen = adj.where((F.col("type") == kind) & F.col("nbr_type").isin(via, other)).groupBy("id").agg(F.collect_set(own(via)).alias("via"), F.collect_set(own(other)).alias("others"), F.max(mine).alias("any"), F.max(mine & F.col("nbr").isNull()).alias("bare"))
    return seen.where(F.size("via") > 0)


def shared_subnet_without_vlan(adj: DataFrame, kind: str = "interface", shared: str = "subnet", lacking: str = "vlan") -> DataFrame:
    """Pairs of nodes that share a neighbour of one type, none of another, and of which one has a neighbour of that."""
    pairs = met_in_place(_two_kinds(adj, kind, shared, lacking), 512)
    return pairs.where((F.col("a.any") | F.col("b.any")) & ~F.arrays_overlap("a.others", "b.others")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def neighbor_differences(adj: DataFrame, kind: str, via: str, nbr_kind: str) -> DataFrame:
    """a, b, nbr, side: neighbours of a type that only one node has, of pairs of nodes that share a neighbour of another type."""
    only = lambda x, y: F.concat(F.array_except(f"{x}.others", f"{y}.others"), F.when(F.col(f"{x}.bare"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    marked = lambda x, y: F.transform(only(x, y), lambda n: F.struct(n.alias("nbr"), F.lit(x).alias("side")))
    pairs = met_in_place(_two_kinds(adj, kind, via, nbr_kind), 256)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.explode(F.concat(marked("a", "b"), marked("b", "a"))).alias("x")).select("a", "b", "x.nbr", "x.side")


def triangles(adj: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """x, y, z of the three types, all adjacent."""
    xy = adj.where((F.col("type") == first) & (F.col("nbr_type") == second)).select(F.col("id").alias("x"), F.col("nbr").alias("y"))
    yz = adj.where((F.col("type") == second) & (F.col("nbr_type") == third)).select(F.col("id").alias("y"), F.col("nbr").alias("z"))
    xz = adj.where((F.col("type") == first) & (F.col("nbr_type") == third)).select(F.col("id").alias("x"), F.col("nbr").alias("z"))
    return xy.join(yz, "y").join(xz, ["x", "z"], "left_semi").select("x", "y", "z")


def typed_edges(adj: DataFrame, kind: str, nbr_kind: str) -> DataFrame:
    return adj.where((F.col("type") == kind) & (F.col("nbr_type") == nbr_kind)).select("id", "nbr")


def induced_counts(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row: nodes and edges of the subgraph on some types."""
    inside = edges.where(F.col("src_type").isin(*kinds) & F.col("dst_type").isin(*kinds))
    n = nodes(edges).where(F.col("type").isin(*kinds)).agg(F.count("*").alias("nodes"))
    return n.join(F.broadcast(inside.agg(F.count("*").alias("edges"))))


def subnets_within(interfaces: DataFrame, lo: int, hi: int) -> DataFrame:
    """Interfaces whose whole network lies in [lo, hi]."""
    return interfaces.where((ipf.network(F.col("ip"), F.col("length")) >= lo) & (ipf.last_address(F.col("ip"), F.col("length")) <= hi))


def subnet_acls(interfaces: DataFrame, lo: int, hi: int) -> DataFrame:
    """Distinct ACLs applied inside a network."""
    inside = subnets_within(interfaces, lo, hi)
    return inside.select(F.explode(F.array("in_acl", "out_acl")).alias("acl")).where("acl is not null").distinct()


def aggregate_prefixes(networks: DataFrame) -> DataFrame:
    """Smallest set of CIDR blocks (lo, length) that covers exactly the given ones: contained ones go, sibling halves merge.

    Containment is found once, by an equi-join with the at most 33 supernets of each block; without contained blocks, a merged
    block is contained in none, so lengths are merged from long to short in one go.
    """
    every = stored(networks.select("lo", "length").distinct())
    lengths = [r["length"] for r in every.select("length").distinct().collect()]
    if not lengths:
        return every
    wider = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n < F.col("length"))
    offered = every.select("lo", "length", F.explode(wider).alias("wide")).withColumn("net", ipf.network(F.col("lo"), F.col("wide")))
    inside = offered.join(every.select(F.col("lo").alias("net"), F.col("length").alias("wide")), ["net", "wide"], "left_semi").select("lo", "length").distinct()
    kept = stored(every.join(inside, ["lo", "length"], "left_anti"))
    out, up = [], None
    for length in range(max(lengths), -1, -1):
        own = kept.where(F.col("length") == length).select("lo")
        own = own if up is None else own.unionByName(up)
        if not length:
            out.append(own.withColumn("length", F.lit(0)))
            break
        halves = stored(own.groupBy(ipf.network(F.col("lo"), F.lit(length - 1)).alias("up")).agg(F.count("*").alias("n"), F.min("lo").alias("lo")))
        out.append(halves.where("n = 1").select("lo", F.lit(length).alias("length")))
        up = halves.where("n = 2").select(F.col("up").alias("lo"))
        if length <= min(lengths) and up.isEmpty():
            break
    return union(*out)
