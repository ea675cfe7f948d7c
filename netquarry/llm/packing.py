"""Packing of documents into token sequences by minimum bin slack.

A document is its token ids and an end id. Longer ones are cut into full pieces after a shorter first piece. Full pieces
are sequences of their own; the others are told apart by length only, so the search works on a histogram of at most
`capacity - 1` lengths, whatever the number of rows. For each bin, the longest open length is set and a bitset
subset-sum over the lengths left finds the fullest feasible filling of the slack; that filling is taken as often as
the counts allow, and removed. Every taking uses up a length, so there are at most `capacity` kinds of bins.
A piece then finds its bin by its rank among the pieces of its length: ranks are local counts of each partition plus
offsets by (partition, length), so that a length that most rows share is never gathered in one task. There are as many
offsets as partitions times lengths, so they are joined by a shuffle, never broadcast.

`pack` gives every piece its place and its token ids; `packed_sequences` makes the training sequences of them.

Edge cases: null or empty text is the end id alone; a special string of the tokenizer's file that stands in a text is its
special token, as the plain call of the tokenizer has it; ties and equal rows are interchangeable and all packed; an empty
table gives no rows; null doc_ids stay; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.runtime import map_arrow, stored, text_rows
from netquarry.llm.tokens import byte_bpe

CAPACITY = 2048
END_ID = 0
_KEPT = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
_PIECES = f"{_KEPT}, part int, rank long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]


def _tokenize(json_path: str, ranks_path: str, capacity: int, end_id: int, with_ids: bool):
    """Pieces with their rank among the pieces of their length in this task."""

    def run(batches):
        from pyspark import TaskContext

        encode = byte_bpe(json_path, ranks_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].view("<i4") if with_ids else None, part, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*_NAMES, "part", "rank"])

    return run


def fullest(slack: int, counts: dict[int, int]) -> list[int]:
    """Lengths, each at most as often as it is there, with the largest sum up to slack; longer ones are tried first."""
    mask = (1 << (slack + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= slack), reverse=True):
        left, size = min(counts[length], slack // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> slack & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out += [length] * take
    return out


def fill_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), until the histogram is used up."""
    counts, bins = {k: n for k, n in histogram.items() if n}, []
    while counts:
        longest = max(counts)
        rest = {k: n - (k == longest) for k, n in counts.items() if n - (k == longest)}
        lengths = [longest, *fullest(capacity - longest, rest)]
        used = {k: lengths.count(k) for k in set(lengths)}
        times = min(counts[k] // n for k, n in used.items())
        bins.append((lengths, times))
        counts = {k: left for k, n in counts.items() if (left := n - times * used.get(k, 0))}
    return bins


def _placements(bins: list[tuple[list[int], int]], first_sequence: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs of ranks: (first rank, places a bin, first bin, offset of the first place)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = first_sequence
    for lengths, times in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            runs.setdefault(length, []).append((ranks.get(length, 0), per, sequence, offset))
            ranks[length] = ranks.get(length, 0) + per * times
            offset += per * length
        sequence += times
    return runs


def _place(runs: dict[int, list[tuple[int, int, int, int]]]):
    firsts = {length: [r[0] for r in found] for length, found in runs.items()}

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_pylist() for c in ("length", "rank"))
            sequences, offsets = [], []
            for length, rank in zip(lengths, ranks, strict=True):
                first, per, sequence, offset = runs[length][bisect_right(firsts[length], rank) - 1]
                bins, place = divmod(rank - first, per)
                sequences.append(sequence + bins)
                offsets.append(offset + place * length)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _NAMES], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*_NAMES, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset."""
    pieces = stored(map_arrow(text_rows(docs), _tokenize(json_path, ranks_path, capacity, end_id, with_ids), _PIECES), "pieces")
    # Full pieces are sequences of their own and need no rank. Of the others, a part's have the ranks behind those of the parts before.
    whole, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    shares = stored(rest.groupBy("part", "length").agg(F.count("*").alias("n")), "shares")
    # At most `capacity` rows, one a length.
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = rest.join(offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead")).select(*_NAMES, "rank")
    placed = map_arrow(ranked, _place(_placements(fill_bins(histogram, capacity), 0)), f"{_KEPT}, sequence_id long, offset long")
    # Numbers of full ones are below zero.
    own = -(F.col("part").cast("long") * (1 << 32) + F.col("rank") + 1)
    return placed.unionByName(whole.select(*_NAMES, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and lengths of the pieces of pack (with ids), one row a sequence of at most the capacity."""
    placed = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    return placed.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
