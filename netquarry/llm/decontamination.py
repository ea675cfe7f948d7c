"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two blocks of four to sixteen words, a block apart, of the documents and of the benchmark items;
blocks begin where the text itself says so, hence a copied passage has the windows of its source. Their
terms are words hashed to TERMS columns. The term-passage matrix A is weighted by inverse document frequency, which is
never zero. Its singular value decomposition is randomised and distributed: a first pass sums document frequencies and
the sketch Y = A S (S: sparse random signs, WIDTH columns, NONZERO entries a passage, drawn by a hash of its words); the
driver orthonormalises Y to Q; a second pass sums the Gram matrix of B = Q'A; its leading RANK eigenvectors rotate Q into
the singular vectors. A third pass folds every passage into the latent space (U scaled by the inverse singular values)
and searches by cosine among the windows of the items: those above COSINE, and always the nearest. What it finds is checked by the longest common subsequence
of words of the item and the surroundings: one of LCS_ALONE of the item is a leak, and one of LCS_PARAPHRASE is if the
item's answer (its last sentence) is there too. Frequencies scale terms smoothly, so an item is found as well if it leaks
into a third of all rows or into one.

Edge cases: null or empty texts have no passages; null or empty items are ignored; without items nothing is
contaminated; repeated rows and items give repeated findings; null doc_ids stay; extra columns pass or are ignored;
empty tables give empty results. The benchmark is handled in blocks of about ITEMS_AT_ONCE items: the driver and the
tasks hold one block at a time, and each block is one more pass over the documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from netquarry.llm.runtime import map_arrow, on_one_blas_thread, one_blas_thread, stored, text_rows
from netquarry.llm.words import chunks, mix64, word_hashes

TERMS, RANK, OVERSAMPLED, NONZERO = 1 << 14, 96, 32, 2
NEAR, LONGEST = 3, 16
WIDTH = RANK + OVERSAMPLED
#: Added (in squares) to the singular values before they are inverted, as a share of the largest: directions that hardly
#: any passage has, as in a corpus of few passages, are not blown up.
RIDGE = 0.2
COSINE = 0.7
LCS_ALONE, LCS_PARAPHRASE, ANSWER = 0.6, 0.5, 0.6
LEAKED = "_leaked_items"
ITEMS_AT_ONCE = 20_000
#: Text handled at once by a task.
CHUNK_BYTES = 1 << 18
#: Words of surroundings whose subsequences are computed together.
PLACES_AT_ONCE = 1 << 20
_GROUP, SALT = 256, 16


class Passages:
    """Blocks and windows of the rows of a chunk.

    A block begins at a word whose hash is the least of NEAR words on either side, and at most LONGEST words after the one
    before it: equal passages have equal blocks wherever they stand. A window is a block and the next of its row: one
    after the other for the decomposition, every such pair for the search.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, every_pair: bool = False):
        self.hashes, self.at, _, _ = word_hashes(raw, offsets)
        self.terms = (self.hashes & np.uint64(TERMS - 1)).astype(np.int64)
        self.block_start = _block_starts(self.hashes, self.at)
        self.block_row = np.searchsorted(self.at, self.block_start, side="right") - 1
        blocks = len(self.block_start)
        self.block_end = np.append(self.block_start[1:], len(self.hashes))
        follows, goes_on = np.zeros(blocks, bool), np.zeros(blocks, bool)
        follows[:-1] = self.block_row[1:] == self.block_row[:-1]
        goes_on[1:] = follows[:-1]
        if every_pair:
            # The last block of a row with several is no window of its own.
            self.window = np.flatnonzero(follows | ~goes_on)
        else:
            place = np.arange(blocks) - np.maximum.accumulate(np.where(goes_on, 0, np.arange(blocks)))
            self.window = np.flatnonzero(place % 2 == 0)
        self.pair = follows[self.window]
        self.start = self.block_start[self.window]
        self.end = self.block_end[self.window + self.pair]

    def block_sums(self, table: np.ndarray) -> np.ndarray:
        """Sums of table's rows over the terms of each block."""
        # Longest blocks first: those with another word are always the first ones.
        sizes = self.block_end - self.block_start
        order = np.argsort(-sizes, kind="stable")
        starts, longer = self.block_start[order], np.cumsum(np.bincount(sizes, minlength=LONGEST + 1)[::-1])[::-1]
        sums = table.take(self.terms[starts], axis=0)
        for k in range(1, LONGEST):
            n = longer[k + 1]
            sums[:n] += table.take(self.terms[starts[:n] + k], axis=0)
        out = np.empty_like(sums)
        out[order] = sums
        return out

    def windows(self, table: np.ndarray) -> np.ndarray:
        """Sums of table's rows over the terms of each window."""
        sums = self.block_sums(table)
        out = sums[self.window]
        out[self.pair] += sums[self.window[self.pair] + 1]
        return out


def _block_starts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First words of the blocks."""
    n = len(hashes)
    least = np.ones(n, bool)
    for k in range(1, min(NEAR, n - 1) + 1):
        least[k:] &= hashes[k:] < hashes[:-k]
        least[:-k] &= hashes[:-k] <= hashes[k:]
    firsts = at[:-1][at[:-1] < at[1:]]
    least[firsts] = True
    starts = np.flatnonzero(least)
    gaps = np.diff(np.append(starts, n))
    parts = -(-gaps // LONGEST)
    if (parts == 1).all():
        return starts
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(starts, parts) + inside * LONGEST


def _firsts(p: Passages) -> np.ndarray:
    """Terms, once for each block that has them."""
    block = np.repeat(np.arange(len(p.block_start)), p.block_end - p.block_start)
    first = np.ones(len(p.terms), bool)
    for k in range(1, min(LONGEST, len(p.terms))):
        first[k:] &= ~((p.terms[k:] == p.terms[:-k]) & (block[k:] == block[:-k]))
    return p.terms[first]


def _signs(p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the windows' entries in the sketching matrix: arrays of (NONZERO, windows)."""
    sums = np.add.reduceat(p.hashes, p.block_start)
    keys = sums[p.window]
    keys[p.pair] += sums[p.window[p.pair] + 1] * np.uint64(3)
    draws = np.stack([mix64(keys + np.uint64(k + 1)) for k in range(NONZERO)])
    return ((draws >> np.uint64(8)) % np.uint64(WIDTH)).astype(np.int64), np.where(draws & np.uint64(1), 1, -1)


def _add_sketch(p: Passages, product: np.ndarray) -> None:
    """Adds the chunk's passages, times the sketching matrix, to product (flat, TERMS x WIDTH)."""
    columns, signs = _signs(p)
    sizes = p.block_end - p.block_start
    of_word = np.repeat(np.arange(len(sizes)), sizes)
    terms = p.terms * WIDTH
    for column, sign in zip(columns, signs, strict=True):
        for windows, chosen in ((p.window, slice(None)), (p.window[p.pair] + 1, p.pair)):
            c, g = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.float32)
            c[windows], g[windows] = column[chosen], sign[chosen]
            np.add.at(product, terms + c[of_word], g[of_word])


def _partial_sketch(batches):
    """Of one task: rows of Y and block frequencies, by groups of terms."""
    product, frequency, blocks = np.zeros(TERMS * WIDTH, np.float32), np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for _, _, raw, offsets in chunks(batch.column(0)):
            p = Passages(raw, offsets)
            if len(p.terms):
                blocks += len(p.block_start)
                frequency += np.bincount(_firsts(p), minlength=TERMS)
                _add_sketch(p, product)
    product = product.reshape(TERMS, WIDTH)
    rows = []
    for g in range(0, TERMS, _GROUP):
        there = np.flatnonzero(frequency[g : g + _GROUP])
        if len(there):
            rows.append((g // _GROUP, _pack(there, frequency[g + there], product[g + there])))
    yield _payloads([*rows, (-1, np.int64(blocks).tobytes())])


def _payloads(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["terms", "payload"])


def _pack(there: np.ndarray, frequency: np.ndarray, product: np.ndarray) -> bytes:
    return there.astype("<u2").tobytes() + frequency.astype("<i8").tobytes() + product.astype("<f4").tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // (2 + 8 + 4 * WIDTH)
    return np.frombuffer(payload, "<u2", n), np.frombuffer(payload, "<i8", n, 2 * n), np.frombuffer(payload, "<f4", n * WIDTH, 10 * n).reshape(n, WIDTH)


def _summed(batches):
    """Adds up what arrives, a group of terms at a time in memory of fixed size."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    blocks = 0
    for batch in batches:
        for group, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if group < 0:
                blocks += int(np.frombuffer(payload, np.int64)[0])
                continue
            f, z = sums.setdefault(group, (np.zeros(_GROUP, np.int64), np.zeros((_GROUP, WIDTH))))
            there, frequency, product = _unpack(payload)
            f[there] += frequency
            z[there] += product
    rows = []
    for g, (f, z) in sums.items():
        there = np.flatnonzero(f)
        rows.append((g, _pack(there, f[there], z[there])))
    yield _payloads(rows + ([(-1, np.int64(blocks).tobytes())] if blocks else []))


def _partial_gram(basis: np.ndarray):
    """Of one task: the Gram matrix of Q'A."""

    def run(batches):
        one_blas_thread()
        gram = np.zeros((WIDTH, WIDTH))
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0), CHUNK_BYTES):
                p = Passages(raw, offsets)
                if len(p.terms):
                    b = p.windows(basis)
                    gram += b.T @ b
        yield _payloads([(0, gram.tobytes())])

    return run


def _summed_grams(batches):
    gram, some = np.zeros((WIDTH, WIDTH)), False
    for batch in batches:
        for payload in batch.column(1).to_pylist():
            gram += np.frombuffer(payload).reshape(WIDTH, WIDTH)
            some = True
    yield _payloads([(0, gram.tobytes())] if some else [])


def _added(parts: DataFrame, by_key) -> list[tuple[int, bytes]]:
    """Sums of the tasks' payloads in two steps, so that no task reads what every task wrote."""
    salted = parts.withColumn("salt", F.spark_partition_id() % SALT).repartition("terms", "salt").select("terms", "payload")
    partial = map_arrow(salted, by_key, "terms int, payload binary")
    # One row a group of terms reaches the driver, whatever the size of the corpus.
    return [(r["terms"], bytes(r["payload"])) for r in map_arrow(partial.repartition("terms"), by_key, "terms int, payload binary").collect()]


def _weights(frequency: np.ndarray, blocks: int) -> np.ndarray:
    """Smoothed inverse document frequency, damped: above zero for the most frequent terms."""
    return np.sqrt(np.log1p(blocks / np.maximum(frequency, 1)))


def _orthonormal(sketch: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(sketch)
    size = np.abs(np.diag(r))
    return q * (size > 1e-9 * max(size.max(), 1e-30))


def _with_zeros(table: np.ndarray) -> np.ndarray:
    return np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def _singular(basis: np.ndarray, gram: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and values of A from Q and the Gram matrix of Q'A, largest first, without the null ones."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    real = values > 1e-7 * max(values[0], 1e-30)
    return basis @ vectors[:, real], np.sqrt(values[real])


@on_one_blas_thread()
def latent_space(texts: DataFrame) -> np.ndarray:
    """What folds a passage in: a row a term (its weight times its left singular vector, scaled by the inverse singular values), and a last row of zeros."""
    found = _added(map_arrow(texts, _partial_sketch, "terms int, payload binary"), _summed)
    frequency, sketch, blocks = np.zeros(TERMS, np.int64), np.zeros((TERMS, WIDTH)), 0
    for group, payload in found:
        if group < 0:
            blocks += int(np.frombuffer(payload, np.int64)[0])
        else:
            there, f, z = _unpack(payload)
            frequency[group * _GROUP + there] = f
            sketch[group * _GROUP + there] = z
    idf = _weights(frequency, blocks)[:, None]
    basis = _orthonormal(sketch * idf)
    grams = _added(map_arrow(texts, _partial_gram(_with_zeros(basis * idf)), "terms int, payload binary"), _summed_grams)
    gram = sum((np.frombuffer(p).reshape(WIDTH, WIDTH) for _, p in grams), np.zeros((WIDTH, WIDTH)))
    vectors, values = _singular(basis, gram)
    return folded(vectors, values, idf)


def folded(vectors: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows that fold terms into the latent space."""
    return _with_zeros(vectors / np.sqrt(values**2 + (RIDGE * values.max(initial=1e-30)) ** 2) * weights)


class Benchmark:
    """A block of items with their windows in the latent space."""

    def __init__(self, items: list[tuple[int, str]], space: np.ndarray):
        self.ids = [i for i, _ in items]
        self.words = _words_of([t for _, t in items])
        self.answers = [frozenset(w.tolist()) for w in _words_of([_answer(t) for _, t in items])]
        self.length = np.array([len(w) for w in self.words], np.int64)
        vectors, owner = [], []
        for a, _, raw, offsets in chunks(pa.array([t for _, t in items], pa.large_string())):
            p = Passages(raw, offsets, every_pair=True)
            vectors.append(p.windows(space))
            owner.append(p.block_row[p.window] + a)
        self.vectors, self.owner = _unit(np.concatenate(vectors)) if vectors else np.zeros((0, space.shape[1])), np.concatenate([np.zeros(0, np.int64), *owner])
        self.vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *self.words]))
        self.shift = np.uint64(46)
        self.perhaps = np.zeros(1 << 18, bool)
        self.perhaps[self.vocabulary >> self.shift] = True
        self.limbs = -(-self.length // 64)
        self.known = [self._places(w) for w in self.words]

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An item's distinct words by number, and the places of each as bits of 64-bit limbs."""
        numbers, inverse = np.unique(np.searchsorted(self.vocabulary, words), return_inverse=True)
        bits = np.zeros((len(numbers), -(-len(words) // 64)), np.uint64)
        place = np.arange(len(words))
        np.bitwise_or.at(bits, (inverse, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        return numbers, bits

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers in the vocabulary; its length for words that are not there."""
        out = np.full(len(hashes), len(self.vocabulary), np.int64)
        place = np.flatnonzero(self.perhaps[hashes >> self.shift])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[place]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[place]
        out[place[same]] = at[same]
        return out


def _words_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, raw, offsets in chunks(pa.array(texts, pa.large_string())):
        hashes, at, _, _ = word_hashes(raw, offsets)
        out += [hashes[at[i] : at[i + 1]] for i in range(len(at) - 1)]
    return out


def _answer(text: str) -> str:
    parts = [x for x in re.split(r"[.?!\n]+", text) if x.strip()]
    return parts[-1] if parts else ""


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def common_subsequences(masks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs at once, by bit-parallel rows.

    masks (pairs, places, limbs): for each word of the one text, its places in the other, as bits; lengths: words of the other.
    """
    pairs, places, limbs = masks.shape
    row = np.full((limbs, pairs), ~np.uint64(0))
    bits = np.moveaxis(masks, 0, -1)
    for k in range(places):
        carry = np.zeros(pairs, np.uint64)
        for j in range(limbs):
            m = bits[k, j]
            u = row[j] & m
            total = row[j] + u
            if limbs > 1:
                over = total < u
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
            row[j] = total | (row[j] & ~m)
    out = np.zeros(pairs, np.int64)
    for j in range(limbs):
        inside = np.clip(lengths - 64 * j, 0, 64)
        keep = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~row[j] & keep).astype(np.int64)
    return out


def _subsequences(numbers: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, bench: Benchmark) -> np.ndarray:
    """For each pair, the longest common subsequence of its item and the words from begin to end (sorted by item)."""
    widest, limbs = int((end - begin).max()), int(bench.limbs[item].max())
    masks = np.zeros((len(item), widest, limbs), np.uint64)
    places = begin[:, None] + np.arange(widest)
    there = np.where(places < end[:, None], numbers[np.minimum(places, len(numbers) - 1)], len(bench.vocabulary))
    edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    table = np.zeros((len(bench.vocabulary) + 1, limbs), np.uint64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        words, bits = bench.known[item[a]]
        table[words, : bits.shape[1]] = bits
        masks[a:b] = table[there[a:b]]
        table[words] = 0
    return common_subsequences(masks, bench.length[item])


def _enough_words(numbers: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Which pairs can have a subsequence that long: none is longer than the places from begin to end whose word the item has."""
    order = np.argsort(item, kind="stable")
    edges = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
    table, out = np.zeros(len(bench.vocabulary) + 1, np.float32), np.zeros(len(item), bool)
    before = np.zeros(len(numbers) + 1, np.float64)
    widths = np.arange(int((end - begin).max(initial=0)))
    ones = np.ones(len(widths), np.float32)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = order[a:b]
        k = int(item[some[0]])
        words = bench.known[k][0]
        lo, hi, least = begin[some], end[some], LCS_PARAPHRASE * bench.length[k]
        table[words] = 1
        width = int((hi - lo).max())
        if len(some) * width * 2 < len(numbers):
            places = lo[:, None] + widths[:width]
            np.minimum(places, len(numbers) - 1, out=places)
            # Beyond a pair's end there may be words of the next text: they only make the bound looser.
            out[some] = table[numbers[places]] @ ones[:width] >= least
        else:
            np.cumsum(table[numbers], out=before[1:])
            out[some] = before[hi] - before[lo] >= least
        table[words] = 0
    return out


def candidates(p: Passages, space: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Windows and items whose cosine reaches the threshold, and each window's nearest item; each pair once."""
    passages = _unit(p.windows(space))
    found = [np.zeros(0, np.int64)]
    size = len(bench.vectors)
    at_once = max(1, (1 << 20) // size)
    for a in range(0, len(passages), at_once):
        cosines = passages[a : a + at_once] @ bench.vectors.T
        # The nearest one counts as if it reached the threshold.
        cosines[np.arange(len(cosines)), cosines.argmax(axis=1)] = 1
        flat = np.flatnonzero(cosines >= COSINE)
        # Windows and the owners of the vectors ascend, so equal pairs are neighbours.
        pairs = (flat // size + a) * len(bench.ids) + bench.owner[flat % size]
        found.append(pairs[np.diff(pairs, prepend=-1) > 0])
    pairs = np.concatenate(found)
    return pairs // len(bench.ids), pairs % len(bench.ids)


def find_leaks(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray, bench: Benchmark) -> list[dict[int, float]]:
    """For each row, the items that it leaks and the share of the item in the longest common subsequence."""
    found: list[dict[int, float]] = [{} for _ in range(len(offsets) - 1)]
    p = Passages(raw, offsets, every_pair=True)
    if not len(p.terms) or not len(bench.vectors):
        return found
    window, item = candidates(p, space, bench)
    row, n = p.block_row[p.window[window]], bench.length[item]
    begin = np.maximum(p.at[row], p.start[window] - n)
    end = np.minimum(p.at[row + 1], p.end[window] + n)
    row, item, begin, end = merged_surroundings(row, item, n, begin, end)
    n = bench.length[item]
    numbers = bench.numbers(p.hashes)
    worth = _enough_words(numbers, begin, end, item, bench)
    row, item, n, begin, end = row[worth], item[worth], n[worth], begin[worth], end[worth]
    # Pairs of like sizes together, and within that by item.
    order = np.lexsort((item, bench.limbs[item], end - begin >> 5))
    sizes = np.cumsum((end - begin)[order] * bench.limbs[item[order]])
    cuts = np.flatnonzero(np.diff(sizes // PLACES_AT_ONCE, prepend=-1, append=-1)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        some = order[a:b]
        some = some[np.argsort(item[some], kind="stable")]
        share = _subsequences(numbers, begin[some], end[some], item[some], bench) / n[some]
        for x in np.flatnonzero(share >= LCS_PARAPHRASE).tolist():
            i = some[x]
            r, k = int(row[i]), int(item[i])
            if share[x] >= LCS_ALONE or _answered(bench.answers[k], p.hashes[begin[i] : end[i]].tolist()):
                found[r][k] = max(float(share[x]), found[r].get(k, 0.0))
    return found


def merged_surroundings(row: np.ndarray, item: np.ndarray, n: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, begin, end), where surroundings of one row and item that begin within half the item's length are one, from the
    first begin to the last end: each place of a long item's surroundings is compared a few times, not once for every window."""
    bucket = begin // np.maximum(1, n // 2)
    order = np.lexsort((begin, bucket, item, row))
    row, item, bucket, begin, end = (x[order] for x in (row, item, bucket, begin, end))
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(bucket) != 0)
    first = np.flatnonzero(new)
    return row[first], item[first], begin[first], np.maximum.reduceat(end, first) if len(first) else end


def _answered(answer: frozenset, around: list[int]) -> bool:
    return bool(answer) and len(answer.intersection(around)) >= ANSWER * len(answer)


def _leaks_of(space: np.ndarray, items: list[tuple[int, str]], at: int, name: str):
    """Adds a column of leaked items (sorted ids) to every row; the text is column number at."""

    def run(batches):
        one_blas_thread()
        bench = Benchmark(items, space)
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(at), CHUNK_BYTES):
                leaks = [sorted(bench.ids[k] for k in x) for x in find_leaks(raw, offsets, space, bench)]
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], pa.array(leaks, pa.list_(pa.int64()))], [*batch.schema.names, name])

    return run


def _searched(docs: DataFrame, space: np.ndarray, items: list[tuple[int, str]], name: str = LEAKED) -> DataFrame:
    return map_arrow(docs, _leaks_of(space, items, docs.columns.index("text"), name), StructType([*docs.schema.fields, StructField(name, ArrayType(LongType()))]))


def _text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("leaks"), text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE, name: str = LEAKED) -> DataFrame:
    """docs and one more column by the name given; one that docs has by that name is replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    space = latent_space(text_rows(docs).select("text").unionByName(items.select("text")))
    blocks = max(1, -(-items.count() // items_at_once))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def block(k: int) -> list[tuple[int, str]]:
        return sorted((r["item_id"], r["text"]) for r in numbered.where(F.col("block") == k).collect())

    if blocks == 1:
        return _searched(docs, space, block(0), name)
    # Findings of a block are few (one row a leaking text); they wait in tables, so that one block is in memory at a time.
    distinct = stored(text_rows(docs).select("text").where("text is not null").distinct(), "texts")
    findings = None
    for k in range(blocks):
        h1, h2 = _text_key(F.col("text"))
        now = _searched(distinct, space, block(k)).where(F.size("_leaked_items") > 0).select(h1.alias("_h1"), h2.alias("_h2"), F.explode("_leaked_items").alias("_item"))
        now = stored(now, "findings")
        findings = now if findings is None else findings.unionByName(now)
    found = stored(findings.groupBy("_h1", "_h2").agg(F.array_sort(F.collect_list("_item")).alias("_leaked_items")), "findings")
    columns = docs.columns
    h1, h2 = _text_key(F.col("_doc.text").cast("string"))
    keyed = docs.select(F.struct(*[F.col(c) for c in columns]).alias("_doc")).withColumns({"_h1": h1, "_h2": h2}).join(found, ["_h1", "_h2"], "left")
    return keyed.select(*[F.col(f"_doc.{c}").alias(c) for c in columns], F.coalesce("_leaked_items", F.array().cast("array<bigint>")).alias(name))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids of every document."""
    found = with_leaks(text_rows(docs), benchmark)
    return found.select("doc_id", (F.size("_leaked_items") > 0).alias("contaminated"), F.size("_leaked_items").cast("long").alias("n_items"), F.array_join(F.col("_leaked_items").cast("array<string>"), ",").alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item; columns unchanged, whatever their names."""
    name = LEAKED
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return with_leaks(docs, benchmark, name=name).where(F.size(name) == 0).select(*docs.columns)
