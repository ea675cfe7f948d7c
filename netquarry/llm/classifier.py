"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, read by learned filters (every byte by some position of them: the text is padded to the stride), and
the filters' outputs are max-pooled over overlapping chunks that cover the whole document. A document's features are, for each filter, the mean and the largest of its chunk maxima; a logistic
layer makes one probability of them. Trained by back-propagation (Adam) on the driver on a bounded number of labelled
rows (of very long texts, spans from all over them); scores are of whole texts. The weights are small and travel with the code.

Edge cases: null or empty texts are scored as a row of padding; labels that are null or contradict each other for a
doc_id are not learnt from; without any usable label (or with one class only) the score is a constant, and keep_good keeps every row
and warns; equal texts get equal scores; null doc_ids stay; extra columns, whatever their names, are ignored or pass through.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.runtime import map_arrow, on_one_blas_thread, one_blas_thread, text_rows
from netquarry.llm.words import chunks

#: Bound of the sample: labelled rows of each class that have a document. Of a text longer than LEARNT bytes, so many in all are
#: learnt from, in SPANS spans that lie evenly from its first byte to its last.
SAMPLE_ROWS, LEARNT, SPANS = {0: 1500, 1: 4500}, 16_384, 32
EPOCHS, BATCH, RATE, SEED = 8, 24, 0.01, 7
#: Bytes of a batch that are read together in training.
BYTES_AT_ONCE = 1 << 16
EMBEDDED, FILTERS, WIDTH, STRIDE = 4, 16, 6, 2
#: In filter positions: a chunk, and the step from chunk to chunk.
CHUNK, STEP = 160, 128
THRESHOLD = 0.7
#: Weight of the good class against the other: wrongly rejecting a document counts more.
GOOD_WEIGHT = 2.0


def _pieces(n: int) -> np.ndarray:
    """Starts of the chunks over n positions."""
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


class ByteNetwork:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        shape = {"embed": (256, EMBEDDED), "filter": (WIDTH * EMBEDDED, FILTERS), "bias": (FILTERS,), "out": (2 * FILTERS,), "shift": (1,)}
        scale = {"embed": 0.5, "filter": 0.3, "bias": 0.0, "out": 0.1, "shift": 0.0}
        return cls({k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shape.items()})

    def responses(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs at every STRIDE-th byte, and the bytes that they read."""
        raw = padded(raw)
        n = (len(raw) - WIDTH) // STRIDE + 1
        at = np.arange(n)[:, None] * STRIDE + np.arange(WIDTH)[None, :]
        read = raw[at]
        patches = self.w["embed"][read].reshape(n, WIDTH * EMBEDDED)
        return np.maximum(patches @ self.w["filter"] + self.w["bias"], 0), read

    def score(self, raw: np.ndarray) -> float:
        r, _ = self.responses(raw)
        tops = _chunk_maxima(r, _pieces(len(r)))
        z = float(np.concatenate([tops.mean(axis=0), tops.max(axis=0)]).astype(np.float64) @ self.w["out"].astype(np.float64) + self.w["shift"][0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradients(self, texts: list[np.ndarray], labels: list[int], weights: list[float]) -> dict[str, np.ndarray]:
        """Of the weighted sum of the texts' losses; the texts are read as one, chunk by chunk."""
        texts = [padded(t) for t in texts]
        sizes = np.array([(len(t) - WIDTH) // STRIDE + 1 for t in texts])
        raw, byte_at, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])[:-1], np.cumsum([0, *sizes])
        # A text's positions, then the bytes of each; chunks are rows of positions, cut at the text's end.
        position = np.concatenate([b + np.arange(n) * STRIDE for b, n in zip(byte_at, sizes, strict=True)])
        read = raw[position[:, None] + np.arange(WIDTH)]
        r = np.maximum(self.w["embed"][read].reshape(len(position), -1) @ self.w["filter"] + self.w["bias"], 0)
        starts = [_pieces(n) for n in sizes]
        text = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
        start = np.concatenate([a + x for a, x in zip(at[:-1], starts, strict=True)])
        arg = _chunk_places(r, start, at[text + 1])
        tops = np.take_along_axis(r, arg, axis=0)
        first = np.cumsum([0, *[len(x) for x in starts]])[:-1]
        features = np.concatenate([np.add.reduceat(tops, first, axis=0) / np.diff([*first, len(tops)])[:, None], np.maximum.reduceat(tops, first, axis=0)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(features @ self.w["out"] + self.w["shift"][0], -60, 60)))
        d = ((p - labels) * weights).astype(r.dtype)
        per = (d / np.diff([*first, len(tops)]))[text][:, None] * self.w["out"][:FILTERS]
        # The largest chunk of a text and filter: the first where several are.
        is_top = tops == features[text, FILTERS:]
        order = np.cumsum(is_top, axis=0)
        is_top &= order - (order[first] - is_top[first])[text] == 1
        per = (per + is_top * d[text][:, None] * self.w["out"][FILTERS:]) * (tops > 0)
        chunk, filt = np.nonzero(per)
        place, g = arg[chunk, filt], per[chunk, filt].astype(r.dtype)
        patches = self.w["embed"][read[place]].reshape(len(place), -1)
        by_filter = np.zeros((FILTERS, WIDTH * EMBEDDED), r.dtype)
        np.add.at(by_filter, filt, patches * g[:, None])
        back = (self.w["filter"].T[filt] * g[:, None]).reshape(-1, EMBEDDED)
        bytes_read = read[place].reshape(-1)
        embed = np.stack([np.bincount(bytes_read, back[:, k], minlength=256) for k in range(EMBEDDED)], axis=1).astype(r.dtype)
        return {"embed": embed, "filter": by_filter.T, "bias": per.sum(axis=0), "out": d @ features, "shift": d.sum(keepdims=True)}


def padded(raw: np.ndarray) -> np.ndarray:
    """Zero bytes behind, so that the filters' positions reach the last byte."""
    missing = max(WIDTH - len(raw), 0) or (WIDTH - len(raw)) % STRIDE
    return np.concatenate([raw, np.zeros(missing, np.uint8)]) if missing else raw


def _unit_blocks(r: np.ndarray) -> np.ndarray:
    """r in blocks of CHUNK - STEP positions, zeros behind: chunks are whole blocks."""
    unit = CHUNK - STEP
    blocks = -(-len(r) // unit) + CHUNK // unit
    out = np.zeros((blocks * unit, r.shape[1]), r.dtype)
    out[: len(r)] = r
    return out.reshape(blocks, unit, -1)


def _chunk_maxima(r: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maxima of the chunks, from maxima of blocks: each position is read once."""
    small = _unit_blocks(r).max(axis=1)
    first = starts // (CHUNK - STEP)
    return np.max([small[first + k] for k in range(CHUNK // (CHUNK - STEP))], axis=0)


def _chunk_places(r: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each chunk (start, before end) and filter, the place of the first largest response."""
    places = np.minimum(start[:, None] + np.arange(CHUNK), (end - 1)[:, None])
    return np.take_along_axis(places, r[places].argmax(axis=1), axis=1)


@on_one_blas_thread()
def train(examples: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork | float:
    """The fitted network, or a constant where there is nothing to tell apart."""
    labels = np.array([y for _, y in examples])
    if not len(labels) or labels.min() == labels.max():
        return float(labels[0]) if len(labels) else 0.5
    net, rng = ByteNetwork.fresh(seed), np.random.default_rng(seed)
    share = labels.mean()
    net.w["shift"][0] = np.log(share / (1 - share))
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    weight = {1: GOOD_WEIGHT / (1 + GOOD_WEIGHT) / share, 0: 1 / (1 + GOOD_WEIGHT) / (1 - share)}
    texts = [np.frombuffer(t, np.uint8) for t, _ in examples]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            total = {k: np.zeros_like(x) for k, x in net.w.items()}
            # Some bytes at a time, so that memory follows the longest text.
            sizes = np.cumsum([len(texts[i]) for i in part])
            for some in np.split(part, np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE)) + 1):
                for k, g in net.gradients([texts[i] for i in some], [int(labels[i]) for i in some], [weight[int(labels[i])] for i in some]).items():
                    total[k] += g
            t += 1
            for k, g in total.items():
                g = g / len(part)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spans(raw: Column) -> Column:
    """Bytes of a text, or of spans all over it."""
    size = LEARNT // SPANS
    begin = lambda k: F.floor((F.octet_length(raw) - size) * k / (SPANS - 1)).cast("int") + 1
    return F.when(F.octet_length(raw) <= LEARNT, raw).otherwise(F.concat(*[F.substr(raw, begin(k), F.lit(size)) for k in range(SPANS)]))


def sample(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> list[tuple[bytes, int]]:
    """Labelled texts: at most so many rows of each class (SAMPLE_ROWS) that have a document, the first in the order of a hash of
    doc_id; the length of one text decides nothing about the others. At most LEARNT bytes of each reach the driver."""
    rows = rows or SAMPLE_ROWS
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("label_id").isNotNull())
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    there = known.join(docs.select(F.col("doc_id").cast("long").alias("label_id")), "label_id", "left_semi")
    chosen = None
    for y in (0, 1):
        top = there.where(F.col("lo") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(rows[y])
        chosen = top if chosen is None else chosen.unionByName(top)
    # The chosen ids are as few as the bounds say, so that side is broadcast by a fixed bound.
    found = text_rows(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lo").alias("y"))
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    # Arrow columns take a fraction of the driver's memory that rows of strings take.
    got = found.select("doc_id", _spans(F.col("text").cast("binary")).alias("text"), "y").toArrow().sort_by("doc_id")
    return list(zip(got.column("text").to_pylist(), got.column("y").to_pylist(), strict=True))


def _scorer(net: ByteNetwork | float):
    def run(batches):
        one_blas_thread()
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(1)):
                if isinstance(net, ByteNetwork):
                    scores = [round(net.score(raw[offsets[i] : offsets[i + 1]]), 6) for i in range(b - a)]
                else:
                    scores = [net] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, net: ByteNetwork | float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = map_arrow(text_rows(docs), _scorer(net), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: ByteNetwork | float) -> DataFrame:
    """docs without those that the network rejects; columns unchanged. A constant tells nothing apart: then all rows stay, with a warning."""
    if not isinstance(net, ByteNetwork):
        warnings.warn("no quality labels of both classes to learn from: every document is kept", stacklevel=2)
        return docs
    at = docs.columns.index("text")

    def run(batches):
        score = _scorer(net)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["doc_id", "text"])
            scores = pa.concat_arrays([x.column(1) for x in score([texts])] or [pa.array([], pa.float64())])
            yield batch.filter(pc.greater_equal(scores, THRESHOLD))

    return map_arrow(docs, run, docs.schema)
