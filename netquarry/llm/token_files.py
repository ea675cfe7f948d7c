"""Token ids of whole documents as grammar-compressed shards, read back by document or by any range of ids.

Documents are dealt into ranges of doc_id and sorted within them; a task encodes its texts in that order, cuts the stream
of ids into shards at document ends, and turns each shard into a Re-Pair grammar (grammar.py). The files are Parquet, one row a
shard: part and shard (their order is the order of the ids), before (ids of the part ahead of it), doc_ids, ends (of the
documents, inside the shard) and body (the grammar's bytes). A reader finds a document by its end, and expands what it needs.

The tokenizer gets the stretches of a text between spaces and line feeds: its patterns match none of these characters and none of
its tokens spans them, so ids are those of the whole text (tested). A stretch that a worker remembers is not encoded again.

Edge cases: null or empty text is the end id alone; null doc_ids come first; rows of one doc_id are ordered by a hash of their text
and equal rows are interchangeable; a shard holds whole documents, so one text beyond SHARD_IDS ids is a shard of its own and
memory follows the longest text; extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.grammar import Shard, to_bytes
from netquarry.llm.runtime import map_arrow, stored, text_rows

END_ID = 1
#: A shard is closed by the document that brings it to so many ids.
SHARD_IDS = 1 << 20
#: Stretches that a worker remembers; then it starts afresh.
REMEMBERED = 1 << 20
#: Characters of new stretches that are encoded in one call.
CHARS_AT_ONCE = 1 << 18
#: The tokenizer always cuts between a letter and one of these marks, so a space between them changes nothing.
_LETTER_MARK = "([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?])"
#: Stretches that the tokenizer takes as one word, whose last token alone has the mark of a word's end.
_WORD = "^([a-zß-öø-ÿ]+|[.,;:!?]+)$"
#: What stands between stretches that are encoded together: a control character, which is a token of its own.
_MARK = "\x01"
SHARDS = "part int, shard int, before long, n_ids long, doc_ids array<long>, ends array<long>, body binary"


class StretchEncoder:
    """Ids of texts by the tokenizers library, each distinct stretch between spaces encoded once."""

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        with open(json_path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", ())]
        if any(re.search(rf"[ \n{_MARK}]|{_LETTER_MARK}", x) for x in self.special):
            raise ValueError("a special token spans what texts are cut at")
        (self.mark,) = self._ids(_MARK)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.place, self.flat, self.ends, self.used = {}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _keys(self, stretches: pa.Array) -> list[str]:
        """The stretches, in lower case where that cannot change their ids: the library lowers them itself, after composing letters and marks."""
        plain = pc.string_is_ascii(stretches)
        for x in self.special:
            plain = pc.and_not(plain, pc.match_substring(stretches, x, ignore_case=True))
        return pc.if_else(plain, pc.ascii_lower(stretches), stretches).to_pylist()

    def _learn(self, stretches: list[str]) -> None:
        """Ids of new stretches: many are encoded as one text, told apart by the ends of words where each is one word, else by a mark."""
        word = pc.match_substring_regex(pa.array(stretches, pa.string()), _WORD).to_pylist()
        rest = [x for x, w in zip(stretches, word, strict=True) if not w]
        for x in (x for x in rest if _MARK in x):
            ids = self._ids(x)
            self._keep([x], ids, np.array([len(ids)]))
        for some, joint in (([x for x, w in zip(stretches, word, strict=True) if w], " "), ([x for x in rest if _MARK not in x], f" {_MARK} ")):
            at = 0
            while at < len(some):
                end, chars = at, 0
                while end < len(some) and (end == at or chars < CHARS_AT_ONCE):
                    chars += len(some[end])
                    end += 1
                ids = self._ids(joint.join([*some[at:end], ""]))
                if joint == " ":
                    ends = np.flatnonzero(self.ends_word[ids]) + 1
                else:
                    marks = ids == self.mark
                    ends, ids = np.flatnonzero(marks) - np.arange(end - at), ids[~marks]
                self._keep(some[at:end], ids, ends)
                at = end

    def _keep(self, stretches: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, used = len(self.place), self.used
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ends) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(ends)] = used + ends
        self.place.update(zip(stretches, range(n, n + len(ends)), strict=True))
        self.used = used + len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        spaced = pc.replace_substring_regex(pc.replace_substring(texts.fill_null(""), "\n", " "), _LETTER_MARK, r"\1 \2")
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        words = self._keys(coded.dictionary)
        if len(self.place) > REMEMBERED:
            self._forget()
        self._learn([w for w in dict.fromkeys(words) if w not in self.place])
        places = np.array([self.place[w] for w in words], np.int64)[coded.indices.to_numpy()]
        starts, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        at = np.cumsum(sizes)
        total = int(at[-1]) if len(at) else 0
        ids = self.flat[np.repeat(starts - (at - sizes), sizes) + np.arange(total)]
        offsets = split.offsets.to_numpy()
        before = np.concatenate([[0], at])
        return ids, np.diff(before[offsets - offsets[0]])


@lru_cache(maxsize=1)
def stretch_encoder(json_path: str) -> StretchEncoder:
    return StretchEncoder(json_path)


def _shards(json_path: str, end_id: int, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, part = stretch_encoder(json_path), TaskContext.get().partitionId()
        doc_ids, sizes, ids = [], [], []
        shard = before = held = 0

        def closed():
            stream = np.concatenate(ids)
            row = [[part], [shard], [before], [len(stream)], [list(doc_ids)], [np.cumsum(sizes)], [to_bytes(stream)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "shard", "before", "n_ids", "doc_ids", "ends", "body"])

        for batch in batches:
            flat, counts = encoder.encode(batch.column("text"))
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                doc_ids.append(doc_id)
                sizes.append(n + 1)
                ids.append(np.append(flat[at : at + n], np.uint32(end_id)))
                at, held = at + n, held + n + 1
                if held >= shard_ids:
                    yield closed()
                    shard, before, held = shard + 1, before + held, 0
                    doc_ids, sizes, ids = [], [], []
        if ids:
            yield closed()

    return run


def token_shards(docs: DataFrame, json_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row a shard (SHARDS), to be written as it is; (part, shard) is the order of the ids."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", F.xxhash64("text")]
    dealt = text_rows(docs).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return map_arrow(dealt, _shards(json_path, end_id, shard_ids), SHARDS)


def with_starts(shards: DataFrame) -> DataFrame:
    """shards with start: the number of ids in all shards before. One row a part reaches the driver."""
    spark = shards.sparkSession
    rows, total = [], 0
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        rows.append((part, total))
        total += n
    ahead = spark.createDataFrame(rows, "part int, ahead long")
    return shards.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")


def _decoded(with_ids: bool):
    def run(batches):
        for batch in batches:
            for start, doc_ids, ends, body in zip(*[batch.column(c) for c in ("start", "doc_ids", "ends", "body")], strict=True):
                shard, start = Shard(body.as_py()), start.as_py()
                ids, ends = shard.read(0, len(shard)), ends.values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [doc_ids.values, pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document, decoded from the shards."""
    return map_arrow(with_starts(shards), _decoded(True), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def document_digests(shards: DataFrame) -> DataFrame:
    """read_documents without the ids themselves."""
    return map_arrow(with_starts(shards), _decoded(False), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(shards: DataFrame, start: int, stop: int) -> DataFrame:
    """start and ids of the pieces, one a shard, that hold the ids from start to before stop of the whole table."""

    def run(batches):
        for batch in batches:
            for first, body in zip(batch.column("start").to_pylist(), batch.column("body"), strict=True):
                ids = Shard(body.as_py()).read(start - first, stop - first)
                yield pa.RecordBatch.from_arrays([pa.array([max(start, first)], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["start", "ids"])

    held = with_starts(shards).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return map_arrow(held.select("start", "body"), run, "start long, ids array<long>")


def write_and_digest(docs: DataFrame, json_path: str) -> DataFrame:
    """The shards written to the shared folder, and what reading them back gives."""
    return document_digests(stored(token_shards(docs, json_path), "token-ids"))
