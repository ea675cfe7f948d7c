"""Greedy word-piece lengths of whole texts.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text. The automaton (tokens.LongestMatch) counts a word's pieces in time
linear in its bytes; counts of words met before come from a bounded table.

Edge cases: null or empty text has no words and no pieces; a word that greedy matching cannot cover is one unknown
piece; equal rows give equal rows; null doc_ids stay; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from netquarry.llm.runtime import map_arrow, text_rows
from netquarry.llm.tokens import word_pieces

#: Words remembered by a Python worker; longer words than this many bytes are never remembered.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64


class _Counts(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def _counter(ranks_path: str):
    def run(batches):
        automaton, _, _ = word_pieces(ranks_path)
        known = _Counts(automaton.count)
        for batch in batches:
            n_words, n_pieces, longest = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                pieces = list(map(known.__getitem__, words))
                n_words.append(len(words))
                n_pieces.append(sum(pieces))
                longest.append(max(pieces, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_pieces, longest)]], ["doc_id", "n_words", "n_pieces", "most_pieces"])

    return run


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_words, n_pieces, most_pieces (of one word)."""
    return map_arrow(text_rows(docs), _counter(ranks_path), "doc_id long, n_words long, n_pieces long, most_pieces long")
