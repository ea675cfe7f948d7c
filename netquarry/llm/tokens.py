"""Token ids of the public byte-level BPE vocabulary, and greedy word-piece counts by a linear automaton."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

#: Texts of these characters only are split alike by both libraries; any other text goes to the slower one.
_SIMPLE = "[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-›€]"


@lru_cache(maxsize=1)
def _full(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=1)
def byte_bpe(json_path: str, ranks_path: str):
    """encode(text) -> ids by tokenizers' file without added special tokens; its faster equal where the text is simple.

    The file's own special strings are its special tokens wherever they stand in a text, as the plain call has it. The
    slower library is loaded by the first text that needs it.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f).get("added_tokens", ())]
    slow = re.compile("|".join([_SIMPLE, *map(re.escape, special)]))
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if slow.search(text):
            return _full(json_path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class LongestMatch:
    """Greedy longest-match-first piece counts of a word in one pass over its bytes.

    The trie of the vocabulary (initial and continuing pieces apart) gets, for every node, a failure link: the node
    reached when the longest pieces at the front of the node's string are popped, with the number of pieces popped.
    Reading a byte either descends, or follows links (each pops at least one piece); so a word takes linear time, and
    no piece is built.
    """

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]
        self.piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                if p:
                    node = root
                    for byte in p:
                        node = self._child(node, byte)
                    self.piece[node] = True
        self._links()

    def _child(self, node: int, byte: int) -> int:
        found = self.children[node].get(byte)
        if found is None:
            found = self.children[node][byte] = len(self.children)
            self.children.append({})
            self.piece.append(False)
        return found

    def _links(self) -> None:
        n = len(self.children)
        self.link: list[int | None] = [None] * n
        self.popped = [0] * n
        queue = [(root, byte, child) for root in (0, 1) for byte, child in self.children[root].items()]
        at = 0
        while at < len(queue):
            parent, byte, node = queue[at]
            at += 1
            if self.piece[node]:
                self.link[node], self.popped[node] = 1, 1
            else:
                z, k = self.link[parent], self.popped[parent]
                while z is not None and byte not in self.children[z]:
                    k += self.popped[z]
                    z = self.link[z]
                if z is not None:
                    self.link[node], self.popped[node] = self.children[z][byte], k
            queue.extend((node, b, c) for b, c in self.children[node].items())

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (the unknown piece) where greedy matching fails; 0 for no bytes."""
        node, total = 0, 0
        children, link, popped = self.children, self.link, self.popped
        for byte in word:
            while True:
                child = children[node].get(byte)
                if child is not None:
                    node = child
                    break
                if link[node] is None:
                    return 1
                total += popped[node]
                node = link[node]
        while node > 1:
            if link[node] is None:
                return 1
            total += popped[node]
            node = link[node]
        return total


@lru_cache(maxsize=2)
def word_pieces(ranks_path: str) -> tuple[LongestMatch, set[bytes], set[bytes]]:
    """Pieces of a rank file: those that begin with a space start a word, those without a space continue one."""
    with open(ranks_path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f]
    initial = {p[1:] for p in pieces if p[:1] == b" " and b" " not in p[1:] and p[1:]}
    continuing = {p for p in pieces if b" " not in p}
    return LongestMatch(initial, continuing), initial, continuing
