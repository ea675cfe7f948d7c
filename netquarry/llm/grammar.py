"""Re-Pair grammars of token ids: numpy rounds, a binary form, and decoding of any range by expansion lengths.

A round counts all neighbouring pairs and takes the frequent ones, most frequent first, as long as no symbol is the left
of one and the right of another; so no two occurrences overlap (but in runs of one symbol, where every second is taken)
and each pair taken is replaced everywhere. Rounds go on until no pair is frequent.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: A pair is replaced while it occurs at least so often in its shard; a rule costs three numbers.
LEAST_COUNT = 16
#: A round takes pairs down to this share of the most frequent one's count.
ROUND_SHARE = 32
_MAGIC = b"RPG1"
_SHIFT = 32


def compress(ids: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, sequence): symbol k < len(terminals) is that id, each later symbol is the pair rules[k - len(terminals)]."""
    terminals = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    number = np.zeros(int(terminals[-1]) + 1 if len(terminals) else 0, np.int64)
    number[terminals] = np.arange(len(terminals))
    symbols = number[ids]
    rules, known = [], len(terminals)
    while len(symbols) > 1:
        taken = _frequent(symbols, known, least)
        if not len(taken):
            break
        symbols = _replaced(symbols, taken, known)
        rules.append(np.stack([taken >> _SHIFT, taken & (2**_SHIFT - 1)], axis=1))
        known += len(taken)
    return terminals, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), symbols


def _frequent(symbols: np.ndarray, known: int, least: int) -> np.ndarray:
    """The pairs that this round replaces, as codes in ascending order. Few symbols make short codes, which sort faster."""
    shift, kind = (16, np.uint32) if known <= 1 << 16 else (_SHIFT, np.int64)
    codes = (symbols[:-1] << shift | symbols[1:]).astype(kind)
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(first, len(codes)))
    if counts.max() < least:
        return np.zeros(0, np.int64)
    some = np.flatnonzero(counts >= max(least, counts.max() // ROUND_SHARE))
    pairs = codes[first[some]].astype(np.int64)[np.argsort(-counts[some], kind="stable")]
    pairs = pairs >> shift << _SHIFT | pairs & ((1 << shift) - 1)
    lefts, rights, taken = set(), set(), []
    for code in pairs.tolist():
        a, b = code >> _SHIFT, code & (2**_SHIFT - 1)
        if a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights)):
            lefts.add(a)
            rights.add(b)
            taken.append(code)
    return np.sort(np.array(taken, np.int64))


def _replaced(symbols: np.ndarray, taken: np.ndarray, known: int) -> np.ndarray:
    is_left, is_right = np.zeros(known, bool), np.zeros(known, bool)
    is_left[taken >> _SHIFT] = True
    is_right[taken & (2**_SHIFT - 1)] = True
    at = np.flatnonzero(is_left[symbols[:-1]] & is_right[symbols[1:]])
    code = symbols[at] << _SHIFT | symbols[at + 1]
    rank = np.minimum(np.searchsorted(taken, code), len(taken) - 1)
    hit = taken[rank] == code
    at, rank = at[hit], rank[hit]
    # Neighbouring hits are runs of one symbol: every second of a run is taken.
    begins = np.concatenate([[True], np.diff(at) != 1])
    start = np.maximum.accumulate(np.where(begins, at, 0))
    own = (at - start) % 2 == 0
    at, rank = at[own], rank[own]
    out = symbols.copy()
    out[at] = known + rank
    stays = np.ones(len(out), bool)
    stays[at + 1] = False
    return out[stays]


def stretches(n_terminals: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rules that name no rule of their own run, so that each can be worked on at once."""
    at, latest = 0, np.maximum(left, right)
    while at < len(latest):
        later = np.flatnonzero(latest[at:] >= n_terminals + at)
        end = at + int(later[0]) if len(later) else len(latest)
        yield at, end
        at = end


def expansion_lengths(n_terminals: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each symbol stands for. A rule names earlier symbols only."""
    sizes = np.ones(n_terminals + len(rules), np.int64)
    for lo, hi in stretches(n_terminals, rules[:, 0], rules[:, 1]):
        sizes[n_terminals + lo : n_terminals + hi] = sizes[rules[lo:hi]].sum(axis=1)
    return sizes


def _packed(values: np.ndarray) -> bytes:
    kind = "<u2" if not len(values) or values.max() < 1 << 16 else "<u4"
    body = values.astype(kind).tobytes()
    return struct.pack("<BQ", int(kind[-1]), values.size) + body


def to_bytes(ids: np.ndarray, least: int = LEAST_COUNT) -> bytes:
    """Magic, then terminals, left and right symbols of the rules, expansion lengths of the rules, and the sequence; each with
    the width of its numbers (2 or 4 bytes, little-endian) and how many there are."""
    terminals, rules, sequence = compress(ids, least)
    sizes = expansion_lengths(len(terminals), rules)[len(terminals) :]
    return _MAGIC + b"".join(map(_packed, (terminals, rules[:, 0], rules[:, 1], sizes, sequence)))


class Shard:
    """Ids of a shard, read from its bytes."""

    def __init__(self, body: bytes):
        if body[:4] != _MAGIC:
            raise ValueError("not a shard of token ids")
        parts, at = [], 4
        for _ in range(5):
            width, n = struct.unpack_from("<BQ", body, at)
            parts.append(np.frombuffer(body, f"<u{width}", n, at + 9).astype(np.int64))
            at += 9 + width * n
        self.terminals, self.left, self.right, sizes, self.sequence = parts
        self.sizes = np.concatenate([np.ones(len(self.terminals), np.int64), sizes])
        self.ends = np.cumsum(self.sizes[self.sequence])
        self.known: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to before stop; only what the symbols that hold them stand for is looked up."""
        start, stop = max(0, start), min(stop, len(self))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, [start, stop - 1], side="right")
        symbols = self.sequence[a : b + 1]
        before = int(self.ends[a] - self.sizes[symbols[0]])
        return self._expanded(symbols)[start - before : stop - before]

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        flat, at = self._expansions()
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        return flat[np.repeat(at[symbols] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all symbols one after another, and where each begins. A rule's two sides are known before it."""
        if self.known is None:
            at = np.cumsum(self.sizes) - self.sizes
            flat = np.zeros(int(self.sizes.sum()), np.uint32)
            n = len(self.terminals)
            flat[:n] = self.terminals
            for lo, hi in stretches(n, self.left, self.right):
                for side, begin in ((self.left[lo:hi], at[n + lo : n + hi]), (self.right[lo:hi], at[n + lo : n + hi] + self.sizes[self.left[lo:hi]])):
                    sizes = self.sizes[side]
                    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    flat[np.repeat(begin, sizes) + step] = flat[np.repeat(at[side], sizes) + step]
            self.known = flat, at
        return self.known
