"""Re-Pair grammars over token ids, with random access to the decoded ids.

A grammar has rules ``base + k -> (left, right)`` whose sides are ids below ``base`` or earlier rules, the length of
each symbol's expansion, and the sequence that is left. Pairs are counted over the whole shard in each round; every
round replaces the frequent ones, left to right without overlap.
"""

from __future__ import annotations

import itertools
import struct
from dataclasses import dataclass

import numpy as np

from helixspark.llm.pretokens import gather, offsets

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIQB")


@dataclass
class Grammar:
    base: int  #: ids are below it
    rules: np.ndarray  #: (n, 2) uint32
    lengths: np.ndarray  #: of the rules' expansions
    sequence: np.ndarray  #: uint32

    def __post_init__(self):
        self._ends = self._table = None

    @property
    def ends(self) -> np.ndarray:
        """Decoded length up to each symbol of the sequence."""
        if self._ends is None:
            rule = self.sequence >= self.base
            size = np.ones(len(self.sequence), np.int64)
            size[rule] = self.lengths[self.sequence[rule] - self.base]
            self._ends = np.cumsum(size)
        return self._ends

    def _expanded_rules(self) -> np.ndarray:
        """The ids of all rules, one after another: one gather a nesting level."""
        symbols, flat = np.arange(len(self.rules), dtype=np.uint32) + np.uint32(self.base), self.rules.ravel()
        while (rule := symbols >= self.base).any():
            # a plain id is gathered from the symbols themselves, which stand behind the rules
            start = np.where(rule, 2 * (symbols.astype(np.int64) - self.base), len(flat) + np.arange(len(symbols)))
            symbols = gather(np.concatenate([flat, symbols]), start, np.where(rule, 2, 1))
        return symbols

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that a run of symbols stands for."""
        if self._table is None:
            length = np.concatenate([np.ones(self.base, np.int64), self.lengths])
            self._table = np.concatenate([np.arange(self.base, dtype=np.uint32), self._expanded_rules()]), offsets(length), length
        flat, start, length = self._table
        return gather(flat, start[symbols], length[symbols])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Decoded ids start..stop; only the symbols that cover them are expanded."""
        total = int(self.ends[-1]) if len(self.sequence) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.ends, [start, stop - 1], "right")
        before = int(self.ends[first - 1]) if first else 0
        return self.expanded(self.sequence[first : last + 1])[start - before : stop - before]

    def to_bytes(self) -> bytes:
        wide = 4 if self.base + len(self.rules) > 1 << 16 else 2
        kind = f"<u{wide}"
        head = _HEAD.pack(MAGIC, self.base, len(self.rules), 0, len(self.sequence), wide)
        return head + self.rules.astype(kind).tobytes() + self.lengths.astype("<u4").tobytes() + self.sequence.astype(kind).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Grammar:
        magic, base, n_rules, _, n, wide = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a grammar")
        kind, at = f"<u{wide}", _HEAD.size
        rules = np.frombuffer(data, kind, 2 * n_rules, at).astype(np.uint32).reshape(-1, 2)
        at += 2 * n_rules * wide
        lengths = np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)
        return cls(base, rules, lengths, np.frombuffer(data, kind, n, at + 4 * n_rules).astype(np.uint32))


_SLOT_BITS = 18


def _slot(pairs: np.ndarray) -> np.ndarray:
    wide = pairs.dtype.type
    mixed = pairs * wide(0x9E3779B1 if pairs.itemsize == 4 else 0x9E3779B97F4A7C15)
    return mixed >> wide(pairs.itemsize * 8 - _SLOT_BITS)


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at places ``at`` to replace: of pairs that overlap, the one of the highest rank, then those that are left; of a pair that overlaps itself, every other one from the left.

    This depends on nothing but the neighbouring symbols, so copies stay copies.
    """
    kept, open_ = np.zeros(len(at), bool), np.arange(len(at))
    while len(open_):
        here, high = at[open_], rank[open_]
        beside = np.diff(here) == 1
        begin = np.flatnonzero(np.append(True, ~beside | (high[1:] != high[:-1])))  # of runs of one pair over itself
        best = (np.arange(len(here)) - np.repeat(begin, np.diff(begin, append=len(here)))) % 2 == 0
        best[1:] &= ~(beside & (high[:-1] > high[1:]))
        best[:-1] &= ~(beside & (high[1:] > high[:-1]))
        kept[open_[best]] = True
        gone = best.copy()
        gone[1:] |= best[:-1] & beside
        gone[:-1] |= best[1:] & beside
        open_ = open_[~gone]
    return kept


def _replace(sequence: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Put symbols[i] in place of the pair at at[i]."""
    out = sequence.copy()
    out[at] = symbols
    stay = np.ones(len(sequence), bool)
    stay[at + 1] = False
    return out[stay]


def compressed(ids: np.ndarray, base: int, min_count: int = 32, max_rounds: int | None = None, max_symbols: int = 1 << 31) -> Grammar:
    """The grammar of ``ids``. A round replaces the pairs that occur at least ``min_count`` times and a sixteenth as often as the most frequent one.

    Rounds go on until no pair occurs ``min_count`` times, unless ``max_rounds`` or ``max_symbols`` ends them before. Symbols
    are handled in 16 bits as long as they fit.
    """
    sequence = ids.astype(np.uint32)
    rules, lengths = np.zeros((0, 2), np.uint32), np.ones(base, np.int64)  # lengths of all symbols, the plain ones first
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        room = max_symbols - len(lengths)
        if len(sequence) <= min_count or room <= 0:
            break
        wide, bits = (np.uint32, 16) if len(lengths) <= 1 << 16 else (np.uint64, 32)
        pairs = (sequence[:-1].astype(wide) << wide(bits)) | sequence[1:].astype(wide)
        ordered = np.sort(pairs)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(edge, append=len(ordered))
        most = int(count.max())
        if most < min_count:
            break
        frequent = np.flatnonzero(count >= max(min_count, most // 16))
        if len(frequent) > room:
            frequent = np.sort(frequent[np.argsort(-count[frequent], kind="stable")[:room]])
        chosen = ordered[edge[frequent]]  # ascending
        # a table by hash finds the pair at each place; of chosen pairs that meet in a slot, one waits for the next round
        slot = _slot(chosen)
        table = np.zeros(1 << _SLOT_BITS, np.int32)
        table[slot] = np.arange(len(chosen), dtype=np.int32)
        won = table[slot] == np.arange(len(chosen))
        chosen, rank = chosen[won], count[frequent][won]
        rank[np.lexsort((slot[won], rank))] = np.arange(len(chosen))  # by frequency
        table[slot[won]] = np.arange(len(chosen), dtype=np.int32)
        found = table[_slot(pairs)]
        at = np.flatnonzero(chosen[found] == pairs)
        found = found[at]
        keep = _apart(at, rank[found])
        # a pair that others leave few places waits; the first of all has half of its own at least
        used = np.bincount(found[keep], minlength=len(chosen)) >= max(1, min_count // 4)
        keep &= used[found]
        at, found, chosen = at[keep], (np.cumsum(used) - 1)[found[keep]], chosen[used]
        sequence = _replace(sequence, at, (len(lengths) + found).astype(np.uint32))
        new = np.stack([chosen >> wide(bits), chosen & wide((1 << bits) - 1)], 1).astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[new].sum(1)])
        rules = np.concatenate([rules, new])
    lengths = lengths[base:]
    return Grammar(base, rules, lengths, sequence)
