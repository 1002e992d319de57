"""Burrows-Wheeler transforms of collections of strings of numbers, and their merge by interleave refinement.

Each string is cyclic and ends in the symbol 0, which stands nowhere else. The transform of a shard lists, for all rotations of its
strings in order, the symbol before each. Two or more transforms are merged without their strings: an interleave says from which
shard each place of the merged order comes. It starts as the shards one after another and is refined in passes;
pass k takes the symbols that the shards have at its places and sorts the interleave by them, stably, after which it is
right for the first k symbols. Places that part in pass k share a prefix of k - 1 symbols.
"""

from __future__ import annotations

import numpy as np


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a shard, and the place (in the concatenated strings) of each rotation in order."""
    return transform_flat(np.concatenate([np.zeros(0, np.int64), *strings]).astype(np.int64), np.fromiter(map(len, strings), np.int64, len(strings)))


def transform_flat(flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As transform(), of strings that stand one after another."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.repeat(np.cumsum(length) - length, length)
    size = np.repeat(length, length)
    within = np.arange(len(flat)) - first
    rank = flat if int(flat.max()) < 1 << 31 else _ranked(flat)  # any order of the symbols will do, if it is the same for all shards
    step = 1
    while step < int(length.max()):  # doubling: ranks by twice as many symbols
        after = within + step
        after = rank[first + (after % size)]
        found = _ranked(rank * (int(after.max()) + 1) + after)
        done = int(found.max()) == int(rank.max())
        rank = found
        if done:
            break
        step *= 2
    order = np.argsort(rank, kind="stable")
    return flat[first[order] + (within[order] - 1) % size[order]], order


def _ranked(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    edge = np.append(False, values[order][1:] != values[order][:-1])
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(edge)
    return rank


def _stable(values: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers, by 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    high = values >> 16
    while high.any():
        order = order[np.argsort((high[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        high = high >> 16
    return order


def merged(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave after ``depth`` passes, and the common prefix of each place with the one before, ``depth`` at most.

    The places of one shard keep their order, so the i-th place of a shard in the interleave is its i-th rotation.
    """
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), sizes)
    block = np.zeros(len(shard), np.int64)  # of places whose first symbols agree so far
    common = np.full(len(shard), depth, np.int64)
    common[:1] = 0
    flat = np.concatenate([np.zeros(0, np.int64), *transforms]).astype(np.int64)
    for k in range(depth):
        # the i-th place of each shard stands at the i-th symbol of its transform
        by_shard = np.argsort(shard, kind="stable")
        place = np.empty(len(shard), np.int64)
        place[by_shard] = np.arange(len(shard))
        symbol = flat[place]
        order = _stable(symbol)
        symbol, block, shard = symbol[order], block[order], shard[order]
        edge = np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])) if len(shard) else np.zeros(0, bool)
        common[edge & (common == depth)] = k
        block = np.cumsum(edge)
    return shard, common


def repeated(strings: list[np.ndarray], shards: int, depth: int) -> np.ndarray:
    """Which strings share ``depth`` symbols in a row with a rotation elsewhere: those in an interval of common prefixes."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.concatenate([np.zeros(0, np.int64), *strings]).astype(np.int64)
    own = np.arange(len(strings)) * min(shards, max(1, len(strings))) // max(1, len(strings))
    out = np.zeros(len(strings), bool)
    out[np.repeat(np.arange(len(strings)), length)[repeated_places(flat, length, own, depth)]] = True
    return out


def repeated_places(flat: np.ndarray, length: np.ndarray, shard_of: np.ndarray, depth: int) -> np.ndarray:
    """Of strings that stand one after another, whether the ``depth`` symbols at each place stand elsewhere too.

    ``shard_of`` has the shard of each string, ascending. Each shard has its transform; these are merged, and only the intervals
    of common prefixes that the merge derives say what is repeated.
    """
    made = []
    edges = np.flatnonzero(np.append(True, np.diff(shard_of) != 0)) if len(shard_of) else np.zeros(0, np.int64)
    starts = np.append(np.cumsum(length) - length, len(flat))
    for a, b in zip(edges, [*edges[1:], len(shard_of)], strict=False):
        made.append((int(starts[a]), *transform_flat(flat[starts[a] : starts[b]], length[a:b])))
    shard, common = merged([t for _, t, _ in made], depth)
    inside = common >= depth
    inside = inside | np.append(inside[1:], False)
    out = np.zeros(len(flat), bool)
    for i, (start, _, order) in enumerate(made):
        out[start + order[inside[shard == i]]] = True
    return out
