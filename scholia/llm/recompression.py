"""Locally consistent parsing of word sequences by recompression.

Rounds name maximal runs of one symbol and then pairs (left, right), where a symbol is left or right by a bit of its
name in that round. A name is a 64-bit hash of what it stands for, the same wherever it occurs, so naming is global
without a table. Each symbol carries the stretch of words that decides it: equal words there give the equal symbol at
the equal place, whatever stands around. Inside equal passages all symbols but those at the rims are equal.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ENOUGH = 4
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two names."""
    x = a * _C[0] + np.asarray(b, np.uint64) * _C[2] + _C[1]
    x ^= x >> np.uint64(30)
    x *= _C[1]
    x ^= x >> np.uint64(27)
    x *= _C[2]
    return x ^ (x >> np.uint64(31))


class Level(NamedTuple):
    """Symbols in order: name, first word, end, and the words lo to hi that decide the symbol; doc is its document."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray


def words_level(names: np.ndarray, doc: np.ndarray) -> Level:
    at = np.arange(len(names), dtype=np.int32)
    return Level(names, at, at + 1, at, at, doc)


def _joined(s: Level, first: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Level:
    """Symbols grouped from each place in ``first`` on."""
    last = np.append(first[1:], len(s.name)) - 1
    return Level(name, s.start[first], s.end[last], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), s.doc[first])


def _runs(s: Level, words: np.ndarray, step: int) -> Level:
    """Runs of one symbol become one. Where a run ends is decided by the next symbol's first word, if that differs."""
    n = len(s.name)
    same = np.zeros(n + 1, bool)  # same[k]: symbol k continues the run of k - 1
    same[1:n] = (s.name[1:] == s.name[:-1]) & (s.doc[1:] == s.doc[:-1])
    first = np.flatnonzero(~same[:n])
    last = np.append(first[1:], n) - 1
    out = _joined(s, first, s.name[first], s.lo, s.hi)
    long_ = last > first
    out.name[long_] = mixed(out.name[long_], (last - first + 1)[long_].astype(np.uint64) * np.uint64(64) + np.uint64(step))
    lo, hi = np.minimum(out.lo, out.start - 1), np.maximum(out.hi, out.end)
    # neighbours that begin (or end) with this symbol's own first (or last) word are looked at as a whole
    near = np.flatnonzero((words[out.start[:-1]] == words[out.start[1:]]) & (out.doc[:-1] == out.doc[1:])) if len(first) > 1 else first[:0]
    hi[near] = np.maximum(hi[near], out.hi[near + 1])
    lo[near] = np.minimum(lo[near], out.lo[near + 1])
    near = np.flatnonzero((words[out.end[1:] - 1] == words[out.end[:-1] - 1]) & (out.doc[:-1] == out.doc[1:])) + 1 if len(first) > 1 else first[:0]
    lo[near] = np.minimum(lo[near], out.lo[near - 1])
    hi[near] = np.maximum(hi[near], out.hi[near - 1])
    return out._replace(lo=lo, hi=hi)


def _pairs(s: Level, step: int) -> Level:
    """A left symbol and a right symbol after it become one; others are decided by the neighbour they didn't join."""
    n = len(s.name)
    right = (s.name >> np.uint64(step % 60) & np.uint64(1)).astype(bool)
    one_doc = np.append(s.doc[1:] == s.doc[:-1], False)
    joins = np.zeros(n, bool)  # joins[k]: k and k + 1 become one
    joins[:-1] = ~right[:-1] & right[1:]
    joins &= one_doc
    lo, hi = s.lo.copy(), s.hi.copy()
    single = ~joins
    single[1:] &= ~joins[:-1]
    k = np.flatnonzero(single & ~right)  # looks at the next symbol
    inner = k[one_doc[k]]
    lo[inner], hi[inner] = np.minimum(s.lo[inner], s.lo[inner + 1]), np.maximum(s.hi[inner], s.hi[inner + 1])
    edge = k[~one_doc[k]]
    hi[edge] = np.maximum(hi[edge], s.end[edge])
    k = np.flatnonzero(single & right)  # looks at the symbol before
    before = np.append(False, one_doc[:-1])
    inner = k[before[k]]
    lo[inner], hi[inner] = np.minimum(s.lo[inner], s.lo[inner - 1]), np.maximum(s.hi[inner], s.hi[inner - 1])
    edge = k[~before[k]]
    lo[edge] = np.minimum(lo[edge], s.start[edge] - 1)
    taken = np.zeros(n, bool)
    taken[1:] = joins[:-1]
    first = np.flatnonzero(~taken)
    name = s.name[first]
    two = joins[first]
    name[two] = mixed(name[two], s.name[first[two] + 1] + np.uint64(step))
    return _joined(s, first, name, lo, hi)


def rounds(words: np.ndarray, doc: np.ndarray, n: int) -> list[Level]:
    """Levels 0 (words) to n."""
    levels = [words_level(words, doc)]
    for step in range(n if len(words) else 0):
        levels.append(_pairs(_runs(levels[-1], words, step), step))
    return levels


def window_symbols(levels: list[Level], width: int) -> np.ndarray:
    """For each word the name of the symbol that stands for the window of ``width`` words from it.

    Of the symbols decided within the window it is one of ENOUGH words or, failing that, of most words; among these the
    one with the greatest name, so neighbouring windows mostly share theirs. Equal windows have equal names. Windows that
    leave a document have no meaning.
    """
    n = len(levels[0].name)
    best = np.full(n, -1, np.int64)
    base = 0
    for s in levels:
        spread = s.hi - s.lo
        use = np.flatnonzero((spread < width) & (s.lo >= 0))
        lo, room = s.lo[use], width - spread[use]
        size = np.minimum(s.end[use] - s.start[use], ENOUGH).astype(np.int64)
        rank = size << 56 | (s.name[use] >> np.uint64(44)).astype(np.int64) << 36 | (base + use)
        for d in range(width):
            k = np.flatnonzero((room > d) & (lo >= d))
            if not len(k):
                break
            np.maximum.at(best, lo[k] - d, rank[k])
        base += len(s.name)
    names = np.concatenate([s.name for s in levels])
    return names[best & ((1 << 36) - 1)]
