"""Two-stage suffix sorting of one bounded text, and the common prefixes of neighbours.

Only suffixes that are smaller than their successors are sorted directly. Every
other suffix is larger than its successor, so one scan of the buckets in ascending
order puts it in place behind the suffix that it precedes in the text. The order is
by the first `depth` symbols at least, which is all that common prefixes up to that
length need.
"""

from __future__ import annotations

import numpy as np

#: 9 bits a symbol: seven symbols make one key.
_PER_KEY = 7


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one counts as smaller."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    out = np.ones(n, bool)
    # equal symbols have the type of the next place where neighbours differ
    at = np.searchsorted(differs, np.arange(n - 1))
    known = at < len(differs)
    place = differs[at[known]]
    out[:-1][known] = text[place] < text[place + 1]
    return out


def _direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """at, sorted by the first `depth` symbols from there on."""
    padded = np.concatenate([text, np.zeros(depth + _PER_KEY, text.dtype)]).astype(np.uint64)

    def key(places: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k in range(_PER_KEY):
            out = (out << np.uint64(9)) | padded[places + (_PER_KEY * j + k)]
        return out

    first = key(at, 0)
    order = np.argsort(first, kind="stable")
    at, now = at[order], first[order]
    new = np.append(True, now[1:] != now[:-1])
    for j in range(1, -(-depth // _PER_KEY)):
        # only runs of more than one suffix are still open
        lone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~lone)
        if not len(open_):
            break
        run, k = np.cumsum(new)[open_], key(at[open_], j)
        order = np.lexsort((k, run))
        at[open_], k = at[open_][order], k[order]
        same = np.append(False, (k[1:] == k[:-1]) & (run[1:] == run[:-1]))
        new[open_] = ~same
    return at


def two_stage_sort(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes of text (symbols 0 .. 511, the last one 0), in order of their first `depth` symbols.

    needed: a mask that holds, with each suffix larger than its successor, that
    successor too; the ones it lacks cost nothing.
    """
    small = smaller_than_successor(text)
    direct = _direct(text, np.flatnonzero(needed & small), depth)
    n_symbols = int(text.max(initial=0)) + 1
    bounds = np.searchsorted(text[direct], np.arange(n_symbols + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    larger = needed & ~small
    out = []

    def before(found: np.ndarray) -> np.ndarray:
        """Suffixes that start one symbol ahead and are larger than their successors."""
        found = found[found > 0] - 1
        return found[larger[found]]

    def deal(found: np.ndarray) -> None:
        if not len(found):
            return
        symbols = text[found]
        order = np.argsort(symbols, kind="stable")
        found, symbols = found[order], symbols[order]
        cuts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(found)), strict=True):
            induced[symbols[a]].append(found[a:b])

    for c in range(n_symbols):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(front):  # a run of one symbol goes on within its bucket
            out.append(front)
            ahead = before(front)
            same = text[ahead] == c
            deal(ahead[~same])
            front = ahead[same]
        own = direct[bounds[c] : bounds[c + 1]]
        out.append(own)
        deal(before(own))
        induced[c] = []
    return np.concatenate(out) if out else direct


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """For each of the sorted suffixes the length of the prefix it shares with the one before, up to limit."""
    out = np.zeros(len(suffixes), np.int64)
    if len(suffixes) < 2:
        return out
    padded = np.concatenate([text, np.zeros(limit, text.dtype)])
    open_ = np.arange(1, len(suffixes))
    for d in range(limit):
        open_ = open_[padded[suffixes[open_] + d] == padded[suffixes[open_ - 1] + d]]
        if not len(open_):
            break
        out[open_] = d + 1
    return out
