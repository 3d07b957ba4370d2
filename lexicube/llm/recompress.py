"""Locally consistent parsing of texts by recompression.

Each round joins pairs: a symbol a in the left and b in the right half of the alphabet
become one symbol (a, b). A name is a 64-bit hash of what it stands for, and the half of
a symbol is a bit of its name and the round, so a name means the same in every text and
on every executor. Symbols of ``freeze`` or more characters take no further part, so none
spans more than 2 * ``freeze`` - 2. Runs of one symbol stay as they are: both halves of a
pair (a, a) are the same, and naming a run would need its ends, which may lie outside.

**Equal substrings share their inner symbols.** Whether two neighbours are joined depends
on nothing but these two symbols. So, of the symbols that lie wholly inside a substring
and are the same wherever it stands, a round can only spoil the first and the last: they
may be joined to what lies outside. Before round r (from 0) a symbol that still takes part
has at most min(2**r, freeze - 1) characters. Hence at either end at most
``loss`` = sum of those over the rounds are spoilt, and what lies between is cut into the
same symbols everywhere.

A *key* is the shortest sequence of symbols from a symbol on that spans ``least``
characters or more (at most ``least`` + 2 * ``freeze`` - 3). For a window of ``width``
characters at p, the *designated* key is the one with the smallest hash of those that start
in [p + loss, p + loss + reach); ``reach`` is chosen so that they end before
p + width - loss. They all lie in the part that is the same everywhere, so equal windows
have the same designated key at the same place in them: a window can stand in another text
only if its designated key does.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a place in one array of texts; the rest of a word orders the keys.
PLACE = 24


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: Names of the characters of the first plane.
    _NAMES = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to ``n``, kept for the next call."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n, 1 << 19) + 1
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(size, np.uint64(b), dtype=np.uint64)
                x[0] = 1
                both.append(np.cumprod(x))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def loss(rounds: int, freeze: int) -> int:
    """Characters at either end of a substring whose symbols may differ."""
    return sum(min(1 << r, freeze - 1) for r in range(rounds))


def reach(width: int, least: int, rounds: int, freeze: int) -> int:
    """Length of the stretch in which the designated key of a window starts."""
    out = width - 2 * loss(rounds, freeze) - (least + 2 * freeze - 3) + 1
    if out < 2 * freeze - 2:
        raise ValueError("width is too small for these rounds, freeze and least")
    return out


def parse(codes: np.ndarray, rounds: int = 6, freeze: int = 8, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names and start positions of the symbols of a text given as code points.

    ``breaks`` are positions of separators, over which nothing is joined: so many
    texts are parsed as one array.
    """
    with np.errstate(over="ignore"):
        names = _NAMES[np.minimum(codes, 0xFFFF)]
        wide = np.flatnonzero(codes > 0xFFFF)
        if len(wide):
            names[wide] = mix64(codes[wide].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        starts = np.arange(len(codes), dtype=np.int32)
        wall = np.zeros(len(codes) + 1, dtype=bool)
        if breaks is not None and len(breaks):
            wall[breaks] = True
        n = len(codes)
        for r in range(rounds):
            live = (np.diff(starts, append=n) < freeze) & ~wall[starts]
            side = ((names >> np.uint64(r * 5 + 1)) & np.uint64(1)).astype(bool)
            left = np.flatnonzero(live[:-1] & live[1:] & ~side[:-1] & side[1:])
            if not len(left):
                continue
            names[left] = mix64(names[left] * np.uint64(3) + mix64(names[left + 1] + np.uint64(7)))
            keep = np.ones(len(names), dtype=bool)
            keep[left + 1] = False
            names, starts = names[keep], starts[keep]
    return names, starts


def keys(names: np.ndarray, starts: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of every symbol's shortest sequence that spans ``least`` characters."""
    ends = np.append(starts[1:], n)
    last = np.searchsorted(ends, starts + least)
    first = np.flatnonzero(last < len(starts))
    if not len(first):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    with np.errstate(over="ignore"):
        # polynomial hash of the sequence from running sums, in arithmetic modulo 2**64
        up, down = powers(0x9E3779B97F4A7C15, len(names))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(names * up[: len(names)])))
        stop = last[first] + 1
        value = (sums[stop] - sums[first]) * down[first]
        return mix64(value + (stop - first).astype(np.uint64)), starts[first], ends[last[first]]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    blocks = np.append(values, np.full(pad, np.uint64(2**64 - 1))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def designated(codes: np.ndarray, breaks: np.ndarray, width: int, least: int, rounds: int, freeze: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): the designated keys and the windows, by their starts, each stands for.

    ``codes`` holds texts, each followed by a separator at ``breaks``. Every window of
    every text is in exactly one row.
    """
    key, start, end = keys(*parse(codes, rounds, freeze, breaks), len(codes), least)
    own = np.searchsorted(breaks, start)
    inside = (own < len(breaks)) & (end <= breaks[np.minimum(own, len(breaks) - 1)])
    key, start = key[inside], start[inside]
    order = np.full(len(codes), np.uint64(2**64 - 1))
    order[start] = (key >> np.uint64(PLACE) << np.uint64(PLACE)) | start.astype(np.uint64)
    skip = loss(rounds, freeze)
    least_at = sliding_least(order[skip:], reach(width, least, rounds, freeze))
    place = np.full(len(codes), -1, dtype=np.int64)
    place[: len(least_at)] = (least_at & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    # a window must lie in one text
    stop = np.repeat(breaks, np.diff(breaks, prepend=-1))
    place[np.arange(len(codes)) + width > stop] = -1
    change = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    ends = np.append(change[1:], len(place)) - 1
    real = place[change] >= 0
    first, last, where = change[real], ends[real], place[change[real]]
    return key[np.searchsorted(start, where)], first, last


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every substring of ``width`` characters."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(0xD6E8FEB86659FD93, len(codes))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))
        return mix64((sums[width:] - sums[:n]) * down[:n])
