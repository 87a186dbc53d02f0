"""A collection's Burrows-Wheeler transform and common prefixes, built column by column through sequential files."""

from __future__ import annotations

import os

import numpy as np

#: Bytes of a symbol at most: fewer, wider columns cost less.
WIDEST = 5


class Column:
    """A value for each row of the growing matrix, in a file that each round reads and writes once from end to end."""

    def __init__(self, folder: str, name: str, dtype):
        self.file, self.dtype, self.n = open(os.path.join(folder, name), "w+b"), np.dtype(dtype), 0  # noqa: SIM115

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.dtype, self.n)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        values.tofile(self.file)
        self.file.flush()
        self.n = len(values)


def sorted_by(symbols: np.ndarray, term: int) -> np.ndarray:
    """A stable order by symbol, term being the largest; 16 bits are sorted at a time, which numpy does by counting."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    for shift in range(16, int(term).bit_length(), 16):
        order = order[np.argsort((symbols >> np.uint64(shift)).astype(np.uint16)[order], kind="stable")]
    return order


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of low .. high (both included) of each range, from minima over spans of powers of two."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out, span = np.empty(len(low), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(span[low[at]], span[high[at] - (1 << k) + 1])
        span = np.minimum(span[: -(1 << k)], span[1 << k :])
    return out


def build(flat: np.ndarray, term: int, starts: np.ndarray, lengths: np.ndarray, length: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """For the strings flat[start : start + length] of symbols below term: (windows, lcp) of the finished matrix.

    Each round inserts one more symbol of every string that still has one, from its end: where a suffix goes follows
    from the transform alone (its symbol's place among all equal symbols), and its common prefix with the rows
    around it from the least common prefix between the equal symbols above and below. windows: for each row the
    number of its window, counted over all substrings of `length` symbols string by string, or -1 for a shorter
    suffix. lcp: symbols in common with the row above, `length` at most. Memory is a few numbers for each row.
    """
    n = len(starts)
    # one column holds the transform's symbol and, in the low byte, the common prefix with the row above
    if term >= 1 << 56 or length > 255:
        raise ValueError("symbols have 56 bits at most, and windows 255 symbols")
    eight = np.uint64(8)
    column, ids = Column(folder, "bwt-lcp", np.uint64), Column(folder, "ids", np.int64)
    ends = starts + lengths
    windows = lengths - length + 1
    first_window = np.cumsum(windows) - windows
    column.write(flat[ends - 1].astype(np.uint64) << eight)
    row, string = np.arange(n), np.arange(n, dtype=np.int32)  # of the suffixes inserted last, by row
    owner = np.zeros(int(lengths.sum()) + n, np.int32)
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        both = column.read()
        symbols = both >> eight
        common = both.astype(np.uint8)
        if depth == length:
            ids.write(np.full(len(symbols), -1, np.int64))
        order = sorted_by(symbols, term)
        order = order[: len(symbols) - np.count_nonzero(symbols == term)]
        live = lengths[string] >= depth
        row, string = row[live], string[live]
        inserted = np.zeros(len(symbols), bool)
        inserted[row], owner[row] = True, string
        place = np.flatnonzero(inserted[order])  # among the rows that start with a symbol
        old = order[place]
        string, symbol = owner[old], symbols[old]
        row = place + n
        above, below = order[np.maximum(place - 1, 0)], order[np.minimum(place + 1, len(order) - 1)]
        has_above = (place > 0) & (symbols[above] == symbol)
        has_below = (place < len(order) - 1) & (symbols[below] == symbol)
        own, after = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        for values, has, low, high in ((own, has_above, above, old), (after, has_below, old, below)):
            values[has] = np.minimum(range_min(common, low[has] + 1, high[has]).astype(np.uint64) + np.uint64(1), np.uint64(length))
        before = np.where(lengths[string] > depth, flat[np.maximum(ends[string] - depth - 1, 0)], term).astype(np.uint64)
        at = row - np.arange(len(row))
        both = np.insert(both, at, before << eight | own)
        follows = row + 1 < len(both)
        next_row = row[follows] + 1
        both[next_row] = both[next_row] >> eight << eight | after[follows]
        column.write(both)
        if depth >= length:
            ids.write(np.insert(ids.read(), at, first_window[string] + lengths[string] - depth))
    return (ids.read() if ids.n else np.full(n, -1, np.int64)), column.read().astype(np.uint8)


def wide_symbols(flat: np.ndarray, wide: int) -> tuple[np.ndarray, int]:
    """(the rank of the `wide` bytes at each place among all that occur, their number); any number of ranks fits."""
    padded = np.append(flat, np.zeros(wide, np.uint8)).astype(np.uint64)
    value = np.zeros(len(flat), np.uint64)
    for k in range(wide):
        value = value << np.uint64(8) | padded[k : k + len(flat)]
    order = np.argsort(value, kind="stable")
    rank = np.empty(len(flat), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([0], value[order][1:] != value[order][:-1])))
    return rank, int(rank.max()) + 1


def least_of_equal(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, length: int, folder: str) -> np.ndarray:
    """For each window of `length` bytes, string by string: the least value of the strings that hold an equal window.

    A symbol is as many bytes as divide length, WIDEST at most, so a string counts as one for each of its first places
    and has fewer symbols; the columns are still inserted one a round.
    """
    wide = max(k for k in range(1, WIDEST + 1) if length % k == 0)
    rank, term = wide_symbols(flat, wide)
    # the symbols of the string from place p on, p < wide, next to one another
    phase = np.tile(np.arange(wide), len(starts))
    string = np.repeat(np.arange(len(starts)), wide)
    n = np.maximum(lengths[string] - phase, 0) // wide
    string, phase, n = string[n >= length // wide], phase[n >= length // wide], n[n >= length // wide]
    at = np.cumsum(n) - n
    place = np.repeat(starts[string] + phase - at * wide, n) + np.arange(int(n.sum())) * wide
    windows, lcp = build(rank[place], term, at, n, length // wide, folder)
    per_string = n - length // wide + 1
    owner = np.repeat(np.arange(len(string)), per_string)
    rows = np.flatnonzero(windows >= 0)
    group = np.cumsum(lcp < length // wide)[rows]
    window = windows[rows]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    found = np.empty(len(owner), values.dtype)
    if len(rows):
        least = np.minimum.reduceat(values[string[owner[window]]], first)
        found[window] = np.repeat(least, np.diff(np.append(first, len(rows))))
    # back to the order of the windows in the strings
    each = lengths - length + 1
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per_string) - per_string, per_string)
    to = (np.cumsum(each) - each)[string[owner]] + phase[owner] + within * wide
    out = np.empty(int(each.sum()), values.dtype)
    out[to] = found
    return out
