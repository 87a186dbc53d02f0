"""A minimal acyclic transducer: words with id outputs in an automaton that shares suffixes, in one flat file."""

from __future__ import annotations

import os
import tempfile

import numpy as np

from stridecast.llm.common import ragged


class Lexicon:
    """Each state has at most one arc a byte; an arc adds the number of words before it, so that a word's path sums to
    its place in sorted order, and the place gives its ids (a minimal perfect hash).

    The file: a header of five numbers, then of each arc its place (256 times the state and the byte, ascending), next state and
    output, then final states, ends of the words' ids, ids. It is as large as the arcs and ids: some 2 MB for 60,000 words.
    """

    def __init__(self, raw):
        states, words, n_ids, first, arcs = (int(x) for x in np.frombuffer(raw, np.int32, 5))
        at = 20
        parts = []
        for n in (arcs, arcs, arcs, states, words + 1, n_ids):
            parts.append(np.frombuffer(raw, np.int32, n, at))
            at += 4 * n
        self.arc, self.next, self.out, self.final, self.ends, self.flat = parts
        self.first = first

    @staticmethod
    def compile(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
        """Words must be sorted and distinct. States are made minimal as soon as no later word can change them."""
        arcs: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # the last word's states and bytes that aren't minimal yet
        free: list[int] = []

        def settle(keep: int) -> None:
            while len(path) > keep:
                parent, byte = path.pop()
                child = arcs[parent][byte]
                key = (final[child], tuple(arcs[child].items()))
                same = register.setdefault(key, child)
                if same != child:
                    arcs[parent][byte] = same
                    free.append(child)

        last = b""
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            settle(shared)
            state = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[shared:]:
                if free:
                    new = free.pop()
                    arcs[new], final[new] = {}, False
                else:
                    new = len(arcs)
                    arcs.append({})
                    final.append(False)
                arcs[state][byte] = new
                path.append((state, byte))
                state = new
            final[state] = True
            last = word
        settle(0)
        order = Lexicon._children_first(arcs)
        number = {s: k for k, s in enumerate(order)}
        below = np.zeros(len(order), np.int64)
        if len(order) >= 1 << 23:
            raise ValueError("the automaton has too many states for its file")
        rows, ends = [], np.zeros(len(order), np.int32)
        for k, s in enumerate(order):
            n = int(final[s])
            ends[k] = final[s]
            for byte, child in sorted(arcs[s].items()):
                rows.append((k << 8 | byte, number[child], n))
                n += below[number[child]]
            below[k] = n
        arc, step, out = np.array(rows, np.int64).reshape(-1, 3).T
        head = np.array([len(order), len(words), len(ids), number[0], len(rows)], np.int32)
        parts = (head, arc, step, out, ends, np.concatenate(([0], np.cumsum(counts))), ids)
        return b"".join(np.ascontiguousarray(p, np.int32).tobytes() for p in parts)

    @staticmethod
    def _children_first(arcs: list[dict[int, int]]) -> list[int]:
        order, seen, stack = [], {0}, [(0, iter(arcs[0].values()))]
        while stack:
            state, rest = stack[-1]
            for child in rest:
                if child not in seen:
                    seen.add(child)
                    stack.append((child, iter(arcs[child].values())))
                    break
            else:
                order.append(state)
                stack.pop()
        return order

    @classmethod
    def mapped(cls, raw: bytes) -> Lexicon:
        """Memory-mapped from a scratch file of this worker; the file has no name any more once it is mapped, so that
        nothing stays behind, and it is only a copy of what was sent: a new worker maps its own."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls(np.memmap(f, np.uint8, "r"))

    def find(self, words: list[bytes], longest: int = 32) -> np.ndarray:
        """The place of each word, -1 for those it lacks (and for any over longest, which it never holds); all words
        take a step together."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.where(lengths <= longest, np.int64(self.first), -1)
        place = np.zeros(len(words), np.int64)
        for depth in range(int(min(lengths.max(initial=0), longest)) if len(self.arc) else 0):
            live = np.flatnonzero((state >= 0) & (lengths > depth))
            wanted = state[live] << 8 | flat[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            known = self.arc[arc] == wanted
            place[live] += self.out[arc]
            state[live] = np.where(known, self.next[arc], -1)
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        return np.where(ok, place, -1)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.ends[places].astype(np.int64)
        lengths = self.ends[places + 1] - starts
        return ragged(self.flat, starts, lengths).astype(np.int64), lengths
