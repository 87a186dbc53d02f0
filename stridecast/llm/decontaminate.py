"""Benchmark decontamination: rare word n-grams of test items seed candidates, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import keyed_texts, ragged, slices, without_ids

#: Seeds that are expected by chance, from the words' shares, at most so often in the whole corpus count as rare.
RARE = 1.0
#: Of so many neighbouring seeds the rarest is kept even if none is rare, so that a copy with edits elsewhere shares one.
NEIGHBOURS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the windows that are aligned with an item at once (one window at least), and the length of a piece in items.
CELLS, PIECE = 1 << 18, 4
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, text of each): words are runs of letters and digits after lower-casing; beyond ASCII every
    character counts as a letter but spaces and punctuation of the common blocks."""
    joined = "\n".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = (codes - 97 < 26) | (codes - 48 < 10) | ((codes >= 0xAA) & (codes != 0xAB) & (codes != 0xBB) & (codes != 0xBF) & (codes - 0x2000 >= 0x70) & (codes - 0x3000 >= 0x40))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    letters = codes[inside].astype(np.uint64)
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    x = letters * MIX[0] + (place.astype(np.uint64) + np.uint64(1)) * MIX[1]
    x ^= x >> np.uint64(29)
    x *= MIX[3]
    x ^= x >> np.uint64(32)
    h = np.add.reduceat(x, at)
    h ^= h >> np.uint64(31)
    h *= MIX[2]
    # lower() may change lengths, so texts are told apart by the line ends that join them
    breaks = np.concatenate(([0], np.cumsum([t.lower().count("\n") + 1 for t in texts])))
    lines = np.flatnonzero(codes == 10)
    line = np.searchsorted(lines, starts)
    return h ^ (h >> np.uint64(32)), np.searchsorted(breaks, line, side="right") - 1


def grams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words of one text, place of the first)."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * MIX[k % 4] + words[k : len(words) - n + 1 + k]
    ok = text[: len(text) - n + 1] == text[n - 1 :]
    return h[ok], np.flatnonzero(ok)


@dataclass
class Items:
    """A bounded block of test items: their words, and the seeds that look for them."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    #: By their number of words: hashes in order, the item and the place in it of each.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    @staticmethod
    def of(rows, n: int) -> Items:
        ids, words = [], []
        for item_id, text in rows:
            h, _ = word_hashes([text])
            if len(h):
                ids.append(item_id)
                words.append(h)
        return Items(ids, words, np.unique(np.concatenate([*words, np.zeros(0, np.uint64)])))

    def choose_seeds(self, counts: np.ndarray, total: int, n: int) -> None:
        """counts: of the vocabulary's words over all documents; total: of all words there."""
        share = np.log((counts + 1.0) / (total + len(counts) + 1.0))
        found: dict[int, list] = {}
        for k, words in enumerate(self.words):
            size = min(n, len(words))
            h, at = grams(words, np.zeros(len(words), np.int64), size)
            p = share[np.searchsorted(self.vocabulary, words)]
            expected = sum(p[j : len(p) - size + 1 + j] for j in range(size)) + math.log(max(1, total))
            # the rarest of each few neighbours; an item shorter than a seed is one, and says nothing where it isn't rare
            order = np.lexsort((expected, np.arange(len(expected)) // NEIGHBOURS))
            chosen = np.zeros(len(expected), bool)
            chosen[order[::NEIGHBOURS]] = size == n
            keep = np.flatnonzero(chosen | (expected <= math.log(RARE)))
            found.setdefault(size, []).append((h[keep], np.full(len(keep), k), at[keep]))
        self.seeds = {}
        for size, parts in found.items():
            seeds, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, item, seeds))
            if len(order):
                self.seeds[size] = seeds[order], item[order], place[order]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words, for many windows (rows) at once: (best score, column where it ends)."""
    n, width = windows.shape
    ramp = -GAP * np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for word in item:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(windows == word, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along the window
        row = new
        at = row.argmax(1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def seeded(items: Items, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, diagonal, text) of each seed in the texts: the join of their n-grams with those of the items."""
    out = []
    for n, (seeds, item, place_in) in items.seeds.items():
        h, place = grams(words, text, n)
        left = np.searchsorted(seeds, h)
        found = np.flatnonzero(seeds[np.minimum(left, len(seeds) - 1)] == h)
        count = np.searchsorted(seeds, h[found], side="right") - left[found]
        seed = ragged(np.arange(len(seeds)), left[found], count)
        at = np.repeat(place[found], count)
        out.append((item[seed], at - place_in[seed], text[at]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    item, diagonal, owner = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((diagonal, item, owner))
    return item[order], diagonal[order], owner[order]


def matches(items: Items, words: np.ndarray, text: np.ndarray, least: float):
    """(text, item, score, seeds, first word, last word) of the alignments that score at least `least` of a full match.

    Seeds of an item on neighbouring diagonals share a window; where they go on for long (a text that repeats an item) it is
    cut into pieces of PIECE items, with room on both sides, so that an alignment around a seed lies within a piece.
    """
    item, diagonal, owner = seeded(items, words, text)
    if not len(item):
        return []
    size = np.array([len(w) for w in items.words])
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (diagonal[1:] - diagonal[:-1] > size[item[1:]])
    start = diagonal[np.flatnonzero(new)][np.cumsum(new) - 1]
    piece = (diagonal - start) // (PIECE * size[item])
    new[1:] |= piece[1:] != piece[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    begin_of, end_of = np.searchsorted(text, owner[first]), np.searchsorted(text, owner[first], side="right")
    slack = np.maximum(8, size[item[first]] // 2)
    begin = np.maximum(begin_of, diagonal[first] - slack)
    end = np.minimum(end_of, diagonal[last] + size[item[first]] + slack)
    out = []
    for k in np.unique(item[first]):
        group = np.flatnonzero(item[first] == k)
        group = group[np.argsort(end[group] - begin[group], kind="stable")]
        widths = (end - begin)[group]
        at = 0
        while at < len(group):
            # as many windows as fit: the widest of a part is its last
            n = np.arange(1, min(len(group) - at, CELLS // int(widths[at]) + 1) + 1)
            n = max(1, int(np.count_nonzero(n * widths[at : at + len(n)] <= CELLS)))
            part = group[at : at + n]
            at += n
            cells = begin[part][:, None] + np.arange(int((end[part] - begin[part]).max()))
            inside = cells < end[part][:, None]
            windows = np.where(inside, words[np.minimum(cells, len(words) - 1)], np.uint64(0))
            score, stop = align(items.words[k], windows)
            for p, s, z in zip(part.tolist(), score.tolist(), stop.tolist()):
                if s >= least * MATCH * size[k]:
                    out.append((int(owner[first[p]]), int(k), s / (MATCH * size[k]), int(last[p] - first[p] + 1), int(begin[p] - begin_of[p]), int(begin[p] - begin_of[p] + z)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 3, least: float = 0.5, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_seeds, end_word: documents that hold a test item, or an edited copy of one.

    Seeds are n-grams of `words` words of the items that are rare: by the words' counts over all documents they are
    expected by chance at most once in the corpus, and the rarest of each NEIGHBOURS neighbouring ones, so that also an item of common
    words has seeds all along: a copy is found that leaves 2 * NEIGHBOURS + words - 2 words in a row as they were. (How often the n-gram itself occurs isn't asked, so a passage
    copied into a third of the documents is still found.) Around seeds on neighbouring diagonals the item is aligned with
    the text; score is the alignment's share of a full match, `least` of it makes a pair. A pair appears once a
    document row, with its best score. Items of fewer words than a seed are sought by all their words, if these are rare
    together (a lone word never is). Texts and items without a word, null texts and null item ids take no part; rows that
    repeat a document id are each searched, and pairs that are equal appear once.

    The items are sent to the workers in blocks of most_bytes at most: where the test tables are larger, there are
    more passes over the documents instead of larger blocks. Documents aren't shuffled.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col).filter(F.length("text") > 0)
    tests = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // most_bytes))
    schema = "doc_id long, item_id long, score double, n_seeds int, end_word int"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = sorted((r.item_id, r.text) for r in tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        items = Items.of(rows, words)
        if items.ids:
            found = found.unionByName(_pass(texts, items, words, least, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_seeds", "end_word")).alias("best")).select("doc_id", "item_id", "best.*")


def _pass(texts: DataFrame, items: Items, n: int, least: float, schema: str) -> DataFrame:
    vocabulary = items.vocabulary

    def count(batches):
        import pyarrow as pa

        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in slices(batches):
            h, _ = word_hashes(batch.column(1).to_pylist())
            at = np.searchsorted(vocabulary, h)
            at[at == len(vocabulary)] = 0
            counts += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
            total += len(h)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(counts[hit], total), pa.int64())], ["word", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    total = 0
    for r in texts.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r.word < 0:
            total = r.n
        else:
            counts[r.word] = r.n
    items.choose_seeds(counts, total, n)
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        import pyarrow as pa

        own = sent.value
        for batch in slices(batches):
            rows = matches(own, *word_hashes(batch.column(1).to_pylist()), least)
            ids = batch.column(0).to_pylist()
            columns = [[ids[r[0]] for r in rows], [own.ids[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[5] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "score", "n_seeds", "end_word"])

    return texts.mapInArrow(search, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no test item, columns as they were. Rows without an id stay; null and empty texts too."""
    return without_ids(docs, contaminated(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct(), id_col)
