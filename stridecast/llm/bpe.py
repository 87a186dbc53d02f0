"""Byte-level BPE: pre-tokens, vectorised exact merges, token counts, and encoding with a memory-mapped lexicon."""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import keyed_texts, ragged, slices
from stridecast.llm.lexicon import Lexicon

#: Unicode's White_Space, spelled out so that Python's regex agrees with the tokenizers library.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the published pattern of byte-level pre-tokens.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Longer pre-tokens are merged one by one with a heap, in n log n.
LONG = 64
#: Pre-tokens that a worker remembers between slices.
REMEMBERED = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(later)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers file; no begin, end or added special tokens."""

    def __init__(self, path: str):
        import regex

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for word, i in vocab.items():
            if word not in self.special:
                self.pieces[i] = bytes(of[c] for c in word)
        for word, i in self.special.items():
            self.pieces[i] = word.encode()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
        rows = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        keys = rows[:, 0] << 32 | rows[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), rows[order, 2]
        self.by_rank = rows[:, 2]
        self.none = len(rows)
        self.pair_ranks = {(int(a), int(b)): r for r, (a, b, _) in enumerate(rows)}
        self.find = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token's string is one of its own, as the library has it by default."""
        if self.parts is None or not any(s in text for s in self.special):
            return self.find(text)
        return list(chain.from_iterable([x] if x in self.special else self.find(x) for x in self.parts(text)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has. In each round every word that still can merges
        its leftmost pair of lowest rank, all words at once."""
        out: list = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.merge_long(w)
            else:
                short.append(k)
        lengths = np.array([len(words[k]) for k in short], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        done_ids, done_words = [], []
        word = np.repeat(np.arange(len(short)), lengths)
        last = np.ones(len(symbols), bool)  # of its word
        last[:-1] = word[1:] != word[:-1]
        ranks = np.full(len(symbols), self.none)
        pairs = np.flatnonzero(~last)
        ranks[pairs] = self.rank(symbols[pairs], symbols[pairs + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            best = np.minimum.reduceat(ranks, starts)
            size = np.diff(np.append(starts, len(symbols)))
            going = best < self.none
            if not going.all():
                ended = np.repeat(~going, size)
                done_ids.append(symbols[ended])
                done_words.append(word[ended])
                symbols, word, last, ranks = (x[~ended] for x in (symbols, word, last, ranks))
                best, size = best[going], size[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(best, size))
            hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]
            symbols[hit] = self.by_rank[ranks[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            ranks[hit] = self.none
            moved = hit - np.arange(len(hit))
            symbols, word, last, ranks = (x[keep] for x in (symbols, word, last, ranks))
            before = moved - 1
            before = before[(moved > 0) & ~last[before]]
            near = np.concatenate((moved[~last[moved]], before))
            ranks[near] = self.rank(symbols[near], symbols[near + 1])
        ids = np.concatenate([*done_ids, np.zeros(0, np.int64)])
        at = np.concatenate([*done_words, np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(short))
        if len(short) == len(words):
            return ids[order], counts
        for k, x in zip(short, np.split(ids[order], np.cumsum(counts)[:-1])):
            out[k] = x
        return np.concatenate(out), np.array([len(x) for x in out])

    def merge_long(self, word: bytes) -> np.ndarray:
        """A heap of ranked pairs over a linked list; for words so long that a round a merge would be square."""
        symbols = [int(x) for x in self.first[np.frombuffer(word, np.uint8)]]
        n, gone = len(symbols), bytearray(len(symbols))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.pair_ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], gone[j], right[i] = int(self.by_rank[r]), 1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (s := self.pair_ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (s, x, symbols[x], symbols[y]))
        return np.array([s for s, g in zip(symbols, gone) if not g], np.int64)

    def whole_tokens(self) -> dict[str, int]:
        """The vocabulary strings that are proved to encode alone as their one token: one pre-token that merges to it."""
        words, ids = [], []
        for i, piece in enumerate(self.pieces):
            try:
                word = piece.decode()
            except UnicodeDecodeError:
                continue
            if word and word not in self.special and self.find(word) == [word]:
                words.append(word)
                ids.append(i)
        merged, counts = self.merge([w.encode() for w in words])
        ends = np.cumsum(counts)
        return {w: i for w, i, n, e in zip(words, ids, counts, ends) if n == 1 and merged[e - 1] == i}


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One vocabulary for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Pre-tokens that are proved whole tokens count one each; only the rest are merged. The proof is made once, on
    the driver, over the vocabulary alone, and sent to the workers: it is as large as the vocabulary. A null text
    is empty and has no tokens; every row has a result, rows that repeat too. No shuffle.
    """
    whole = docs.sparkSession.sparkContext.broadcast(frozenset(load(path).whole_tokens()))

    def count(batches):
        import pyarrow as pa

        bpe = load(path)
        known = dict.fromkeys(whole.value, 1) | dict.fromkeys(bpe.special, 1)
        own = len(known)
        for batch in slices(batches):
            texts = batch.column(1).fill_null("").to_pylist()
            tokens = [bpe.pre_tokens(t) for t in texts]
            if len(known) > own + REMEMBERED:
                known = dict.fromkeys(whole.value, 1) | dict.fromkeys(bpe.special, 1)
            rest = list(set(chain.from_iterable(tokens)).difference(known))
            if rest:
                known.update(zip(rest, bpe.merge([w.encode() for w in rest])[1].tolist()))
            n = [sum(map(known.__getitem__, t)) for t in tokens]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = keyed_texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def frequent_words(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The words between spaces that are most frequent over all texts, size at most.

    Each task keeps a summary of heavy hitters (Misra and Gries) of 8 x size words, so memory and what is shuffled
    are bounded whatever the texts are; any word more frequent than 1 in 8 x size of its task is in it.
    """
    room = 8 * size

    def summarise(batches):
        import pyarrow as pa
        from collections import Counter

        held: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(1).fill_null("").to_pylist():
                held.update(text.split(" "))
            if len(held) > room:
                off = sorted(held.values(), reverse=True)[room]
                held = Counter({w: n - off for w, n in held.items() if n > off})
        top = [(w, n) for w, n in held.most_common(size) if 0 < len(w) <= LONG // 4]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    counts = keyed_texts(docs, id_col, text_col).mapInArrow(summarise, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, size: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Compile frequent words, bare and after a space, with their ids; size bounds the words and so the lexicon."""
    bpe = load(path)
    words = sorted({w for word in frequent_words(docs, size, id_col, text_col) for w in (word, f" {word}") if bpe.pre_tokens(w) == [w] and w not in bpe.special}, key=str.encode)
    keys = [w.encode() for w in words]
    ids, counts = bpe.merge(keys)
    return Lexicon.compile(keys, ids, counts)


def encode(docs: DataFrame, path: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text: doc_id, ids (array of int). A null or empty text has none. No shuffle.

    The lexicon is sent to the workers once, memory-mapped there, and walked for many words at once; words that it
    doesn't hold are merged exactly.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        bpe, words = load(path), Lexicon.mapped(sent.value)
        known: dict[str, int] = {}
        store = _Store()
        for batch in slices(batches):
            tokens = [bpe.pre_tokens(t) for t in batch.column(1).fill_null("").to_pylist()]
            if len(known) > REMEMBERED:
                known, store = {}, _Store()
            new = list(set(chain.from_iterable(tokens)).difference(known))
            if new:
                known.update(zip(new, range(store.n, store.n + len(new))))
                store.add(*_encode_words(bpe, words, new))
            codes = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64)
            ids, counts = store.get(codes)
            per_doc = np.add.reduceat(np.append(counts, 0), np.cumsum([0, *map(len, tokens)])[:-1]) * np.array([bool(t) for t in tokens])
            ends = np.concatenate(([0], np.cumsum(per_doc)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


class _Store:
    """The ids of remembered words, by the words' codes."""

    def __init__(self):
        self.n, self.ids, self.starts, self.lengths = 0, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths)
        self.starts = np.concatenate((self.starts, len(self.ids) + ends - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.n = len(self.starts)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[codes]
        return ragged(self.ids, self.starts[codes], lengths), lengths


def _encode_words(bpe: ByteBPE, lexicon: Lexicon, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens, from the lexicon or merged."""
    raw = [w.encode() for w in words]
    found = lexicon.find(raw)
    counts = np.zeros(len(words), np.int64)
    special = {k for k, w in enumerate(words) if w in bpe.special} if bpe.special else set()
    rest = [k for k in np.flatnonzero(found < 0).tolist() if k not in special]
    merged, merged_counts = bpe.merge([raw[k] for k in rest])
    hit = np.flatnonzero(found >= 0)
    ids, hit_counts = lexicon.ids(found[hit])
    counts[hit], counts[rest] = hit_counts, merged_counts
    alone = sorted(special)
    counts[alone] = 1
    out = np.zeros(int(counts.sum()), np.int64)
    starts = np.cumsum(counts) - counts
    for part, at in ((ids, hit), (merged, rest), (np.array([bpe.special[words[k]] for k in alone], np.int64), alone)):
        out[ragged(np.arange(len(out)), starts[at], counts[at])] = part
    return out, counts


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays, special tokens kept: doc_id, text. Bytes that aren't UTF-8 become U+FFFD; null ids are empty."""

    def run(batches):
        import pyarrow as pa

        for ids, batch in _id_slices(batches):
            pieces, starts = _decoded(load(path), *ids)
            texts = [pieces[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """n_tokens, the hash of the ids written in decimal with commas, and the hash of the text decoded from the ids."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        decimal = [f"{i},".encode() for i in range(len(bpe.pieces))]
        flat, lengths = np.frombuffer(b"".join(decimal), np.uint8), np.array([len(x) for x in decimal])
        at = np.cumsum(lengths) - lengths
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for (ids, ends), batch in _id_slices(batches):
            pieces, starts = _decoded(bpe, ids, ends)
            digits = ragged(flat, at[ids], lengths[ids])
            cut = np.concatenate(([0], np.cumsum(lengths[ids])))[ends]
            n = np.diff(ends)
            written = [sha(digits[a : max(a, b - 1)].data) for a, b in zip(cut[:-1], cut[1:])]
            texts = [_sha_text(pieces[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha_text(raw: bytes) -> str:
    return hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()


def _id_slices(batches, most: int = 1 << 18):
    """((flat ids, ends), rows) of about so many ids each."""
    for batch in batches:
        column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        ends = np.asarray(column.offsets).astype(np.int64)
        values, at = np.asarray(column.values), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield (values[ends[at] : ends[to]], ends[at : to + 1] - ends[at]), batch.slice(at, to - at)
            at = to


def _decoded(bpe: ByteBPE, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, and where each row's bytes start and end."""
    if not hasattr(bpe, "flat"):
        bpe.flat = np.frombuffer(b"".join(bpe.pieces), np.uint8)
        bpe.sizes = np.array([len(p) for p in bpe.pieces])
        bpe.starts = np.cumsum(bpe.sizes) - bpe.sizes
    sizes = bpe.sizes[ids]
    return ragged(bpe.flat, bpe.starts[ids], sizes), np.concatenate(([0], np.cumsum(sizes)))[ends]
