"""Language ID: unigram piece probabilities for each language, and texts scored by the sum over all segmentations."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import held_out, keyed_texts, slices

#: Fixed value: the mark of a word's start in the vocabulary.
START = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Piece probabilities are scaled by so much a character, so that words of usual length neither under- nor overflow.
SCALE = 12.0
REMEMBERED = 300_000
#: Letters of a run that the fit takes together; a run of a language without spaces seldom is longer.
LETTERS = 64


def word_pieces(path: str) -> list[str]:
    """The lower-case pieces of letters, with or without the start mark, of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            bare = piece.removeprefix(START)
            if piece == piece.lower() and (bare.isalpha() or not bare):
                found.add(piece)
    return sorted(found)


class Pieces:
    """A fixed piece vocabulary; substrings of many words are looked up together by a rolling hash."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]):
        """For each end position, (length, piece of each word that ends there or -1); words must be equally long."""
        size = len(words[0]) + 1
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
        prefix, power = np.zeros((size + 1, len(words)), np.uint64), [np.uint64(1)]
        with np.errstate(over="ignore"):
            for i in range(size):
                prefix[i + 1] = prefix[i] * BASE + codes[:, i]
            for _ in range(self.longest):
                power.append(power[-1] * BASE)
            for end in range(1, size + 1):
                for length in range(1, min(end, self.longest) + 1):
                    h = prefix[end] - prefix[end - length] * power[length]
                    at = np.searchsorted(self.hashes, h)
                    at[at == self.n] = 0
                    yield end, length, np.where(self.hashes[at] == h, self.order[at], -1)


@dataclass
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    log_prior: np.ndarray
    #: A row for each piece, one for any other single character, one of zeros; a column for each language.
    probs: np.ndarray


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), summed over all segmentations, for words of any lengths."""
    out = np.zeros((len(words), table.shape[1]))
    scaled = table * SCALE ** np.arange(pieces.longest + 1)[:, None, None]
    lengths = np.array([len(w) for w in words])
    for size in np.unique(lengths):
        group = np.flatnonzero(lengths == size)
        shape = (len(group), table.shape[1])
        alpha, log_off, now = {0: np.ones(shape)}, np.zeros(shape), 0
        for end, length, ids in pieces.lattice([words[k] for k in group]):
            if end != now:
                if now and size > 48:  # long words are brought back to 1 at every step
                    unit = alpha[now].copy()
                    log_off += np.log(unit)
                    for a in alpha.values():
                        a /= unit
                now = end
                alpha = {k: a for k, a in alpha.items() if k >= end - pieces.longest}
                alpha[end] = np.zeros(shape)
            row = np.where(ids >= 0, ids, pieces.n if length == 1 else pieces.n + 1)
            if length == 1 or (ids >= 0).any():
                alpha[end] += alpha[end - length] * scaled[length][row]
        out[group] = np.log(alpha[now]) + log_off - (size + 1) * np.log(SCALE)
    return out


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words, over all segmentations by their probability; one language."""
    total = np.zeros(pieces.n + 1)
    lengths = np.array([len(w) for w in words])
    for size in np.unique(lengths):
        group = np.flatnonzero(lengths == size)
        steps = [(end, length, np.where(ids >= 0, ids, pieces.n if length == 1 else pieces.n + 1)) for end, length, ids in pieces.lattice([words[k] for k in group]) if length == 1 or (ids >= 0).any()]
        p = [table[row] * SCALE**length for _, length, row in steps]
        ahead, behind = np.zeros((size + 2, len(group))), np.zeros((size + 2, len(group)))
        ahead[0] = behind[size + 1] = 1
        for (end, length, _), q in zip(steps, p):
            ahead[end] += ahead[end - length] * q
        for (end, length, _), q in zip(reversed(steps), reversed(p)):
            behind[end - length] += behind[end] * q
        weight = counts[group] / ahead[size + 1]
        for (end, length, row), q in zip(steps, p):
            total += np.bincount(row, ahead[end - length] * q * behind[end] * weight, pieces.n + 2)[: pieces.n + 1]
    return total


def fit_languages(docs: DataFrame, path: str, sample: int = 400, longest: int = 32_768, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on about sample documents of each language at most (chosen by a hash of the id), texts of longest characters
    at most: that bounds what the driver gathers for a language. Held-out rows and null languages are never learned from. Runs
    of more than LETTERS letters are learned from in parts as long; texts are scored by whole runs."""
    import regex
    from collections import Counter

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(n)
    pieces = word_pieces(path)
    if not names:
        return LanguageModel(pieces, [], np.zeros(0), np.zeros((len(pieces) + 2, 0)))
    share = F.coalesce(*(F.when(F.col("lang") == k, min(1.0, sample / n[k])) for k in names))
    chosen = rows.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000) & (F.length("text") <= longest)).select("doc_id", "lang", "text").collect()
    seen = {k: Counter() for k in names}
    words = regex.compile(r"\p{L}+").findall
    for r in sorted(chosen, key=lambda r: (r.doc_id, r.lang, r.text)):
        seen[r.lang].update(w[at : at + LETTERS] for w in words(r.text.lower()) for at in range(0, len(w), LETTERS))
    made, probs = Pieces(pieces), np.zeros((len(pieces) + 2, len(names)))
    for k, name in enumerate(names):
        table = np.append(np.full(len(pieces) + 1, 1 / (len(pieces) + 1)), 0.0)
        kinds = sorted(seen[name])
        counts = np.array([seen[name][w] for w in kinds], float)
        for _ in range(rounds if kinds else 0):
            used = expected_counts(made, table, kinds, counts) + 0.05
            table[:-1] = used / used.sum()
        probs[:, k] = table
    return LanguageModel(pieces, names, np.log(np.array([n[k] for k in names]) / sum(n.values())), probs)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the likeliest learned language of each whole text and its probability.

    A text that is null or has no letter is `und` with score 0, and so is every text if no language was learned.
    Equal languages in a tie: the first by name. Each row is scored alone. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        import regex

        m = sent.value
        pieces, find = Pieces(m.pieces), regex.compile(r"\p{L}+").findall
        known: dict[str, int] = {}
        store = np.zeros((0, len(m.languages)))
        for batch in slices(batches):
            words = [find(t.lower()) for t in batch.column(1).fill_null("").to_pylist()]
            if len(known) > REMEMBERED:
                known, store = {}, store[:0]
            new = list(set(chain.from_iterable(words)).difference(known))
            if new and m.languages:
                known.update(zip(new, range(len(store), len(store) + len(new))))
                store = np.concatenate((store, forward(pieces, m.probs, new)))
            langs, scores = [], []
            for w in words:
                if not w or not m.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = store[np.fromiter(map(known.__getitem__, w), np.int64, len(w))].sum(0) + m.log_prior
                best = int(total.argmax())
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
