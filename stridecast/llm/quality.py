"""Quality classifier by compression: zstandard dictionaries of good and bad text, and a calibrated size difference."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import broadcast_if_small, held_out, keyed_texts, slices, small_batches

CHUNK = 1024


@dataclass
class QualityModel:
    """dictionaries: trained on bad and good text, empty if a class is missing; weights: of the logistic calibration of the
    normalised size difference (the first is the constant)."""

    dictionaries: tuple[bytes, bytes]
    weights: tuple[float, ...]
    level: int = 3

    def scorer(self):
        if not all(self.dictionaries):
            share = 1 / (1 + math.exp(-self.weights[0]))
            return lambda raw: share
        constant, slope = self.weights
        difference = self.difference()
        return lambda raw: 1 / (1 + math.exp(-max(-500.0, min(500.0, constant + slope * difference(raw)))))

    def difference(self):
        """A function of a text's bytes: its size under the bad dictionary less that under the good one, a byte of text (a few
        bytes are added, so that short texts lean to no difference). The whole text is compressed in chunks, so that a
        dictionary weighs alike everywhere in it."""
        import zstandard as zstd

        made = [zstd.ZstdCompressionDict(d) for d in self.dictionaries]
        for d in made:
            d.precompute_compress(level=self.level)
        bad, good = (zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in made)

        def difference(raw: bytes) -> float:
            n = 0
            for at in range(0, len(raw), CHUNK):
                part = raw[at : at + CHUNK]
                n += len(bad(part)) - len(good(part))
            return n / (len(raw) + 32.0)

        return difference


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 32_768, dictionary_kb: int = 112, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on about sample labelled rows of each class at most (chosen by a hash of the id), texts of longest characters
    at most: that bounds what the driver gathers. Held-out rows are never learned from. Labels other than 0 and 1,
    and null ids, take no part; without rows of both classes every score is the smoothed share of good rows. Of rows that
    repeat an id the first text counts, so two fits on the same tables agree. The sample's ids go to the documents, which aren't
    shuffled."""
    import zstandard as zstd

    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.filter(F.greatest(*(F.when((F.col("label") == k) & (draw < min(1.0, sample / max(1, n.get(k, 0))) * 1_000_000), 1).otherwise(0) for k in (0, 1))) == 1)
    rows = keyed_texts(docs, id_col, text_col).filter(F.length("text").between(1, longest)).join(broadcast_if_small(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    texts, y = [r.text.encode() for r in rows], np.array([r.label for r in rows], float)
    prior = math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))
    try:
        dictionaries = []
        for k in (0, 1):
            parts = [t[i : i + CHUNK] for t, label in zip(texts, y) if label == k for i in range(0, len(t), CHUNK)]
            dictionaries.append(zstd.train_dictionary(dictionary_kb << 10, parts).as_bytes())
    except (zstd.ZstdError, ValueError):  # too few samples for a dictionary
        return QualityModel((b"", b""), (prior,))
    model = QualityModel(tuple(dictionaries), (0.0, 0.0))
    difference = model.difference()
    x = np.array([(1.0, 10 * difference(t)) for t in texts])
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    sampled = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w[0] += prior - sampled  # back from the sample's shares to those of all labels
    model.weights = float(w[0]), float(10 * w[1])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 if score >= 0.5). A null text is empty; an empty
    one gets the score of no evidence. Each row is scored alone, so repeated rows score alike. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        score = sent.value.scorer()
        for batch in slices(batches):
            scores = [score(t.encode()) for t in batch.column(1).fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores `least` or more, all columns as they were. No shuffle. A null text is empty, and
    an empty one is judged by the score of no evidence; each row is judged alone, so repeated rows stay or go together.
    Texts are taken one at a time, so a batch of long ones isn't copied whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        score = sent.value.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep = [score((texts[k].as_py() or "").encode()) >= least for k in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
