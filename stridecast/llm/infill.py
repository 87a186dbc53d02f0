"""Fill-in-middle transformation: texts are cut by code points and reordered, with a sparse index of multibyte characters."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.common import keyed_texts, slices, text_buffers

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)


class Exceptions:
    """The multibyte characters of UTF-8 texts laid end to end in one buffer: their places, in code points and in bytes, and the bytes
    in excess of one so far. Between two of them code points and bytes advance together, so ASCII costs no memory."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        value = data[lead]
        extra = 1 + (value >= 0xE0).astype(np.int64) + (value >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        #: Byte and code point that follow a character's excess bytes.
        self.byte_ends = lead + 1 + extra
        self.point_ends = self.byte_ends - self.excess[1:]

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before the bytes `at`, which begin a character."""
        return at - self.excess[np.searchsorted(self.byte_ends, at, side="right")]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before the code points `at`."""
        return at + self.excess[np.searchsorted(self.point_ends, at, side="right")]


def drawn(doc_id: int | None, salt: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers: the first 8-digit groups of the SHA-256 of `salt:id`; a null id has no digits."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, salt: str = "1", transformed: int = 90, suffix_first: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output of each row.

    Two cuts drawn from the id part a text in prefix, middle and suffix. Of a hundred texts about `transformed` are reordered, and of
    these `suffix_first` in a hundred are spm (`<S>`suffix`<P>`prefix`<M>`middle), the others psm (`<P>`prefix`<S>`suffix`<M>`middle).
    A text that is null, empty or holds a mark stays plain (a null one comes out empty), with null lengths. Every row has a result;
    rows that repeat an id have the same draws, and so may rows without an id. Texts of any length are taken whole, about 1 MB
    of them at a time (one text at least). No shuffle.
    """

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            data, offsets = text_buffers(batch.column(1))
            base, ends = offsets[0], offsets - offsets[0]
            data = data[base : offsets[-1]]
            index = Exceptions(data)
            ids = batch.column(0).to_pylist()
            starts = index.points(ends[:-1])
            n = index.points(ends[1:]) - starts
            draws = np.array([drawn(i, salt) for i in ids], np.int64).reshape(-1, 4)
            cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            low, high = (index.bytes(starts + cuts[:, k]).tolist() for k in (0, 1))
            view, forms, outputs = memoryview(data), [], []
            for k, (start, a, b, end) in enumerate(zip(ends.tolist(), low, high, ends[1:].tolist())):
                whole = bytes(view[start:end])
                if not whole or draws[k, 2] % 100 >= transformed or any(m in whole for m in MARKS):
                    forms.append("plain")
                    outputs.append(whole)
                    continue
                prefix, middle, suffix = view[start:a], view[a:b], view[b:end]
                forms.append("spm" if draws[k, 3] % 100 < suffix_first else "psm")
                outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if forms[-1] == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
            plain = np.array([f == "plain" for f in forms])
            chars = [pa.array(c, pa.int64(), mask=plain) for c in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
            output = pa.array(outputs, pa.binary()).cast(pa.string()) if sum(map(len, outputs)) < 1 << 31 else pa.array(outputs, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(forms), *chars, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: str, output: bytes) -> bytes:
    """The text of one output: what stood between the marks, in the order prefix, middle, suffix."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    last = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : last], output[last + len(MIDDLE) :]
    return two + middle + one if form == "spm" else one + middle + two


def restore(transformed: DataFrame) -> DataFrame:
    """The columns of `transformed` (form, output and others), with the original text as `text` in place of the output. A null output or form
    gives an empty text. A text that was cut holds no mark, so the first of each mark is the one that was put in."""
    others = [c for c in transformed.columns if c != "output"]
    schema = transformed.select(*others).schema.add("text", "string")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [restored(f or "plain", (o or "").encode()).decode() for f, o in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    return transformed.select(*others, "output").mapInArrow(run, schema)


def digest(transformed: DataFrame) -> DataFrame:
    """What fill_in_middle gave, with SHA-256 sums of the output and of the text rebuilt from it instead of the output."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return restore(transformed.select(*kept, sha("output").alias("output_sha256"), "output")).select(*kept, "output_sha256", sha("text").alias("restored_sha256"))


#: The same by string functions, for DuckDB.
ORACLE = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, LEAST(c1, c2) AS a, GREATEST(c1, c2) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM o
"""
