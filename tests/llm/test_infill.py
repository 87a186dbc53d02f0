"""Fill-in-middle transformation against a plain version over code points."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stridecast.llm import infill, queries

SCHEMA = "doc_id long, text string, form string, n int, output string, source string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_odd_rows(spark):
    r = random.Random(1)
    letters = "ab <>PSM\n\0é中𝄞́￿"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.choice([1, 2, 7, 40, 3000])))) for i in range(300)]
    texts += [(1, ""), (2, None), (None, "no id ü"), (None, None), (7, texts[7][1]), (-9, "neg"), (10**17, "𝄞"), (11, "y" * 2_500_000 + "é" * 900_000), (12, "has <M> in it"), (13, "<P" + ">" * 3), (14, "< P><S"), (15, "x" * 100)]
    docs = spark.createDataFrame([(i, t, "c", 1, "o", None) for i, t in texts], SCHEMA)
    got = infill.digest(infill.fill_in_middle(docs))
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain(i, t)) for i, t in texts)
    back = infill.restore(infill.fill_in_middle(docs, transformed=100, suffix_first=50)).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in texts)
    assert infill.digest(infill.fill_in_middle(docs.limit(0))).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_infill(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(plain(r.doc_id, r.text) for r in docs) if all(r.text for r in docs) else len(got) == len(docs)
    assert {"psm", "spm", "plain"} == {r.form for r in got}


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_index_converts_both_ways(texts):
    whole = "".join(texts)
    index = infill.Exceptions(np.frombuffer(whole.encode(), np.uint8))
    places = np.arange(len(whole) + 1)
    ends = np.array([len(whole[:i].encode()) for i in places])
    assert index.bytes(places).tolist() == ends.tolist()
    assert index.points(ends).tolist() == places.tolist()
    assert len(index.byte_ends) == sum(ord(c) > 127 for c in whole)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restored_takes_the_marks_put_in(form):
    for p, s, m in (("<", "P>", "<S"), ("", "", ""), ("<S", ">", "<M"), ("a<P", ">b", ">")):
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        assert infill.restored(form, out.encode()).decode() == p + m + s
