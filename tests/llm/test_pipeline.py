"""The pipeline against a plain version on the smallest table."""

import numpy as np

import corpus_pipeline
from stridecast.llm import queries, quality, simhash
from stridecast.llm.common import table

KEY = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_groups(docs, similarity=0.8):
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and both >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in docs}


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = table(spark, sf_dir, "documents")
    score = quality.fit_quality(docs, table(spark, sf_dir, "labels")).scorer()
    kept = {r.doc_id: r.text for r in docs.collect() if score((r.text or "").encode()) >= 0.5}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(KEY)
    held = {}
    for i, t in kept.items():
        for s in t.split("\n"):
            if len(key(s)) >= 20:
                held.setdefault(key(s), set()).add(i)
    kept = {i: "\n".join(s for s in t.split("\n") if len(held.get(key(s), ())) < 3 or i == max(held[key(s)])) for i, t in kept.items()}
    groups = near_groups(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    words = lambda t: " ".join(t.lower().split())
    items = [words(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in words(t) for x in items)}
    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in kept.items())


ODD = "doc_id long, text string, lang string, source string, n_chars long, later_id long, bad_id long, node long, item_id long, score double, row string, key int"


def test_each_stage_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, an id twice, extra columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(40))
    texts = [(1, None), (None, words), (2, ""), (2, ""), (3, words), (4, words), (4, "an other text of this id"), (5, "long " * 200_000), (6, " \n\n"), (-7, words + " tail")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, None, 3, 4, 0.5, "r", 0) for i, t in texts], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {f.dataType.typeName() for f in out.schema} == {f.dataType.typeName() for f in docs.schema}, name
        kept = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality":
            assert len(kept) <= len(texts) and set(kept) <= set(texts)
        elif name == "line_dedup":  # the line of 3, 4 and the null id: two documents, so it stays
            assert sorted(kept, key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)
        elif name == "near_dedup":  # 3 is a copy of -7; of the two rows of 4 the one with the larger key counts, which isn't
            assert sorted(kept, key=repr) == sorted([x for x in texts if x[0] != 3], key=repr)
        else:
            assert sorted(kept, key=repr) == sorted(texts, key=repr)
    encoded = corpus_pipeline.token_ids(spark, docs, sf_dir)
    assert encoded.columns == ["doc_id", "ids", "n_tokens"] and encoded.count() == len(texts)
    assert encoded.filter("doc_id in (1, 2)").agg({"n_tokens": "max"}).first()[0] == 0


def test_sketches_never_overstate(spark):
    rng = np.random.default_rng(6)
    for n in (1, 9, 40, 400, 3000):
        for share in (0.0, 0.3, 0.85, 1.0):
            pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate((pool[: int(share * n)], pool[n : n + max(1, int(1.2 * n * (1 - share)))]))
            assert simhash.least_difference(simhash.sketch_of(a), simhash.sketch_of(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
    same = np.full(2000, 5, np.uint64)  # counts over 255
    assert simhash.least_difference(simhash.sketch_of(same), simhash.sketch_of(np.append(same, same))) == 0


def test_stages_on_odd_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
    rows = [(1, None), (None, "a b c"), (2, ""), (2, ""), (3, "word " * 50), (4, "word " * 50)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, sf_dir).collect()} == {1, None, 2, 3}
    assert corpus_pipeline.without_benchmark(spark, docs, sf_dir).columns == docs.columns


def test_similar_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, got = near_groups(texts), {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    joined = [i for i in texts if want[i] != i]
    assert joined and got == want


def texts_frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def test_no_pair_of_the_similarity_is_missed(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(500):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 204)]
        texts[k] = " ".join(words)
        words[100:118] = [f"v{x}" for x in rng.integers(0, 10**9, 18)]  # 22 of 200 shingles: similarity 178 / 222
        texts[1000 + k] = " ".join(words)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(texts_frame(spark, texts)).collect()}
    assert got == {i: i % 1000 for i in texts}


def test_partners_do_not_depend_on_id_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in range(30)]
    texts = {}
    for i in rng.permutation(400).tolist():
        words = base[: 12 + i % 18]
        for at in rng.integers(0, len(words), rng.integers(0, 3)):
            words[at] = f"v{rng.integers(0, 3)}"
        texts[i] = " ".join(words)
    want = near_groups(texts)
    assert len(set(want.values())) > 50
    for block, run in ((256, 1024), (8, 4)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "RUN", run)
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(texts_frame(spark, texts)).collect()} == want


def test_equal_fingerprints_of_different_sets_stay(spark):
    words = lambda c, n: " ".join(f"{c}{x}" for x in range(n))
    shared = words("s", 21)
    texts = {k: " ".join([shared] * 50 + [words(c, 104)]) for k, c in ((1, "a"), (2, "b"))}
    texts[3] = texts[1] + " " + texts[1]  # the set of 1 but for few
    assert near_groups(texts) == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(texts_frame(spark, texts)).collect()} == {1: 1, 2: 2, 3: 1}


def test_repeats_do_not_hide_a_copy(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 304)]
        texts[k] = " ".join(words)
        texts[1000 + k] = " ".join(words + words[100:130] * 14)
    assert near_groups(texts) == {i: i % 1000 for i in texts}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(texts_frame(spark, texts)).collect()}
    assert got == {i: i % 1000 for i in texts}


def test_fingerprints_give_candidates(spark):
    """The near-copy stage takes the pairs of SimHash fingerprints: equal ones meet the first, near ones by their first nodes."""
    near = [(1, 0), (2, 0), (3, 0b11), (4, 0b111), (5, -1), (6, 0b11), (7, -2)]
    marks = spark.createDataFrame(near, "node long, fp long")
    assert {(r.a, r.b) for r in simhash.fingerprint_pairs(marks).collect()} == {(1, 2), (3, 6), (1, 3), (3, 4), (5, 7)}
    docs = texts_frame(spark, {1: " ".join(f"w{i}" for i in range(40)), 2: "a b"})
    got = {r.doc_id: r.fp for r in simhash.shingle_prefixes(docs, 5, 0.8).collect()}
    assert got == {r.doc_id: r.fp for r in simhash.fingerprints(docs, 5).collect()}


def test_pairs_of_fingerprints_reach_the_exact_check(spark, monkeypatch):
    """A pair of fingerprints is a candidate of the first round; it links only if the whole sets are alike."""
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join([*words, "x"]), 3: " ".join(f"u{i}" for i in range(400))}
    asked = []
    close, plain = simhash._close, simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "_close", lambda links, *args: asked.append({(r.a, r.b) for r in links.collect()}) or close(links, *args))
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda marks: plain(marks).union(spark.createDataFrame([(1, 3)], "a long, b long")))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(texts_frame(spark, texts)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and {(1, 2), (1, 3)} <= asked[0]


def test_near_copies_take_few_jobs(spark):
    """The driver plans each job, and what it holds of them and leaves as garbage counts as its memory."""
    r = np.random.default_rng(9)
    base = [[f"w{x}" for x in r.integers(0, 10**9, 200)] for _ in range(20)]
    texts = {i: " ".join(base[i % 20][: 200 - i // 20] + [f"x{i}"]) for i in range(100)}
    spark.sparkContext.setJobGroup("near copies", "")
    try:
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(texts_frame(spark, texts)).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("near copies")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i % 20 for i in texts} and 0 < len(jobs) <= 90, len(jobs)


def test_every_row_is_compared(spark):
    """Rows that repeat an id are compared by their own texts, rows without an id link others; all rows have a result."""
    rng = np.random.default_rng(11)
    prose = lambda n=100: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    a, b, c, d, e, f, g, h = (prose() for _ in range(8))
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (3, c), (8, [*c, "z"]), (8, [*c, "u", "v"]), (4, d), (9, [*d, "t"]), (9, e)]
    rows += [(20, f[:92]), (None, f), (21, f[8:]), (None, g), (None, [*g, "s"]), (11, h), (11, h), (12, [*h, "r"])]  # f holds 20 and 21 together
    rows = [(i, " ".join(t)) for i, t in rows] + [(30, ""), (31, None), (32, " \n"), (None, None), (3, "")]
    by_row = dict(enumerate(t or "" for _, t in rows))
    root = near_groups(by_row)
    least = {}
    for k, (i, t) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted(((i, least.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)
    assert {(5, 5), (6, 5), (7, 5), (8, 3), (9, 4), (9, 9), (20, 20), (21, 20), (12, 11)} <= set(want)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()), key=repr) == want
    # an id goes when all its texts are copies, and one of 9's isn't
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=repr) == sorted((x for x in rows if x[0] not in (6, 7, 8, 21, 12)), key=repr)
