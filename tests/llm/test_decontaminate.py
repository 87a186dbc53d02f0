"""Recall of edited copies of items without a rare word."""

import random

from stridecast.llm import decontaminate

COMMON = "the of and to in a is that for it as was with be by on not he i this".split()


def test_edited_copies_of_items_of_common_words(spark):
    """All words are frequent, so no seed is rare; copies keep any 36 of 60 words in a row, or all but every eighth word."""
    r = random.Random(6)
    text = lambda n: [r.choice(COMMON) for _ in range(n)]
    item = text(60)
    docs = [(i, " ".join(text(200))) for i in range(300)]
    for i in range(25):
        docs.append((1000 + i, " ".join([*text(40), *text(i), *item[i : i + 36], *text(24 - i), *text(40)])))
    for i in range(8):
        changed = [w if k % 8 != i else "changed" for k, w in enumerate(item)]
        docs.append((2000 + i, " ".join([*text(30), *changed, *text(30)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "quite other words that nobody has said here before today at all")], "item_id long, text string")
    found = {x.doc_id for x in decontaminate.contaminated(df, tests).collect()}
    assert found >= {i for i, _ in docs if i >= 1000}


def test_seeds_all_along():
    items = decontaminate.Items.of([(1, " ".join(COMMON)), (2, "of the"), (3, "rare words of the of the of the of the of the")], 3)
    import numpy as np

    items.choose_seeds(np.full(len(items.vocabulary), 1000), 20_000, 3)
    seeds, item, place = items.seeds[3]
    for k in (0, 2):
        at = sorted(place[item == k])
        assert at[0] < 4 and max(np.diff(at)) < 8 and len(items.words[k]) - 3 - at[-1] < 4
    assert 2 not in items.seeds
