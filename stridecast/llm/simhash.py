"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits, found by pigeonring chains; and
near copies by the exact similarity of their sets of shingles."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridecast.llm.common import broadcast_if_small, ensure_checkpoint_dir, keyed_texts, slices, without_ids
from stridecast.llm.components import connected_components

SEED = 42
SEGMENTS = 16
#: Fingerprints that share a chain are compared pair by pair up to so many; larger groups are first divided by further
#: segments of the ring, exactly too.
PAIRED = 24


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 of the word shingles, repeats included. Only A-Z are lower-cased; words are cut at ASCII white space."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    raw = b" ".join(parts)
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[words - 1 :].tolist() if len(parts) >= words else [len(raw)]
    view, one = memoryview(raw), xxhash.xxh64_intdigest
    return np.array([one(view[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)


def majority_bits(h: np.ndarray) -> np.uint64:
    """A bit is 1 if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]


def text_fingerprint(text: str, words: int = 3) -> int:
    return int(majority_bits(shingle_hashes(text, words)))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each whole text; a null text is empty. No shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = np.array([text_fingerprint(t, words) for t in batch.column(1).fill_null("").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _chains(bits: int, segments: int) -> tuple[int, list[tuple[int, int]]]:
    """The length of the longest chain whose budget is 0, and the (length, budget) that further chains must keep.

    If at most `bits` bits differ over a ring of `segments` segments, then from some segment on the differences of
    every chain of l segments are at most l * bits / segments (the pigeonring principle).
    """
    budgets = [length * bits // segments for length in range(segments + 1)]
    zero = max(length for length, b in enumerate(budgets) if b == 0)
    return zero, [(max(length for length, b in enumerate(budgets) if b == k), k) for k in range(1, bits)] + [(segments, bits)]


def _rotated(value: Column, by: int) -> Column:
    return value if by == 0 else F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, 64 - by))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _ones(n: int) -> int:
    return _signed((1 << n) - 1)


def _further(zero: int, segments: int, bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(segments that must match as a bit set, [(number, bit set) of its children]) of a chain of `zero` segments and what may
    extend it: of the segments left, parted into bits + 1 runs, one run matches if `bits` bits differ at most."""
    out: list[tuple[int, list[tuple[int, int]]]] = [((1 << zero) - 1, [])]
    for at in range(segments**segments):
        if at == len(out):
            break
        held, children = out[at]
        left = [i for i in range(segments) if not held >> i & 1]
        if len(left) > bits:
            for part in np.array_split(left, bits + 1):
                more = held | sum(1 << int(i) for i in part)
                children.append((len(out), more))
                out.append((more, []))
    return out


def similar_links(fps: DataFrame, bits: int = 2, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Links a < b (as longs) between distinct fingerprints at most `bits` bits apart, all of them. fps: distinct fp, cheap to read
    again; what else it has of a fingerprint comes along for both ends, as a_* and b_*.

    A fingerprint is posted under each chain of the ring that must match whole. Of fingerprints with a common chain the
    longer chains are checked against their budgets, then all 64 bits. A chain shared by more than `paired`
    fingerprints is extended: its members are posted again under the chain with one of bits + 1 runs of the segments left, one of which
    must match too; and so on while a group is large and segments are left for it. What is left then differs in fewer than
    bits + 1 segments, so a last group has no more members than these have values.
    """
    if 64 % segments or not 0 < bits < segments:
        raise ValueError("the number of segments must divide 64 and be over bits")
    width = 64 // segments
    zero, steps = _chains(bits, segments)
    held = _further(zero, segments, bits)
    mask = lambda k: F.lit(_signed(sum(((1 << width) - 1) << (i * width) for i in range(segments) if held[k][0] >> i & 1)))
    turn = lambda c: reduce(lambda out, i: F.when(F.col("start") == i, _rotated(c, i * width)).otherwise(out), range(segments), F.lit(0).cast("long"))
    fp, keys, others = F.col("fp"), ["start", "path", "value"], [c for c in fps.columns if c != "fp"]
    end = lambda few, x: few.select(*keys, F.col("fp").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in others))
    starts = F.array(*(F.struct(F.lit(i).alias("start"), F.lit(0).alias("path"), _rotated(fp, i * width).bitwiseAND(mask(0)).alias("value")) for i in range(segments)))
    posted, level, pairs = fps.select("fp", *others, F.inline(starts)), [0], []
    while level:
        shared = posted.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        met = posted.join(shared, keys).checkpoint()
        last = [k for k in level if not held[k][1]]
        few = met.filter((F.col("n") <= paired) | F.col("path").isin(last))
        pairs.append(end(few, "a").join(end(few, "b"), keys).filter("a < b").drop("path", "value"))
        many = met.filter((F.col("n") > paired) & ~F.col("path").isin(last))
        level = [] if many.isEmpty() else [c for k in level for c, _ in held[k][1]]
        if level:
            whole = many.withColumn("turned", turn(fp))
            child = lambda k: F.array(*(F.struct(F.lit(c).alias("path"), F.col("turned").bitwiseAND(mask(c)).alias("value")) for c, _ in held[k][1]))
            parents = sorted({k for k, (_, cs) in enumerate(held) for c, _ in cs if c in level})
            posts = reduce(lambda out, k: F.when(F.col("path") == k, child(k)).otherwise(out), parents[1:], child(parents[0]))
            posted = whole.select("fp", *others, "start", F.inline(posts)).distinct()
    found = reduce(DataFrame.union, pairs).withColumn("turned", turn(F.col("a").bitwiseXOR(F.col("b"))))
    for length, budget in steps:
        found = found.filter(F.bit_count(F.col("turned").bitwiseAND(F.lit(_ones(length * width)))) <= budget)
    return found.drop("start", "turned").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest id reachable over links, itself included.

    Every row has a result. Null and empty texts have fingerprint zero and are linked like any other; repeated rows and
    equal texts share a fingerprint and are one node. Rows with a null id get the smallest id of their component, null
    if it has none. Links are sought between distinct fingerprints only.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs, words, id_col, text_col).checkpoint()
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = connected_components(similar_links(nodes.select("fp"), bits))
    grouped = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(nodes["fp"], "least", F.coalesce("component", nodes["fp"]).alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(named, "component").select(F.col("fp").alias("node_fp"), "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("node_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: One of so many documents tells which shingles are common, and so many of these are known at most. They only set the order
#: in which shingles are looked at; no result depends on it.
SAMPLED, COMMON = 16, 200_000
#: Members of a shingle's group meet in blocks of so many, one pair of blocks a key; and groups that the sampled documents
#: show to be larger than RUN are dealt to runs of about so many.
BLOCK, RUN = 256, 1024
#: Sets that are checked against one are gathered up to about so many shingles.
GATHERED = 250_000


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and row_key, which tells rows apart by both, of all rows but those of null texts."""
    return keyed_texts(docs).filter("text is not null").withColumn("row_key", F.xxhash64("doc_id", "text"))


def _set_part(key: bytes) -> int:
    """64 bits of a set_key, as a long."""
    return int.from_bytes(key[:8], "little", signed=True)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled documents hold, ascending, and in how many of them."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = np.concatenate([shingle_set(t, words) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    sampled = keyed_texts(docs).filter("text is not null").filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(SAMPLED)) == 0)
    counted = sampled.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """How many shingles have each value of their low bits, up to 255; about four a value."""
    bits = max(3, math.ceil(math.log2(max(1, len(shingles)) / 4)))
    return np.minimum(np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Two sets differ in at least so many shingles, by their sketches; the longer one is folded to the other's length."""
    n = min(len(x), len(y))
    fold = lambda s: np.minimum(s.reshape(-1, n).sum(0, dtype=np.int64), 255)
    return int(np.abs(fold(x) - fold(y)).sum())


def shingle_prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, row_key, set_key, set_part, fp (the SimHash fingerprint), size, sketch and prefix (shingle, runs) of the set of shingles of
    each row whose text has a word, with an id or not.

    In an order common to all documents, rare shingles first, the prefix is as long as it must be for two sets of the
    similarity or more to have a shingle of both prefixes in common, whatever the order. runs: of a shingle's group, 1 but for
    the largest.
    """
    common, counts = common_shingles(docs, words)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            ids, rows, keys, fps, sizes, sketches, prefixes, runs = [], [], [], [], [], [], [], []
            for i, t, row in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingle_set(t, words)
                n = len(found)
                if n:
                    ids.append(i)
                    rows.append(row)
                    keys.append(set_key(found))
                    fps.append(majority_bits(found))
                    sizes.append(n)
                    sketches.append(sketch_of(found).tobytes())
                    often = np.zeros(n, np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        often = np.where(common[at] == found, counts[at], 0)
                    first = np.argsort(often, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]
                    prefixes.append(found[first].view(np.int64))
                    runs.append(often[first] * SAMPLED // RUN + 1)
            if rows:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])])
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(prefixes), pa.int64()), pa.array(np.concatenate(runs), pa.int32())], ["shingle", "runs"])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array([_set_part(k) for k in keys], pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), prefix], ["doc_id", "row_key", "set_key", "set_part", "fp", "size", "sketch", "prefix"])

    return _keyed_rows(docs).mapInArrow(run, "doc_id long, row_key long, set_key binary, set_part long, fp long, size int, sketch binary, prefix array<struct<shingle:long,runs:int>>")


def fingerprint_pairs(marks: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs a, b of nodes (node, fp) by their SimHash fingerprints: each node with the first of its fingerprint, and the first ones of
    fingerprints at most `bits` bits apart. All groups that fingerprints link are held together by these pairs."""
    firsts = marks.groupBy("fp").agg(F.min("node").alias("first")).checkpoint()
    same = marks.join(firsts.hint("merge"), "fp").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = similar_links(firsts, bits)
    return same.union(linked.select(F.least("a_first", "b_first"), F.greatest("a_first", "b_first")))


def _close(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links a, b but for those whose sketches rule the similarity out, with the size of b's set as n, and the row_key and set_part of
    both ends; few of the sets' bytes move for that."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, x, y, *out = batch.columns
            allowed = n.to_numpy() * (1 - similarity) / (1 + similarity) + 1e-9
            ok = [least_difference(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)) <= most for p, q, most in zip(x.to_pylist(), y.to_pylist(), allowed.tolist())]
            yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(ok, pa.bool_()))

    names = ["a", "b", "n", "row_a", "row_b", "part_a", "part_b"]
    side = lambda c: sets.select(F.col("node").alias(c), F.col("row_key").alias(f"row_{c}"), F.col("set_part").alias(f"part_{c}"), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = links.join(side("a"), "a").join(side("b"), "b").select((F.col("na") + F.col("nb")).alias("both"), "sa", "sb", "a", "b", F.col("nb").alias("n"), *names[3:])
    return both.mapInArrow(run, "a long, b long, n int, row_a long, row_b long, part_a long, part_b long").checkpoint()


def _alike(docs: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links a, b (of _close) whose sets of shingles have the similarity. A node's set is made again from the rows of its row_key,
    of which set_part tells others that share the key by chance. A node a with very many links, the first of a group, is sent once for each part of about
    GATHERED shingles of those it is linked with, and each of these once a link."""

    def sets(batches):
        import pyarrow as pa

        for batch in slices(batches):
            rows = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            meant = [_set_part(set_key(r)) == part for r, part in zip(rows, batch.column(2).to_pylist())]
            shingles = pa.array([r.view(np.int64).tolist() for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), shingles], ["leaf", "shingles"]).filter(pa.array(meant, pa.bool_()))

    end = lambda c: links.select(F.col(f"row_{c}").alias("row_key"), F.col(c).alias("leaf"), F.col(f"part_{c}").alias("part"))
    texts = _keyed_rows(docs).join(broadcast_if_small(end("a").union(end("b")).distinct()), "row_key").select("leaf", "text", "part")
    shingles = texts.mapInArrow(sets, "leaf long, shingles array<long>").groupBy("leaf").agg(F.any_value("shingles").alias("shingles")).checkpoint()
    # a is the centre of its links, whose set is sent once for each of its groups and not for each link
    groups = links.groupBy("a").agg(F.ceil(F.sum("n") / GATHERED).cast("int").alias("parts")).checkpoint()
    # only centres of several parts need a join; there is one such row for more than GATHERED shingles of links, so they are few
    large = F.broadcast(groups.filter("parts > 1"))
    dealt = links.join(large, "a", "left").select(F.col("a").alias("of"), F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int").alias("run"), F.col("b").alias("leaf"))
    centres = groups.select(F.col("a").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("run"), F.col("a").alias("leaf"))
    # a centre is the row of its group that is itself; links have two ends, so no leaf is
    sent = centres.union(dealt).join(shingles, "leaf").select("of", "run", "leaf", "shingles")

    def check(key, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        is_centre = pc.equal(rows["leaf"], key[0])
        centre, leaves = rows.filter(is_centre), rows.filter(pc.invert(is_centre))
        if not leaves.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        mine = np.asarray(centre["shingles"].combine_chunks().flatten()).view(np.uint64)
        found = leaves["shingles"].combine_chunks()
        values, offsets = np.asarray(found.values).view(np.uint64), np.asarray(found.offsets)
        close = []
        for start, end_ in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            theirs = values[start:end_]
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = int((mine[at] == theirs).sum())
            close.append(both >= similarity * (len(mine) + len(theirs) - both))
        leaf = leaves["leaf"].combine_chunks().filter(pa.array(close, pa.bool_()))
        return pa.table([pa.array(np.full(len(leaf), key[0].as_py()), pa.int64()), leaf], names=["a", "b"])

    return sent.groupBy("of", "run").applyInArrow(check, "a long, b long")


def _components(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """similar_documents of the rows whose text has a word.

    Rows of equal sets of shingles are one node. The first round's pairs are those of SimHash fingerprints of the sets (fingerprint_pairs),
    and those that fingerprints can't tell: two nodes of the similarity share a shingle of both prefixes (shingle_prefixes), so
    nodes are posted under the shingles of theirs. It compares each member of a shingle's group with the next one and
    the first, which is all pairs of up to three members; a large group is dealt to runs for that. The second compares all
    pairs of the larger groups but those that the first round's components hold already: the members outside a group's
    largest component with all others, in pairs of blocks; so a large group of copies costs no pairs among its
    members. Both rounds drop pairs whose sizes and positions, then sketches, rule the similarity out, and check the rest
    by the whole sets.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    # where an id is null or repeats, perhaps with another text, rows go by numbers instead; these are written, so they stay
    marked = shingle_prefixes(docs, words, similarity).withColumn("number", F.monotonically_increasing_id()).checkpoint()
    by_id = marked.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    marked = marked.withColumn("row", F.col("doc_id" if by_id else "number"))
    nodes = marked.groupBy("set_key").agg(F.min("row").alias("node"))
    member = marked.select("doc_id", "row", "set_key").join(nodes, "set_key").select("doc_id", "row", "node").checkpoint()
    own = marked.join(broadcast_if_small(member.filter("row != node").select("row")), "row", "left_anti").withColumnRenamed("row", "node")
    sets = own.select("node", "row_key", "set_part", "fp", "size", "sketch").checkpoint()
    posted = own.select("node", "size", F.posexplode("prefix").alias("pos", "post")).select("node", "size", "pos", "post.shingle", "post.runs")
    along = Window.partitionBy("shingle", F.pmod(F.xxhash64("node", "shingle"), F.col("runs"))).orderBy("node")
    met = posted.withColumn("n", F.count("*").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("n > 1 or runs > 1").checkpoint()

    def possible(x: Column, y: Column) -> Column:
        # of two sets whose first common shingle is at these positions
        return F.least(x["size"] - x["pos"], y["size"] - y["pos"]) >= similarity / (1 + similarity) * (x["size"] + y["size"]) - 1e-9

    me = F.struct("node", "size", "pos")
    others = F.array(F.lead(me).over(along), F.when(F.row_number().over(along) > 2, F.first(me).over(along)))
    first = met.select(me.alias("x"), others.alias("others")).select("x", F.explode("others").alias("y")).filter(possible(F.col("x"), F.col("y")))
    first = first.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    first = first.union(fingerprint_pairs(sets.select("node", "fp"))).distinct().checkpoint()
    groups = connected_components(_alike(docs, _close(first, sets, similarity), words, similarity)).checkpoint()

    linked = groups.withColumnRenamed("node", "linked")
    larger = met.filter("n > 3 or runs > 1").join(linked, F.col("node") == F.col("linked"), "left").select("shingle", F.struct("node", "size", "pos", F.coalesce("component", "node").alias("component")).alias("x"))
    parts = larger.groupBy("shingle", "x.component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("shingle").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest")).filter("parts > 1")
    mixed = mixed.select("shingle", F.col("largest.component").alias("main"), F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int").alias("asking"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    larger = larger.join(mixed, "shingle").checkpoint()
    block = lambda n: F.pmod(F.xxhash64("x.node", "shingle"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = larger.filter("x.component != main").select("shingle", block("asking").alias("i"), each("blocks").alias("j"), "x")
    everyone = larger.select("shingle", each("asking").alias("i"), block("blocks").alias("j"), F.col("x").alias("y"), "main")
    # a pair of two that are both outside the main component is made from the smaller id only
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
    second = outside.join(everyone, ["shingle", "i", "j"]).filter(apart & possible(F.col("x"), F.col("y")))
    second = second.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti").checkpoint()
    second = _close(second, sets, similarity)
    if not second.isEmpty():
        joined = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
        groups = connected_components(joined.union(_alike(docs, second, words, similarity)))
    named = member.join(groups.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    if by_id:
        return named.withColumnRenamed("component", "component_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id for every row: the smallest id reachable over links, itself included; rows are linked by a Jaccard similarity of
    their word shingles of `similarity` or more. Exact, for all rows whose text has a word (see _components).

    Of rows that repeat an id each is compared by its own text. Rows with a null id link others, too, and get the smallest id of their
    component, null if it has none. Texts without a word and null texts are alone.
    """
    alone = keyed_texts(docs).filter(~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False)))
    return _components(docs, words, similarity).union(alone.select("doc_id", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of near copies, that of the smallest id; columns as they were.

    Rows of one id all stay or go: they go if each of its texts that has a word is in a group with a smaller id. So the smallest
    id of a group always stays. Rows without an id stay, as do ids without a word in their texts.
    """
    found = _components(docs, words, similarity).filter("doc_id is not null")
    later = found.groupBy("doc_id").agg(F.bool_and(F.col("component_id") < F.col("doc_id")).alias("later")).filter("later")
    return without_ids(docs, later.select("doc_id"))
