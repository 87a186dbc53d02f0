"""Suffix-array dedup: byte strings that earlier documents hold too are removed, found by column-wise suffix sorting."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.column_bwt import least_of_equal
from stridecast.llm.common import broadcast_if_small, ensure_checkpoint_dir, keyed_texts, ragged, slices, text_buffers

GRAM = 20
#: Windows of one segment at most.
MOST = 64
#: Bytes of distinct segments that are sorted together, unless one anchor alone has more in its bucket.
COLLECTION = 1 << 20
#: Runs of an anchor that is divided by its context. The results don't depend on it.
OFTEN = 4096
#: Bytes of text of a group of documents, about; and documents that a text of many copies has at least.
GROUP, COPIES = 32 << 20, 1000
#: Odd numbers that mix bits.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


WIDTHS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i8")]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers in one string, each in the fewest bytes that hold its values."""
    kept = []
    for a in arrays:
        least, most = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        kept.append(a.astype(next(w for w in WIDTHS if least >= np.iinfo(w).min and most <= np.iinfo(w).max)))
    head = [(WIDTHS.index(a.dtype), a.nbytes) for a in kept]
    return np.array(head, np.int64).tobytes() + b"".join(a.tobytes() for a in kept)


def unpack(raw: bytes, n: int) -> list[np.ndarray]:
    """The n packed arrays, in the widths that they were packed in."""
    at, out = 16 * n, []
    for code, size in np.frombuffer(raw, np.int64, 2 * n).reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, WIDTHS[code], size // WIDTHS[code].itemsize, at))
        at += size
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; there must be as many."""
    n = len(data)
    raw = data.tobytes() + bytes(32)
    words = np.empty(n, np.uint64)
    for k in range(8):
        words[k::8] = np.frombuffer(raw, "<u8", (n - k + 7) // 8, k)
    last = n - GRAM + 1
    h = words[:last] * MIX[0]
    h += words[8 : last + 8] * MIX[1]
    h += words[GRAM - 8 :][:last] * MIX[2]
    h ^= h >> np.uint64(29)
    h *= MIX[3]
    h ^= h >> np.uint64(32)
    return h


def group_of(ids, n: int):
    """The group of a document, by its id; the same for a column and for numpy."""
    if isinstance(ids, np.ndarray):
        return (ids ^ (ids >> 17) ^ (ids >> 34)) % n
    return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 17)).bitwiseXOR(F.shiftright(ids, 34)), F.lit(n)).cast("int")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = a * MIX[0] + b * MIX[1]
    k ^= k >> np.uint64(29)
    k *= MIX[3]
    return k ^ (k >> np.uint64(32))


def window_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, least gram hash) of the window of `length` bytes from each place on; there must be one.

    A window's anchor is its 20-byte string of the least hash, the first of equals. The key is a hash of the anchor together with
    the half of the rest of the window that stands before it, if there is room for that, else after it. So equal windows have
    equal keys wherever they are, and an anchor that very many texts hold is split by its context.
    """
    h = gram_hashes(data)
    room = length - GRAM
    least, at, span = h, np.arange(len(h)), 1
    for step in [*(1 << k for k in range((room + 1).bit_length() - 1)), room + 1 - (1 << (room + 1).bit_length() - 1)]:
        if step:
            n = len(least) - step
            later = least[step:] < least[:n]
            least, at = np.where(later, least[step:], least[:n]), np.where(later, at[step:], at[:n])
    near = room // 2
    from_ = at - near * (at - np.arange(len(at)) >= near)
    return mixed(h[from_], h[from_ + near]), least


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The least gram hash of the window of `length` bytes from each place on."""
    h = gram_hashes(data)
    wide, span = length - GRAM + 1, 1
    while span * 2 <= wide:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: span - wide], h[wide - span :]) if span < wide else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows, anchor, key) of the runs of windows of `length` bytes that share an anchor, the least hash of
    their 20-byte strings; of those whose anchor is hot (low bits, ascending) the runs that share a key (window_keys).

    Else the key is the anchor. Windows never cross rows. A run has MOST windows at most.
    """
    sizes = np.diff(offsets)
    n = int(offsets[-1] - offsets[0])
    data = data[offsets[0] : offsets[-1]]
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    some_hot = hot is not None and len(hot) > 0
    key, anchors = window_keys(data, length) if some_hot else (None, least_hashes(data, length))
    row = np.flatnonzero(sizes >= length)
    base = (offsets[:-1] - offsets[0])[row]
    count = sizes[row] - length + 1
    window = ragged(np.arange(n), base, count)
    anchors = anchors[window]
    new = np.ones(len(window), bool)
    new[1:] = anchors[1:] != anchors[:-1]
    keys = anchors
    if some_hot:
        keys = np.where(_among(_low(anchors), hot), key[window], anchors)
        new[1:] |= keys[1:] != keys[:-1]
    firsts = np.cumsum(count) - count
    new[firsts] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(window)))
    if (size > MOST).any():
        parts = -(-size // MOST)
        at = np.repeat(at, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.diff(np.append(at, len(window)))
    owner = np.searchsorted(firsts, at, side="right") - 1
    return row[owner], window[at] - base[owner], size, anchors[at], keys[at]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is known; known is ascending."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _low(anchor: np.ndarray) -> np.ndarray:
    """48 bits of an anchor: enough to tell which are shared; a chance collision only keeps a segment too many."""
    return anchor & np.uint64((1 << 48) - 1)


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def _dealt(keys: np.ndarray, n: int):
    """(key, positions that have it) for keys below n."""
    order = np.argsort(keys, kind="stable")
    ends = np.searchsorted(keys[order], np.arange(n + 1))
    for k in np.unique(keys).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _text_rows(batch):
    """The rows of a group of documents in a fixed order: (ids, hashes, data, offsets)."""
    import pyarrow as pa

    batch = batch.select(["doc_id", "text_hash", "text"]).combine_chunks()
    order = pa.compute.sort_indices(batch, [("doc_id", "ascending"), ("text_hash", "ascending")])
    batch = batch.take(order).combine_chunks()
    text = batch["text"].combine_chunks() if batch.num_rows else pa.array([], pa.string())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    data, offsets = text_buffers(text)
    return np.asarray(batch["doc_id"]), np.asarray(batch["text_hash"]), data, offsets


def _row_slices(offsets: np.ndarray, most: int = 2 << 20):
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def remove_repeats(docs: DataFrame, length: int = 50, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the remaining bytes). Strings are judged
    on the input, overlaps count, matches never cross documents; a null text is empty. Rows that repeat an id are
    each judged against smaller ids only, so they keep alike; rows without an id keep all and remove nothing elsewhere.

    1. Windows are grouped into runs by anchors; the anchors of all documents are dealt to buckets, which tell the documents'
       groups which anchors two ids share, and which occur more than OFTEN times. 2. Runs with shared anchors are sent, once for all
       equal ones of a group, to the bucket of their anchor; those of frequent anchors are cut by the anchor's context, and sent to
       the bucket of both (window_keys), so no task gets a frequent anchor whole. 3. There distinct segments are suffix-sorted column by column (column_bwt), and
       each occurrence learns which of its windows a smaller id holds. 4. The documents' groups cut their texts.
       Documents that equal one with a smaller id are removed whole and take no part in 1 to 3.
    Texts move once and are read in 2 and 4; what else moves are hashes, runs and spans. Unless given, buckets and groups are as many as
    twice the shuffle partitions, and more where a group would have over about GROUP bytes of text, so that a task's memory
    doesn't grow with the table (rows that repeat one id are one group).
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, -(-size // GROUP))
    without_id = texts.filter(F.col("doc_id").isNull())
    texts = texts.filter(F.col("doc_id").isNotNull()).select(group_of(F.col("doc_id"), n).alias("g"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")

    known = texts.select("g", "doc_id", "text_hash", F.xxhash64(F.lit("whole"), "text").alias("h2"), F.octet_length("text").alias("size")).filter(F.col("size") >= length)
    same = ["text_hash", "h2", "size"]
    ensure_checkpoint_dir(spark)
    first = known.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").checkpoint()
    # texts of very many copies are few, and their copies aren't gathered by text
    many = broadcast_if_small(first.filter(F.col("n") > COPIES))
    later = known.join(many, same, "left_anti").join(first.filter(F.col("n") <= COPIES), same).unionByName(known.join(many, same)).filter(F.col("doc_id") > F.col("first_id"))
    later = later.select("g", "doc_id", "text_hash", F.lit(None).cast("binary").alias("blob"))

    def post(batches):
        import pyarrow as pa

        for batch in slices(batches, 2 << 20):
            ids = np.asarray(batch.column(0)).astype(np.int64)
            row, _, _, anchor, _ = runs(*text_buffers(batch.column(1)), length)
            anchor = _low(anchor)
            out = []
            for b, at in _dealt(_bucket(anchor, n), n):
                low = ids[row[at]].min()
                out.append((b, pack(np.array([low]), anchor[at].astype(np.uint32), anchor[at] >> np.uint64(32), ids[row[at]] - low)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["b", "blob"])

    def reply(key, table):
        import pyarrow as pa

        keys, ids = [], []
        for blob in table["blob"].to_pylist():
            low, lo, hi, far = unpack(blob, 4)
            keys.append(lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32))
            ids.append(far.astype(np.int64) + int(low[0]))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        shared = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        size = np.diff(np.append(at, len(keys)))
        mask, hot = np.repeat(shared, size), np.repeat(size > OFTEN, size)
        keys, hot, groups = keys[mask], hot[mask], group_of(ids[mask], n)
        out = [(g, pack(np.unique(keys[p]), np.unique(keys[p[hot[p]]]))) for g, p in _dealt(groups, n)]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["g", "doc_id", "text_hash", "blob"])

    def cut(texts, told):
        """The runs of a group's documents that have shared anchors, equal ones together, by the buckets of their keys."""
        import pyarrow as pa

        ids, hashes, data, offsets = _text_rows(texts)
        blobs = [[k.astype(np.uint64) for k in unpack(x, 2)] for x in told["blob"].to_pylist() if x is not None]
        out = []
        if blobs and len(ids):
            shared, hot = (np.unique(np.concatenate(k)) for k in zip(*blobs))
            gone = _whole(told)
            alive = np.array([(d, h) not in gone for d, h in zip(ids.tolist(), hashes.tolist())])
            kept = []
            for a, z in _row_slices(offsets):
                row, start, size, anchor, key = runs(data, offsets[a : z + 1], length, hot)
                ok = _among(_low(anchor), shared) & alive[row + a]
                kept.append((row[ok] + a, start[ok], size[ok], anchor[ok], key[ok]))
            row, start, size, anchor, key = map(np.concatenate, zip(*kept))
            g = texts["g"][0].as_py()
            for b, p in _dealt(_bucket(_low(key), n), n):
                out.append((b, _segments(g, ids, data, offsets, row[p], start[p], size[p], anchor[p], length)))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["b", "blob"])

    def judge(key, table):
        """Which windows of the segments of a bucket a smaller id holds, told to the groups of their documents."""
        import pyarrow as pa

        out = _judge(table["blob"].to_pylist(), length)
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["g", "doc_id", "text_hash", "blob"])

    def finish(texts, told):
        import pyarrow as pa

        ids, hashes, data, offsets = _text_rows(texts)
        size = np.diff(offsets)
        total = int(offsets[-1] - offsets[0]) if len(ids) else 0
        base = offsets[:-1] - (offsets[0] if len(ids) else 0)
        data = data[offsets[0] : offsets[-1]] if len(ids) else data
        blobs = [[c.astype(np.int64) for c in unpack(x, 3)] for x in told["blob"].to_pylist() if x is not None]
        step = np.zeros(total + 1, np.int32)
        if blobs:
            row, start, end = map(np.concatenate, zip(*blobs))
            step += np.bincount(base[row] + start, minlength=total + 1).astype(np.int32)
            step -= np.bincount(base[row] + end, minlength=total + 1).astype(np.int32)
        gone = _whole(told)
        for k, x in enumerate(zip(ids.tolist(), hashes.tolist())):
            if x in gone:
                step[base[k]] += 1
                step[base[k] + size[k]] -= 1
        covered = np.cumsum(step[:-1]) > 0
        rises = covered.copy()
        rises[1:] &= ~covered[:-1]
        first = base[size > 0]
        rises[first] = covered[first]
        per_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(base, total)])
        removed, spans = per_row(covered), per_row(rises)
        kept = data[~covered]
        ends = np.concatenate(([0], np.cumsum(size - removed))).astype(np.int64)
        # the cast fails, and doesn't wrap, if a group of one id keeps more than Arrow's binary holds
        binary = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
        return pa.table([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), binary], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    told = "g int, doc_id long, text_hash long, blob binary"
    posted = texts.select("doc_id", "text").mapInArrow(post, "b int, blob binary")
    shared = posted.groupBy("b").applyInArrow(reply, told)
    segments = texts.groupBy("g").cogroup(shared.unionByName(later).groupBy("g")).applyInArrow(cut, "b int, blob binary")
    spans = segments.groupBy("b").applyInArrow(judge, told)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    done = texts.groupBy("g").cogroup(spans.unionByName(later).groupBy("g")).applyInArrow(finish, result)
    zero = F.lit(0).cast("long")
    return done.unionByName(without_id.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept")))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _whole(told) -> set[tuple[int, int]]:
    """(id, hash) of the documents that equal an earlier one."""
    return {(d, h) for d, h in zip(told["doc_id"].to_pylist(), told["text_hash"].to_pylist()) if d is not None}


def _hash_segments(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """128 bits for each segment, as two columns, from sums of its mixed bytes and places."""
    place = ragged(np.arange(int(lengths.max(initial=0))), np.zeros(len(starts), np.int64), lengths)
    rng = np.random.default_rng(7)
    table = rng.integers(0, 1 << 63, (2, int(lengths.max(initial=0)) + 1), dtype=np.uint64) | np.uint64(1)
    symbols = ragged(flat, starts, lengths).astype(np.uint64) + np.uint64(1)
    at = np.cumsum(lengths) - lengths
    out = []
    for row in table:
        x = symbols * row[place]
        x ^= x >> np.uint64(31)
        x *= MIX[3]
        out.append(np.add.reduceat(x, at) + lengths.astype(np.uint64) * MIX[0])
    return np.stack(out, 1)


def _segments(g: int, ids, data, offsets, row, start, size, anchor, length: int) -> bytes:
    """Pack distinct segments with the least id that has each here, and all their occurrences."""
    at, lengths = offsets[row] + start, size + length - 1
    h = _hash_segments(data, at, lengths)
    order = np.lexsort((h[:, 1], h[:, 0], anchor))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(1) | (anchor[order[1:]] != anchor[order[:-1]])
    first = np.flatnonzero(new)
    kept = order[first]
    low = ids[row].min()
    return pack(np.array([g]), np.array([low]), lengths[kept], ragged(data, at[kept], lengths[kept]), np.diff(np.append(first, len(order))), row[order], start[order], ids[row[order]] - low)


def _anchors(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its first place, whether it occurs again) of each segment."""
    h = gram_hashes(np.append(flat, np.zeros(MOST + length, np.uint8)))
    low = h[: len(flat)]
    anchor = np.minimum.reduceat(np.append(low, low[-1:]), np.stack((starts, starts + length - GRAM + 1), 1).ravel())[::2]
    n = lengths - GRAM + 1
    hit = np.flatnonzero(ragged(h, starts, n) == np.repeat(anchor, n))
    ends = np.cumsum(n)
    owner = np.searchsorted(ends, hit, side="right")
    first = np.searchsorted(owner, np.arange(len(starts)))
    return anchor, hit[first] - (ends - n), np.bincount(owner, minlength=len(starts)) > 1


def promising(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, place: np.ndarray, again: np.ndarray, length: int, step: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of each distinct segment that another one may hold too; last < first if there is none.

    Equal windows have their anchor at the same place, so what is left and right of it within them is equal too. A window
    stays if the context on either side, in steps of `step` bytes, occurs with another segment of the anchor. Where an
    anchor occurs twice in a segment, all windows of its group stay.
    """
    room = length - GRAM
    odd = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(odd), -1, 1 << 64))
    powers = np.cumprod(np.full(len(flat), odd, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers)))
    back = np.cumprod(np.full(len(flat) + 1, inverse, np.uint64))
    at = starts + place
    reach = []
    for side in (-1, 1):
        most = np.zeros(len(starts), np.int64)
        for n in range(step, room + 1, step):
            ok = np.flatnonzero(place >= n if side < 0 else place + GRAM + n <= lengths)
            low = at[ok] - n if side < 0 else at[ok] + GRAM
            key = (sums[low + n] - sums[low]) * back[low]
            key ^= key >> np.uint64(29)
            key = key * MIX[3] + anchor[ok]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            shared = np.zeros(len(ok), bool)
            shared[order[1:]] = same
            shared[order[:-1]] |= same
            most[ok[shared]] = n
        reach.append(most)
    windows = lengths - length + 1
    first = np.maximum(0, place - reach[0] - step + 1)
    last = np.minimum(windows - 1, place - room + step - 1 + reach[1])
    whole = np.isin(anchor, anchor[again])
    return np.where(whole, 0, first), np.where(whole, windows - 1, last)


def _judge(blobs: list[bytes], length: int) -> list[tuple[int, bytes]]:
    """Distinct segments over all blobs are sorted by suffixes; then each blob's occurrences are judged in turn."""
    parts = []
    for g, low, sizes, data, *others in (unpack(b, 8) for b in blobs):
        repeats, rows, begins, far = (x.astype(np.int64) for x in others)
        parts.append((int(g[0]), sizes.astype(np.int64), data.astype(np.uint8), repeats, rows, begins, far + int(low[0])))
    lengths = np.concatenate([p[1] for p in parts])
    flat = np.concatenate([p[2] for p in parts])
    starts = np.cumsum(lengths) - lengths
    h = _hash_segments(flat, starts, lengths)
    least = np.concatenate([np.minimum.reduceat(p[6], np.cumsum(p[3]) - p[3]) for p in parts])
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(1)
    first = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    kept = order[first]
    least = np.minimum.reduceat(least[order], first)
    lengths, old = lengths[kept], starts[kept]
    flat = ragged(flat, old, lengths)
    starts = np.cumsum(lengths) - lengths
    windows = lengths - length + 1
    ends = np.cumsum(windows)
    smallest = np.repeat(least, windows)
    # what may be shared, in collections of whole anchors
    anchor, place, again = _anchors(flat, starts, lengths, length)
    low, high = promising(flat, starts, lengths, anchor, place, again, length)
    some = np.flatnonzero(low <= high)
    some = some[np.argsort(anchor[some], kind="stable")]
    size = np.cumsum(high[some] - low[some] + length)
    heads = np.flatnonzero(np.concatenate(([True], anchor[some[1:]] != anchor[some[:-1]]))) if len(some) else some
    at = 0
    while at < len(some):
        done = size[at - 1] if at else 0
        k = np.searchsorted(heads, max(at + 1, np.searchsorted(size, done + COLLECTION, side="right")), side="right") - 1
        to = len(some) if size[-1] - done <= COLLECTION else int(heads[k]) if heads[k] > at else int(heads[k + 1]) if k + 1 < len(heads) else len(some)
        part = some[at:to]
        local = high[part] - low[part] + length
        with tempfile.TemporaryDirectory() as folder:
            found = least_of_equal(ragged(flat, starts[part] + low[part], local), np.cumsum(local) - local, local, least[part], length, folder)
        n = local - length + 1
        smallest[ragged(np.arange(len(smallest)), ends[part] - windows[part] + low[part], n)] = found
        at = to
    out, seen = [], 0
    for g, sizes, _, repeats, rows, begins, ids in parts:
        mine = np.repeat(kind[seen : seen + len(sizes)], repeats)
        seen += len(sizes)
        count = windows[mine]
        lost = ragged(smallest, ends[mine] - count, count) < np.repeat(ids, count)
        occurrence = np.repeat(np.arange(len(mine)), count)
        offset = ragged(np.arange(MOST), np.zeros(len(mine), np.int64), count)
        edge = np.flatnonzero(np.concatenate(([True], (lost[1:] != lost[:-1]) | (occurrence[1:] != occurrence[:-1]))))
        size_of = np.diff(np.append(edge, len(lost)))
        hit = lost[edge]
        edge, size_of = edge[hit], size_of[hit]
        if len(edge):
            who = occurrence[edge]
            begin = begins[who] + offset[edge]
            out.append((g, pack(rows[who], begin, begin + size_of + length - 1)))
    return out
