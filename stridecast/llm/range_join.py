"""Embedding near-dedup: an exact range join by cosine. Pivots part the vectors into cells, the triangle inequality tells which other
cells a vector must visit, and each cell joins by itself."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.llm.ann import clean_vectors
from stridecast.llm.common import ensure_checkpoint_dir
from stridecast.llm.components import connected_components

#: Rows that pivots are drawn from, and pivots of one length of vectors, at most; numbers of a side of one comparison.
SAMPLE, PIVOTS, SIDE = 4096, 1024, 1 << 19
#: Numbers of a matrix that a task or the driver holds at once.
CELLS = 2_000_000
#: Angles are rounded up or down by so much where a bound decides.
SLACK = 1e-6


@dataclass
class Metric:
    """A range of cosines as angles, and rings of angles around a pivot. Two vectors of rings a and b around one pivot are linked
    if a + b + 2 <= sure, as their angle is at most the sum of both, and aren't if the rings are `apart` or more, as it is at
    least the difference."""

    similarity: float
    angle: float = field(init=False)
    chord: float = field(init=False)
    width: float = field(init=False)
    sure: int = field(init=False)
    apart: int = field(init=False)
    rings: int = field(init=False)

    def __post_init__(self):
        if not 0 < self.similarity < 1:
            raise ValueError("the similarity must be between 0 and 1")
        self.angle = math.acos(self.similarity)
        self.chord = math.sqrt(2 - 2 * self.similarity)
        self.width = max((self.angle - SLACK) / 32, math.pi / 512)
        self.sure = int((self.angle - SLACK) / self.width + 1e-9)
        self.apart = int((self.angle + SLACK) / self.width) + 2
        self.rings = int(math.pi / self.width) + 1

    def ring(self, cosines: np.ndarray) -> np.ndarray:
        return (np.arccos(np.clip(cosines, -1, 1)) / self.width).astype(np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int, metric: Metric) -> np.ndarray:
    """Up to n unit vectors. Rows of the sample lead the later ones within the range that have no leader yet; those that lead
    most become pivots, at the mean direction of what they lead, so that a dense group is one cell around its middle."""
    x, led, leaders, free = unit(sample), [], [], np.ones(len(sample), bool)
    for i in range(len(x)):
        if free[i]:
            near = free & (x @ x[i] >= metric.similarity)
            near[i] = True
            free &= ~near
            leaders.append(i)
            led.append(near)
    order = sorted(range(len(leaders)), key=lambda k: (-int(led[k].sum()), k))[:n]
    means = np.array([x[led[k]].mean(axis=0) for k in order])
    return unit(means)


def default_pivot(size: int) -> np.ndarray:
    """For vectors of a length that the sample lacks: one cell around the first axis."""
    return np.eye(1, size)


@dataclass
class Layout:
    """How the rows of one cell are dealt to comparisons. Rings with many rows are families of `parts` blocks, others share one."""

    home: dict[int, tuple[int, int]]
    outer: dict[int, tuple[int, int]]
    home_span: list[tuple[int, int, int]]
    outer_span: list[tuple[int, int, int]]
    home_copies: np.ndarray
    outer_copies: np.ndarray
    centre: int


def families(counts: dict[int, int], block: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int, int]]]:
    """ring -> (family, parts), and the (first ring, last ring, parts) of each family."""
    of, spans, filled = {}, [], block
    for ring, n in sorted(counts.items()):
        if n > block or filled + n > block:
            spans.append((ring, ring, max(1, -(-n // block))))
            filled = block if n > block else n
        else:
            spans[-1] = (spans[-1][0], ring, 1)
            filled += n
        of[ring] = (len(spans) - 1, spans[-1][2])
    return of, spans


class Cells:
    """The pivots of each length of vectors, and of each cell its extent and layout, for the tasks."""

    def __init__(self, metric: Metric, pivots: dict[int, np.ndarray]):
        self.metric, self.pivots = metric, pivots
        self.extent: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.layouts: dict[tuple[int, int], Layout] = {}

    def of(self, size: int) -> np.ndarray:
        return self.pivots[size] if size in self.pivots else default_pivot(size)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector, that of its nearest pivot, and its ring there."""
        cosines = x @ self.of(x.shape[1]).T
        home = cosines.argmax(axis=1)
        return home.astype(np.int32), self.metric.ring(cosines[np.arange(len(x)), home])

    def visits(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, ring there) of the other cells that the unit vectors must visit. Of two cells one visits the other.

        A vector within the range lies beyond the plane between the two pivots, so that is no farther than the range; and the
        cell's vectors are at angles to its pivot that differ from the own one by the range at most.
        """
        pivots = self.of(x.shape[1])
        k = len(pivots)
        if k == 1:
            return tuple(np.zeros(0, np.int32) for _ in range(3))
        cosines = x @ pivots.T
        number = np.arange(k)
        between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
        beyond = cosines[np.arange(len(x)), home][:, None] - cosines
        goes = ((home[:, None] < number) == ((home[:, None] + number) % 2 == 0)) & (number != home[:, None])
        goes &= beyond <= (self.metric.chord + SLACK) * between + SLACK
        rings = self.metric.ring(cosines)
        first, last = self.extent[x.shape[1]]
        goes &= (rings > first - self.metric.apart) & (rings < last + self.metric.apart)
        row, cell = np.nonzero(goes)
        return row, cell.astype(np.int32), rings[row, cell]

    def pairs(self, size: int, cell: int, outer: bool, ring: int, part: int) -> list[tuple[int, int, int, int, bool, bool]]:
        """(family, part, other family, other part, whether the other side is made of visitors, whether the row is of that side) of
        the comparisons that a row of this ring and part takes part in."""
        layout, metric = self.layouts[size, cell], self.metric
        mine = (layout.outer if outer else layout.home)[ring][0]
        lo, hi, _ = (layout.outer_span if outer else layout.home_span)[mine]

        def meet(span) -> bool:
            return hi + span[1] + 2 > metric.sure and max(span[0] - hi, lo - span[1]) < metric.apart

        out = []
        for f, span in enumerate(layout.home_span):
            if meet(span):
                for p in range(span[2]):
                    if outer:
                        out.append((f, p, mine, part, True, True))
                    elif (mine, part) <= (f, p):
                        out.append((mine, part, f, p, False, False))
                    else:
                        out.append((f, p, mine, part, False, True))
        if not outer:
            for f, span in enumerate(layout.outer_span):
                if meet(span):
                    out += [(mine, part, f, p, True, False) for p in range(span[2])]
        return out

    def surely(self, size: int, cell: int, outer: bool, ring: int) -> int:
        """Vectors of the cell, copies counted, that a row of this ring is linked with by the sum of angles; a home row counts itself."""
        layout, most = self.layouts[size, cell], self.metric.sure - 2 - ring
        if most < 0:
            return 0
        return int(layout.home_copies[: most + 1].sum()) + (0 if outer else int(layout.outer_copies[: most + 1].sum()))


def compare(x: np.ndarray, y: np.ndarray, rings_x: np.ndarray, rings_y: np.ndarray, weights_x: np.ndarray, weights_y: np.ndarray, metric: Metric, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the rows of x with those of y (the later ones of x, if `same`) that the rings leave open: how many each row of x and of y
    has, by weight, and a label for each row of both, equal for those that the links connect. Products are taken in single
    precision; those near the threshold again in double precision."""
    n, m = len(x), len(y)
    links_x, links_y, labels = np.zeros(n, np.int64), np.zeros(m, np.int64), np.arange(n + m)
    if same:
        labels[n:] = labels[:n]
    at_y = (lambda j: j) if same else (lambda j: n + j)
    ux, uy = unit(x), unit(y)
    sx, sy = ux.astype(np.float32), uy.astype(np.float32).T
    near = 1.5e-7 * (x.shape[1] + 16)
    step = max(1, CELLS // max(1, m))
    for at in range(0, n, step):
        product = sx[at : at + step] @ sy
        hit = product >= metric.similarity - near
        if not hit.any():
            continue
        rows = np.arange(at, min(n, at + step))
        if same:
            hit &= np.arange(m)[None, :] > rows[:, None]
        hit &= rings_x[rows][:, None] + rings_y[None, :] + 2 > metric.sure
        i, j = np.nonzero(hit & (product < metric.similarity + near))
        for a in range(0, len(i), 10_000):
            p, q = rows[i[a : a + 10_000]], j[a : a + 10_000]
            cosines = (x[p] * y[q]).sum(axis=1) / np.sqrt(np.square(x[p]).sum(axis=1)) / np.sqrt(np.square(y[q]).sum(axis=1))
            steep = ~np.isfinite(cosines)
            cosines[steep] = (ux[p[steep]] * uy[q[steep]]).sum(axis=1)
            hit[i[a : a + 10_000], q] = cosines >= metric.similarity
        links_x[rows] += hit @ weights_y
        links_y += weights_x[rows] @ hit
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            theirs = np.unique(np.append(labels[at_y(np.flatnonzero(hit[k]))], labels[at + k]))
            if len(theirs) > 1:
                renamed = np.arange(n + m)
                renamed[theirs] = theirs[0]
                labels = renamed[labels]
    if same:
        labels[n:] = labels[:n]
    return links_x, links_y, labels


KEYS = ["size", "cell", "fx", "px", "fy", "py", "visitors"]


def similar_vectors(vectors: DataFrame, similarity: float = 0.95, sample: int = SAMPLE, most_pivots: int = PIVOTS, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: for each id how many other vectors have a cosine of `similarity` or more with its own, in
    double precision, and the smallest id reachable by such links. All links are found, and no others.

    1. Equal vectors are one node. 2. Pivots come from `sample` nodes chosen by a hash of the id (choose_pivots), about one for each
    `block` nodes; the cell of a vector is that of its nearest pivot. 3. Vectors that may have a link into another cell visit
    it (Cells.visits). 4. In a cell vectors lie on rings by their angle to the pivot. The sum and the difference of two rings
    decide most pairs of a dense group: such links are counted from the numbers of vectors by ring and connected through the
    innermost one, without any pair. Other rings meet in blocks of `block` rows a side (SIDE numbers, unless given), one group each; a group returns
    counts and labels, so the links of a hot group are never rows. 5. Components come from the labels.

    The driver holds the sample, the pivots and counts by cell and ring, none of which grows with the rows; lengths of vectors
    (which never link with another length) have cells of their own. Vectors that are null, empty, zero or hold a null or
    non-finite component have no links. Of rows that share an id the one with the largest valid vector counts; rows without an id
    have no result, nor has an empty table.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    metric = Metric(similarity)
    clean = clean_vectors(vectors, id_col, vector_col).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("vector"), "vector")}).checkpoint()
    nodes = clean.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).checkpoint()
    own = clean.join(nodes.select("node", "copies"), F.col("vec_id") == F.col("node")).select("node", "copies", F.size("vector").alias("size"), "vector")
    kind = clean.schema["vector"].dataType.simpleString()

    facts = nodes.agg(F.count("*").alias("n")).first()
    share = min(1.0, 1.2 * sample / max(1, facts.n))
    longest = clean.agg(F.max(F.size("vector"))).first()[0] or 1
    block = block or max(64, SIDE // longest)
    drawn = own.filter(F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    drawn = sorted(drawn.limit(max(64, min(2 * sample, 4 * CELLS // longest))).select("node", "vector").collect(), key=lambda r: r.node)
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r.vector), []).append(r.vector)
    wanted = lambda rows: max(1, min(most_pivots, -(-facts.n * len(rows) // (len(drawn) * block))))
    cells = Cells(metric, {size: choose_pivots(np.array(rows, float), wanted(rows), metric) for size, rows in by_size.items()})

    def matrices(batches, column: str):
        """Arrow batches in pieces of one length of vectors, with the matrix of the vectors."""
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes).tolist():
                piece = batch if (sizes == size).all() else batch.filter(sizes == size)
                step = max(1, CELLS // max(size, most_pivots))
                for at in range(0, piece.num_rows, step):
                    part = piece.slice(at, step)
                    yield size, part, np.asarray(part.column(column).flatten(), float).reshape(-1, size)

    sent_pivots = spark.sparkContext.broadcast(cells)

    def place(batches):
        import pyarrow as pa

        for _, part, x in matrices(batches, "vector"):
            home, ring = sent_pivots.value.homes(unit(x))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(ring)], [*part.schema.names, "home", "ring"])

    placed = own.mapInArrow(place, f"node long, copies long, size int, vector {kind}, home int, ring int").checkpoint()
    for r in placed.groupBy("size", "home").agg(F.min("ring").alias("lo"), F.max("ring").alias("hi")).collect():
        first, last = cells.extent.setdefault(r["size"], (np.full(len(cells.of(r["size"])), 1 << 20), np.full(len(cells.of(r["size"])), -(1 << 20))))
        first[r.home], last[r.home] = r.lo, r.hi
    sent_extent = spark.sparkContext.broadcast(cells)

    def stays(part, x):
        """(row, cell, ring, whether it visits) of all places of the rows."""
        home, ring = np.asarray(part.column("home")), np.asarray(part.column("ring"))
        row, cell, there = sent_extent.value.visits(unit(x), home)
        outer = np.repeat([False, True], [len(home), len(row)])
        return np.append(np.arange(len(home)), row), np.append(home, cell), np.append(ring, there), outer

    def count(batches):
        import pyarrow as pa

        for size, part, x in matrices(batches, "vector"):
            row, cell, ring, outer = stays(part, x)
            key, index = np.unique(np.stack([cell, ring, outer]), axis=1, return_inverse=True)
            index = index.ravel()
            copies, node = np.asarray(part.column("copies"))[row], np.asarray(part.column("node"))[row]
            total, least = np.zeros(key.shape[1], np.int64), np.full(key.shape[1], np.iinfo(np.int64).max)
            np.add.at(total, index, copies)
            np.minimum.at(least, index, node)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(key.shape[1], size), pa.int32()), *(pa.array(k, pa.int32()) for k in key), pa.array(np.bincount(index, minlength=key.shape[1]), pa.int64()), pa.array(total), pa.array(least)], ["size", "cell", "ring", "outer", "n", "copies", "least"])

    counted = placed.mapInArrow(count, "size int, cell int, ring int, outer int, n long, copies long, least long")
    counted = counted.groupBy("size", "cell", "ring", "outer").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.min("least").alias("least")).collect()
    by_cell: dict[tuple[int, int], list] = {}
    for r in counted:
        by_cell.setdefault((r["size"], r.cell), []).append(r)
    for key, rows in by_cell.items():
        sides = [{r.ring: r for r in rows if r.outer == o} for o in (0, 1)]
        (home, home_span), (outer, outer_span) = (families({k: r.n for k, r in side.items()}, block) for side in sides)
        copies = np.zeros((2, metric.rings + 1), np.int64)
        for r in rows:
            copies[r.outer, r.ring] = r.copies
        cells.layouts[key] = Layout(home, outer, home_span, outer_span, *copies, min((r.ring, r.least) for r in rows)[1])
    sent = spark.sparkContext.broadcast(cells)

    def sure_links(batches):
        import pyarrow as pa

        for size, part, x in matrices(batches, "vector"):
            row, cell, ring, outer = stays(part, x)
            close = np.flatnonzero(ring <= metric.sure - 2)
            found = [(r, sent.value.surely(size, c, o, g), sent.value.layouts[size, c].centre) for r, c, o, g in zip(row[close].tolist(), cell[close].tolist(), outer[close].tolist(), ring[close].tolist())]
            # the row itself, with its copies, is among its own ring's if that is within half the range
            node, copies = part.column("node").to_pylist(), part.column("copies").to_pylist()
            own_part = [0 if o or 2 * g + 2 > metric.sure else copies[r] for r, o, g in zip(row[close].tolist(), outer[close].tolist(), ring[close].tolist())]
            out = [(node[r], n - o, centre) for (r, n, centre), o in zip(found, own_part) if n > o]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["node", "links", "label"])

    def deal(batches):
        import pyarrow as pa

        for size, part, x in matrices(batches, "vector"):
            row, cell, ring, outer = stays(part, x)
            node, columns, rows, known = np.asarray(part.column("node")), [], [], {}

            def out():
                taken = part.select(["size", "node", "copies", "vector"]).take(pa.array(rows))
                names = ["cell", "ring", "fx", "px", "fy", "py", "visitors", "second"]
                kinds = [pa.int32()] * 6 + [pa.bool_()] * 2
                return pa.RecordBatch.from_arrays([*taken.columns, *(pa.array([c[i] for c in columns], k) for i, k in enumerate(kinds))], ["size", "node", "copies", "vector", *names])

            for r, c, g, o in zip(row.tolist(), cell.tolist(), ring.tolist(), outer.tolist()):
                layout = sent.value.layouts[size, c]
                spread = (int(node[r]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33
                where = c, o, g, spread % (layout.outer if o else layout.home)[g][1]
                if where not in known:
                    known[where] = sent.value.pairs(size, *where)
                rows += [r] * len(known[where])
                columns += [(c, g, *p) for p in known[where]]
                if len(rows) * size > CELLS:
                    yield out()
                    columns, rows = [], []
            if rows:
                yield out()

    dealt = placed.mapInArrow(deal, f"size int, node long, copies long, vector {kind}, cell int, ring int, fx int, px int, fy int, py int, visitors boolean, second boolean")

    def join(key, rows):
        import pyarrow as pa

        size, _, fx, px, fy, py, visitors = (k.as_py() for k in key)
        same = (fx, px) == (fy, py) and not visitors
        second = np.asarray(rows["second"])
        left, right = rows.filter(pa.array(~second)), rows.filter(pa.array(second))
        if not left.num_rows or not (same or right.num_rows):
            return pa.table([pa.array([], pa.int64())] * 3, names=["node", "links", "label"])
        right = left if same else right
        side = lambda t: (np.asarray(t["vector"].combine_chunks().flatten(), float).reshape(-1, size), np.asarray(t["ring"]), np.asarray(t["copies"]))
        (x, ring_x, copies_x), (y, ring_y, copies_y) = side(left), side(right)
        links_x, links_y, labels = compare(x, y, ring_x, ring_y, copies_x, copies_y, metric, same)
        if same:
            links, ids, labels = links_x + links_y, np.asarray(left["node"]), labels[: len(x)]
        else:
            links, ids = np.append(links_x, links_y), np.append(np.asarray(left["node"]), np.asarray(right["node"]))
        some = np.flatnonzero(links)
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[labels[some]])], names=["node", "links", "label"])

    met = dealt.groupBy(*KEYS).applyInArrow(join, "node long, links long, label long")
    links = placed.mapInArrow(sure_links, "node long, links long, label long").union(met).checkpoint()
    components = connected_components(links.filter("node != label"), "node", "label")
    per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(per_node, "node", "left").join(components, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    members = clean.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "links", "component")
    ids = vectors.select(vectors[id_col].cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    out = ids.join(members, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs, and what is reachable over links, for DuckDB; links of smaller tables only.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN embedding IF y <> 0]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
n AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a), c AS (SELECT a, MIN(b) AS b FROM reached GROUP BY a)
SELECT e.vec_id, COALESCE(n.n, 0) AS n_links, LEAST(e.vec_id, COALESCE(c.b, e.vec_id)) AS component_id, e.vec_id <= COALESCE(c.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
