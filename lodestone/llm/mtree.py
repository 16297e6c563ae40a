"""Exact top-k inner products by M-tree best-first search.

Inner products become distances by one more coordinate: with R the greatest norm,
x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + R^2 - 2 q.x. The top
of the tree lies in Spark: cells around pivot vectors, with covering radii. A cell is
dealt into shards of bounded size, and each shard is the subtree of its pages: entries
with routing objects, covering radii and distances to the parent. A query pops pages by
their least possible distance; the stored parent distances rule entries out by the
triangle inequality before any distance is computed.

A query first visits one shard of its home cell. The k-th score found there goes with it
to the other shards, of those cells alone whose radius allows a better one. Data go to
their shard once, or once for each `query_rows` queries that visit it; a shard returns at
most k rows a query. Scores are exact integers (they and the sums that make them stay
below 2^53, else they are computed with Python's integers), bounds carry a small slack
and ties are explored, so nothing is lost.

Vectors that are null or hold null or non-finite components take no part. Empty vectors
take part with score 0; shorter vectors count as filled up with zeros. Rows that repeat a
vec_id are candidates one by one, never for their own vec_id; as a query such an id asks
with the least of its vectors, as arrays compare. Null vec_ids take no part. Where a third
of all rows are one vector, its cell has more shards. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 256
FANOUT = 16
#: Integers up to here are exact as floats.
EXACT = 1 << 53
FOUND = "query_id long, vec_id long, score long"


class MTree:
    """Bulk-loaded paged tree (Euclidean); `points` are put in the order of its leaves."""

    def __init__(self, points: np.ndarray):
        self.random = np.random.default_rng(7)
        self.pages: list[tuple] = []  # (first row or None, objects, their norms, distances to parent, radii, child pages)
        self.order = np.empty(0, np.int64)
        self.root = self._load(points, np.einsum("ij,ij->i", points, points), np.arange(len(points)), None) if len(points) else -1

    @staticmethod
    def distances(x: np.ndarray, x_norm: float, points: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norms + (x_norm - 2 * (points @ x))))

    def _load(self, points: np.ndarray, norms: np.ndarray, rows: np.ndarray, parent: int | None) -> int:
        def apart(row, of):
            return self.distances(points[row], norms[row], points[of], norms[of])

        to_parent = np.zeros(len(rows)) if parent is None else apart(parent, rows)
        if len(rows) <= PAGE:
            self.pages.append((len(self.order), points[rows], norms[rows], to_parent, None, None))
            self.order = np.append(self.order, rows)
            return len(self.pages) - 1
        pivots = self.random.choice(rows, FANOUT, replace=False)
        spread = np.stack([apart(p, rows) for p in pivots])
        nearest = spread.argmin(axis=0)
        if (nearest == nearest[0]).all():  # equal vectors: cut anywhere
            nearest = np.arange(len(rows)) % FANOUT
        own = [(p, i, np.flatnonzero(nearest == i)) for i, p in enumerate(pivots)]
        own = [x for x in own if len(x[2])]
        objects = np.array([p for p, _, _ in own])
        radii = np.array([spread[i, of].max() for _, i, of in own])
        children = [self._load(points, norms, rows[of], p) for p, _, of in own]
        near = np.zeros(len(objects)) if parent is None else apart(parent, objects)
        self.pages.append((None, points[objects], norms[objects], near, radii, children))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, k: int, offer, score: float, distance_of) -> None:
        """Offers rows of leaves to a query, nearest pages first.

        `offer(first, at, dots)` takes rows first + at with their inner products and returns
        the k-th score so far; `score` is what is known of it at the start, and
        `distance_of(score)` turns it into a distance. Rows beyond it are not offered.
        """
        if self.root < 0:
            return
        q_norm = float(q @ q)
        reach = distance_of(score)
        queue = [(0.0, self.root, None)]
        while queue and queue[0][0] <= reach:
            _, page, q_parent = heapq.heappop(queue)
            first, objects, norms, to_parent, radii, children = self.pages[page]
            at = None
            if q_parent is not None:
                width = reach if radii is None else reach + radii
                open_ = np.abs(q_parent - to_parent) <= width
                if not open_.all():
                    at = np.flatnonzero(open_)
                    if not len(at):
                        continue
            dots = (objects if at is None else objects[at]) @ q
            if first is not None:
                good = np.flatnonzero(dots >= score)
                if len(good):
                    score = offer(first, good if at is None else at[good], dots[good])
                    reach = distance_of(score)
                continue
            at = np.arange(len(norms)) if at is None else at
            distance = np.sqrt(np.maximum(0.0, norms[at] + (q_norm - 2 * dots)))
            least = np.maximum(0.0, distance - radii[at])
            for i, d, low in zip(at.tolist(), distance.tolist(), least.tolist(), strict=True):
                if low <= reach:
                    heapq.heappush(queue, (low, children[i], d))


class Best:
    """The k best (score, -vec_id) of a query among rows whose vec_ids are `ids`."""

    def __init__(self, ids: np.ndarray, query_id: int, k: int, score: float):
        self.ids, self.query_id, self.k, self.least, self.heap = ids, query_id, k, score, []

    def offer(self, first: int, at: np.ndarray, scores: np.ndarray) -> float:
        ids = self.ids[first + at]
        other = ids != self.query_id
        ids, scores = ids[other], scores[other]
        if len(ids) > self.k:
            top = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[top], scores[top]
        for entry in zip(scores.tolist(), (-ids).tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
        return max(self.least, self.heap[0][0]) if len(self.heap) == self.k else self.least


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(vectors: pa.ChunkedArray | pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, one row a vector, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """What all tasks know: dimensions, scale, greatest norm, pivots with radii and shards."""

    def __init__(self, dims: int, scale: int, largest: float, pivots: pa.Array | None):
        self.dims, self.scale, self.largest = dims, scale, largest
        self.pivots = self.lift(_matrix(pivots, dims, scale)) if pivots is not None else np.empty((0, dims + 1))
        self.norms = np.einsum("ij,ij->i", self.pivots, self.pivots)
        self.radii, self.shards = np.zeros(len(self.pivots)), np.ones(len(self.pivots), np.int64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.largest - np.einsum("ij,ij->i", x, x)))[:, None]])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        own = np.einsum("ij,ij->i", x, x)
        return np.sqrt(np.maximum(0.0, own[:, None] + self.norms - 2 * (x @ self.pivots.T)))

    def reach(self, q_norm: float, score: float) -> float:
        """The greatest distance at which a score of `score` or more can lie."""
        if score == -np.inf:
            return np.inf
        return float(np.sqrt(max(0.0, q_norm + self.largest - 2 * score))) * (1 + 1e-7) + 1e-6 * (1 + np.sqrt(q_norm + self.largest))


def _exact_dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], object)


def top_k(embeddings: DataFrame, k: int = 5, query_step: int = 50, scale: int = 256, shard_rows: int = 8192, query_rows: int = 65_536, most_pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best integer inner products of each query.

    `most_pivots` bounds the cells, and with them what is sent to the tasks; where there
    are more rows than `most_pivots * shard_rows`, cells have several shards.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("v"))
    cut = F.transform("v", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    square = F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x)
    n, dims, largest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    pivots = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(most_pivots, max(1, -(-n // shard_rows))))
    space = Space(dims, scale, largest, pivots.toArrow().column("v").combine_chunks() if n else None)  # at most most_pivots rows
    sent = spark.sparkContext.broadcast(space)

    def measure(batches):
        """Per cell and batch: its rows and radius."""
        for batch in batches:
            far = sent.value.to_pivots(sent.value.lift(_matrix(batch.column(1), dims, scale)))
            cell = far.argmin(axis=1)
            found = np.unique(cell)
            of = far[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([int((cell == c).sum()) for c in found], pa.int64()), pa.array([float(of[cell == c].max()) for c in found], pa.float64())], names=["cell", "n", "radius"])

    cells = rows.mapInArrow(measure, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    for cell in cells.collect():  # a row a pivot
        space.radii[cell["cell"]], space.shards[cell["cell"]] = cell["radius"], -(-cell["n"] // shard_rows)
    known = spark.sparkContext.broadcast(space)

    def deal(batches):
        """Data to the shards of their cells."""
        for batch in batches:
            space = known.value
            cell = space.to_pivots(space.lift(_matrix(batch.column(1), dims, scale))).argmin(axis=1)
            part = (batch.column(2).to_numpy().view(np.uint64) % space.shards[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(part)], names=["vec_id", "v", "cell", "part"])

    kind = dict(rows.dtypes)["v"]
    data = rows.withColumn("h", F.xxhash64("vec_id", F.lit(1))).mapInArrow(deal, f"vec_id long, v {kind}, cell long, part long")
    asked = rows.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def home(batches):
        """Queries to one shard of the cell they lie in."""
        for batch in batches:
            space = known.value
            q = _matrix(batch.column(1), dims, scale)
            cell = space.to_pivots(np.hstack([q, np.zeros((len(q), 1))])).argmin(axis=1)
            part = (batch.column(0).to_numpy().view(np.uint64) % space.shards[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(q), np.nan)), pa.array(cell), pa.array(part)], names=["vec_id", "v", "least", "cell", "part"])

    visit = f"vec_id long, v {kind}, least double, cell long, part long"
    first = _search(data, asked.mapInArrow(home, visit), known, k, query_rows)
    # The k-th score of the home shard; none where the shard has fewer candidates.
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("least"))

    def others(batches):
        """Queries to all shards but the one they have visited that can hold a better row."""
        for batch in batches:
            space = known.value
            q = _matrix(batch.column(1), dims, scale)
            least = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            far = space.to_pivots(np.hstack([q, np.zeros((len(q), 1))]))
            own = far.argmin(axis=1)
            done = batch.column(0).to_numpy().view(np.uint64) % space.shards[own].astype(np.uint64)
            norms = np.einsum("ij,ij->i", q, q)
            for i in range(len(q)):
                near = np.flatnonzero(far[i] - space.radii <= space.reach(float(norms[i]), least[i]))
                cell = np.repeat(near, space.shards[near])
                part = np.arange(len(cell)) - np.repeat(np.cumsum(space.shards[near]) - space.shards[near], space.shards[near])
                left = np.flatnonzero((cell != own[i]) | (part != done[i]))
                again = pa.array(np.full(len(left), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(np.full(len(left), least[i])), pa.array(cell[left]), pa.array(part[left])], names=["vec_id", "v", "least", "cell", "part"])

    rest = asked.join(bounds, asked.vec_id == bounds.query_id, "left").select("vec_id", "v", "least").mapInArrow(others, visit)
    found = first.unionByName(_search(data, rest, known, k, query_rows))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(data: DataFrame, visits: DataFrame, known, k: int, query_rows: int) -> DataFrame:
    """The k best of every visited shard for every visit."""
    # Visitors of a shard are dealt into blocks of about query_rows; its data go to each block.
    blocks = visits.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    queries = visits.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    shards = data.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).drop("blocks")

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        space, out = known.value, []
        if own.num_rows and asking.num_rows:
            points = _matrix(own.column("v"), space.dims, space.scale)
            tree = MTree(space.lift(points))
            ids = own.column("vec_id").to_numpy()[tree.order]
            least = np.nan_to_num(asking.column("least").to_numpy().astype(float), nan=-np.inf)
            wide = space.largest >= EXACT // 4
            for query_id, q, score in zip(asking.column("vec_id").to_pylist(), _matrix(asking.column("v"), space.dims, space.scale), least.tolist(), strict=True):
                best, norm = Best(ids, query_id, k, -np.inf if wide else score), float(q @ q)
                if wide:  # beyond what floats hold exactly
                    best.offer(0, np.arange(len(ids)), _exact_dots(points[tree.order], q))
                else:
                    tree.search(np.append(q, 0.0), k, best.offer, score, lambda s, norm=norm: space.reach(norm, s))
                out += [(query_id, -negative, int(score)) for score, negative in best.heap]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return shards.groupBy("cell", "part", "block").cogroup(queries.groupBy("cell", "part", "block")).applyInArrow(search, FOUND)
