"""Exact top-k search by integer inner product, with a ball tree in every shard.

Vectors are dealt to cells (nearest of a few sampled vectors) and the cells to
shards of bounded size; each shard holds a ball tree.  Queries are blocked in the
same way.  A block and a shard meet only as summaries at first: the inner product
of anything in two balls is at most what their centres, radii and norms allow.  For
each block the shards are ordered by that bound and visited in three waves, the
best one, the next sixteen, then the rest; every wave starts from the best scores of
the waves before, and shards that can't reach the least kth score of the block drop
out before their vectors move.  Within a task the nodes of several shards share one
heap ordered by upper bound: a node is opened for just those queries whose kth score
it may still beat (or tie with a smaller id), so the result is exact.

Left out, as queries and as candidates: rows whose vector is null or holds a null
or non-finite component, or one whose ``scale``-fold no double holds.  Vectors of
different lengths don't meet.  A row without ``vec_id`` is a candidate, after all
others among ties, and never a query.  Rows that repeat an id are candidates each,
and each a query, but none is a candidate of its own id; so a repeated query's
results stand there once for each row.  Scores beyond a long are clamped to it
before ranking.  No queries or no candidates give no rows.  Other columns are not
read.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import working_tables, written

#: Vectors of a shard, queries of a block, and the most bytes of either; vectors of a leaf.
SHARD, BLOCK, MOST_BYTES, LEAF = 4096, 512, 8 << 20, 256
#: Sampled vectors around which cells form, at most.  They only decide who sits with whom.
PIVOTS = 256
#: Shards of a block in the first waves; the last wave has all others.
WAVES = (1, 16)
#: Shards that one task searches together.
TOGETHER = 8

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Relative error that any sum of products of two vectors may have, generously.
ROUNDING = 1e-9

FOUND = "part string, query int, query_id long, score long, vec_id long"
FOUND_ARROW = pa.schema([("part", pa.string()), ("query", pa.int32()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


# integers ----------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, width, x`` of the rows that take part; ``x`` has whole numbers, as doubles."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * float(scale))
    own = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return own.where(F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))).select("vec_id", F.size("x").alias("width"), "x")


def smallest(x: np.ndarray) -> np.ndarray:
    """The whole numbers of ``x`` in the narrowest type that holds them."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, clamped to a long."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if reach < 1 << 53:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in q.tolist()], dtype=object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape).T
    return np.array([[min(max(int(v), LEAST + 1), MOST) for v in row] for row in big], dtype=np.int64).reshape(big.shape)


# ball trees ----------------------------------------------------------------------


class Tree:
    """A ball tree over the rows of ``x``: nodes in arrays, rows of a node side by side."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.lo, self.hi, self.left, centres, self.radius, self.least = [], [], [], [], [], []
        rows = np.arange(len(x))
        todo = [(0, len(x))]
        while todo:  # children are numbered when their parent is taken, breadth first
            following = []
            for lo, hi in todo:
                part = x[rows[lo:hi]]
                centre = part.mean(axis=0)
                away = np.sqrt(((part - centre) ** 2).sum(axis=1))
                self.lo.append(lo)
                self.hi.append(hi)
                centres.append(centre)
                self.radius.append(float(away.max(initial=0)) * (1 + ROUNDING))
                self.least.append(int(self.ids[rows[lo:hi]].min()))
                self.left.append(-1)
                if hi - lo > LEAF:
                    far = part[away.argmax()]
                    along = part @ (part[((part - far) ** 2).sum(axis=1).argmax()] - far)
                    rows[lo:hi] = rows[lo:hi][np.argsort(along, kind="stable")]  # equal rows stay in the order of ids
                    middle = (lo + hi) // 2
                    self.left[-1] = len(following)  # made absolute below
                    following += [(lo, middle), (middle, hi)]
            level = len(self.lo) - len(todo)
            for node in range(level, len(self.lo)):
                if self.left[node] >= 0:
                    self.left[node] += len(self.lo)
            todo = following
        self.ids, self.x = self.ids[rows], smallest(x[rows])
        self.centres, self.radius, self.least = np.array(centres), np.array(self.radius), np.array(self.least, dtype=np.int64)
        self.lengths = np.sqrt((self.centres**2).sum(axis=1))

    def bounds(self, nodes: list[int], q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each query the greatest inner product that each node may hold."""
        far = lengths[:, None] * (self.radius[nodes] * (1 + ROUNDING) + self.lengths[nodes] * ROUNDING)
        return q @ self.centres[nodes].T + far + ROUNDING

    def rows(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.lo[node], self.hi[node])
        return self.ids[part], self.x[part].astype(np.float64)


class Queries:
    """A block of queries with the best scores found so far, best first, ties by smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x.astype(np.float64), k
        self.lengths = np.sqrt((self.x**2).sum(axis=1))
        self.scores = np.full((len(ids), k), LEAST)
        self.found = np.full((len(ids), k), MOST)
        self.new = np.zeros((len(ids), k), bool)

    def merge(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        new = np.concatenate([self.new[query], np.ones(len(ids), bool)])
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.found[query], ids])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.scores[query], self.found[query], self.new[query] = scores[best], ids[best], new[best]

    def open(self, active: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
        """Which of the active queries may gain from a node with these bounds and this least id."""
        kth, last = self.scores[active, -1], self.found[active, -1]
        whole = np.floor(bounds)
        return ~((whole < kth) | ((whole == kth) & (least >= last)))

    def meet(self, active: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        scores = products(self.x[active], x)
        kth, last = self.scores[active, -1][:, None], self.found[active, -1][:, None]
        better = ((scores > kth) | ((scores == kth) & (ids < last))) & (ids != self.ids[active][:, None])
        for i in np.flatnonzero(better.any(axis=1)):
            self.merge(active[i], scores[i, better[i]], ids[better[i]])


def descend(queries: Queries, trees: list[Tree]) -> int:
    """Branch and bound over the nodes of all trees, the most promising first; the number of nodes opened."""
    heap: list = []
    number = itertools.count()

    def push(tree: Tree, nodes: list[int], active: np.ndarray) -> None:
        bounds = tree.bounds(nodes, queries.x[active], queries.lengths[active])
        for j, node in enumerate(nodes):
            may = queries.open(active, bounds[:, j], tree.least[node])
            if may.any():
                heapq.heappush(heap, (-np.nan_to_num(bounds[may, j], nan=np.inf).max(), next(number), tree, node, active[may], bounds[may, j]))

    with np.errstate(over="ignore", invalid="ignore"):
        for tree in trees:
            push(tree, [0], np.arange(len(queries.ids)))
        opened = 0
        while heap:
            _, _, tree, node, active, bounds = heapq.heappop(heap)
            active = active[queries.open(active, bounds, tree.least[node])]  # the kth scores may have risen since
            if not len(active):
                continue
            opened += 1
            if tree.left[node] < 0:
                queries.meet(active, *tree.rows(node))
            else:
                push(tree, [tree.left[node], tree.left[node] + 1], active)
    return opened


# shards and blocks ---------------------------------------------------------------


def celled(points: DataFrame, cells: int, query_cells: int) -> DataFrame:
    """Adds ``cell`` and ``query_cell``, the nearest of the first sampled vectors of the same length (-1: none)."""
    drawn = points.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(max(cells, query_cells)).select("width", "x").collect()
    pivots = {w: np.floor(np.array([r.x for r in drawn if r.width == w]).reshape(-1, w)) for w in {r.width for r in drawn}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            widths = part.column("width").to_numpy()
            near = np.full((2, len(widths)), -1, np.int32)
            for w in np.unique(widths).tolist():
                if w in pivots:
                    rows = np.flatnonzero(widths == w)
                    x = np.floor(part.column("x").take(pa.array(rows)).flatten().to_numpy()).reshape(len(rows), w)
                    with np.errstate(over="ignore", invalid="ignore"):
                        away = (pivots[w] ** 2).sum(axis=1) - 2 * x @ pivots[w].T
                    near[0, rows], near[1, rows] = away[:, :cells].argmin(axis=1), away[:, :query_cells].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near[0]), pa.array(near[1])], names=[*part.schema.names, "cell", "query_cell"])

    return points.mapInArrow(run, "vec_id long, width int, x array<double>, cell int, query_cell int").withColumn("row", F.monotonically_increasing_id())


def blocks(points: DataFrame, cell: str, rows: int, tree: bool) -> DataFrame:
    """Blocks of about ``rows`` points of a cell, as one row each.

    A cell with more points, as equal vectors make it, is dealt to several blocks,
    row by row.  Vectors of a length that is not among the sampled ones are so few
    that a tenth of all rows bounds them.
    """
    points = points.withColumnRenamed(cell, "own")
    key = F.concat_ws(".", "width", "own")
    sizes = points.where("own >= 0").groupBy(key.alias("key")).count().collect()  # at most as many as sampled vectors
    rare = F.lit(points.count() // 10 + 1)
    n = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for r in sizes for v in r)), key), rare) if sizes else rare
    room = F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(MOST_BYTES // 8) / F.greatest("width", F.lit(1)))))
    points = points.withColumn("piece", F.pmod(F.xxhash64("row"), F.ceil(n / room)).cast("int"))
    schema = "block string, width int, n long, centre array<double>, radius double, length double, body binary"

    def build(table: pa.Table) -> pa.Table:
        width, own, piece = (table.column(c)[0].as_py() for c in ("width", "own", "piece"))
        ids = table.column("vec_id").combine_chunks().fill_null(MOST).to_numpy()
        x = np.floor(table.column("x").combine_chunks().flatten().to_numpy()).reshape(len(ids), width)
        with np.errstate(over="ignore", invalid="ignore"):
            made = Tree(ids, x)
        return pa.table({
            "block": [f"{width}.{own}.{piece}"], "width": pa.array([width], pa.int32()), "n": [len(ids)], "centre": pa.array([made.centres[0].tolist()], pa.list_(pa.float64())),
            "radius": [float(made.radius[0])], "length": [float(made.lengths[0])], "body": [pickle.dumps(made if tree else (made.ids, made.x))],
        })

    return points.groupBy("width", "own", "piece").applyInArrow(build, schema)


def pairs(parts: DataFrame, shards: DataFrame) -> DataFrame:
    """Every block of queries with every shard, as ``part, block, bound, place``; summaries only.

    The blocks are dealt to as many numbers as there are blocks, and a shard is sent
    to each number, so the two sides meet by an equal key.
    """
    numbers = max(parts.count(), 1)
    asks = parts.select(F.col("block").alias("part"), "width", F.pmod(F.xxhash64("block"), F.lit(numbers)).alias("number"), *(F.col(c).alias(f"q_{c}") for c in ("centre", "radius", "length")))
    sent = shards.select("block", "width", "centre", "radius", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))).alias("number"))
    middle = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    around = (F.col("q_length") + F.col("q_radius")) * (F.col("radius") * (1 + ROUNDING) + F.col("length") * ROUNDING) + F.col("length") * F.col("q_radius")
    met = asks.join(sent, ["width", "number"]).select("part", "block", (middle + around + ROUNDING).alias("bound"))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("bound"), "block")))


def wave(parts: DataFrame, shards: DataFrame, met: DataFrame, found: DataFrame | None, first: int, last: int | None, k: int) -> DataFrame:
    """What the shards at these places add to the best ``k`` found so far."""
    bodies = parts.select(F.col("block").alias("part"), "n", F.col("body"))
    chosen = met.where((F.col("place") >= first) & (F.lit(True) if last is None else F.col("place") <= last))
    chosen = chosen.withColumn("team", F.floor((F.col("place") - first) / TOGETHER))
    if found is None:
        bodies = bodies.withColumn("top", F.expr("cast(null as array<struct<query: int, score: bigint, vec_id: bigint>>)"))
    else:
        top = F.collect_list(F.struct("query", "score", "vec_id")).alias("top")  # k for each query of a block
        tops = found.groupBy("part").agg(top, F.min("score").alias("least"), F.count("*").alias("held"))
        bodies = bodies.join(tops, "part", "left")
        known = bodies.where(F.col("held") == F.col("n") * k).select("part", "least")
        chosen = chosen.join(known, "part", "left").where("least is null or bound >= least")
    trees = chosen.join(shards.select("block", "body"), "block").select("part", "team", F.lit(True).alias("tree"), "body", F.lit(None).cast(bodies.schema["top"].dataType).alias("top"))
    asks = chosen.select("part", "team").distinct().join(bodies, "part").select("part", "team", F.lit(False).alias("tree"), "body", "top")

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ask = next(r for r in rows if not r["tree"])
        queries = Queries(*pickle.loads(ask["body"]), k)
        for t in ask["top"] or []:
            queries.merge(t["query"], np.array([t["score"]]), np.array([MOST if t["vec_id"] is None else t["vec_id"]]))
        queries.new[:] = False
        descend(queries, [pickle.loads(r["body"]) for r in rows if r["tree"]])
        at, rank = np.nonzero(queries.new & (queries.scores > LEAST))
        ids = queries.found[at, rank]
        return pa.table([[ask["part"]] * len(at), at.astype(np.int32), queries.ids[at], queries.scores[at, rank], pa.array(ids, mask=ids == MOST)], schema=FOUND_ARROW)

    new = asks.unionByName(trees).groupBy("part", "team").applyInArrow(search, FOUND)
    both = new if found is None else found.unionByName(new)
    order = Window.partitionBy("part", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides the ``k`` greatest inner products of ``floor(scale * x)``."""
    with working_tables(vectors.sparkSession) as keep:
        n = vectors.count()
        cells, query_cells = (min(PIVOTS, 1 + 2 * size // room) for size, room in ((n, SHARD), (n // every, BLOCK)))
        points = written(celled(whole_vectors(vectors, scale), cells, query_cells), "points")
        shards = written(blocks(points, "cell", SHARD, True), "shards")
        parts = written(blocks(points.where(F.col("vec_id") % every == 0), "query_cell", BLOCK, False), "blocks")
        met = written(pairs(parts, shards), "pairs")
        found, first = None, 1
        for size in (*WAVES, None):
            last = None if size is None else first + size - 1
            found = written(wave(parts, shards, met, found, first, last, k), "found")
            first = 0 if last is None else last + 1
        order = Window.partitionBy("part", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return keep(found).select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
