"""Approximate nearest neighbours by learned partitions.

A cell is a set of vectors, at first all of them. On a bounded sample of a cell (SAMPLE at most, by the hash of id and
vector) a graph of NEIGHBOURS nearest neighbours is cut into balanced partitions: bisection along principal directions,
then moves of vectors to the partition most of their neighbours are in, as long as sizes stay within SLACK of even. A
small network learns, for a vector, how its neighbours spread over the partitions. Every vector of the cell is filed
under its most probable partition; a query goes to its most probable ones, as many as the sample's held-out queries need
to find TARGET of their true neighbours (DEEPER below the first level). Partitions with more than twice PER_PARTITION
vectors are cells of the next level, so the number of partitions grows with the table; one that holds nearly all of the
cell above (copies of one vector) is left as it is. The vectors of a query's partitions are compared exactly.

Cells are fitted by tasks, each on its sample, and their models meet the rows in an exchange by cell and a salt, so
nothing that grows comes to the driver or is broadcast. A partition is cut into blocks of vectors and of queries by hash,
so that a popular partition is many tasks and none holds more than BLOCK vectors and QUERIES queries; a block answers
with at most k rows a query. A query whose partitions hold fewer than k others is compared with all vectors, in blocks.

A vector that is null, zero or empty, holds a null or a non-finite component, or isn't as long as most vectors (the
shorter of equally frequent lengths) takes no part, nor does one with a null id. Rows that repeat a query's id and
vector are that query; a row of its id with another vector is a candidate, and a query of its own, with ranks of its own.
Repeated rows are candidates each. Ties go to the smaller id. Fewer than 2 * LEAST_ROWS vectors are one partition, so
their search is exact. Columns besides vec_id and embedding aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import map_batches
from .components import group_bounds, whole_groups
from .lineage import stored

SAMPLE, NEIGHBOURS, SLACK, TARGET, DEEPER, BLOCK, QUERIES = 4096, 10, 0.05, 0.95, 0.99, 4096, 1024
#: Vectors for each partition, the fewest and most partitions of a cell, sampled vectors for each, rows that share a salt.
PER_PARTITION, FEWEST, MOST, LEAST_ROWS, SALTED = 3000, 64, 64, 20, 1 << 16


def nearest(points: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest points of each query, in no order."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), 512):
        q = queries[i : i + 512]
        d = (points**2).sum(1)[None] - 2 * q @ points.T
        out[i : i + 512] = np.argpartition(d, k - 1, 1)[:, :k]
    return out


def balanced_partition(points: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 12) -> np.ndarray:
    """A partition of each point: even sizes within the slack, few graph edges between partitions."""
    n = len(points)
    part = np.zeros(n, np.int64)

    def bisect(rows: np.ndarray, first: int, count: int) -> None:
        part[rows] = first
        if count == 1:
            return
        x = points[rows] - points[rows].mean(0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        left = count // 2
        order = rows[np.argsort(x @ axis, kind="stable")]
        cut = len(rows) * left // count
        bisect(order[:cut], first, left)
        bisect(order[cut:], first + left, count - left)

    bisect(np.arange(n), 0, parts)
    most, fewest = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    sizes = np.bincount(part, minlength=parts)
    links = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel())), np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (links[0], part[links[1]]), 1)
        gain = votes - votes[np.arange(n), part][:, None]
        moved = 0
        for i in np.argsort(-gain.max(1), kind="stable"):
            to = int(gain[i].argmax())
            if gain[i, to] > 0 and sizes[to] < most and sizes[part[i]] > fewest:
                sizes[to], sizes[part[i]], part[i], moved = sizes[to] + 1, sizes[part[i]] - 1, to, moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer: log-probabilities of partitions."""

    weights: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x @ a + b, 0) @ c + d

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, rate: float = 2e-3, seed: int = 5) -> Router:
        random = np.random.default_rng(seed)
        n, parts = len(x), target.shape[1]
        weights = [random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(n), max(1, n // 128)):
                h = np.maximum(x[rows] @ weights[0] + weights[1], 0)
                z = h @ weights[2] + weights[3]
                p = np.exp(z - z.max(1, keepdims=True))
                g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
                back = (g @ weights[2].T) * (h > 0)
                step += 1
                for w, m, v, d in zip(weights, first, second, (x[rows].T @ back, back.sum(0), h.T @ g, g.sum(0)), strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(weights)


@dataclass
class Index:
    """A router and how many partitions each query goes to; scale divides the vectors."""

    router: Router | None
    scale: float
    parts: int
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions, the most probable first."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.scores(x / self.scale), 1, kind="stable")


def fit_index(sample: np.ndarray, parts: int, k: int, target: float = TARGET) -> Index:
    """Learns on nine tenths of the sample and sets the number of probes on the rest."""
    if parts < 2 or len(sample) < 2 * LEAST_ROWS or len(sample) < 4 * k:
        return Index(None, 1.0, 1, 1)
    scale = float(np.sqrt((sample**2).mean())) or 1.0
    x = sample / scale
    tests, x = x[::10], x[np.arange(len(x)) % 10 > 0]
    graph = nearest(x, x, NEIGHBOURS + 1)
    part = balanced_partition(x, graph, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    index = Index(Router.fit(x, spread), scale, parts, parts)
    filed = index.ranked(x * scale)[:, 0]
    place = np.argsort(index.ranked(tests * scale), 1)  # of each partition, among a query's
    needed = place[np.arange(len(tests))[:, None], filed[nearest(x, tests, k)]]
    found = [(needed < m).mean() for m in range(1, parts + 1)]
    index.probes = int(np.argmax(np.array(found) >= min(target, found[-1]))) + 1
    return index


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").limit(1)
    length = lengths.first()
    return rows.where(F.size("embedding") == (length["length"] if length else 0))


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cell", "block", "bunch"]
        for table in whole_groups(batches, keys, 1):
            bounds = group_bounds(table, keys)
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                group = table.slice(low, high - low)
                asks = np.asarray(group.column("asks"))
                ids, marks = group.column("vec_id").to_numpy(), group.column("mark").to_numpy()
                points = _points(group.column("embedding").combine_chunks())
                queries, query_ids, query_marks, points, ids, marks = points[asks], ids[asks], marks[asks], points[~asks], ids[~asks], marks[~asks]
                if not len(points) or not len(queries):
                    continue
                square = (points**2).sum(1)
                for i in range(0, len(queries), 64):
                    q, own, mark = queries[i : i + 64], query_ids[i : i + 64], query_marks[i : i + 64]
                    rough = square[None] - 2 * q @ points.T
                    rough[(own[:, None] == ids[None]) & (mark[:, None] == marks[None])] = np.inf
                    edge = np.partition(rough, min(k, len(points)) - 1, 1)[:, min(k, len(points)) - 1]
                    near = rough <= np.where(np.isfinite(edge), edge + 1e-9 * (square.max() + (q**2).sum(1)), np.finfo(float).max)[:, None]
                    for j in range(len(q)):
                        at = np.flatnonzero(near[j])
                        exact = np.sqrt(((points[at] - q[j]) ** 2).sum(1))
                        order = np.lexsort((ids[at], exact))[:k]
                        rows[0].append(np.full(len(order), own[j]))
                        rows[1].append(np.full(len(order), mark[j]))
                        rows[2].append(ids[at[order]])
                        rows[3].append(exact[order])
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], ["query_id", "query_mark", "vec_id", "score"])

    return run


def _fitted(parts: int | None, k: int, target: float):
    """Whole samples of cells to a model each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cell"], 1):
            bounds = group_bounds(table, ["cell"])
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                group = table.slice(low, high - low)
                points = _points(group.column("embedding").combine_chunks())
                even = max(FEWEST, group.column("size")[0].as_py() // PER_PARTITION)
                index = fit_index(points, min(parts or even, MOST, len(points) // LEAST_ROWS), k, target)
                yield pa.RecordBatch.from_arrays([group.column("cell").combine_chunks().slice(0, 1), pa.array([pickle.dumps(index)])], ["cell", "model"])

    return run


_PLACED = ("cell", "asks", "vec_id", "mark", "embedding")


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their cells, each cell's model first: vectors to one cell below, queries to as many as they probe."""
    index = None
    for batch in batches:
        cells, models = batch.column("cell").to_numpy(), batch.column("model")
        change = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]) | np.asarray(models.is_valid()))
        for low, high in zip(change, np.append(change[1:], len(cells)), strict=True):
            if models[low].is_valid:
                index, low = pickle.loads(models[low].as_py()), low + 1
            part = batch.slice(low, high - low)
            if not part.num_rows:
                continue
            order = index.ranked(_points(part.column("embedding")))
            probes = np.where(np.asarray(part.column("asks")), index.probes, 1)
            rows = np.repeat(np.arange(len(order)), probes)
            below = order[rows, np.arange(len(rows)) - np.repeat(np.cumsum(probes) - probes, probes)]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cells[low] * MOST + 1 + below), *(part.column(c).take(at) for c in _PLACED[1:])], list(_PLACED))


def partitioned(rows: DataFrame, parts: int | None, k: int, sample: int, target: float) -> DataFrame:
    """rows (asks, vec_id, mark, embedding) with cell: a vector once, a query once for each partition it probes."""
    placed = rows.withColumn("cell", F.lit(0).cast("long"))
    schema = "cell long, asks boolean, vec_id long, mark long, embedding array<double>"
    above = None
    while True:
        sizes = stored(placed.where("not asks").groupBy("cell").agg(F.count(F.lit(1)).alias("size")))
        if above is None:
            cells = sizes.where(F.col("size") >= 2 * LEAST_ROWS)
        else:  # below the cells just split
            parent = above.select(F.col("cell").alias("of"), F.col("size").alias("whole"))
            cells = sizes.join(parent, F.floor((F.col("cell") - 1) / MOST) == F.col("of")).where((F.col("size") > 2 * PER_PARTITION) & (F.col("size") < 0.8 * F.col("whole"))).select("cell", "size")
        above = stored(cells)
        if above.isEmpty():
            return placed
        hashed = F.pmod(F.xxhash64("mark", "vec_id", F.lit(3)), F.lit(1 << 30))
        some = placed.where("not asks").join(above, "cell").where(hashed < F.lit(1 << 30) * F.lit(2.0 * sample) / F.col("size"))
        place = F.row_number().over(Window.partitionBy("cell").orderBy(hashed, "vec_id", "mark"))
        some = some.withColumn("place", place).where(F.col("place") <= sample).repartition("cell").sortWithinPartitions("cell", "place")
        models = stored(map_batches(some.select("cell", "size", "embedding"), _fitted(parts, k, target), "cell long, model binary"))
        parts, target = None, DEEPER
        salts = F.ceil(F.col("size") / SALTED).cast("int")
        none = F.lit(None)
        moving = placed.join(above, "cell").select(*_PLACED, F.pmod(F.xxhash64("mark", "vec_id"), salts).cast("int").alias("salt"), none.cast("binary").alias("model"))
        given = models.join(above, "cell").select("cell", none.cast("boolean").alias("asks"), none.cast("long").alias("vec_id"), none.cast("long").alias("mark"), none.cast("array<double>").alias("embedding"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "model")
        both = moving.unionByName(given).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("model").isNull())
        rest = placed.join(above, "cell", "left_anti").select(*_PLACED)
        placed = stored(rest.unionByName(map_batches(both, _route, schema)))


def compared(placed: DataFrame, k: int) -> DataFrame:
    """query_id, query_mark, vec_id and score of each query's k nearest in each block of its cells."""
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("asks")).alias("vectors"), F.count_if("asks").alias("queries"))
    counts = stored(sizes.where("vectors > 0 and queries > 0").select("cell", F.ceil(F.col("vectors") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("bunches")))
    rows = placed.join(counts, "cell")
    own = lambda n, seed: F.pmod(F.xxhash64("mark", "vec_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = rows.where("not asks").select(*_PLACED, own("blocks", 1).alias("block"), every("bunches").alias("bunch")).unionByName(rows.where("asks").select(*_PLACED, own("bunches", 2).alias("bunch"), every("blocks").alias("block")))
    grouped = sides.repartition("cell", "block", "bunch").sortWithinPartitions("cell", "block", "bunch")
    return map_batches(grouped, _answers(k), "query_id long, query_mark long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, *, parts: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """The k nearest found of each query row: query_id, rank (from 1), vec_id and score (Euclidean distance)."""
    rows = stored(usable(vectors).select(F.coalesce(is_query, F.lit(False)).alias("asks"), "vec_id", F.xxhash64("embedding").alias("mark"), "embedding"))
    asked = rows.where("asks").dropDuplicates(["vec_id", "mark"])
    both = rows.withColumn("asks", F.lit(False)).unionByName(asked)
    found = stored(compared(partitioned(both, parts, k, sample, target), k))
    name = ("query_id", "query_mark")
    enough = found.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = stored(asked.join(enough, (F.col("vec_id") == F.col("query_id")) & (F.col("mark") == F.col("query_mark")), "left_anti"))
    if not short.isEmpty():
        everywhere = rows.withColumn("asks", F.lit(False)).unionByName(short).withColumn("cell", F.lit(0).cast("long"))
        shorter = short.select(F.col("vec_id").alias("query_id"), F.col("mark").alias("query_mark"))
        found = found.join(shorter, list(name), "left_anti").unionByName(compared(everywhere.select(*_PLACED), k))
    place = F.row_number().over(Window.partitionBy(*name).orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
