"""Nearest neighbours by low-dimensional stable projections, kd-trees and a stopping test.

For a Gaussian projection to m parts, the squared projected distance of two vectors over
their squared distance follows a chi-square law with m degrees of freedom.  So when the
next projected distance exceeds ``quantile(confidence) * d_k``, with ``d_k`` the distance of
the k-th neighbour found, a vector nearer than that would have been met with the given
probability, and the search stops.

A kd-tree over a sample of projections deals all vectors into cells.  A task takes a
cell, builds a kd-tree of small leaves over its projections and visits leaves in the order
of their distance to the query until the test holds.  Queries first search the cell they fall
into; the bound found there decides, by the same test and down the tree, which other cells they visit.
Equal vectors are searched once, both as queries and as candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, grouped, matrix, valid_vector

PROJECTED = 8
CONFIDENCE = 0.97
CELL_ROWS = 4096
LEAF_ROWS = 64
#: Cells at most, and sampled rows for each: they bound what the driver holds (projections of 4 million rows, 134 MB).
CELLS = 65_536
SAMPLE_PER_CELL = 32
#: A cell's queries come in this many groups, one in memory at a time.
QUERY_GROUPS = 64


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 50.0 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(size: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, m))


def split(points: np.ndarray, rows: int, most: int) -> tuple[list[tuple[int, float]], int]:
    """A complete kd-tree by medians: (dimension, value) by node, and its depth."""
    depth = 0
    while (1 << depth) * rows < len(points) and (2 << depth) <= most:
        depth += 1
    nodes: list[tuple[int, float]] = [(0, math.inf)] * ((1 << depth) - 1)
    parts = {0: np.arange(len(points))}
    for node in range((1 << depth) - 1):
        own = parts.pop(node)
        if not len(own):
            parts[2 * node + 1] = parts[2 * node + 2] = own
            continue
        x = points[own]
        d = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        value = float(np.median(x[:, d]))
        nodes[node] = (d, value)
        parts[2 * node + 1], parts[2 * node + 2] = own[x[:, d] <= value], own[x[:, d] > value]
    return nodes, depth


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    dims = np.array([d for d, _ in nodes] or [0])
    values = np.array([v for _, v in nodes] or [0.0])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > values[at])
    return at - ((1 << depth) - 1)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    gap = np.maximum(low[None] - q[:, None], 0) + np.maximum(q[:, None] - high[None], 0)
    return (gap * gap).sum(axis=2)


class Cell:
    """Vectors of one cell with a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray):
        nodes, depth = split(p, LEAF_ROWS, 1 << 20)
        leaf = leaf_of(p, nodes, depth)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.x = ids[order], x[order]
        p, leaf = p[order], leaf[order]
        self.at = np.r_[np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), len(leaf)]
        self.low = np.minimum.reduceat(p, self.at[:-1])
        self.high = np.maximum.reduceat(p, self.at[:-1])

    def search(self, q: np.ndarray, lows: np.ndarray, k: int, bound: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the leaves visited before the test holds: ids and squared distances."""
        order = np.argsort(lows, kind="stable")
        ids, dist = np.empty(0, dtype=np.int64), np.empty(0)
        limit, at, step = bound, 0, 1
        while at < len(order) and not lows[order[at]] > factor * limit:
            part = order[at : at + step]
            part = part[lows[part] <= factor * limit]
            rows = np.concatenate([np.arange(self.at[i], self.at[i + 1]) for i in part])
            gap = self.x[rows] - q
            dist = np.r_[dist, np.einsum("ij,ij->i", gap, gap)]
            ids = np.r_[ids, self.ids[rows]]
            if len(dist) > k:
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            if len(dist) == k:
                limit = min(limit, dist.max())
            at, step = at + step, min(2 * step, 16)
        return ids, dist


def _deal(size: int, m: int, seed: int, nodes: list[tuple[int, float]], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = projection(size, m, seed)
        for batch in batches:
            if batch.num_rows:
                p = matrix(batch.column("vec"), batch.num_rows) @ a
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, m, dtype=np.int32), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(p, nodes, depth)), lists], names=[*batch.schema.names, "cell", "p"])

    return run


def _search(m: int, k: int, factor: float):
    """Rows (cell, kind, part, id, vec, p, bound), sorted; kind 0 are vectors, 1 queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = None, None
        for table, bounds in grouped(batches, ["cell", "kind", "part"]):
            queries, ids, dists = [], [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(s, e - s)
                where, n = part["cell"][0].as_py(), e - s
                x, p, own = matrix(part["vec"], n), matrix(part["p"], n), part["id"].to_numpy()
                if part["kind"][0].as_py() == 0:
                    cell, at = Cell(own, x, p), where
                    continue
                if at != where:
                    continue
                bound = part["bound"].to_numpy()
                for b in range(0, n, 256):
                    lows = box_distance(p[b : b + 256], cell.low, cell.high)
                    for i in range(len(lows)):
                        found, dist = cell.search(x[b + i], lows[i], k, bound[b + i], factor)
                        queries.append(np.full(len(found), own[b + i]))
                        ids.append(found)
                        dists.append(dist)
            if queries:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(dists))], names=["query", "rep", "dist"])

    return run


def boxes_by_level(low: np.ndarray, high: np.ndarray, cells: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of all nodes of the complete tree over the cells, from its root down; those of empty nodes are infinite."""
    a, b = (np.full((1 << depth, low.shape[1]), x) for x in (np.inf, -np.inf))
    a[cells], b[cells] = low, high
    levels = [(a, b)]
    while len(a) > 1:
        a, b = np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2])
        levels.insert(0, (a, b))
    return levels


def _visit(levels: list[tuple[np.ndarray, np.ndarray]], factor: float):
    """The cells, other than its own, that each query visits: down the tree, as far as boxes are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 32):
                batch = whole.slice(start, 32)
                n = batch.num_rows
                p, home, bound = matrix(batch.column("p"), n), batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
                query, node = np.arange(n), np.zeros(n, dtype=np.int64)
                for level, (low, high) in enumerate(levels):
                    if level:
                        query, node = np.repeat(query, 2), (2 * node[:, None] + np.arange(2)).reshape(-1)
                    gap = np.maximum(low[node] - p[query], 0) + np.maximum(p[query] - high[node], 0)
                    far = (gap * gap).sum(axis=1)
                    near = np.isfinite(far) & (far <= factor * bound[query])
                    query, node = query[near], node[near]
                query, node = query[node != home[query]], node[node != home[query]]
                part = batch.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(node), part.column("vec"), part.column("p"), part.column("bound")], names=["id", "cell", "vec", "p", "bound"])

    return run


def _project(size: int, m: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = projection(size, m, seed)
        for batch in batches:
            if batch.num_rows:
                p = (matrix(batch.column("vec"), batch.num_rows) @ a).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p], pa.binary())], names=["p"])

    return run


def nearest(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", m: int = PROJECTED, confidence: float = CONFIDENCE, seed: int = 1) -> DataFrame:
    """The ``k`` nearest found of every query row among all other rows, by Euclidean distance.

    Returns ``query_id, rank, id, score``: ranks from 1, the distance in double precision on
    the original vectors, ties to the smaller id; all candidates where there are fewer than
    ``k``.  Vectors that are null, empty, zero or hold null or non-finite parts take no
    part, nor do rows with a null id; vectors of different lengths are not compared.  A row
    is no candidate of a query with its id, so rows that share an id don't find each other.
    ``m`` is even.  An empty table, or one without queries, gives an empty result.  Other columns play no part.
    """
    kind = "array<float>" if df.select(F.col(f"`{vec_col}`")).dtypes[0][1] == "array<float>" else "array<double>"
    vec = F.col(f"`{vec_col}`").cast(kind)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(valid_vector(F.col("vec")) & F.col("id").isNotNull())
    # of equal vectors, the k + 1 smallest ids can be among the answers
    same = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    few = cut(few.withColumn("rep", F.min("id").over(Window.partitionBy("vec"))).select("id", "rep", "n", "vec"), "distinct")
    reps = few.where("n = 1").select("rep", "vec")
    members = few.select("rep", "id")
    asked = cut(rows.where("asks").select("id", "vec").join(reps, "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "asked")
    wanted = asked.select(F.col("query").alias("rep")).distinct()
    found = None
    for (size,) in reps.select(F.size("vec")).distinct().collect():
        part = _nearest_of(reps.where(F.size("vec") == size), wanted, size, k + 1, m, chi_square_quantile(confidence, m), seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    order = Window.partitionBy("query").orderBy("dist", "id")
    ids = found.join(members, "rep").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    final = Window.partitionBy("query_id").orderBy("dist", "id")
    pairs = asked.join(ids.select("query", "id", "dist"), "query").where("id <> query_id")
    pairs = pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "id", F.sqrt("dist").alias("score"))


def _nearest_of(reps: DataFrame, wanted: DataFrame, size: int, k: int, m: int, factor: float, seed: int) -> DataFrame:
    total = reps.count()
    cells = min(CELLS, max(1, -(-total // CELL_ROWS)))
    share = min(1.0, 2 * cells * SAMPLE_PER_CELL / total)
    a = projection(size, m, seed)
    p = np.zeros((0, m), dtype=np.float32)
    if cells > 1:
        drawn = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vec")
        p = np.frombuffer(b"".join(drawn.mapInArrow(_project(size, m, seed), "p binary").toArrow().column("p").to_pylist()), dtype=np.float32).reshape(-1, m)
    nodes, depth = split(p, max(1, len(p) // cells), cells)
    field = reps.schema["vec"].dataType.simpleString()
    dealt = cut(reps.mapInArrow(_deal(size, m, seed, nodes, depth), f"rep long, vec {field}, cell long, p array<double>"), "cells")
    ends = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    boxes = dealt.groupBy("cell").agg(*ends).collect()
    where = np.array([b["cell"] for b in boxes], dtype=np.int64)
    low, high = (np.array([[b[f"{name}{i}"] for i in range(m)] for b in boxes]).reshape(-1, m) for name in ("low", "high"))

    points = dealt.select("cell", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("rep").alias("id"), "vec", "p", F.lit(0.0).alias("bound"))
    asks = dealt.join(wanted, "rep", "left_semi").select(F.col("rep").alias("id"), "cell", "vec", "p")
    group = F.pmod(F.xxhash64("id"), F.lit(QUERY_GROUPS)).cast("int")

    def search(q: DataFrame) -> DataFrame:
        mine = q.select("cell", F.lit(1).alias("kind"), group.alias("part"), "id", "vec", "p", "bound")
        work = points.join(mine.select("cell").distinct(), "cell", "left_semi").select(*mine.columns).unionByName(mine)
        work = work.repartition("cell").sortWithinPartitions("cell", "kind", "part", "id")
        return cut(work.mapInArrow(_search(m, k, factor), "query long, rep long, dist double"), "found")

    home = search(asks.withColumn("bound", F.lit(float("inf"))))
    kth = home.groupBy("query").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    known = asks.join(kth.withColumnRenamed("query", "id"), "id").select("id", "cell", "vec", "p", bound.alias("bound"))
    away = known.mapInArrow(_visit(boxes_by_level(low, high, where, depth), factor), f"id long, cell long, vec {field}, p array<double>, bound double")
    return home.unionByName(search(away))
