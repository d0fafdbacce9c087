"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

With one more coordinate, sqrt(M^2 - |x|^2) where M is the largest norm, the
largest inner product is the smallest Euclidean distance, so the triangle
inequality holds.  Vectors go to the cell of their nearest pivot; a cell is cut
into shards of at most about ``SHARD`` vectors, each with a vantage-point tree.
A query first searches its own cell, which bounds the distance of its k-th
neighbour, then only the cells, and in their trees the branches, whose lower
bound is below that distance divided by ``factor``.  A factor of one prunes
nothing that can hold a neighbour: the search is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.llm.common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
#: How much the bound of pruning is tightened; measured recall is in the README.
FACTOR = 1.2
#: Vectors of a shard, vectors of a leaf, queries that a task searches a shard for.
SHARD, LEAF, QUERIES = 4_096, 64, 20_000
#: Pivots at most, a matrix that goes to every task.
MOST_PIVOTS = 4_096
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """A node: the vantage point and, for its inner and outer half, the least and
    largest distance to it; or a leaf's rows."""

    rows: np.ndarray | None = None
    vantage: np.ndarray | None = None
    halves: list = field(default_factory=list)  # (least, largest, Tree)


def build(points: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Tree:
    """A vantage-point tree over ``points[rows]``; of several tries the vantage
    point whose distances spread most is taken."""
    if len(rows) <= LEAF:
        return Tree(rows=rows)
    best, spread = None, -1.0
    for at in rng.choice(rows, size=3):
        d = np.linalg.norm(points[rows] - points[at], axis=1)
        if d.std() > spread:
            best, spread = (at, d), float(d.std())
    at, d = best
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    parts = (order[:half], order[half:])
    return Tree(vantage=points[at], halves=[(float(d[p].min()), float(d[p].max()), build(points, rows[p], rng)) for p in parts])


class Search:
    """The best ``k`` points so far of each query, by product, then class."""

    def __init__(self, points: np.ndarray, classes: np.ndarray, queries: np.ndarray, k: int, factor: float, radius: float, limit: np.ndarray):
        self.points, self.classes, self.queries, self.k, self.factor = points, classes, queries, k, factor
        self.norm = (queries**2).sum(axis=1) + radius**2
        self.best = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)
        self.limit = limit.copy()  # distances of the k-th neighbours known from elsewhere

    def reach(self, active: np.ndarray) -> np.ndarray:
        return np.minimum(self.limit[active], np.sqrt(np.maximum(self.norm[active] - 2 * self.best[active, -1], 0))) / self.factor * (1 + SLACK) + SLACK

    def leaf(self, active: np.ndarray, rows: np.ndarray) -> None:
        found = self.queries[active] @ self.points[rows].T
        score = np.concatenate([self.best[active], found], axis=1)
        row = np.concatenate([self.row[active], np.broadcast_to(rows, found.shape)], axis=1)
        name = np.where(row >= 0, self.classes[row], np.iinfo(np.int64).max)
        order = np.lexsort((name, -score), axis=1)[:, : self.k]
        self.best[active], self.row[active] = np.take_along_axis(score, order, axis=1), np.take_along_axis(row, order, axis=1)

    def home(self, tree: Tree, active: np.ndarray) -> None:
        """Only the leaf that each query falls into, for a first bound."""
        if tree.rows is not None:
            self.leaf(active, tree.rows)
            return
        d = np.linalg.norm(self.queries[active] - tree.vantage, axis=1)
        (_, inner, left), (outer, _, right) = tree.halves
        inside = d <= (inner + outer) / 2
        for part, child in ((active[inside], left), (active[~inside], right)):
            if len(part):
                self.home(child, part)

    def all(self, tree: Tree, active: np.ndarray) -> None:
        if tree.rows is not None:
            # The home leaf is met again: its rows must not count twice.
            seen = np.isin(self.row[active], tree.rows)
            self.best[active] = np.where(seen, -np.inf, self.best[active])
            self.row[active] = np.where(seen, -1, self.row[active])
            self.leaf(active, tree.rows)
            return
        d = np.linalg.norm(self.queries[active] - tree.vantage, axis=1)
        for least, largest, child in tree.halves:
            bound = np.maximum(least - d, d - largest)
            part = active[bound <= self.reach(active)]
            if len(part):
                self.all(child, part)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), dtype=np.float64).reshape(len(column), -1)


def _lifted(x: np.ndarray, radius: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(radius**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _flat(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, fine), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Index:
    """``points``: dim, cell, shard, class_id (the smallest id), ids (the smallest
    of equal vectors), vector (bytes).  ``pivots`` and ``radii`` by dimension."""

    points: DataFrame
    pivots: dict[int, np.ndarray]
    radii: dict[int, np.ndarray]
    radius: float
    k: int


def _same(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard: int = SHARD) -> Index:
    """Every usable vector is indexed.  Equal vectors are one point with their
    ``k`` + 1 smallest ids, more of which no result can hold; a rank that is cut
    off in each map task keeps a very common vector small.  Pivots are the first
    vectors by hash, at most ``MOST_PIVOTS``; only they reach the driver."""
    smallest = Window.partitionBy("v").orderBy("id")
    few = _same(vectors, id_col, vector_col).withColumn("_rank", F.row_number().over(smallest)).where(F.col("_rank") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    points = materialize(points.select(F.col("ids")[0].alias("class_id"), "ids", "v", F.size("v").alias("dim"), norm.alias("norm")), "points")
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    radius = float(points.agg(F.max("norm")).first()[0] or 0.0) ** 0.5
    wanted = {d: min(MOST_PIVOTS, -(-n // shard)) for d, n in sizes.items()}
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "class_id")
    limit = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in wanted.items()]) if wanted else F.lit(0)
    # MOST_PIVOTS rows a dimension in any task at most: the rank is cut off early.
    first = points.select("dim", "class_id", "v").withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= MOST_PIVOTS).where(F.col("_rank") <= limit)
    pivots: dict[int, list] = {}
    for r in first.orderBy("dim", "_rank").collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    lifted = {d: _lifted(np.array(p), radius) for d, p in pivots.items()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("dim"):
                x = np.stack(part["v"].tolist()).astype(np.float64)
                up = _lifted(x, radius)
                cell, far = np.empty(len(x), dtype=np.int64), np.empty(len(x))
                for at in range(0, len(x), 1024):
                    square = 2 * radius**2 - 2 * up[at : at + 1024] @ lifted[d].T
                    cell[at : at + 1024] = square.argmin(axis=1)
                    far[at : at + 1024] = np.linalg.norm(up[at : at + 1024] - lifted[d][cell[at : at + 1024]], axis=1)
                yield pd.DataFrame({"dim": d, "cell": cell, "far": far, "class_id": part["class_id"].to_numpy(), "ids": part["ids"].to_numpy(), "vector": [row.tobytes() for row in x]})

    placed = points.select("dim", "class_id", "ids", "v").mapInPandas(assign, "dim int, cell long, far double, class_id long, ids array<long>, vector binary")
    placed = materialize(placed, "placed")
    cells = materialize(placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")), "cells")
    # At most MOST_PIVOTS rows a dimension.
    radii = {d: np.full(len(p), -1.0) for d, p in lifted.items()}
    for r in cells.collect():
        radii[r["dim"]][r["cell"]] = r["radius"]
    placed = placed.join(F.broadcast(cells.select("dim", "cell", "shards")), ["dim", "cell"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("class_id"), F.col("shards")).cast("int")).drop("shards", "far")
    return Index(placed, lifted, radii, radius, k)


def _route(index: Index, home: bool, factor: float):
    """The cells that a query goes to: its own, or all others in reach."""
    pivots, radii, radius = index.pivots, index.radii, index.radius

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("dim"):
                if d not in pivots:
                    continue
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    q = _flat(_matrix(some["vector"]))
                    square = (q**2).sum(axis=1)[:, None] + radius**2 - 2 * q @ pivots[d].T
                    own = square.argmin(axis=1)
                    if home:
                        yield some.assign(cell=own, reach=np.inf)
                        continue
                    bound = np.sqrt(np.maximum(square, 0)) - radii[d]
                    open_ = (bound <= some["reach"].to_numpy()[:, None] / factor * (1 + SLACK) + SLACK) & (radii[d] >= 0)
                    open_[np.arange(len(own)), own] = False
                    row, cell = np.nonzero(open_)
                    yield some.iloc[row].assign(cell=cell)

    return route


def _searched(index: Index, queries: DataFrame, factor: float) -> DataFrame:
    """(query, id, score): of each query and shard its best ``k`` + 1 ids."""
    k, radius = index.k + 1, index.radius
    # A shard that very many queries visit is searched by several tasks.
    load = queries.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    load = materialize(load, "load")
    points = index.points.join(F.broadcast(load), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    shards = index.points.select(*[F.col(c).alias(c) for c in ("dim", "cell", "shard")]).distinct()
    asked = queries.join(F.broadcast(load), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
    asked = asked.join(shards, ["dim", "cell"])

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        p = p.sort_values("class_id", ignore_index=True)
        x, asked_ = _matrix(p["vector"]), _matrix(q["vector"])
        up = _lifted(x, radius)
        s = Search(up, p["class_id"].to_numpy(), _flat(asked_), k, factor, radius, q["reach"].to_numpy(dtype=np.float64))
        tree = build(up, np.arange(len(up)), np.random.default_rng(len(up)))
        every = np.arange(len(asked_))
        s.home(tree, every)
        s.all(tree, every)
        at, place = np.nonzero(s.row >= 0)
        row = s.row[at, place]
        # The measure itself, on the vectors as they came.
        score = (asked_[at] * x[row]).sum(axis=1)
        ids = p["ids"].to_numpy()
        n = np.array([len(ids[r]) for r in row], dtype=np.int64)
        out = pd.DataFrame({"query": np.repeat(q["query"].to_numpy()[at], n), "id": np.concatenate([ids[r] for r in row]) if len(row) else np.array([], dtype=np.int64), "score": np.repeat(score, n)})
        out = out.sort_values(["query", "score", "id"], ascending=[True, False, True])
        return out.groupby("query", sort=False).head(k)

    keys = ["dim", "cell", "shard", "block"]
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query long, id long, score double")


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query by
    inner product, nearest first, ties to the smaller id; its own id is left out.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part on either side; vectors of another length are no candidates.  Equal
    query vectors are searched once.  Rows that repeat id and vector are one.
    Fewer candidates than ``k``: all of them; an empty table: no rows."""
    rows = _same(queries, id_col, vector_col)
    shared = materialize(rows.groupBy("v").agg(F.min("id").alias("query")), "queries")
    packed = shared.select("query", F.size("v").alias("dim"), "v").mapInPandas(_pack, "query long, dim int, vector binary")
    packed = materialize(packed, "packed")
    schema = "query long, dim int, vector binary, reach double, cell long"
    own = packed.withColumn("reach", F.lit(float("inf"))).mapInPandas(_route(index, True, factor), "query long, dim int, vector binary, cell long, reach double").select("query", "dim", "vector", "reach", "cell")
    near = materialize(_best(_searched(index, materialize(own, "own-cells"), factor), "query", index.k + 1), "own-results")
    # The distance of the (k + 1)-th found so far; without as many there is no bound.
    last = near.where(F.col("rank") == index.k + 1).select("query", F.col("score").alias("least"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    reach = F.sqrt(F.greatest(F.lit(0.0), square + F.lit(index.radius**2) - 2 * F.col("least")))
    bounded = packed.join(shared.join(last, "query", "left").select("query", F.coalesce(reach, F.lit(float("inf"))).alias("reach")), "query")
    other = materialize(bounded.select("query", "dim", "vector", "reach").mapInPandas(_route(index, False, factor), schema), "other-cells")
    found = _best(near.drop("rank").unionByName(_searched(index, other, factor)), "query", index.k + 1).drop("rank")
    # Every id of a shared query vector has the same neighbours but for itself.
    each = rows.select(F.col("id").alias("query_id"), "v").join(shared, "v").select("query_id", "query")
    theirs = each.join(materialize(found, "found"), "query").where("id <> query_id").drop("query")
    return _best(theirs, "query_id", index.k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"query": batch["query"], "dim": batch["dim"], "vector": [np.asarray(v, dtype=np.float64).tobytes() for v in batch["v"]]})
