"""Centroid clustering of integer vectors with kd-trees (filtering).

Every partition puts its vectors, in blocks of at most ``block``, into kd-trees,
once: a block's vectors are halved at the median of their widest component until
``leaf`` or fewer are left. A tree is one row of a stored table, its vectors in
the order of the leaves. From these, each node has its count, its integer sums
and squares, and its box.

In a round every task takes the centroids down its trees, level by level. At a
node, the centroid nearest to the middle of the box is held against the others:
one that is strictly farther from the whole box (from the corner of the box that
lies most in its favour) can't win there, nor tie, and is left out below. A node
with one centroid left goes to it whole, by its sums; vectors of leaves with
several left are resolved exactly. Only counts, sums and squares by centroid leave
the tasks: at most ``k`` rows each. All arithmetic is on integers, so that
results don't depend on partitions, blocks or order.

Defined cases: rows whose vector is null, has another size, or holds a null or
a value that is not finite are left out; ties go to the smaller number; equal
vectors and repeated rows count as often as they occur; with fewer than ``k``
vectors there are as many centroids; a centroid that nothing is nearest to stays;
an empty table gives an empty table. Components beyond 2 ** 26 raise an error, as
their squared distances could leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

LARGEST = 1 << 26
#: Products of components up to this size are exact in a 64-bit float, added up over a few thousand components.
_FLOAT = 1 << 20


def integers(vectors: Column, dim: int, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector is not of ``dim`` finite numbers."""
    whole = (F.size(vectors) == dim) & ~F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(whole, F.transform(vectors, lambda x: F.floor(x.cast("double") * scale)))


@dataclass
class Tree:
    """Vectors in the order of the leaves, and the bounds of the leaves."""

    points: np.ndarray  # (n, dim) int64
    bounds: np.ndarray

    @staticmethod
    def halved(n: int, leaf: int) -> list[np.ndarray]:
        """Bounds of the nodes of each level, from the root down to leaves of at most ``leaf`` vectors."""
        out = [np.array([0, n], np.int64)]
        while np.diff(out[-1]).max() > leaf:
            out.append(np.sort(np.concatenate([out[-1], (out[-1][:-1] + out[-1][1:]) // 2])))
        return out

    @classmethod
    def order(cls, points: np.ndarray, leaf: int) -> np.ndarray:
        """The permutation that puts the vectors in the order of the leaves."""
        out, levels = np.arange(len(points)), cls.halved(len(points), leaf)
        for upper, lower in zip(levels, levels[1:]):
            for i, middle, j in zip(upper[:-1].tolist(), lower[1::2].tolist(), upper[1:].tolist()):
                part = points[out[i:j]]
                wide = int(np.argmax(part.max(0) - part.min(0)))
                out[i:j] = out[i:j][np.argpartition(part[:, wide], middle - i)]
        return out

    @classmethod
    def read(cls, points: np.ndarray, leaf: int) -> Tree:
        return cls(points, cls.halved(len(points), leaf)[-1])

    def levels(self) -> list[tuple[np.ndarray, ...]]:
        """From the leaves up: first and last leaf, count, sums, squares, low and high corner of the nodes of a level."""
        at, p = self.bounds[:-1], self.points
        squares = np.einsum("ij,ij->i", p, p)
        nodes = (np.arange(len(at)), np.arange(len(at)) + 1, np.diff(self.bounds), np.add.reduceat(p, at), np.add.reduceat(squares, at), np.minimum.reduceat(p, at), np.maximum.reduceat(p, at))
        out = [nodes]
        while len(nodes[0]) > 1:
            pairs = np.arange(0, len(nodes[0]), 2)
            nodes = (nodes[0][::2], nodes[1][1::2], *(np.add.reduceat(x, pairs) for x in nodes[2:5]), np.minimum.reduceat(nodes[5], pairs), np.maximum.reduceat(nodes[6], pairs))
            out.append(nodes)
        return out

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, tuple]], np.ndarray, np.ndarray]:
        """Whole nodes with their centroid, and for the leaves left over: their numbers and which centroids may win."""
        levels, k = self.levels(), len(centroids)
        whole, open_nodes, live = [], np.zeros(1, np.int64), np.ones((1, k), bool)
        for height in range(len(levels) - 1, -1, -1):
            nodes = levels[height]
            low, high = nodes[5][open_nodes], nodes[6][open_nodes]
            live = undominated(low, high, centroids, live)
            single = live.sum(1) == 1
            whole.append((live[single].argmax(1), tuple(x[open_nodes[single]] for x in nodes[:5])))
            open_nodes, live = open_nodes[~single], live[~single]
            if height:
                open_nodes, live = np.stack([2 * open_nodes, 2 * open_nodes + 1], 1).ravel(), np.repeat(live, 2, 0)
        return whole, open_nodes, live

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By centroid: count, sums and sum of squares of its vectors."""
        k = len(centroids)
        count, sums, squares = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64), np.zeros(k, np.int64)
        whole, leaves, live = self.filtered(centroids)
        for to, (_, _, n, s, q) in whole:
            np.add.at(count, to, n)
            np.add.at(sums, to, s)
            np.add.at(squares, to, q)
        rows, to, _ = self.resolved(leaves, live, centroids)
        points = self.points[rows]
        count += np.bincount(to, minlength=k)
        np.add.at(squares, to, np.einsum("ij,ij->i", points, points))
        for c in np.unique(to):
            sums[c] += points[to == c].sum(0)
        return count, sums, squares

    def resolved(self, leaves: np.ndarray, live: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of these leaves, their nearest live centroid, and the distance."""
        n = np.diff(self.bounds)[leaves]
        rows = np.arange(n.sum()) + np.repeat(self.bounds[:-1][leaves] - np.cumsum(n) + n, n)
        far = distances(self.points[rows], centroids)
        far[~np.repeat(live, n, 0)] = np.iinfo(np.int64).max
        to = far.argmin(1) if len(rows) else np.zeros(0, np.int64)
        return rows, to, far[np.arange(len(rows)), to]

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every vector."""
        cluster, far = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        whole, leaves, live = self.filtered(centroids)
        for to, (first, last, *_) in whole:
            for c, i, j in zip(to.tolist(), self.bounds[first].tolist(), self.bounds[last].tolist()):
                cluster[i:j] = c
                gap = self.points[i:j] - centroids[c]
                far[i:j] = np.einsum("ij,ij->i", gap, gap)
        rows, to, near = self.resolved(leaves, live, centroids)
        cluster[rows], far[rows] = to, near
        return cluster, far


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(points, centroids): exact squared distances."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) > _FLOAT:
        return np.stack([np.einsum("ij,ij->i", gap, gap) for c in centroids for gap in [points - c]], 1)
    cross = np.rint(points.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ij->i", points, points)[:, None] - 2 * cross + np.einsum("ij,ij->i", centroids, centroids)


def undominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Of the live centroids of each box, those that are not strictly farther than another from all of it."""
    span = low + high  # twice the middle
    far = distances(span, 2 * centroids)
    far[~live] = np.iinfo(np.int64).max
    best = centroids[far.argmin(1)]
    out = live.copy()
    for z, centroid in enumerate(centroids):
        corner = np.where(centroid > best, high, low)
        gain = np.einsum("ij,ij->i", centroid - best, centroid + best - 2 * corner)  # distance to the centroid less that to the best one
        out[:, z] &= gain <= 0
    return out


def _blocks(it: Iterator[pa.RecordBatch], dim: int, block: int, leaf: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        points = table["_vector"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dim)
        if np.abs(points).max(initial=0) > LARGEST:
            raise ValueError(f"components beyond {LARGEST} can't be clustered in 64 bits")
        order = Tree.order(points, leaf)
        kind = next(t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= points.min(initial=0) and points.max(initial=0) <= np.iinfo(t).max)
        ids = table["_id"].combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([points[order].astype(kind).tobytes()], pa.binary()), pa.array([np.dtype(kind).itemsize], pa.int32())], ["ids", "points", "width"]
        )

    count = 0
    for batch in it:
        while batch.num_rows:
            part = batch.slice(0, block - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == block:
                yield row()
                held, count = [], 0
    if count:
        yield row()


def _trees(batch: pa.RecordBatch, dim: int, leaf: int) -> Iterator[tuple[pa.Array, Tree]]:
    for ids, points, width in zip(batch["ids"], batch["points"], batch["width"].to_pylist()):
        yield ids.values, Tree.read(np.frombuffer(points.as_py(), f"i{width}").reshape(-1, dim).astype(np.int64), leaf)


class Clusters:
    """Clustering of ``vectors`` (an array column of integers, see ``integers``) by rounds from the first centroids in ``start`` order."""

    def __init__(self, table: DataFrame, id_col: Column, vectors: Column, start: Column, k: int = 16, rounds: int = 3, dim: int = 64, block: int = 8192, leaf: int = 32):
        if k < 1 or dim < 1 or leaf < 2:
            raise ValueError("k and dim are 1 at least, and a leaf has room for two vectors")
        self.dim, self.leaf, self.spark = dim, leaf, table.sparkSession
        rows = table.select(id_col.alias("_id"), vectors.alias("_vector"), start.alias("_start")).filter(F.col("_vector").isNotNull())
        self.id_type = rows.schema["_id"].dataType.simpleString()
        first = rows.orderBy(F.col("_start").asc_nulls_last(), "_vector").limit(k).select("_vector").collect()
        self.centroids = np.array([r[0] for r in first], np.int64).reshape(-1, dim)
        schema = f"ids array<{self.id_type}>, points binary, width int"
        self.trees = stored(rows.select("_id", "_vector").mapInArrow(lambda it: _blocks(it, dim, block, leaf), schema))
        for _ in range(rounds if len(first) else 0):
            sums, count, _ = self.totals()
            self.centroids = np.array([[s // n for s in of] if n else old.tolist() for of, n, old in zip(sums, count, self.centroids)], np.int64).reshape(-1, dim)

    def _run(self, f: Callable[[pa.Array, Tree, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        centroids, dim, leaf = self.centroids, self.dim, self.leaf

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for ids, tree in _trees(batch, dim, leaf):
                    yield f(ids, tree, centroids)

        return self.trees.mapInArrow(run, schema)

    def totals(self) -> tuple[list[list[int]], list[int], list[int]]:
        """By centroid: the sums, counts and sums of squared distances of its vectors."""

        def partial(ids: pa.Array, tree: Tree, centroids: np.ndarray) -> pa.RecordBatch:
            count, sums, squares = tree.totals(centroids)
            inertia = squares - 2 * np.einsum("ij,ij->i", sums, centroids) + count * np.einsum("ij,ij->i", centroids, centroids)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count), pa.array(inertia), lists], ["cluster", "n", "inertia", "sums"])

        exact = lambda c: F.sum(c.cast("decimal(20,0)"))
        found = self._run(partial, "cluster int, n bigint, inertia bigint, sums array<bigint>").groupBy("cluster")
        rows = {r["cluster"]: r for r in found.agg(exact(F.col("n")).alias("n"), exact(F.col("inertia")).alias("inertia"), F.array(*[exact(F.col("sums")[i]) for i in range(self.dim)]).alias("sums")).collect()}
        each = range(len(self.centroids))
        value = lambda c, what, default: rows[c][what] if c in rows else default
        return [[int(s) for s in value(c, "sums", [0] * self.dim)] for c in each], [int(value(c, "n", 0)) for c in each], [int(value(c, "inertia", 0)) for c in each]

    def assigned(self) -> DataFrame:
        """id, cluster and squared distance of every vector."""

        def rows(ids: pa.Array, tree: Tree, centroids: np.ndarray) -> pa.RecordBatch:
            cluster, far = tree.assigned(centroids)
            return pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

        return self._run(rows, f"id {self.id_type}, cluster int, distance bigint")
