"""Operator 13: exact k-means over integer vectors, with ball trees that take whole balls at once.

Each partition turns its vectors into trees of at most `TREE_ROWS` vectors. A node is a ball: centre, radius, count and integer
sum of its vectors. A round takes the trees, which stay where they were written, against the centroids: by the triangle
inequality a ball in which one centroid is nearest for every vector is assigned as a whole, with its count and sum; where it
is not, the centroids that are nowhere nearest are left out and the ball's halves are asked; leaves are compared exactly. A
round sends one row a tree and cluster to the sums; the driver sees one row a cluster.

Balls are judged in floating point with a margin far above its error, so that what is near a tie always goes to the leaves,
where distances are exact integers. Ties go to the smaller centroid.

Defined cases: vectors that are null, have another length or a component that is null or not finite are left out. Repeated rows
count each. Seeds with the same hash (repeated ids) are taken in the order of their vectors; a row without an id is never a
seed, but is assigned. Fewer vectors than clusters make fewer clusters. A component must stay below 2**26 after scaling, since
the squared distance must fit a long; a larger one stops the job. Clusters that lose their vectors keep their centroid. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Vectors of one tree, vectors of one leaf at most, and the largest component.
TREE_ROWS, LEAF_ROWS, LARGEST = 16_384, 16, 1 << 26
#: Up to this component products of 64 components are exact in doubles.
EXACT = 1 << 22
#: Share of the distance, and further distance, by which a ball must be clear of a tie.
MARGIN, SLACK = 1e-9, 1e-4


@dataclass
class Tree:
    """A ball tree in arrays. Vectors are in the order of the leaves; node i has the vectors low[i] to high[i], and its halves
    are nodes left[i] and left[i] + 1 (0: a leaf)."""

    vectors: np.ndarray  # int64, rows by components
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it has the vectors. Each ball is halved at the median of its widest component."""
        order = np.arange(len(vectors))
        low, high, left, level = [0], [len(vectors)], [0], [0]
        while level:
            following = []
            for node in level:
                a, b = low[node], high[node]
                if b - a <= leaf:
                    continue
                part = vectors[order[a:b]]
                spread = part.max(0) - part.min(0)
                widest = int(spread.argmax())
                if not spread[widest]:
                    continue  # copies of one vector are a ball of radius 0, however many
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, widest], half)]
                left[node] = len(low)
                for x, y in ((a, a + half), (a + half, b)):
                    following.append(len(low))
                    low.append(x)
                    high.append(y)
                    left.append(0)
            level = following
        vectors = vectors[order]
        sums = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), vectors.cumsum(0)])
        a, b = np.array(low), np.array(high)
        total = sums[b] - sums[a]
        centre = total / (b - a)[:, None]
        radius = np.array([np.sqrt(((vectors[x:y] - c) ** 2).sum(1).max()) for x, y, c in zip(low, high, centre, strict=True)])
        return cls(vectors, a, b, np.array(left), centre, radius, total), order

    FIELDS = {"vectors": np.int32, "low": np.int32, "high": np.int32, "left": np.int32, "centre": np.float64, "radius": np.float64, "total": np.int64}

    def pack(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k).astype(kind)).tobytes() for k, kind in self.FIELDS.items()}

    @classmethod
    def unpack(cls, row: dict[str, bytes], width: int) -> Tree:
        x = {k: np.frombuffer(row[k], kind) for k, kind in cls.FIELDS.items()}
        wide = {k: x[k].reshape(-1, width) for k in ("vectors", "centre", "total")}
        return cls(wide["vectors"].astype(np.int64), x["low"].astype(np.int64), x["high"].astype(np.int64), x["left"].astype(np.int64), wide["centre"], x["radius"], wide["total"])

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """(nearest, balls): the nearest centroid of each vector, -1 where a ball answers for it; the balls assigned whole, as
        (centroid, nodes)."""
        nearest, balls = np.full(len(self.vectors), -1, np.int64), []
        nodes, allowed = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            away = np.sqrt(np.maximum(0, ((self.centre[nodes][:, None, :] - centroids[None]) ** 2).sum(2)))
            away = np.where(allowed, away, np.inf)
            best = away.min(1)
            # A centroid further than this from the centre is nearest for no vector of the ball.
            reach = (best + 2 * self.radius[nodes]) * (1 + MARGIN) + SLACK
            allowed = away <= reach[:, None]
            alone = allowed.sum(1) == 1
            for k in np.unique(away[alone].argmin(1)) if alone.any() else ():
                balls.append((int(k), nodes[alone][away[alone].argmin(1) == k]))
            open_, rest = nodes[~alone], allowed[~alone]
            leaf = self.left[open_] == 0
            if leaf.any():
                rows = np.concatenate([np.arange(self.low[x], self.high[x]) for x in open_[leaf]])
                nearest[rows] = distances(self.vectors[rows], centroids).argmin(1)
            nodes = (self.left[open_[~leaf]][:, None] + np.arange(2)).ravel()
            allowed = np.repeat(rest[~leaf], 2, axis=0)
        return nearest, balls


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, as longs: rows by centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def _build(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Trees of a partition's vectors, `rows` vectors at a time."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tree() -> pa.RecordBatch:
        ids, named, vectors = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        made, order = Tree.of(vectors)
        row = {"ids": ids[order].tobytes(), "named": named[order].tobytes(), **made.pack()}
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in row.items()})

    for batch in batches:
        column, ids = batch.column("v"), batch.column("vec_id")
        vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
        if np.abs(vectors).max(initial=0) >= LARGEST:
            raise ValueError(f"a component of {LARGEST} or more: its squared distance may not fit a long")
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a in range(0, len(vectors), rows):
            kept.append((ids[a : a + rows], named[a : a + rows], vectors[a : a + rows]))
            if sum(len(x[0]) for x in kept) >= rows:
                yield tree()
    if kept:
        yield tree()


def _gather(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and sum of the vectors that each tree has in each cluster."""
    k, width = centroids.shape
    for batch in batches:
        for row in batch.to_pylist():
            tree = Tree.unpack(row, width)
            nearest, balls = tree.assign(centroids)
            near = nearest >= 0
            count, total = np.bincount(nearest[near], minlength=k), np.zeros((k, width), np.int64)
            np.add.at(total, nearest[near], tree.vectors[near])
            for c, nodes in balls:
                count[c] += int((tree.high[nodes] - tree.low[nodes]).sum())
                total[c] += tree.total[nodes].sum(0)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used]), "total": pa.array(total[used].tolist(), pa.list_(pa.int64()))})


def _label(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cluster and distance of every vector."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = Tree.unpack(row, centroids.shape[1])
            nearest, balls = tree.assign(centroids)
            for c, nodes in balls:
                for x in nodes.tolist():
                    nearest[tree.low[x] : tree.high[x]] = c
            away = np.zeros(len(nearest), np.int64)
            for a in range(0, len(nearest), 4096):
                part = slice(a, a + 4096)
                away[part] = np.take_along_axis(distances(tree.vectors[part], centroids), nearest[part, None], 1)[:, 0]
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["named"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(away)], names=["vec_id", "cluster", "distance"])


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors, scaled and rounded down."""
    usable = (F.size("g") == width) & F.forall("g", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("g"))
    return given.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("g", lambda x: F.floor(x * scale)).alias("v"))


def seeds(points: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = points.where("vec_id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    points = integer_vectors(vectors, id_col, vector_col, width, scale)
    centroids = seeds(points, k, seed)
    if not len(centroids):  # no vector with an id: nothing to start from
        return points.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    fields = ", ".join(f"{x} binary" for x in ("ids", "named", *Tree.FIELDS))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = cut(points.repartition(n_parts).mapInArrow(lambda b: _build(b, width, tree_rows), fields))
    for _ in range(rounds):
        now = centroids
        sums = trees.mapInArrow(lambda b, c=now: _gather(b, c), "cluster int, n long, total array<long>")
        rows = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"c{i}") for i in range(width)]).collect()  # one row a cluster
        centroids = centroids.copy()
        for r in rows:
            centroids[r["cluster"]] = [r[f"c{i}"] // r["n"] for i in range(width)]
    labelled = cut(trees.mapInArrow(lambda b: _label(b, centroids), "vec_id long, cluster int, distance long"))
    digests = F.create_map(*[F.lit(x) for i, c in enumerate(centroids) for x in (i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())])
    inertia = labelled.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}  # one row a cluster
    own = F.create_map(*[F.lit(x) for c in range(len(centroids)) for x in (c, sums.get(c, 0))]).cast("map<int,bigint>")
    return labelled.select("vec_id", "cluster", "distance", F.element_at(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(digests, F.col("cluster")).alias("centroid_sha256"))
