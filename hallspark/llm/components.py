"""Connected components as rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) of the components of some edges; the root is the least vertex, and is left out as vertex."""
    vertices, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    parent = list(range(len(vertices)))
    for u, v in zip(left, right, strict=True):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u < v:
            parent[v] = u
        else:
            parent[u] = v
    for k in range(len(parent)):
        parent[k] = parent[parent[k]]
    roots = np.array(parent, np.int64)
    own = roots != np.arange(len(roots))
    return vertices[own], vertices[roots[own]]


def _shrink(batches):
    """Replace the edges of a task by stars with the same components."""
    for batch in batches:
        if batch.num_rows:
            v, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges of long vertices, to (vertex, component), where component is the least vertex in reach; vertices without edges are left out.

    Alternating large-star and small-star rounds: a logarithmic number of joins, each cut off by a written table. No
    component is ever gathered; a hot vertex is only a join key whose rows adaptive execution splits.
    """
    now = materialize(edges.where("a != b").select("a", "b").mapInArrow(alone(_shrink), "a long, b long").distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
