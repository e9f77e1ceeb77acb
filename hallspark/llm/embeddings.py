"""Embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, broadcast_checked, key_runs, materialize
from .components import components, forest


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 rows q with scales s, and a bound e of |x - s q| for each."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - scale[:, None] * q, axis=1) + 1e-12


#: So many products of int8 values sum up to less than 2**24, so that float32 holds the sum exactly.
EXACT = (1 << 24) // (127 * 127)


def possible_pairs(a: tuple, b: tuple, threshold: float, rows: int = 512):
    """Blocks of index pairs (i, j) whose dot product may reach ``threshold``.

    x.y = s q.s' q' + (x - s q).s' q' + x.(y - s' q'), so the product of the quantised vectors errs by e |s' q'| + e'
    at most, and |s' q'| <= 1 + e'. Sums of up to EXACT products are held exactly by float32; longer vectors are
    multiplied in slices and added up in double precision.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    slices = [slice(k, k + EXACT) for k in range(0, qa.shape[1], EXACT)]
    right = [np.ascontiguousarray(qb[:, k].T.astype(np.float32)) for k in slices]
    for at in range(0, len(qa), rows):
        dots = qa[at : at + rows, slices[0]].astype(np.float32) @ right[0]
        for k, more in zip(slices[1:], right[1:], strict=True):
            dots = dots.astype(np.float64) + qa[at : at + rows, k].astype(np.float32) @ more
        # s s' q.q' + e (1 + e') + e' >= threshold, with e <= its largest value in the block as a first, cheap sieve
        e = ea[at : at + rows]
        floor = ((threshold - 1e-9 - e.max() * (1 + eb) - eb) / (sb * sa[at : at + rows].max())).astype(np.float32)
        floor -= np.abs(floor) * np.float32(1e-6)
        i, j = np.nonzero(dots >= floor[None, :])
        if len(i):
            exact = sa[at + i] * sb[j] * dots[i, j] + ea[at + i] * (1 + eb[j]) + eb[j] >= threshold - 1e-9
            if exact.any():
                yield at + i[exact], j[exact]


def _unit(batches):
    """Valid vectors as unit vectors in double precision, and quantised."""
    for batch in batches:
        by_length: dict[int, tuple[list, list]] = {}
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not vector or None in vector:
                continue
            x = np.array(vector, np.float64)
            norm = np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max() if np.isfinite(x).all() and x.any() else 0.0
            if norm > 0 and np.isfinite(norm):
                keys, units = by_length.setdefault(len(x), ([], []))
                keys.append(key)
                units.append(x / norm)
        for length, (keys, units) in by_length.items():
            q, scale, bound = quantised(np.array(units))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([length] * len(keys), pa.int32()), pa.array([u.tobytes() for u in units], pa.binary()), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(bound)], names=["row", "dim", "unit", "q", "scale", "bound"])


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("row")
    return pd.DataFrame({"dim": [group["dim"].iloc[0]], "tile": [group["tile"].iloc[0]], "rows": [group["row"].to_numpy(np.int64).tobytes()], "q": [b"".join(group["q"])], "errors": [group[["scale", "bound"]].to_numpy(np.float64).tobytes()]})


def _possible(threshold: float):
    def compare(batches):
        """Cells of two tiles to the rows that may link in them: dim, tile, other, row, side (2 in a cell of one tile)."""
        for batch in batches:
            for dim, t, o, r1, q1, e1, r2, q2, e2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = ((np.frombuffer(q, np.int8).reshape(-1, dim), *np.frombuffer(e).reshape(-1, 2).T) for q, e in ((q1, e1), (q2, e2)))
                left, right = np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool)
                for i, j in possible_pairs(a, b, threshold):
                    if t == o:
                        i, j = i[i < j], j[i < j]
                    left[i] = right[j] = True
                rows_a, rows_b = np.frombuffer(r1, np.int64), np.frombuffer(r2, np.int64)
                rows, side = (rows_a[left | right], 2) if t == o else (np.concatenate([rows_a[left], rows_b[right]]), None)
                sides = np.full(len(rows), 2) if side else np.repeat([0, 1], [left.sum(), right.sum()])
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, t)), pa.array(np.full(n, o)), pa.array(rows), pa.array(sides, pa.int32())], names=["dim", "tile", "other", "row", "side"])

    return compare


def _exact(threshold: float, rows: int = 512):
    def compare(batches):
        """Columns dim, tile, other, side, row, unit, by cell: link counts in double precision and a spanning forest of the links of each cell."""
        for group in key_runs(batches, 3):
            side, row = group.column(3).to_numpy(), group.column(4).to_numpy()
            x = np.frombuffer(b"".join(group.column(5).to_pylist())).reshape(len(row), -1)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            counts, stars = np.zeros(len(row), np.int64), [(row[:0], row[:0])]
            for at in range(0, len(left), rows):
                i, j = np.nonzero(x[left[at : at + rows]] @ x[right].T >= threshold)
                i, j = left[at + i], right[j]
                if side[0] == 2:
                    i, j = i[i < j], j[i < j]
                counts += np.bincount(i, minlength=len(row)) + np.bincount(j, minlength=len(row))
                if len(i):
                    stars.append(forest(row[i], row[j]))
            v, root = forest(*map(np.concatenate, zip(*stars, strict=True)))
            linked = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([row[linked], v])), pa.array(np.concatenate([counts[linked], np.zeros(len(v), np.int64)])), pa.array(np.concatenate([np.full(linked.sum(), -1), root]))], names=["row", "links", "root"])

    return compare


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = 2048) -> DataFrame:
    """Link all pairs of vectors with a cosine of at least ``threshold``: vec_id, n_links, component_id, kept.

    Rows are dealt at random into tiles of about ``tile_rows``, quantised to int8; each pair of tiles is multiplied, and
    the rows that the quantisation error bounds leave possible come again in double precision, to the cell that asks for
    them, where their pairs are computed. A task emits rows, link counts and a spanning forest of its tiles, never
    pairs, so large groups of copies cost no more rows than others. The work is that of comparing all pairs; tasks and
    memory are bounded by the tile.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows with the same id are vectors of their own, but share a component name. A null id links like
    others and comes back as null, its component as the least id it reaches. An empty table gives an empty result. Other
    columns (labels) are ignored.
    """
    given = materialize(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    units = materialize(given.select("row", "v").mapInArrow(alone(_unit), "row long, dim int, unit binary, q binary, scale double, bound double"), "units")
    tiles_of = materialize(units.groupBy("dim").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("tiles")), "tile-counts")
    dealt = units.join(broadcast_checked(tiles_of, 16), "dim").select("dim", F.pmod(F.xxhash64("row"), F.col("tiles")).alias("tile"), "row", "q", "scale", "bound")
    tiles = materialize(dealt.groupBy("dim", "tile").applyInPandas(_tile, "dim int, tile long, rows binary, q binary, errors binary"), "tiles")
    right = tiles.select(F.col("dim").alias("d2"), F.col("tile").alias("t2"), F.col("rows").alias("r2"), F.col("q").alias("q2"), F.col("errors").alias("e2"))
    # each tile is sent to the cells of a triangle; a cell holds two tiles
    last = tiles.groupBy("dim").agg(F.max("tile").alias("last"))
    cells = tiles.select("dim", "tile").join(broadcast_checked(last, 16), "dim").select("dim", "tile", F.explode(F.sequence("tile", "last")).alias("other"))
    spark = vectors.sparkSession
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paired = cells.join(tiles, ["dim", "tile"]).join(right, (F.col("dim") == F.col("d2")) & (F.col("other") == F.col("t2"))).select("dim", "tile", "other", "rows", "q", "errors", "r2", "q2", "e2").repartition(spread, "dim", "tile", "other")
    possible = materialize(paired.mapInArrow(alone(_possible(threshold)), "dim int, tile long, other long, row long, side int"), "possible")
    asked = possible.join(units.select("row", "unit"), "row").select("dim", "tile", "other", "side", "row", "unit")
    asked = asked.repartition("dim", "tile", "other").sortWithinPartitions("dim", "tile", "other")
    found = materialize(asked.mapInArrow(alone(_exact(threshold)), "row long, links long, root long"), "links")
    counts = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    groups = components(found.where("root >= 0").select(F.col("row").alias("a"), F.col("root").alias("b")))
    ids = given.select("row", "vec_id")
    grouped = ids.join(groups, F.col("row") == F.col("vertex"), "left").join(counts, "row", "left").select("row", "vec_id", "component", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    names = grouped.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("name"))
    out = grouped.join(names, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("name")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
