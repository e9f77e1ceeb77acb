"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, broadcast_checked, materialize, small_batches

INDEX = "dim int, shard long, rows binary, ids binary, known binary, units binary, copies binary, graph binary"
BLOCK = "dim int, block long, q_rows binary, q_units binary"


def _units(batches):
    """Valid vectors as unit vectors in double precision: row, vec_id, dim, unit."""
    for batch in batches:
        rows, ids, dims, units = [], [], [], []
        for row, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not vector or None in vector:
                continue
            x = np.array(vector, np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x /= np.abs(x).max()  # else squares may overflow or vanish
            rows.append(row)
            ids.append(vec_id)
            dims.append(len(x))
            units.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["row", "vec_id", "dim", "unit"])


def _gaps(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors by number."""
    return np.maximum(2 - 2 * np.einsum("nd,nd->n", x[a], b), 0)


class Graph:
    """A directed graph over unit vectors (float32) of at most ``degree`` edges a vector, built in batches that double.

    A batch's vectors search the graph as it stands; all that a search expanded is proposed as neighbours. Robust pruning
    takes the nearest proposal again and again and drops those that lie closer to it than, ``alpha`` times relaxed, to the
    vector itself. The edges' ends get edges back and are pruned where they have too many. Vectors that no path from the
    entry reaches then get an edge from the nearest one reached, so that every vector can be found.
    """

    def __init__(self, x: np.ndarray, *, degree: int, beam: int, alpha: float, batch: int = 256):
        self.x, self.degree, self.beam, self.relaxed = x, degree, beam, np.float32(alpha * alpha)
        self.edges = np.full((len(x), degree), -1, np.int32)
        self.entry = int((x @ x.mean(axis=0)).argmax())
        order = np.random.default_rng(len(x)).permutation(len(x))
        order = np.concatenate([[self.entry], order[order != self.entry]])
        at = 1
        while at < len(order):
            self.insert(order[at : at + min(at, batch)])
            at += min(at, batch)
        self.connect()

    def search(self, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Beams of all queries at once: numbers and squared distances, nearest first (-1: none); and those of all that was expanded."""
        b, n = len(queries), len(self.x)
        ids, gaps, todo = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32), np.zeros((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)  # the last column is for missing edges
        seen[:, n] = seen[:, self.entry] = True
        ids[:, 0], todo[:, 0] = self.entry, True
        gaps[:, 0] = _gaps(self.x, np.full(b, self.entry), queries)
        active, past_ids, past_gaps = np.arange(b), [], []
        while True:
            waiting = np.where(todo[active], gaps[active], np.inf)
            more = np.isfinite(waiting).any(axis=1)
            active, waiting = active[more], waiting[more]
            if not len(active):
                break
            step = min(width, beam)
            at = np.argpartition(waiting, step - 1, axis=1)[:, :step]
            chosen = np.isfinite(np.take_along_axis(waiting, at, 1))
            line = active[:, None]
            expanded = np.where(chosen, ids[line, at], -1)
            everyone = np.full((2, b, step), -1.0)
            everyone[0, active], everyone[1, active] = expanded, np.where(chosen, gaps[line, at], np.inf)
            past_ids.append(everyone[0].astype(np.int32))
            past_gaps.append(everyone[1].astype(np.float32))
            todo[line, at] = False
            found = []
            for j in range(step):  # one after another, so that each neighbour counts once
                near = np.where(chosen[:, j, None], self.edges[expanded[:, j]], -1)
                near = np.where(seen[line, near], -1, near)
                seen[line, near] = True
                found.append(near)
            new = np.concatenate(found, axis=1)
            i, j = np.nonzero(new >= 0)
            far = np.full(new.shape, np.inf, np.float32)
            far[i, j] = _gaps(self.x, new[i, j], queries[active[i]])
            all_gaps = np.concatenate([gaps[active], far], axis=1)
            best = np.argpartition(all_gaps, beam - 1, axis=1)[:, :beam]
            gaps[active] = np.take_along_axis(all_gaps, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new], axis=1), best, 1)
            todo[active] = np.take_along_axis(np.concatenate([todo[active], new >= 0], axis=1), best, 1)
        order = np.argsort(gaps, axis=1, kind="stable")
        ids, gaps = (np.take_along_axis(v, order, 1) for v in (ids, gaps))
        return np.where(np.isfinite(gaps), ids, -1), gaps, np.concatenate(past_ids, axis=1), np.concatenate(past_gaps, axis=1)

    def pruned(self, near: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Robust pruning of each row's proposals (-1: none) to at most ``degree`` of them."""
        order = np.argsort(gaps, axis=1, kind="stable")
        near, gaps = np.take_along_axis(near, order, 1), np.take_along_axis(gaps, order, 1)
        width = max(1, int((near >= 0).sum(axis=1).max()))
        near, gaps = near[:, :width], gaps[:, :width]
        alive, vectors, line = near >= 0, self.x[near], np.arange(len(near))
        out = np.full((len(near), self.degree), -1, np.int32)
        for k in range(self.degree):
            first = alive.argmax(axis=1)
            some = alive[line, first]
            if not some.any():
                break
            out[some, k] = near[some, first[some]]
            between = np.maximum(2 - 2 * np.matmul(vectors, vectors[line, first][:, :, None])[:, :, 0], 0)
            alive &= self.relaxed * between > gaps
            alive[line, first] = False
        return out

    def insert(self, batch: np.ndarray) -> None:
        _, _, near, gaps = self.search(self.x[batch], self.beam)
        self.edges[batch] = self.pruned(near, gaps)
        i, j = np.nonzero(self.edges[batch] >= 0)
        self.add_edges(self.edges[batch][i, j], batch[i])

    def add_edges(self, ends: np.ndarray, sources: np.ndarray, cells: int = 1 << 15) -> None:
        order = np.argsort(ends, kind="stable")
        ends, sources = ends[order], sources[order]
        ends, first, n = np.unique(ends, return_index=True, return_counts=True)
        have = (self.edges[ends] >= 0).sum(axis=1)
        by_size, at = np.argsort(have + n, kind="stable")[::-1], 0
        while at < len(ends):  # those with about as many proposals together
            j = by_size[at : at + max(1, cells // int(self.degree + n[by_size[at:]].max()))]
            near = np.full((len(j), self.degree + n[j].max()), -1, np.int32)
            near[:, : self.degree] = self.edges[ends[j]]
            line = np.repeat(np.arange(len(j)), n[j])
            place = np.arange(len(line)) - np.repeat(np.cumsum(n[j]) - n[j], n[j])
            near[line, self.degree + place] = sources[np.repeat(first[j], n[j]) + place]
            fits = have[j] + n[j] <= self.degree
            if fits.any():
                packed = np.argsort(near[fits] < 0, axis=1, kind="stable")[:, : self.degree]
                self.edges[ends[j[fits]]] = np.take_along_axis(near[fits], packed, 1)
            if not fits.all():
                own, near = ends[j[~fits]], near[~fits]
                r, c = np.nonzero(near >= 0)
                gaps = np.full(near.shape, np.inf, np.float32)
                gaps[r, c] = _gaps(self.x, near[r, c], self.x[own[r]])
                self.edges[own] = self.pruned(near, gaps)
            at += len(j)

    def reached(self) -> np.ndarray:
        there = np.zeros(len(self.x) + 1, bool)
        wave = np.array([self.entry])
        while len(wave):
            there[wave] = True
            wave = np.unique(self.edges[wave])
            wave = wave[(wave >= 0) & ~there[wave]]
        return there[:-1]

    def connect(self) -> None:
        """An edge to each vector not reached, from the nearest one reached with room for it, or from the nearest one in a new column."""
        while len(lost := np.flatnonzero(~self.reached())):
            for v, near in zip(lost, self.search(self.x[lost[:256]], self.beam)[0], strict=False):
                near = near[near >= 0]
                free = self.edges[near] < 0
                if not free.any():
                    self.edges = np.hstack([self.edges, np.full((len(self.x), 1), -1, np.int32)])
                    free = self.edges[near] < 0
                row = int(free.any(axis=1).argmax())
                self.edges[near[row], int(free[row].argmax())] = v


def _build(degree: int, beam: int, alpha: float):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        """A shard: its rows sorted by vector, then by id; the graph is over distinct vectors, ``copies`` bounds their rows."""
        dim, units = int(group["dim"].iloc[0]), group["unit"].to_numpy()
        known = group["vec_id"].notna().to_numpy()
        ids = group["vec_id"].fillna(0).to_numpy(np.int64)
        rows = group["row"].to_numpy(np.int64)
        order = np.array(sorted(range(len(rows)), key=lambda j: (units[j], not known[j], ids[j], rows[j])))
        first = [k for k, j in enumerate(order) if not k or units[j] != units[order[k - 1]]]
        x = np.frombuffer(b"".join(units[order[first]])).reshape(-1, dim)
        graph = Graph(x.astype(np.float32), degree=degree, beam=beam, alpha=alpha)
        blobs = [rows[order], ids[order], known[order], x, np.array([*first, len(order)], np.int64), np.column_stack([np.full(len(x), graph.entry, np.int32), graph.edges])]
        return pd.DataFrame({"dim": [dim], "shard": [group["shard"].iloc[0]], **{name: [blob.tobytes()] for name, blob in zip(("rows", "ids", "known", "units", "copies", "graph"), blobs, strict=True)}})

    return build


def build_index(units: DataFrame, *, shard_rows: int = 4096, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """A row for each shard of about ``shard_rows`` unit vectors of one length, dealt at random: its vectors and their graph, written."""
    spark = units.sparkSession
    sizes = materialize(units.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards")), "shard-counts")
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = units.join(broadcast_checked(sizes, 16), "dim").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards"))).drop("shards")
    return materialize(dealt.repartition(spread, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build(degree, beam, alpha), INDEX), "graphs")


def _block(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("row")
    return pd.DataFrame({"dim": [group["dim"].iloc[0]], "block": [group["block"].iloc[0]], "q_rows": [group["row"].to_numpy(np.int64).tobytes()], "q_units": [b"".join(group["unit"])]})


def _search(k: int, beam: int, at_once: int = 128):
    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                x, queries = (np.frombuffer(r[c]).reshape(-1, dim) for c in ("units", "q_units"))
                rows, ids, copies, q_rows = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "copies", "q_rows"))
                known, table = np.frombuffer(r["known"], bool), np.frombuffer(r["graph"], np.int32).reshape(len(x), -1)
                graph = Graph.__new__(Graph)
                graph.x, graph.entry, graph.edges = x.astype(np.float32), int(table[0, 0]), table[:, 1:]
                for at in range(0, len(queries), at_once):
                    q, q_row = queries[at : at + at_once], q_rows[at : at + at_once]
                    near = graph.search(q.astype(np.float32), beam)[0]
                    i, j = np.nonzero(near >= 0)
                    v = near[i, j]
                    score = (x[v] * q[i]).sum(axis=1)
                    # of equal vectors the k + 1 with the least ids suffice, as one of them may be the query's own
                    n = np.minimum(copies[v + 1] - copies[v], k + 1)
                    i, score = np.repeat(i, n), np.repeat(score, n)
                    c = np.repeat(copies[v], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    other = rows[c] != q_row[i]
                    i, score, c = i[other], score[other], c[other]
                    order = np.lexsort((rows[c], ids[c], ~known[c], -score, i))
                    i, score, c = i[order], score[order], c[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, score, c = i[kept], score[kept], c[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(q_row[i]), pa.array(ids[c], mask=~known[c]), pa.array(rows[c]), pa.array(score)], names=["q_row", "vec_id", "row", "score"])

    return search


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, beam: int = 128, block_rows: int = 1024) -> DataFrame:
    """Candidates of each query from each shard, at most ``k`` of each: q_row, vec_id, row, score. Queries are packed into blocks, which meet every shard of their length; blocks are broadcast if their counted bytes allow, else joined by a shuffle."""
    spark = index.sparkSession
    sizes = materialize(queries.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")), "block-counts")
    dealt = queries.join(broadcast_checked(sizes, 16), "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).select("dim", "block", "row", "unit")
    blocks = materialize(dealt.groupBy("dim", "block").applyInPandas(_block, BLOCK), "query-blocks")
    cells = index.join(broadcast_checked(sizes, 16), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    cells = cells.join(broadcast_checked(blocks, F.length("q_units") + F.length("q_rows")), ["dim", "block"]).drop("block", "shard")
    with small_batches(spark, 1):  # a row holds a shard
        return materialize(cells.mapInArrow(alone(_search(k, beam)), "q_row long, vec_id long, row long, score double"), "near")


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, beam: int = 128, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, degree: int = 32, build_beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each row that satisfies ``is_query`` (on column vec_id): query_id, rank, vec_id, score.

    All vectors are indexed (:func:`build_index`), and every shard is searched with a beam of ``beam``; what the beams
    find is scored in double precision on the vectors as given. Greater beams find more: recall is a matter of ``beam``
    and ``build_beam``, scores are exact. Every row but the query's own is a candidate; equal vectors share a place in
    the graph, so groups of copies neither disconnect it nor hide one another. Ties go to the smaller id, null ids last.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths
    don't meet. Rows with equal ids are vectors of their own; a row with a null id is a candidate, and a query only if
    ``is_query`` holds for null. Other columns are ignored. With fewer than ``k`` candidates a query gets all, without
    any it has no rows. An empty table gives an empty result.
    """
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = materialize(given.mapInArrow(alone(_units), "row long, vec_id long, dim int, unit binary"), "units")
    asked = units.where(is_query)
    found = search(build_index(units, shard_rows=shard_rows, degree=degree, beam=build_beam, alpha=alpha), asked, k=k, beam=beam)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id")), "q_row").select("query_id", "rank", "vec_id", "score")
