"""Jaccard self-join of word n-grams by chosen paths."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, blanks_as, broadcast_checked, key_runs, materialize, text_or_empty
from .components import components, forest

#: Hash functions of a sketch that are compared; those by which sets are split keep their whole value: one a run and DEEPER further ones.
SKETCH, DEEPER = 128, 32
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words between ASCII blanks."""
    plain = blanks_as(F.lower(text), "\t\n\x0b\x0c\r")
    return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The set of hashed n-grams, sorted; a shorter text is one n-gram, one without words has none."""
    w = words.view(np.uint64)
    width = min(n, len(w))
    if not width:
        return w
    out = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ w[k : k + len(out)]) * MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def multipliers(functions: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, functions, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 4096):
        np.minimum(out, (found[None, k : k + 4096] * by[:, None]).min(axis=1), out=out)
    return out


def _lists(column: pa.Array):
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[offsets[k] : offsets[k + 1]] for k in range(len(column)))


def _sketcher(n: int, paths_kept: int):
    def sketch(batches):
        by = multipliers(max(SKETCH, paths_kept))
        for batch in batches:
            sizes, paths, bits = [], [], []
            for words in _lists(batch.column(4)):
                found = shingles(words, n)
                low = minima(found, by)
                sizes.append(len(found))
                paths.append(low[:paths_kept].tobytes())
                bits.append((low[:SKETCH] >> np.uint64(8)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(paths, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "text_hash", "f1", "f2", "size", "paths", "bits"])

    return sketch


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _similar(bits: np.ndarray, sizes: np.ndarray, least: float, threshold: float, cross: np.ndarray | None):
    """Index pairs whose sketches agree in a share of at least ``least`` and whose sizes permit the threshold. cross: compare only rows of side 0 with rows of side 1."""
    found_i, found_j = [], []
    for i in range(len(bits) - 1):
        if cross is not None and cross[i]:
            continue
        a, b = sizes[i], sizes[i + 1 :]
        ok = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        if cross is not None:
            ok &= cross[i + 1 :] == 1
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            j = j[(bits[j] == bits[i]).sum(axis=1) >= least * SKETCH]
            found_i.append(np.full(len(j), i))
            found_j.append(j)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def _brute(least: float, threshold: float):
    """Columns node, cell, side, rep, size, bits: a spanning forest of the similar pairs of each (node, cell). Side 2 marks rows of one block, compared among themselves."""

    def brute(batches):
        for group in key_runs(batches, 2):
            side = group.column(2).to_numpy()
            order = np.argsort(side, kind="stable")
            rep, sizes, bits = group.column(3).to_numpy()[order], group.column(4).to_numpy()[order], _matrix(group.column(5), np.uint16)[order]
            i, j = _similar(bits, sizes, least, threshold, None if side.max() == 2 else side[order])
            if len(i):
                v, root = forest(rep[i], rep[j])
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["a", "b"])

    return brute


def _density(batches):
    """Columns node, bits: the mean agreement of the sketches sampled from a node."""
    for group in key_runs(batches, 1):
        bits = _matrix(group.column(1), np.uint16)
        m = len(bits)
        mean = sum((bits[i + 1 :] == bits[i]).mean(axis=1).sum() for i in range(m - 1)) / max(1, m * (m - 1) / 2)
        yield pa.RecordBatch.from_arrays([group.column(0).slice(0, 1), pa.array([float(mean)])], names=["node", "density"])


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _path(index: Column) -> Column:
    """A whole value of the sketch, read from its bytes."""
    return F.substring("paths", 8 * index + 1, 8)


def _in_cells(members: DataFrame) -> DataFrame:
    """Deal the members of each node into its ``blocks`` and each block to the cells of a triangle: node, cell, side, rep."""
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return cells.select("node", (low * F.col("blocks") + high).cast("long").alias("cell"), side.alias("side"), "rep")


def _blocks(share: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(share)).cast("int")


def _links(threshold: float):
    """Columns group, cell, side, rep, copies, shingles: exact link counts and a spanning forest of the links of each cell."""

    def verify(batches):
        for group in key_runs(batches, 2):
            side = group.column(2).to_numpy()
            order = np.argsort(side, kind="stable")
            side, rep, copies = side[order], group.column(3).to_numpy()[order], group.column(4).to_numpy()[order]
            held = group.column(5).to_pylist()
            sets = [np.frombuffer(held[k], np.uint64) for k in order]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            every, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            number = np.cumsum(often > 1) - 1
            shared = often[flat] > 1
            owner, flat = owner[shared], number[flat[shared]]
            by = np.argsort(flat, kind="stable")
            owner, flat = owner[by], flat[by]
            common = np.zeros((len(sets), len(sets)), np.float64)
            width = max(64, (4 << 20) // len(sets))
            for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
                a, b = np.searchsorted(flat, [at, at + width])
                held_by = np.zeros((len(sets), width), np.float32)
                held_by[owner[a:b], flat[a:b] - at] = 1
                common += held_by @ held_by.T
            union = sizes[:, None] + sizes[None, :] - common
            linked = common >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            if side.max() < 2:
                linked &= side[:, None] != side[None, :]
            i, j = np.nonzero(np.triu(linked))
            v, root = forest(rep[i], rep[j]) if len(i) else (rep[:0], rep[:0])
            counts = linked @ copies
            rows = np.concatenate([rep, v])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate([counts, np.zeros(len(v), np.int64)])), pa.array(np.concatenate([np.full(len(rep), -1), root]))], names=["rep", "links", "root"])

    return verify


def runs_for(threshold: float, recall: float, split: int, levels: int) -> int:
    """Runs after which a pair at the threshold has met with the probability ``recall``, if each run splits ``levels`` times."""
    meets = threshold * (1 - (1 - threshold) ** split) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-meets))) if meets < 1 else 1


def levels_for(threshold: float, recall: float, split: int, most_levels: int, most_functions: int) -> int:
    """As many splits, up to ``most_levels``, as need no more than ``most_functions`` runs; none if even that needs more."""
    return max((k for k in range(most_levels + 1) if runs_for(threshold, recall, split, k) <= most_functions), default=0)


def _counted(members: DataFrame, bucket: int) -> DataFrame:
    """Members (rep, node) of nodes with more than one, with their number n. Large nodes are few and join by broadcast if their measured size permits, so that no hot node is gathered."""
    counts = materialize(members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes")
    large = broadcast_checked(counts.where(F.col("n") > bucket), 16)
    few = members.join(large, "node", "left_anti").join(counts.where(F.col("n") <= bucket), "node")
    return few.unionByName(members.join(large, "node"))


def _candidates(sets: DataFrame, runs: range, *, roots: int, bucket: int, block: int, split: int, most_levels: int, crowded: float, least: float, threshold: float, planned: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Runs of the chosen-path search: (spanning forests of the similar pairs, the reps whose buckets were split more than ``planned`` times, the deepest level)."""
    firsts = F.transform(F.sequence(F.lit(runs.start), F.lit(runs.stop - 1)), lambda r: F.xxhash64(r, _path(r)))
    members, edges, deep = sets.select("rep", F.explode(firsts).alias("node")), [], None
    for level in range(most_levels + 1):
        members = materialize(_counted(members, bucket), f"nodes-{level}")
        cells = members.where(F.col("n") <= bucket).select("node", F.lit(0).cast("long").alias("cell"), F.lit(2).alias("side"), "rep")
        large = members.where(F.col("n") > bucket)
        sparse = None
        if large.limit(1).count():
            alike = large
            if level < most_levels:
                sample = large.where(F.pmod(F.xxhash64("rep", "node"), F.col("n")) < 48).join(sets.select("rep", "bits"), "rep").select("node", "bits")
                density = materialize(_sorted_by(sample, "node").mapInArrow(alone(_density), "node long, density double"), f"density-{level}")
                dense = broadcast_checked(density.where(F.col("density") >= crowded).select("node"), 16)
                alike, sparse = large.join(dense, "node", "left_semi"), large.join(dense, "node", "left_anti")
            cells = cells.unionByName(_in_cells(alike.withColumn("blocks", _blocks(F.col("n") / block))))
        given = cells.join(sets.select("rep", "size", "bits"), "rep").select("node", "cell", "side", "rep", "size", "bits")
        edges.append(materialize(_sorted_by(given, "node", "cell").mapInArrow(alone(_brute(least, threshold)), "a long, b long"), f"candidates-{level}"))
        if sparse is None or not sparse.limit(1).count():
            break
        if level == planned:
            deep = materialize(sparse.select("rep").distinct(), "deep-sets")
        children = F.array(*[F.xxhash64("node", F.lit(j), _path(F.lit(roots) + F.pmod(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) + 7 * j, F.lit(DEEPER)).cast("int"))) for j in range(split)])
        members = sparse.join(sets.select("rep", "paths"), "rep").select("rep", F.explode(children).alias("node"))
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return found, deep, level


def jaccard_classes(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", bucket: int = 256, block: int = 512, split: int = 2, levels: int = 3, most_levels: int = 24, most_functions: int = 256, crowded: float = 0.25, block_shingles: int = 4 << 20) -> DataFrame:
    """Link all documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``.

    Chosen-path join: a set is embedded as its MinHash sketch. A run splits all sets by the value of one of its
    functions; buckets above ``bucket`` sets are split again by ``split`` further functions chosen by the path, and so
    on. Small buckets, and larger ones whose sampled sketches agree by ``crowded`` in the mean (near copies, which no
    split would part; others at least halve), are compared by brute force, the latter in blocks. A pair at the threshold
    meets in a run with the probability ``threshold`` times that of surviving all splits, which gives the number of runs
    for the target recall at ``levels`` splits. Sets whose buckets were split more often get as many further runs as the
    deepest bucket asks for. Buckets left after ``most_levels`` splits are compared whole, in blocks. Each further split
    asks for more runs, the more so at low thresholds, so there buckets split no more often than ``most_functions`` runs
    make up for: sketches stay bounded (0.8 needs 26 functions for 24 splits, 0.5 has 9 splits, 0.3 three, 0.1 none), the
    recall stays, and what isn't split is compared. Only runs without any split may ask for more. Similar sketches
    only tie candidate components; within each, the whole n-gram sets are compared, all with all, so a link counts once
    and exactly, and links that every run missed are found there too. The work inside a component is that of its pairs
    of different texts; a task holds two blocks, bounded in rows and in shingles.

    Equal texts are joined once, by a representative, and no task emits pairs: link counts and spanning forests only.

    Words are lower-cased and lie between ASCII blanks. A text of fewer than ``n`` words is one n-gram; one without
    words (null, empty) links with nothing. Rows with equal ids are documents of their own; a null id names a class only
    if it has no other. A very long text is one set, in the memory of one task. An empty table gives an empty result.
    Other columns are ignored.

    Returns doc_id, class_id (least doc_id that links reach), n_links (documents linked directly), kept (one a class), text_hash.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), word_hashes(text_or_empty(text_col)).alias("words"))
    hashed = words.select("doc_id", "text_hash", F.xxhash64("words").alias("f1"), F.xxhash64(F.lit(1), "words").alias("f2"), "words")
    most_levels = levels_for(threshold, recall, split, most_levels, most_functions)
    levels = min(levels, most_levels)
    runs, roots = runs_for(threshold, recall, split, levels), runs_for(threshold, recall, split, most_levels)
    sketched = hashed.mapInArrow(alone(_sketcher(n, roots + DEEPER)), "doc_id long, text_hash long, f1 long, f2 long, size long, paths binary, bits binary")
    table = materialize(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches", long_rows=True)
    reps = materialize(table.where("size > 0").groupBy("f1", "f2").agg(F.min(F.struct("row", "doc_id")).alias("r"), F.count("*").alias("copies")).select("f1", "f2", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("rep_doc"), "copies"), "reps")
    sets = materialize(table.join(reps.select("rep"), F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "size", "paths", "bits"), "sets")

    # a sketch of a pair at the threshold agrees in at least this share, with the same probability as the runs find it
    least = threshold - (NormalDist().inv_cdf(recall) + 0.25) * math.sqrt(threshold * (1 - threshold) / SKETCH)
    options = {"roots": roots, "bucket": bucket, "block": block, "split": split, "most_levels": most_levels, "crowded": crowded, "least": least, "threshold": threshold, "planned": levels}
    candidates, deep, deepest = _candidates(sets, range(runs), **options)
    if deep is not None:
        further = range(runs, runs_for(threshold, recall, split, deepest))
        again = materialize(sets.join(deep, "rep", "left_semi"), "deep-sketches")
        candidates = candidates.unionByName(_candidates(again, further, **options)[0])
    tied = components(candidates)
    tied = materialize(tied.join(sets.select("rep", "size"), F.col("vertex") == F.col("rep")), "tied")
    # blocks of a component: two of them meet in a cell, which is bounded in rows and in shingles
    crowd = tied.groupBy("component").agg(_blocks(F.greatest(F.when(F.count("*") <= block, 1).otherwise(F.count("*") / (block // 2)), F.sum("size") / block_shingles)).alias("blocks"))
    needed = materialize(tied.join(crowd, "component").join(reps, "rep").select(F.col("component").alias("node"), "blocks", "rep", "rep_doc", "f1", "f2", "copies"), "needed")
    wanted = broadcast_checked(needed.select("rep_doc", F.col("f1").alias("g1"), F.col("f2").alias("g2"), "rep"), 64)
    same = F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))

    def spell(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(w, n).tobytes() for w in _lists(batch.column(1))], pa.binary())], names=["rep", "shingles"])

    spelled = materialize(hashed.join(wanted, same).select("rep", "words").mapInArrow(alone(spell), "rep long, shingles binary").dropDuplicates(["rep"]), "shingles", long_rows=True)
    placed = _in_cells(needed.select("node", "blocks", "rep"))
    full = placed.join(needed.select("rep", "copies"), "rep").join(spelled, "rep").select("node", "cell", "side", "rep", "copies", "shingles")
    found = materialize(_sorted_by(full, "node", "cell").mapInArrow(alone(_links(threshold)), "rep long, links long, root long"), "links", long_rows=True)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.where("root >= 0").select(F.col("rep").alias("a"), F.col("root").alias("b")))

    labels = reps.join(counts, "rep", "left").join(linked, F.col("rep") == F.col("vertex"), "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    narrow = table.select("row", "doc_id", "text_hash", "f1", "f2", "size")
    joined = narrow.join(labels, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("size") > 0), "left").select("row", "doc_id", "text_hash", F.coalesce("class", F.col("row")).alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    joined = materialize(joined, "classes")
    firsts = joined.where("n_links > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    out = joined.join(firsts, "class", "left")
    return out.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), "n_links", F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_hash")
