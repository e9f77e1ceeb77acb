"""Sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

LOW_BITS = (1 << 24) - 1


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= key: a binary search in one expression."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table, n = _longs(bounds), len(bounds)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at),
    )


def _draw(rows: DataFrame, rate: float, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with ``size * rate`` expected draws each; the expected number of draws bounds what is collected."""
    expected = F.col("size") * F.lit(rate)
    coin = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select("key", (F.floor(expected) + (coin < expected - F.floor(expected)).cast("int")).alias("n"))
    return sorted((r.key, r.n) for r in drawn.where("n > 0").groupBy("key").agg(F.sum("n").alias("n")).collect())


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[int]:
    total, seen, out = sum(n for _, n in sample), 0, []
    for key, n in sample:
        if seen * parts // total != (seen + n) * parts // total:
            out.append(key)
        seen += n
    return out


def shard_by_size(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", least_ranges: int = 256, most_ranges: int = 4096, range_bytes: int = 4 << 30, draws_per_range: int = 64, rounds: int = 4, copies_per_block: int = 100_000) -> DataFrame:
    """Put every row into one of ``n_shards`` shards of nearly equal bytes.

    The key of a row is the hash of its text, refined by the hash of its id, so equal texts are neighbours and a hot
    text still splits. Size-weighted samples of the keys give quantile splitters; ranges above twice the mean size are
    sampled again and subdivided; within ranges and over them, exact running sums cut the shards, which therefore
    differ from equal bytes by less than one row. The splitters on the driver are at most ``most_ranges``
    (some more after subdivision), the collected samples ``draws_per_range`` for each.

    Null texts have size 1 and the checksum of an empty text. A null id is a value like others. Repeated rows keep a
    place each: they are counted before they are shuffled and take places in blocks of ``copies_per_block``, so that no
    task holds them all. An empty table gives an empty result. Other columns are ignored.

    Returns id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text, doc = text_or_empty(text_col), F.col(id_col)
    key = F.xxhash64(text).bitwiseAND(F.lit(~LOW_BITS)).bitwiseOR(F.xxhash64(doc).bitwiseAND(F.lit(LOW_BITS)))
    rows = materialize(docs.select(doc.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(least_ranges, min(most_ranges, -(-total // range_bytes)))
    bounds = _quantiles(_draw(rows, draws_per_range * parts / total, 0), parts) if total else []
    bounds = sorted(set(bounds))
    for attempt in range(1, rounds + 1):
        ranged = rows.withColumn("range", _range_of(F.col("key"), bounds))
        sizes = {r.range: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        full = [k for k, r in sizes.items() if r.bytes > 2 * total / parts and r.lo < r.hi]
        if not full or attempt == rounds:
            break
        more = set(bounds)
        sample = _draw(ranged.where(F.col("range").isin(full)), 2 * draws_per_range * parts / total, attempt)
        by_range: dict[int, list[tuple[int, int]]] = {}
        for k, n in sample:
            by_range.setdefault(bisect.bisect_right(bounds, k), []).append((k, n))
        for k, own in by_range.items():
            more.update(_quantiles(own, max(2, round(2 * sizes[k].bytes * parts / total))))
        if more == set(bounds):
            break
        bounds = sorted(more)
    bytes_before, rows_before, b, n = [], [], 0, 0
    for k in range(len(bounds) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        if k in sizes:
            b, n = b + sizes[k].bytes, n + sizes[k].n
    alike = ranged.groupBy("range", "key", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.get(_longs(bytes_before), F.col("range")) + F.sum(F.col("n") * F.col("size")).over(before) - F.col("n") * F.col("size")
    place = F.get(_longs(rows_before), F.col("range")) + F.sum("n").over(before) - F.col("n")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(copies_per_block).cast("long"))).alias("block")
    blocks = alike.select("key", "doc_id", "text_crc32", "size", "n", start.alias("start"), place.alias("place")).select("*", block).repartition("key", "block")
    copy = F.explode(F.sequence("block", F.least(F.col("n"), F.col("block") + copies_per_block) - 1)).alias("copy")
    rows = blocks.select("doc_id", "text_crc32", "size", "start", "place", copy).select("doc_id", "text_crc32", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start"), (F.col("place") + F.col("copy")).alias("place"))
    shard = F.least(F.lit(n_shards - 1), F.floor(F.col("start") * n_shards / F.lit(max(1, total))))
    placed = materialize(rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "place"), "shard-places")
    firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    first = F.get(_longs([firsts.get(s, 0) for s in range(n_shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
