"""Quality rules with host-level verdicts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, broadcast_checked, materialize

ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() would also cut at, though it belongs to words here.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (each[k : k + n] ^ (each[k : k + n] >> np.uint64(29)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def metrics(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measure(batches):
    for batch in batches:
        found = [metrics(t) for t in batch.column(3).to_pylist()]
        columns = [pa.array([m[k] for m in found], pa.int64()) for k in range(6)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "text_hash", "host", *(c.split()[0] for c in METRICS.split(", "))])


def fitted_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior of the hosts' failure rates by moments: the common rate, and the variance between hosts beyond what chance gives hosts of their sizes. Its strength is 2 documents at least and 1000 at most."""
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.sum("host_failed").alias("failed"), F.sum("host_docs").alias("docs"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("noise")).first()
    mean = min(max((m.failed or 0) / max(m.docs or 0, 1), 1e-6), 1 - 1e-6)
    between = max((m.var or 0.0) - mean * (1 - mean) * (m.noise or 0.0), mean * (1 - mean) / 1001)
    strength = max(mean * (1 - mean) / between - 1, 2.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(hosts: DataFrame, *, least_limit: float = 0.5, certainty: float = 2.0) -> DataFrame:
    """Hosts (host, host_docs, host_failed) with host_rate, the shrunk rate, and host_kept, the verdict.

    The rate of a host has the posterior Beta(a + failed, b + docs - failed). The limit comes from the prior: one of its
    standard deviations above the common rate, but not below ``least_limit``, as a host most of whose documents are
    sound is worth keeping. A host is rejected if its posterior mean lies more than ``certainty`` posterior standard
    deviations above the limit.
    """
    a, b = fitted_prior(hosts)
    limit = max(least_limit, a / (a + b) + (a * b / (a + b + 1)) ** 0.5 / (a + b))
    total = F.col("host_docs") + F.lit(a + b)
    rate = (F.col("host_failed") + F.lit(a)) / total
    deviation = F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", rate - certainty * deviation <= limit)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_limit: float = 0.5, certainty: float = 2.0) -> DataFrame:
    """Rule metrics of every document, and verdicts of their hosts (:func:`host_verdicts`).

    Failures of the rules (too short, repeated windows, symbols, repeated lines) are counted by host. Beta(a, b) is
    fitted to the hosts' rates by moments, which shrinks the rate of a host with few documents to the common one. A
    rejected host goes with all its documents; a document that fails the base rules is rejected anyhow. A host is never
    gathered: its counts are summed before the shuffle, and the verdicts join back by broadcast if their measured size
    permits, else by a join whose hot keys adaptive execution splits.

    A null text has no words and fails. Documents without a host share the host null. Repeated rows count as often as
    they occur. A very long text is measured whole, in the memory of one task. Null ids stay. An empty table gives an
    empty result. Other columns are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]
    measured = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    measured = measured.mapInArrow(alone(_measure), f"doc_id {id_type}, text_hash long, host string, {METRICS}")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    scored = materialize(measured.withColumn("base_failed", base).withColumn("any_failed", base | soft), "quality-rows")
    hosts = materialize(scored.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("any_failed").alias("host_failed")), "quality-hosts")
    verdicts = host_verdicts(hosts, least_limit=least_limit, certainty=certainty).select(F.col("host").alias("verdict_host"), "host_rate", "host_kept")
    joined = scored.join(broadcast_checked(verdicts, 64), F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host_rate", "host_kept", "text_hash")
