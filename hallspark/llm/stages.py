"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), and all but the last return the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, linededup, packing, quality, toxicity
from .common import broadcast_checked, materialize, small_batches
from .queries import table, tokenizer


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the columns'."""
    taken = {k.lower() for k in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _matched(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with (left_semi) or without (left_anti) a row of ``decided`` for their id and text. Nulls match nulls; no column of ``docs`` clashes."""
    d, t = _fresh(docs, "decided_id"), _fresh(docs, "decided_text")
    keys = decided.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t))
    return docs.join(broadcast_checked(keys, 24), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), how)


def _keys(decided: DataFrame) -> DataFrame:
    return materialize(decided.select("doc_id", "text_hash").distinct(), "decided", long_rows=True)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose host is rejected go, null and empty texts with them; rows with equal ids and texts share a verdict. Long texts are measured whole. An empty table stays empty. All columns come back, whatever their names."""
    return _matched(docs, _keys(quality.quality_rules(docs).where("not kept")), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the scorer is fitted on these documents and the table of labels. Null and empty texts have no toxic words and stay, as do rows with null ids that aren't toxic; equal rows share a verdict. Long texts are scored whole. An empty table stays empty. All columns come back, whatever their names."""
    with small_batches(spark):  # it fits its models at once
        return _matched(docs, _keys(toxicity.toxicity(docs, table(spark, sf_dir, "labels"), remembered=100_000).where("predicted = 1")), "left_anti")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which they leave no word is a copy throughout and goes with them. ``n_chars``, where there is one, is counted anew. Null texts and texts without words have no lines to lose and stay; equal rows keep the same lines; a null id is the earliest. An empty table stays empty. All columns come back, also ones named as the operator's own counts."""
    own = {k: _fresh(docs, "given_" + k) for k in docs.columns if k.lower() in ("n_lines", "n_removed_lines")}
    out = linededup.dedup_lines(docs.withColumnsRenamed(own), least_chars=16)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = out.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.drop("n_lines", "n_removed_lines").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least doc_id; of rows that repeat it, one. Texts without words (null, empty) link with nothing and stay, repeated or not. Long texts are compared whole. An empty table stays empty. All columns come back, whatever their names."""
    classes = materialize(jaccard.jaccard_classes(docs).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"), F.max("n_links").alias("links")), "kept")
    out = _matched(docs, _keys(classes.where("not kept")), "left_anti")
    repeated = classes.where("kept and n > 1 and links > 0")
    if repeated.limit(1).count():
        keys = _keys(repeated)
        out = _matched(out, keys, "left_anti").unionByName(_matched(out, keys, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places, as ``op2`` returns them. A null or empty text is one piece of a single token; equal rows are packed each by itself; long texts are cut into pieces. An empty table gives no pieces. Other columns are ignored. Encoders are small, as four stages have been in the executors before."""
    return packing.pack(packing.token_pieces(docs, tokenizer("word_bpe_49k.json"), chars=1 << 19, remembered=150_000)).select(*packing.PIECE, "sequence_id", "offset")


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("ngram_jaccard_join", jaccard_stage), ("best_fit_packing", packing_stage)]
