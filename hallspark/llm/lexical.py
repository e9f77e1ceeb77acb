"""Ranked lexical search: an inverted index in shards, searched by best positions."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, alone, broadcast_checked, materialize, small_batches, text_or_empty

#: Byte by byte, since every byte of a non-ASCII character is above 127: A-Z lower-cased, what stands in no term a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "docs long, terms_in long, ids binary, known binary, lengths binary, terms binary, ptr binary, doc binary, tf binary"


def words_of(text: bytes, piece: int = 1 << 20):
    """The terms of a UTF-8 text, in lists for about ``piece`` bytes each, so that a very long text is never held as one list."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1


class _Shard:
    """Documents as they come, until they are emitted as one row of the index."""

    def __init__(self):
        self.terms: defaultdict = defaultdict()
        self.terms.default_factory = self.terms.__len__  # a new term gets the next number
        self.ids, self.lengths, self.codes, self.size = [], [], [], 0

    def add(self, doc: int | None, text: bytes) -> None:
        n = 0
        for words in words_of(text):
            self.codes.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
            n += len(words)
        if n:
            self.ids.append(doc)
            self.lengths.append(n)
            self.size += n

    def row(self) -> pa.RecordBatch:
        docs = len(self.ids)
        codes = np.concatenate(self.codes).astype(np.int64)
        entries, tf = np.unique(codes * docs + np.repeat(np.arange(docs), self.lengths), return_counts=True)
        ptr = np.searchsorted(entries, np.arange(len(self.terms) + 1) * docs)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        blobs = [ids, np.array([i is not None for i in self.ids]), np.array(self.lengths, np.int64), None, ptr.astype(np.int64), (entries % docs).astype(np.int32), tf.astype(np.int32)]
        columns = [pa.array([b" ".join(self.terms) if x is None else x.tobytes()], pa.binary()) for x in blobs]
        return pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([self.size]), *columns], names=[x.split()[0] for x in INDEX.split(", ")])


def _index(shard_terms: int):
    def build(batches):
        shard = _Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shard.add(doc, text)
                if shard.size >= shard_terms:
                    yield shard.row()
                    shard = _Shard()
        if shard.size:
            yield shard.row()

    return build


def build_index(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = 2_000_000) -> DataFrame:
    """An inverted index of all terms of whole texts: a row for each shard of about ``shard_terms`` terms, written.

    A shard holds its documents' ids and lengths, its vocabulary, and for each term the documents with their counts. It is
    built where its documents are read, so nothing is shuffled. A null text has no terms; documents without terms
    stay out. A text longer than a shard makes a shard of its own; its terms are numbered a megabyte at a time. Rows
    with equal or null ids are documents of their own; other columns are ignored. An empty table gives no shards.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    return materialize(rows.mapInArrow(alone(_index(shard_terms)), INDEX), "lexical-index", long_rows=True)


def _item_terms(batches):
    for batch in batches:
        q, terms, counts = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            count: defaultdict = defaultdict(int)
            for words in words_of(text):
                for word in words:
                    count[word] += 1
            q += [item] * len(count)
            terms += count.keys()
            counts += count.values()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["q", "term", "n"])


def _document_counts(batches):
    for batch in batches:
        for terms, ptr in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(terms.split(b" "), pa.binary()), pa.array(np.diff(np.frombuffer(ptr, np.int64)))], names=["term", "df"])


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """Items with their terms as one row: vocabulary and weights, and for each item the numbers and counts of its terms."""
    group = group.sort_values("q", kind="stable")
    code, vocabulary = pd.factorize(group["term"])
    weights = np.zeros(len(vocabulary), np.int64)
    weights[code] = group["w"]
    items, first = np.unique(group["q"].to_numpy(np.int64), return_index=True)
    blobs = {"vocabulary": b" ".join(vocabulary), "weights": weights.tobytes(), "items": items.tobytes(), "first": np.append(first, len(group)).astype(np.int64).tobytes(), "codes": code.astype(np.int64).tobytes(), "counts": group["n"].to_numpy(np.int64).tobytes()}
    return pd.DataFrame({"block": [group["block"].iloc[0]], **{k: [v] for k, v in blobs.items()}})


BLOCK = "block long, vocabulary binary, weights binary, items binary, first binary, codes binary, counts binary"


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


class ImpactLists:
    """The lists of a shard for some terms, each by falling impact, and the same positions by document for direct access."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_codes: int, n_docs: int):
        order = np.lexsort((docs, -impacts, codes))
        self.code, self.doc, self.impact = codes[order], docs[order], impacts[order]
        self.ptr = np.searchsorted(self.code, np.arange(n_codes + 1))
        self.of_doc = np.argsort(self.doc, kind="stable")
        self.doc_ptr = np.searchsorted(self.doc[self.of_doc], np.arange(n_docs + 1))
        self.times = np.zeros(n_codes, np.int64)

    def search(self, codes: np.ndarray, counts: np.ndarray, top, k: int, first: int = 32):
        """Best Position Algorithm. ``top`` is the Top to which the documents' scores are offered.

        Each round accesses the next unseen positions of every list directly; each document found is looked up in all
        lists, where its positions count as seen. A list's best position is the last one up to which all are seen. An
        unseen document lies behind the best position of each list, so its score is at most the sum of the impacts there.
        The search ends when that is strictly below the k-th score (an equal one could still win by its id), or when
        nothing is unseen. Rounds double in length. Returns the number of positions accessed.
        """
        codes, counts = (x[self.ptr[codes] < self.ptr[codes + 1]] for x in (codes, counts))
        best, ends = self.ptr[codes].tolist(), self.ptr[codes + 1].tolist()
        unseen, accessed, ahead = np.ones(len(self.doc), bool), 0, first
        self.times[codes] = counts
        while True:
            next_up = [b + np.flatnonzero(unseen[b : min(b + ahead, e)]) for b, e in zip(best, ends, strict=True) if b < e]
            if not next_up:
                break
            found = np.unique(self.doc[np.concatenate(next_up)])
            starts, stops = self.doc_ptr[found], self.doc_ptr[found + 1]
            positions = self.of_doc[ranges(starts, stops)]
            scores = np.add.reduceat(self.impact[positions] * self.times[self.code[positions]], np.append(0, np.cumsum(stops - starts)[:-1]))
            unseen[positions] = False
            accessed += len(positions)
            top.offer(found, scores)
            bound = 0
            for j, (b, e) in enumerate(zip(best, ends, strict=True)):
                if b < e:
                    step = int(unseen[b:e].argmax())
                    best[j] = b = b + step if unseen[b + step] else e
                    bound += int(counts[j] * self.impact[b - 1]) if b < e else 0
            if len(top.scores) == k and bound < top.scores[-1]:
                break
            ahead *= 2
        self.times[codes] = 0
        return accessed


class Top:
    """The k best documents of an item so far, over the shards of a task: by falling score, then by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.known, self.ids = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        self.shard: tuple = ()

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= (self.scores[-1] if len(self.scores) == self.k else 1)
        if good.any():
            ids, known = self.shard
            scores, known, ids = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.known, known[docs[good]]), (self.ids, ids[docs[good]])))
            order = np.lexsort((ids, ~known, -scores))[: self.k]
            self.scores, self.known, self.ids = scores[order], known[order], ids[order]


def _search(k: int, n_docs: int, n_terms: int):
    def search(batches):
        tops: dict[int, Top] = {}
        for batch in batches:
            for row in batch.to_pylist():
                as_long = {c: np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "ptr", "weights", "items", "first", "codes", "counts")}
                number = {t: j for j, t in enumerate(row["vocabulary"].split(b" "))}
                here = [(j, number[t]) for j, t in enumerate(row["terms"].split(b" ")) if t in number]
                if not here:
                    continue
                local, code = np.array(here, np.int64).T
                starts, stops = as_long["ptr"][local], as_long["ptr"][local + 1]
                entries, codes = ranges(starts, stops), np.repeat(code, stops - starts)
                doc, tf = np.frombuffer(row["doc"], np.int32)[entries], np.frombuffer(row["tf"], np.int32)[entries].astype(np.int64)
                m = 100 - 25 + 25 * as_long["lengths"] * n_docs // n_terms
                impacts = as_long["weights"][codes] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                lists = ImpactLists(codes, doc, impacts, len(number), len(m))
                shard = as_long["ids"], np.frombuffer(row["known"], bool)
                for q, a, b in zip(as_long["items"].tolist(), as_long["first"], as_long["first"][1:], strict=False):
                    top = tops.setdefault(q, Top(k))
                    top.shard = shard
                    lists.search(as_long["codes"][a:b], as_long["counts"][a:b], top, k)
                    top.shard = ()
        for q, top in tops.items():
            ids = pa.array(top.ids, mask=~top.known) if len(top.ids) else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), ids, pa.array(top.scores)], names=["q", "doc_id", "score"])

    return search


def search(index: DataFrame, items: DataFrame, *, k: int = 20, item_col: str = "item_id", text_col: str = "text", block_items: int = 256) -> DataFrame:
    """The ``k`` best documents of ``index`` for each item, exactly: item_id, rank, doc_id, score.

    Weights come from document counts of the items' terms over all shards. Items are packed into blocks of about
    ``block_items``, which meet every shard; as many blocks as may be broadcast go in one pass over the index. A task
    searches its shards one after another (see :meth:`ImpactLists.search`) and keeps k documents an item, so an earlier
    shard's k-th score also ends the search of a later one. The tasks' documents are ranked together.

    Scores are 64-bit integers; equal ones rank by ascending id, null ids last. Only scores above 0 count, so items
    without terms, or whose terms no document holds, have no rows. Items with equal or null ids are items of their own.
    Documents that repeat are ranked each by itself. Empty tables give an empty result.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("docs").alias("docs"), F.sum("terms_in").alias("terms")).first()
    given = materialize(items.select(F.col(item_col).alias("item_id"), text_or_empty(text_col).alias("text")).withColumn("q", F.monotonically_increasing_id()), "items")
    terms = materialize(given.select("q", "text").mapInArrow(alone(_item_terms), "q long, term binary, n long"), "item-terms")
    wanted = broadcast_checked(materialize(terms.select("term").distinct(), "wanted"), F.length("term") + 16)
    counts = index.select("terms", "ptr").mapInArrow(alone(_document_counts), "term binary, df long").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    with small_batches(spark, 4):  # a row of the index has megabytes
        counts = materialize(counts.withColumn("w", F.floor(1000 * F.log((F.lit(2 * (total["docs"] or 0) + 2)) / (2 * F.col("df") + 1))).cast("long")), "document-counts")
    n_blocks = max(1, -(-given.count() // block_items))
    weighted = terms.join(broadcast_checked(counts.select("term", "w").where("w > 0"), F.length("term") + 24), "term").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)))
    blocks = materialize(weighted.select("block", "q", "term", "n", "w").groupBy("block").applyInPandas(_block, BLOCK), "item-blocks")
    largest = blocks.agg(F.max(sum(F.length(c) for c in blocks.columns[1:]))).first()[0] or 1
    at_once, found = max(1, BROADCAST_BYTES // largest), []
    for first in range(0, n_blocks, at_once):
        last = min(first + at_once, n_blocks) - 1
        cells = index.withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        cells = cells.join(F.broadcast(blocks.where(F.col("block").between(first, last))), "block").drop("block", "docs", "terms_in")
        with small_batches(spark, 1):
            found.append(materialize(cells.mapInArrow(alone(_search(k, total["docs"] or 0, total["terms"] or 1)), "q long, doc_id long, score long"), "found"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(given.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
