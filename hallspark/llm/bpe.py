"""Byte-level BPE by a rank queue on a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker

BITS = 256
#: Texts in which two of these meet, or that hold other blanks, are split by the pattern itself.
MEETING = ("  ", "\n\n", " \n", "\n ")
OTHER_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def odd_blanks(text: str) -> bool:
    if any(map(text.__contains__, MEETING)) or any(map(text.__contains__, OTHER_ASCII)):
        return True
    return not text.isascii() and OTHER_BLANKS.search(text) is not None


class RankQueue:
    """Positions by merge rank. A bitmap marks the ranks with positions, a second one the words of the first that have bits, so the least rank is two find-first-set operations."""

    def __init__(self, ranks: int):
        self.words, self.top, self.buckets = [0] * (ranks // BITS + 1), 0, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank // BITS
            self.words[word] |= 1 << rank % BITS
            self.top |= 1 << word
        else:
            bucket.append(position)

    def pop_bucket(self) -> tuple[int, list[int]]:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits ^ low
        if bits == low:
            self.top &= self.top - 1
        rank = word * BITS + low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class _PairTable:
    """All pairs of ids that may merge, sorted for lookups of whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.found = np.array(keys, np.int64)[order], np.array(found, np.int64)[order]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], -1)


class _Pairs(dict):
    """The rank of two ids' join, -1 if there is none, by ``first << 32 | second``; filled on demand, emptied when it is large."""

    def __init__(self, ranks: dict[bytes, int], bytes_of: list[bytes], most: int = 1_000_000):
        self.ranks, self.bytes_of, self.most = ranks, bytes_of, most

    def __missing__(self, pair: int) -> int:
        if len(self) >= self.most:
            self.clear()
        rank = self[pair] = self.ranks.get(self.bytes_of[pair >> 32] + self.bytes_of[pair & 0xFFFFFFFF], -1)
        return rank


class ByteBPE:
    """Encodes like the public libraries do with the same ranks and pattern."""

    def __init__(self, path: str, pattern: str, cache: int = 800_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = _Pairs(self.ranks, self.bytes_of)
        self.queue, self.table = RankQueue(len(self.bytes_of)), None
        self.pattern, self.most = regex.compile(pattern), cache
        self.young, self.old, self.units = {}, {}, {}

    def merge(self, token: bytes) -> list[int]:
        """Merge a pre-token's bytes: always the least rank, leftmost first. O(n) list work, whatever its length."""
        single, pairs, queue = self.single, self.pairs, self.queue
        ids = [single[b] for b in token]
        n = len(ids)
        last = ids[0]
        for k in range(1, n):
            now = ids[k]
            rank = pairs[last << 32 | now]
            if rank >= 0:
                queue.push(rank, k - 1)
            last = now
        if not queue.top:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue.top:
            rank, positions = queue.pop_bucket()
            if len(positions) > 1:
                positions.sort()
            for k in positions:
                right = after[k]
                if right >= n or ids[k] < 0 or pairs[ids[k] << 32 | ids[right]] != rank:
                    continue  # stale: a neighbour has merged meanwhile
                ids[k], ids[right] = rank, -1
                far = after[k] = after[right]
                if far < n:
                    before[far] = k
                    new = pairs[rank << 32 | ids[far]]
                    if new >= 0:
                        queue.push(new, k)
                near = before[k]
                if near >= 0:
                    new = pairs[ids[near] << 32 | rank]
                    if new >= 0:
                        queue.push(new, near)
        return [x for x in ids if x >= 0]

    def merge_many(self, tokens: list[bytes]) -> list[list[int]]:
        """Merge many pre-tokens in one queue: they lie in one linked list between stops that merge with nothing, and a bucket's positions merge as one array. No pre-token sees another, as the least rank of all is each owner's least."""
        if self.table is None:
            self.table = _PairTable(self.ranks)
        table, queue = self.table, self.queue
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        n = int(lengths.sum()) + len(tokens) + 1
        ids = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[np.concatenate([[0], np.cumsum(lengths + 1)])] = False
        ids[inside] = np.array(self.single, np.int64)[np.frombuffer(b"".join(tokens), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)

        def push(ranks, positions):
            ok = ranks >= 0
            ranks, positions = ranks[ok], positions[ok]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            if len(ranks):
                starts = [0, *cuts.tolist()]
                for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                    queue.push(rank, positions[a:b])

        push(table.ranks_of(ids[:-1], ids[1:]), np.arange(n - 1))
        while queue.top:
            rank, parts = queue.pop_bucket()
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            left, right = ids[at], after[at]
            good = (left >= 0) & (table.ranks_of(left, ids[right]) == rank)  # the others are stale
            if (twin := good & (left == ids[right])).any():  # in a run of one id, pairs overlap: the leftmost goes first
                taken = -1
                for k in np.flatnonzero(twin).tolist():
                    if at[k] == taken:
                        good[k] = False
                    else:
                        taken = right[k]
            at, right = at[good], right[good]
            if not len(at):
                continue
            far = after[right]
            ids[at], ids[right] = rank, -2
            after[at], before[far] = far, at
            near = before[at]
            same = np.full(len(at), rank)
            push(np.concatenate([table.ranks_of(same, ids[far]), table.ranks_of(ids[near], same)]), np.concatenate([at, near]))
        left = ids[ids >= -1]
        return [part[1:].tolist() for part in np.split(left[:-1], np.flatnonzero(left[:-1] < 0)[1:])]

    def _keep(self, piece: str, ids: list[int]) -> None:
        if len(self.young) >= self.most // 4:
            self.old, self.young = self.young, {}
        self.young[piece] = ids

    def token(self, piece: str) -> list[int]:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                data = piece.encode()
                rank = self.ranks.get(data)
                ids = [rank] if rank is not None else self.merge(data)
            if len(piece) <= 64:
                self._keep(piece, ids)
        return ids

    def _split(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.token(piece)
        return out

    @staticmethod
    def _units(text: str) -> list[str] | None:
        """Where no blanks meet, the pattern never matches across the place before a space or a newline, so the parts between those are encoded apart and remembered."""
        return None if odd_blanks(text) else text.replace("\n", " \n").split(" ")

    def prepare(self, texts: list[str], least: int = 30_000) -> None:
        """Remember the units of some texts, a batch at most; new pre-tokens merge together if they are many."""
        every: set[str] = set()
        for text in texts:
            if units := self._units(text):
                every.update(units[1:])
        if len(self.units) + len(every) > self.most:  # what this batch needs stays
            self.units = {u: self.units[u] for u in every & self.units.keys()}
        split = {u: self.pattern.findall(u if u[:1] == "\n" else " " + u) for u in every - self.units.keys() if len(u) <= 64}
        pieces = list({p for found in split.values() for p in found} - self.young.keys() - self.old.keys())
        if len(pieces) >= least:
            done = dict(zip(pieces, self.merge_many([p.encode() for p in pieces]), strict=True))
        else:
            done = {}
        for unit, found in split.items():
            self.units[unit] = tuple(chain.from_iterable([done.get(p) or self.token(p) for p in found]))

    def encode(self, text: str) -> list[int]:
        parts = self._units(text)
        if parts is None:
            return self._split(text)
        first, *rest = parts
        out = self._split(first) if first or not rest else []
        known = self.units
        try:
            out.extend(chain.from_iterable(map(known.__getitem__, rest)))
        except KeyError:  # a long unit, or one that prepare() has not seen
            out = self._split(first) if first or not rest else []
            for unit in rest:
                out += known[unit] if unit in known else self._split(unit if unit[:1] == "\n" else " " + unit)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode their ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    A null or empty text has no ids. Repeated rows give a row each; an empty table an empty result; other columns are
    ignored. ``ranks``: the path of a rank file that every executor can read.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        bpe = kept_in_worker(("bytes", ranks, pattern), lambda: ByteBPE(ranks, pattern))
        decimal = [str(k) for k in range(len(bpe.bytes_of))]
        for batch in batches:
            counts, digests, back, all_ids = [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bpe.prepare(texts)
            for text in texts:
                ids = bpe.encode(text)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns, names = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
