"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from itertools import chain, islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, materialize

if TYPE_CHECKING:  # workers that encode do without it
    import pandas as pd

END = 0
#: Blanks of str.split() that the tokenizer keeps in its words.
KEPT_BLANKS = re.compile(r"[\x1c-\x1f]")
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class _Numbered(dict):
    """A number for each part, in order of appearance."""

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        return number


class WordEncoder:
    """Ids of a tokenizer that drops blanks, remembered by blank-separated part (its words never cross a blank)."""

    def __init__(self, path: str, cache: int = 150_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words of lower-case letters need no normal form and no pattern: many are encoded as one text, each ending in its only id with a word's end
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.most = cache
        self._start([""], np.array([END], "<u4"), np.array([1]), np.array([0]))

    def _start(self, parts: list[str], flat: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        """Part k has the ``lengths[k]`` ids from ``starts[k]`` in ``flat``; part 0 is the end of a text."""
        self.numbers = _Numbered(zip(parts, range(len(parts)), strict=True))
        self.flat, self.lengths, self.starts, self.uses = flat, lengths, np.cumsum(lengths) - lengths, uses

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - lengths), lengths)]

    def _forget(self) -> None:
        """Keep the more used half of the parts."""
        kept = np.union1d([0], np.argsort(-self.uses, kind="stable")[: self.most // 2])
        parts = list(self.numbers)
        self._start([parts[k] for k in kept.tolist()], self._gathered(kept), self.lengths[kept], self.uses[kept])

    def _learn(self) -> None:
        """Find the ids of the parts that were numbered since the last time: of words, of others, then of words with marks after them."""
        known = len(self.lengths)
        cores, tails, composed, words, others = [], [], [], [], []
        for number, part in enumerate(list(islice(self.numbers, known, None)), known):
            core = part.rstrip(string.punctuation)
            if len(core) < len(part) and core.isalpha():  # the pattern cuts between letters and marks
                composed.append(number)
                cores.append(self.numbers[core])
                tails.append(self.numbers[part[len(core) :]])
            else:
                (words if part.isalpha() else others).append((number, part))
        for number, part in islice(enumerate(self.numbers), known + len(composed) + len(words) + len(others), None):
            (words if part.isalpha() else others).append((number, part))
        new, ids, lengths = [number for number, _ in chain(words, others)], [], []
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            ids.append(np.array(self.of_words.encode_batch_fast([" ".join(part for _, part in some)], add_special_tokens=False)[0].ids, "<u4"))
            own = np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1)
            if len(own) != len(some) or own.sum() != len(ids[-1]):
                raise ValueError("a word of the tokenizer does not end where its letters do")
            lengths.append(own)
        for k in range(0, len(others), 4096):
            found = [np.array(own.ids, "<u4") for own in self.tokenizer.encode_batch_fast([part for _, part in others[k : k + 4096]], add_special_tokens=False)]
            ids += found
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        self._add(np.array(new, np.int64), ids, np.concatenate([np.zeros(0, np.int64), *lengths]))
        both = np.column_stack([np.array(cores, np.int64), np.array(tails, np.int64)])
        self._add(np.array(composed, np.int64), [self._gathered(both.ravel())], self.lengths[both].sum(axis=1))

    def _add(self, numbers: np.ndarray, ids: list[np.ndarray], lengths: np.ndarray) -> None:
        """Take up the ids of the parts with these numbers, one after the other."""
        more = [np.zeros(max(0, len(self.numbers) - len(self.lengths)), np.int64)]
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.lengths, self.starts, self.uses = (np.concatenate([old, *more]) for old in (self.lengths, self.starts, self.uses))
        self.lengths[numbers], self.starts[numbers] = lengths, starts
        self.flat = np.concatenate([self.flat, *ids])

    def _parts(self, text: str) -> list[str] | None:
        """Lower-cased parts; none where lower case or normal form might depend on more than the part, or the text holds a special token."""
        if KEPT_BLANKS.search(text) or ("<|" in text and any(map(text.__contains__, self.specials))):
            return None
        if not text.isascii():
            if "\N{GREEK CAPITAL LETTER SIGMA}" in text or not unicodedata.is_normalized("NFC", text):
                return None
            lower = text.lower()
            return lower.split() if unicodedata.is_normalized("NFC", lower) else None
        return text.lower().split()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end's id after them."""
        if len(self.numbers) > self.most:
            self._forget()
        numbered, get = [], self.numbers.__getitem__
        for text in texts:
            parts = self._parts(text)
            numbered.append(None if parts is None else np.fromiter(chain(map(get, parts), (0,)), np.int32, len(parts) + 1))
        if len(self.numbers) > len(self.lengths):
            self._learn()
        own = [n for n in numbered if n is not None]
        every = np.concatenate(own) if own else np.zeros(0, np.int32)
        self.uses += np.bincount(every, minlength=len(self.uses))
        flat, out, at = self._gathered(every), [], 0
        for text, mine in zip(texts, numbered, strict=True):
            if mine is None:
                out.append(np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], "<u4"))
            else:
                length = int(self.lengths[mine].sum())
                out.append(flat[at : at + length])
                at += length
        return out


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", chars: int = 2 << 20, remembered: int = 300_000) -> DataFrame:
    """Tokenize whole texts, end each with id 0, and cut those longer than ``capacity``: doc_id, piece, start, length, ids_crc32.

    ``tokenizer`` is the path of a tokenizer file that every executor can read; its special tokens count where a text
    holds their strings. A null text is empty: its one piece is the end. A null id stays null; repeated rows give their
    pieces again; a very long text is encoded whole and alone. An empty table gives an empty result. Other columns are
    ignored.

    A worker encodes ``chars`` characters at a time and remembers the ids of at most ``remembered`` parts: less of either
    needs less memory and more time, with the same result.
    """
    kind = dict(docs.dtypes)[id_col]

    def pieces(batches):
        encoder = kept_in_worker(("words", tokenizer, remembered), lambda: WordEncoder(tokenizer, remembered))
        for batch in batches:
            keys, given = batch.column(0), batch.column(1)
            sizes, done = pc.fill_null(pc.binary_length(given), 0).to_numpy(zero_copy_only=False), 0
            while done < len(sizes):
                upto = done + max(1, int(np.searchsorted(np.cumsum(sizes[done:]), chars, "right")))
                at, rows = [], []
                for k, ids in enumerate(encoder.encode_many([t or "" for t in given.slice(done, upto - done).to_pylist()]), done):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        at.append(k)
                        rows.append((piece, start, len(part), zlib.crc32(part)))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], names=PIECE)
                done = upto

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Best fit, largest first: the bin of each size. A bitmap of the residuals in use finds the tightest bin in one step."""
    bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, opened, bin_of = 0, 0, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        fitting = in_use >> size
        if fitting:
            residual = size + (fitting & -fitting).bit_length() - 1
            stack = bins_at[residual]
            where = stack.pop()
            if not stack:
                in_use ^= 1 << residual
        else:
            residual, where = capacity, opened
            opened += 1
        bin_of[k] = where
        left = residual - size
        bins_at[left].append(where)
        if left:
            in_use |= 1 << left
    return bin_of


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        """Items (item, used, members) of a group into bins of the same form; a member is (item, offset), and a piece its own only one."""
        import pandas as pd

        used, items, members = group["used"].tolist(), group["item"].tolist(), group["members"].tolist()
        level, salt = group["level"].iloc[0], group["salt"].iloc[0]
        held: dict[int, list[int]] = {}
        for k, where in enumerate(best_fit(used, capacity)):
            held.setdefault(where, []).append(k)
        rows = []
        for own in held.values():
            parts, at = [], 0
            for k in own:
                part = np.array([[items[k], 0]], np.int64) if members[k] is None else np.frombuffer(members[k], np.int64).reshape(-1, 2).copy()
                part[:, 1] += at
                parts.append(part)
                at += used[k]
            rows.append((level, salt, items[own[0]], at, b"".join(p.tobytes() for p in parts)))
        return pd.DataFrame(rows, columns=["level", "salt", "item", "used", "members"])

    return pack


def pack(pieces: DataFrame, *, capacity: int = 2048, group_items: int = 30_000, nearly_full: float = 0.995, least_gain: float = 0.002) -> DataFrame:
    """Pack pieces (length <= ``capacity`` and other columns) into few sequences: the same rows with sequence_id, offset.

    Full pieces are sequences. The rest is dealt at random into groups of about ``group_items``, each packed best-fit,
    largest first. Bins filled to ``nearly_full`` are emitted; the others become items of the next round, in as many
    fewer groups as items are left, until one group is left or a round saves less than ``least_gain`` of its
    bins. A bin has at most ``capacity`` members, and a group never grows with the input.

    Every piece keeps its own row and place, repeated rows too. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    numbered = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces", long_rows=True)
    schema = "level int, salt long, item long, used long, members binary"
    rest = numbered.where(F.col("length") < capacity).select("item", F.col("length").alias("used"), F.lit(None).cast("binary").alias("members"))
    n, level, closed = rest.count(), 0, []
    while n:
        groups = -(-n // group_items)
        key = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups))
        dealt = rest.select(F.lit(level).alias("level"), key.alias("salt"), "item", "used", "members")
        packed = materialize(dealt.groupBy("salt").applyInPandas(_packer(capacity), schema), f"bins-{level}")
        bins = packed.agg(F.count("*"), F.count_if(F.col("used") >= nearly_full * capacity)).first()
        if groups == 1 or (level and bins[0] > n * (1 - least_gain)):
            closed.append(packed)
            break
        closed.append(packed.where(F.col("used") >= nearly_full * capacity))
        rest, n, level = packed.where(F.col("used") < nearly_full * capacity), bins[0] - bins[1], level + 1
    placed = numbered.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for packed in closed:
        placed = placed.unionByName(packed.select(F.col("item").alias("sequence_id"), "members").mapInArrow(_members, "item long, sequence_id long, offset long"))
    return numbered.join(placed, "item").drop("item")


def _members(batches):
    for batch in batches:
        parts = [np.frombuffer(m, np.int64).reshape(-1, 2) for m in batch.column(1).to_pylist()]
        if parts:
            sequences = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
            both = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(sequences), pa.array(both[:, 1])], names=["item", "sequence_id", "offset"])
