"""Toxicity scores of deobfuscated text."""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, materialize, text_or_empty

#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h"}
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçàâîôûñáíóú"
#: Costs of the channel, as natural logarithms.
SUBSTITUTED, COLLAPSED, DOUBLED, DROPPED, NOTHING = -1.0, -0.3, -1.2, -0.2, -8.0
#: A separator may end a word (a gain, as trigrams favour long words: neighbours are joined again, see separate_words). One wider than the narrowest of its part does so unless the letters speak against it.
BOUNDARY, JOINED = 1.0, -3.0
#: Long parts are decoded in pieces of so many runs; so many choices before the end stay open.
PIECE, LAG = 256, 48
SEPARATORS = string.punctuation
_code = np.zeros(0x3000, np.uint8)
for _k, _c in enumerate(LETTERS, 1):
    _code[ord(_c)] = _code[ord(_c.upper() if len(_c.upper()) == 1 else _c)] = _k
SIZE = len(LETTERS) + 1
CODE = {c: k for k, c in enumerate(LETTERS, 1)}

_SYMBOLS = re.escape("".join(c for c in LEET if not c.isdigit()))
_UNIT = rf"(?:[^\W_]|[{_SYMBOLS}])"
LEETED = re.compile(rf"[0-9{_SYMBOLS}]")
LEET_ONLY = re.compile(rf"[0-9{_SYMBOLS}]+")
REPEATED = re.compile(r"([^\W\d_])\1")
STRETCHED = re.compile(r"([^\W\d_])\1\1|(?:([^\W\d_])\2){3}")
SEPARATED = re.compile(rf"{_UNIT}(?:[{re.escape(SEPARATORS)}]+{_UNIT}){{2}}")
SPACED = re.compile(rf"(?<![^\s(\"']){_UNIT}(?:\s+{_UNIT}(?=[.,;:?!\"')]*(?:\s|$))){{2,}}")
WORDS = re.compile(r"[^\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text; everything else is a blank, and blanks in a row are one."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _code[np.where(codes < len(_code), codes, 0)].astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]
    return (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:] if len(codes) > 2 else codes[:0]


def _counted(batches):
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += np.bincount(trigrams(text), minlength=SIZE**3) if len(text) > 20_000 else 0
            if len(text) <= 20_000:
                np.add.at(total, trigrams(text), 1)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two others, from all texts. Its size is fixed by the alphabet; tasks send sums."""
    counts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(alone(_counted), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(SIZE**3)
    for r in counts.collect():
        table[r.gram] = r.n
    table = table.reshape(SIZE, SIZE, SIZE)
    pair, one = table.sum(axis=0), table.sum(axis=(0, 1))
    one = (one + 1) / (one.sum() + SIZE)
    after = (pair + 20 * one) / (pair.sum(axis=1, keepdims=True) + 20)
    return np.log((table + 10 * after[None]) / (table.sum(axis=2, keepdims=True) + 10)).astype(np.float32)


class Decoder:
    """Viterbi decoding of one obfuscated part over a lattice of runs of equal characters."""

    def __init__(self, model: np.ndarray, cache: int = 250_000):
        self.model, self.most, self.known, self.read, self._flat, self._letters = model, cache, {}, {}, [], {}

    @staticmethod
    def _choices(char: str, run: int, marks: set[str], width: int, beside: str = "") -> list[tuple[tuple[int, ...], float]]:
        """What a run of one character may stand for: code sequences with their costs. ``marks`` are the part's separators and ``width`` is the length of the narrowest; ``beside`` are the neighbouring characters; code 0 ends a word."""
        own = CODE.get(char)
        out: list[tuple[tuple[int, ...], float]] = []
        if char in marks:
            out = [((), DROPPED if run <= width else JOINED), ((0,), BOUNDARY)]
            if char not in LEET:
                return out
        for code, cost in ([(own, 0.0)] if own else []) + [(CODE[c], SUBSTITUTED) for c in LEET.get(char, "")]:
            out.append(((code,), cost + (COLLAPSED if run > 2 else DOUBLED if run == 2 else 0.0)))
            if run >= 2:
                out.append(((code, code), cost + (DOUBLED if run > 2 else 0.0)))
        if not out:
            out.append(((), DROPPED))
        elif char in LEET and char not in marks:  # it may repeat its neighbour, or stand for nothing
            out.append(((), SUBSTITUTED if any(c in beside for c in LEET[char]) else NOTHING))
        return out

    @staticmethod
    def _settled(states: dict, lag: int) -> tuple[dict, list[tuple[int, ...]]]:
        """The choices of the best state but its last ``lag``, and the states that agree with them, carried on from there."""
        path, last = max(states.values(), key=lambda v: v[0])[1], []
        while path and len(last) < lag:
            last.append(path)
            path = path[0]
        fixed, cut = [], path
        while path:
            path, choice = path
            fixed.append(choice)
        carried = {}
        for key, (score, path) in states.items():
            own = []
            while path and path is not cut:
                path, choice = path
                own.append(choice)
            if path is cut:
                new: tuple = ()
                for choice in reversed(own):
                    new = new, choice
                carried[key] = score, new
        return carried, fixed[::-1]

    def decode(self, part: str) -> str:
        """The likeliest letters, with a blank where separated letters end a word; the part itself if it has none."""
        part = part.lower()
        if part in self.known:
            return self.known[part]
        if len(self.known) >= self.most:
            self.known.clear()
        runs, k = [], 0
        while k < len(part):
            end = k + 1
            while end < len(part) and (part[end] == part[k] or part[end].isspace() and part[k].isspace()):
                end += 1
            runs.append((part[k], end - k))
            k = end
        blank = {c for c, _ in runs if c.isspace()}
        marks = blank | {c for c, _ in runs if c in SEPARATORS and c not in LEET}
        if not marks and SEPARATED.search(part):
            marks = {c for c, _ in runs if c in SEPARATORS}
        width = min((n for c, n in runs if c in (blank or marks)), default=0)
        if not self._flat:  # in the worker: numbers of a list are read faster than those of an array
            self._flat = self.model.ravel().tolist()
        flat, letters, pairs = self._flat, self._letters, SIZE * SIZE
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by the two codes before
        new: dict[int, tuple[float, tuple]]
        chosen: list[tuple[int, ...]] = []
        for at, (char, run) in enumerate(runs, 1):
            if run == 1 and char in CODE:  # a letter that stands for itself
                code, choice = CODE[char], (CODE[char],)
                new = {}
                for key, (score, path) in states.items():
                    key = key * SIZE + code  # noqa: PLW2901
                    total = score + flat[key]
                    key %= pairs  # noqa: PLW2901
                    if key not in new or new[key][0] < total:
                        new[key] = total, (path, choice)
                states = new
                if at % PIECE == 0:
                    states, fixed = self._settled(states, LAG)
                    chosen += fixed
                continue
            if char in marks or char in LEET:
                beside = "".join(c for c, _ in (*runs[max(at - 2, 0) : at - 1], *runs[at : at + 1]))
                choices = self._choices(char, run, marks, width, beside)
            else:
                own = (char, min(run, 3))
                choices = letters.get(own) or letters.setdefault(own, self._choices(*own, marks, width))
            new = {}
            for choice, cost in choices:
                for key, (score, path) in states.items():
                    total = score + cost
                    for code in choice:
                        key = key * SIZE + code  # noqa: PLW2901
                        total += flat[key]
                        key %= pairs  # noqa: PLW2901
                    if key not in new or new[key][0] < total:
                        new[key] = total, (path, choice) if choice else path
            states = new
            if at % PIECE == 0:
                states, fixed = self._settled(states, LAG)
                chosen += fixed
        path = max(((s + flat[key * SIZE], p) for key, (s, p) in states.items()), key=lambda v: v[0])[1]
        rest = []
        while path:
            path, choice = path
            rest.append(choice)
        best = "".join(LETTERS[c - 1] if c else " " for choice in chosen + rest[::-1] for c in choice).strip() or part
        if len(part) <= 400:
            self.known[part] = best
        return best


def separate_words(decoded: str) -> list[str]:
    """The words of a decoded part, and those that two to four neighbours make: the letters alone do not always tell where a word ends."""
    own = decoded.split()
    return ["".join(own[k : k + n]) for n in range(1, 5) for k in range(len(own) - n + 1)]


def restored(text: str, decoder: Decoder) -> tuple[set[str], int]:
    """The distinct lower-cased words of a text after deobfuscation, and how many parts were obfuscated.

    Only parts that show leetspeak, separated letters or repetition have a lattice of more than one path; other words stand for themselves.
    Ordinary numbers, doubled letters and marks at the end of a word may have another reading too, but do not count as obfuscated."""
    text = text.lower()
    words: set[str] = set()
    odd = 0
    for found in SPACED.findall(text):
        words.update(separate_words(decoder.decode(found)))
        odd += 1
    read = decoder.read
    for part in set(text.split()):
        found = read.get(part)
        if found is None:
            found = _read(part, decoder)
            if len(part) <= 100:
                if len(read) >= decoder.most:
                    read.clear()
                read[part] = found
        words.update(found[0])
        odd += found[1]
    return words, odd


def _read(part: str, decoder: Decoder) -> tuple[tuple[str, ...], int]:
    """The words of one part of a text, and whether it was obfuscated."""
    if part.isalpha():
        if REPEATED.search(part):
            return (part, *separate_words(decoder.decode(part))), int(STRETCHED.search(part) is not None)
        return (part,), 0
    core, open_core = part.strip(".,;:?\"'()!"), part.strip(".,;:?\"')")  # "!" and "(" may be letters
    if core == open_core and core.isalpha():  # a word with marks around it reads as the word
        return decoder.read.get(core) or _read(core, decoder)
    words, odd = WORDS.findall(part), 0
    for form in {core, open_core}:
        if len(form) < 2:
            continue
        leet = LEETED.search(form) and WORDS.search(form)
        separated = SEPARATED.search(form)
        if leet or separated or REPEATED.search(form) or LEET_ONLY.fullmatch(form):
            words += separate_words(decoder.decode(form))
            odd += form is core and bool(leet or separated or STRETCHED.search(form))
    return tuple(words), int(odd)


def features(word: str) -> tuple[str, ...]:
    """A word, its beginnings, and its inner part, which other words may share."""
    return (word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k))


class Scorer:
    """Log odds of the features in toxic and other documents, summed up by a logistic regression."""

    def __init__(self, model: np.ndarray, counts: dict[str, tuple[int, int]], totals: tuple[int, int], weights: np.ndarray | None, remembered: int = 250_000):
        self.decoder, self.counts, self.totals, self.weights, self.known = Decoder(model, remembered), counts, totals, weights, {}

    def odds(self, toxic: int, clean: int) -> float:
        t, c = self.totals
        return math.log((toxic + 0.3) / (t + 1)) - math.log((clean + 0.3 + 0.002 * c) / (c + 1))

    def _of_word(self, word: str) -> tuple[str, ...]:
        if len(self.known) > self.decoder.most:
            self.known.clear()
        found = self.known[word] = tuple(f for f in features(word) if f in self.counts)
        return found

    def summary(self, text: str, label: int | None = None) -> np.ndarray:
        """What the regression sees; with a label, the document's own share of the counts is left out."""
        words, odd = restored(text, self.decoder)
        known, hits = self.known, set()
        for w in words:
            found = known.get(w)
            if found is None:
                found = self._of_word(w)
            if found:
                hits.update(found)
        odds = sorted((self.odds(self.counts[f][0] - (label == 1), self.counts[f][1] - (label == 0)) for f in hits), reverse=True)
        odds = [max(x, 0.0) for x in odds[:10]] + [0.0] * 10
        n = math.log1p(len(words))
        return np.array([1.0, odds[0], sum(odds[1:4]) / 3, sum(odds[4:10]) / 6, sum(odds[:4]) / (4 + n), math.log1p(odd) / 5])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(text) @ self.weights, -30, 30))))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 20_000, least_toxic: int = 4, remembered: int = 250_000) -> Scorer:
    """Fit the scorer: the language model on all texts, the classifier on at most ``most_labels`` labelled documents that are not held out (those whose ids hash lowest).

    A feature is kept if ``least_toxic`` toxic documents of that sample have it, and a share of them four times that of the others.
    A worker remembers the readings of at most ``remembered`` parts and words; fewer take less memory and more time, with equal scores.
    Without labelled documents the scorer knows no features and gives everything the score of its bias.
    """
    spark = docs.sparkSession
    model = language_model(docs, text_col)
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("labelled"), "labelled").limit(most_labels)
    sample = materialize(docs.select(F.col(id_col).alias("labelled"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "labelled").select("labelled", "toxic", "text"), "labelled")
    totals = Counter({r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()})
    totals = totals[1], totals[0]

    def count(batches):
        decoder, seen = Decoder(model, remembered), ({}, {})

        def flush():
            both = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1].get(f, 0) for f in both], pa.int64()), pa.array([seen[0].get(f, 0) for f in both], pa.int64())], names=["feature", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return batch

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen[1 if toxic == 1 else 0]
                for f in {f for w in restored(text, decoder)[0] for f in features(w)}:
                    own[f] = own.get(f, 0) + 1
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    rate = F.col("toxic") / F.lit(max(1, totals[0])) / (F.col("clean") / F.lit(max(1, totals[1])) + F.lit(1e-9))
    counted = sample.select("toxic", "text").mapInArrow(alone(count), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.where((F.col("toxic") >= least_toxic) & (rate > 4))
    scorer = Scorer(model, {r.feature: (r.toxic, r.clean) for r in kept.collect()}, totals, None, remembered)
    shared = spark.sparkContext.broadcast(scorer)

    def summarise(batches):
        for batch in batches:
            rows = [shared.value.summary(t, y).tolist() for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sample.select("toxic", "text").mapInArrow(alone(summarise), "toxic int, x array<double>").collect()
    y = np.array([float(r.toxic == 1) for r in seen])
    weights = _fit(np.array([r.x for r in seen]), y) if len(seen) and 0 < y.sum() < len(y) else np.array([-3.0, 0, 0, 0, 0, 0])
    return Scorer(model, scorer.counts, totals, weights, remembered)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score whole texts for toxicity: doc_id, text_hash, held_out, score, predicted.

    Noisy channel: a part of the text with leetspeak, separated or repeated letters is the output of a channel that
    substitutes, repeats and separates letters; the likeliest input under a trigram model of all texts' letters is found
    by Viterbi search, and the restored words are scored: a logistic regression sees the ten strongest features of a
    document (whatever its length), how many words it has and how many parts were obfuscated. Labels, language, source
    and id are no inputs. A very long text is scored whole, its parts decoded in windows.

    Null and empty texts get the score of a text without features. Repeated rows get equal scores. Null ids are not held
    out and are never labelled. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, **options))
    kind = dict(docs.dtypes)[id_col]

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shared.value.score(t) for t in batch.column(3).to_pylist()], pa.float64())], names=["doc_id", "text_hash", "held_out", "score"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    return given.mapInArrow(alone(score), f"doc_id {kind}, text_hash long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
