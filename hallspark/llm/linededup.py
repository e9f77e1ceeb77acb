"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blanks_as, broadcast_checked, materialize


def _bound(value: Column, use) -> Column:
    """``use(x)`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _low(text: Column) -> Column:
    return blanks_as(F.lower(text), "\t\x0b\x0c\r")


def _plain(low: Column) -> Column:
    """The words of a lower-cased line with one space between them."""
    return F.trim(F.when(low.contains("  "), F.regexp_replace(low, " +", " ")).otherwise(low))


def _n_words(plain: Column) -> Column:
    return F.when(plain == "", 0).otherwise(F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def _at_least(plain: Column, k: int) -> Column:
    """Whether a line with words has ``k`` or more; reads no further than the k-th."""
    return F.octet_length(F.substring_index(plain, " ", k - 1)) < F.octet_length(plain)


def _units(plain: Column, least_words: int) -> Column:
    """The words of a line, or its characters, marked as such, if it has fewer than ``least_words`` words."""
    chars = lambda x: F.transform(F.filter(F.split(x, ""), lambda y: y != ""), lambda y: F.concat(F.lit("\n"), y))
    return _bound(plain, lambda x: F.when(_n_words(x) < least_words, chars(x)).otherwise(F.split(x, " ")))


def _anchors(plain: Column, least_words: int, least_chars: int | None = None) -> list[Column]:
    """One word edit leaves the first or the last words of a line as they are: eight of 16 or more, else half of ``least_words``. Lines of 16 have both kinds, as they may pair with either side. Of shorter lines, one edit of a character leaves the first or the last half of ``least_chars``."""
    few = least_words // 2

    def ends(k: int, used: Column) -> list[Column]:
        return [F.when(used, F.xxhash64(F.lit(2 * k), F.substring_index(plain, " ", k))), F.when(used, F.xxhash64(F.lit(2 * k + 1), F.substring_index(plain, " ", -k)))]

    enough = _at_least(plain, least_words)
    long, own = ends(8, _at_least(plain, 16)), ends(few, enough & ~_at_least(plain, 17))
    if least_chars is not None:
        half, used = least_chars // 2, ~enough & (F.length(plain) >= least_chars)
        own = [F.coalesce(k, F.when(used, F.xxhash64(F.lit(j - 2), x))) for j, (k, x) in enumerate(zip(own, (F.substring(plain, 1, half), F.substring(plain, -half, half)), strict=True))]
    return long + own


def _block_keys(words: Column, blocks: int = 4) -> Column:
    """Deletion neighbourhood of blocks: what is left of a line without each of its quarters. Of two lines that differ by one word, the words before and after the quarter with the edit are equal, counted from either end by the shorter one's length, which is the line's own or one less."""
    n = F.size(words)
    keys = []
    for m in (n, n - 1):
        edges = [F.floor(m * j / blocks).cast("int") for j in range(blocks + 1)]
        for j in range(blocks):
            rest = m - edges[j + 1]
            keys.append(F.xxhash64(m, F.lit(j), F.slice(words, F.lit(1), edges[j]), F.slice(words, n - rest + 1, rest)))
    return F.array(*keys)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two lists of words differ by one substitution, insertion or deletion."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)) == 1
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    at = F.array_position(F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y), F.lit(True)).cast("int")
    at = F.when(at == 0, F.size(long)).otherwise(at)
    deleted = F.concat(F.slice(long, F.lit(1), at - 1), F.slice(long, at + 1, F.size(long))) == short
    return F.when(F.size(a) == F.size(b), replaced).when(F.abs(F.size(a) - F.size(b)) == 1, deleted).otherwise(False)


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 8, least_chars: int | None = None) -> DataFrame:
    """The lines that an earlier one repeats: (doc_id, text_hash, removed), removed being the list of line numbers.

    Lines lie between newlines; they compare by their lower-cased words. Order: doc_id, then the text's hash, then the
    number of the line. A line without words is never removed. A line goes if an equal one is earlier; one of at least
    ``least_words`` words also goes if an earlier one is within one word edit of it, be that itself kept or not.
    With ``least_chars``, a line of fewer words goes too if an earlier one of fewer words is within one edit of a
    character of it and both have ``least_chars`` characters or more, words being one blank apart.

    Deletion neighbourhood: each distinct line and its variants with one word deleted are keyed by hash. Lines that
    share a variant of the same word number differ by that word; a line equal to another one's variant lacks a word.
    Each key only keeps its earliest line, so a group of many is linear, and the partner found is verified on its words.
    Before, lines are set aside that no other can be within the bound of: those whose first and last words no other line
    has, then those that no other equals without one of their quarters.
    """
    if not 2 <= least_words <= 16:
        raise ValueError("least_words lies between 2 and 16")
    if least_chars is not None and least_chars < 4:
        raise ValueError("least_chars is 4 or more")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = whole.withColumn("th", F.xxhash64("text"))
    plain = F.col("plain")
    lines = keyed.where("text is not null").select("doc_id", "th", F.posexplode(F.split(_low(F.col("text")), "\n")).alias("pos", "line"))
    lines = lines.where(F.trim("line") != "").select("doc_id", "th", "pos", _plain(F.col("line")).alias("plain"))
    anchors = [k.alias(f"k{i}") for i, k in enumerate(_anchors(plain, least_words, least_chars))]
    lines = materialize(lines.select("doc_id", "th", "pos", F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(1), "plain").alias("h2"), *anchors), "lines")

    at = F.struct("doc_id", "th", "pos")
    keys = [f"k{i}" for i in range(4)]
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys]), "first-lines")
    anchored = firsts.where("coalesce(k0, k2) is not null").select("first", "h1", "h2", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    shared = broadcast_checked(materialize(anchored.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-anchors"), 16)
    flagged = anchored.join(shared, "key", "left_semi").select("first", "h1", "h2").distinct()
    by_doc = materialize(flagged.groupBy("first.doc_id", "first.th").agg(F.collect_list(F.struct("first.pos", "h1", "h2")).alias("some")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "some"), "flagged-lines")
    by_doc = broadcast_checked(by_doc, 64 + 24 * F.size("some"))
    spell = (lambda x: F.split(x, " ")) if least_chars is None else (lambda x: _units(x, least_words))
    spelled = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", F.explode(_bound(F.split("text", "\n"), lambda own: F.transform("some", lambda s: F.struct(s["pos"].alias("pos"), s["h1"].alias("h1"), s["h2"].alias("h2"), F.get(own, s["pos"]).alias("line"))))).alias("s"))
    spelled = materialize(spelled.select(F.struct("doc_id", "th", "s.pos").alias("o"), F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"), spell(_plain(_low(F.col("s.line")))).alias("words")).dropDuplicates(["h1", "h2"]), "spelled-lines")

    hashed = spelled.select("h1", "h2", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    blocked = materialize(hashed.select("h1", "h2", F.explode(_block_keys(F.col("hashes"))).alias("key")), "blocks")
    twice = broadcast_checked(materialize(blocked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-blocks"), 16)
    close = broadcast_checked(materialize(blocked.join(twice, "key", "left_semi").select("h1", "h2").distinct(), "close-lines"), 32)

    # variants: positional word hashes add up by xor, so one window gives every deletion of a line
    each = spelled.join(close, ["h1", "h2"], "left_semi").select("o", "h1", "h2", F.posexplode("words").alias("j", "word"))
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    here, moved = F.xxhash64("word", "j"), F.xxhash64("word", F.col("j") - 1)
    variants = each.select("o", "j", here.alias("here"), F.bit_xor(here).over(upto).alias("before"), F.bit_xor(here).over(line).alias("base"), F.bit_xor(moved).over(upto).alias("past"), F.bit_xor(moved).over(line).alias("all"))
    deleted = F.struct(F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("past")).bitwiseXOR(F.col("all")).alias("key"), F.col("j").alias("j"))
    base = F.struct(F.col("base").alias("key"), F.lit(-1).alias("j"))
    variants = materialize(variants.select("o", F.explode(F.when(F.col("j") == 0, F.array(deleted, base)).otherwise(F.array(deleted))).alias("v")).select("o", "v.key", "v.j"), "variants")

    earliest = variants.groupBy("key", "j").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    by_key = earliest.groupBy("key").agg(F.min(F.when(F.col("j") < 0, F.col("o"))).alias("base_o"), F.min(F.when(F.col("j") >= 0, F.col("o"))).alias("variant_o"))
    substituted = variants.where("j >= 0").join(earliest.where("j >= 0 and n > 1").select("key", "j", F.col("o").alias("earlier")), ["key", "j"])
    indel = variants.join(by_key.where("base_o is not null and variant_o is not null"), "key").withColumn("earlier", F.when(F.col("j") < 0, F.col("variant_o")).otherwise(F.col("base_o")))
    pairs = substituted.select("o", "earlier").unionByName(indel.select("o", "earlier")).where("earlier < o").distinct()
    partner = spelled.select(F.col("o").alias("earlier"), F.col("words").alias("others"))
    near = pairs.join(partner, "earlier").join(spelled.select("o", "h1", "h2", "words"), "o").where(_one_edit(F.col("words"), F.col("others"))).select("h1", "h2").distinct().withColumn("near", F.lit(True))

    marked = firsts.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    marked = broadcast_checked(materialize(marked, "repeated-lines"), 64)
    gone = lines.select("doc_id", "th", "pos", "h1", "h2").join(marked, ["h1", "h2"]).where(F.col("near") | (at != F.col("first")))
    return materialize(gone.groupBy("doc_id", F.col("th").alias("text_hash")).agg(F.collect_set("pos").alias("removed")), "removed-lines")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 8, least_chars: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the lines that :func:`duplicate_lines` names taken out of the text, plus n_lines and n_removed_lines, which replace columns of these names.

    Null texts stay null, with 0 lines. A null id comes first in the order. Rows with equal ids and texts are one
    document twice: neither is earlier, so both keep what they keep. A very long text is cut into lines in the memory of
    one task, in linear time. An empty table gives an empty result.
    """
    removed = duplicate_lines(docs, id_col=id_col, text_col=text_col, least_words=least_words, least_chars=least_chars)
    removed = broadcast_checked(removed.select(F.col("doc_id").alias("__line_dedup_d"), F.col("text_hash").alias("__line_dedup_t"), F.col("removed").alias("__line_dedup_gone")), 32 + 4 * F.size("__line_dedup_gone"))
    text = F.col(text_col)
    joined = docs.join(removed, F.col(id_col).eqNullSafe(F.col("__line_dedup_d")) & (F.xxhash64(text.cast("string")) == F.col("__line_dedup_t")), "left")
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__line_dedup_gone"), lambda k: F.get(lines, k))
    left = F.array_join(_bound(F.split(text, "\n"), kept), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    out = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("n_removed_lines", F.coalesce(F.size("__line_dedup_gone"), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("__line_dedup_gone").isNull(), text).otherwise(left)).drop("__line_dedup_d", "__line_dedup_t", "__line_dedup_gone")
