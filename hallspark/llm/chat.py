"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, text_or_empty

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _escaped(column):
    """Every ``<|`` of a text becomes ``<||``, so that no control string is left; removing one bar restores it."""
    return F.replace(column, F.lit("<|"), F.lit("<||"))


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")


def _role(column):
    return F.replace(F.replace(_escaped(column), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: str) -> str:
    return unescaped("\\".join(part.replace("\\n", "\n") for part in role.split("\\\\")))


def format_chats(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Format conversations (conv_id, turn, role, text) for training: (segments, examples).

    Prefix-target expansion makes an example of every assistant turn: all turns before it are context, only its own
    text is trainable. The examples of a conversation are prefixes of one transcript, so the transcript is written
    once, as segments (conv_id, seq, formatted), and an example is (conv_id, example, seq, context_chars, example_chars,
    loss_start, loss_end): it is the transcript's first ``example_chars`` characters, trained from ``loss_start`` to
    ``loss_end``. The output so stays linear in the input, however many turns a conversation has.
    :func:`example_texts` spells the texts out.

    Rows of a conversation are ordered by turn, then role, then text; repeated rows are turns of their own. Null roles
    and texts are empty. Null conv_ids form one conversation. A very long text is one turn like others, written whole. An
    empty table gives two empty results. Other columns are ignored.
    """
    spark = turns.sparkSession
    role, text = text_or_empty("role"), text_or_empty("text")
    head = F.concat(F.lit(OPEN), _role(role), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    shaped = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select("conv_id", "role", F.row_number().over(order).cast("long").alias("seq"), F.concat(head, _escaped(text), F.lit(CLOSE)).alias("formatted"), F.length(head).alias("head"))
    chars = F.length("formatted").cast("long")
    before = F.sum(chars).over(Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - chars
    path = new_folder(spark, "chat-segments")
    shaped.withColumn("start", before).write.parquet(path)
    segments = spark.read.parquet(path)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")).cast("long")
    loss_start, loss_end = F.col("start") + F.col("head"), F.col("start") + F.length("formatted") - len(CLOSE)
    examples = segments.where(F.col("role") == "assistant").select("conv_id", number.alias("example"), "seq", F.col("start").alias("context_chars"), (F.col("start") + F.length("formatted")).alias("example_chars"), loss_start.alias("loss_start"), loss_end.alias("loss_end"))
    return segments.select("conv_id", "seq", "start", "formatted"), materialize(examples, "chat-examples")


def example_texts(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples with their context and target spelled out (quadratic in the turns of a conversation, as any such table)."""
    s, e = segments.alias("s"), examples.alias("e")
    own = e.join(s, (F.col("s.conv_id").eqNullSafe(F.col("e.conv_id"))) & (F.col("s.seq") <= F.col("e.seq")))
    parts = F.array_sort(F.collect_list(F.struct("s.seq", "s.formatted")))
    text = F.array_join(F.transform(parts, lambda p: p["formatted"]), "")
    return own.groupBy("e.conv_id", "e.example", "e.loss_start", "e.loss_end").agg(text.alias("text"))


def _parsed(formatted: str) -> tuple[str, str]:
    head, mark, rest = formatted.partition("\n")
    if not head.startswith(OPEN) or not mark or not rest.endswith(CLOSE):
        raise ValueError("a formatted turn lacks its marks")
    body = rest[: -len(CLOSE)]
    if body.replace("<||", "").find("<|") >= 0:
        raise ValueError("a formatted text holds a control string")
    return unescaped_role(head[len(OPEN) :]), unescaped(body)


def _digests(batches):
    """Rows sorted by conversation and turn: one running digest at a time, whatever a conversation's length.

    The transcript parsed so far says what an example must be: every reply has one, its context is all that stands
    before, it ends with the reply, and nothing but the reply is trained. The loss text is read at the example's places."""
    now, state, names = object(), None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

    def row():
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    for batch in batches:
        out = []
        for conv, formatted, example, context, whole, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if state is None or conv != now:
                if state:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = _parsed(formatted)
            start, end = state[4], state[4] + len(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] = end
            if (role == "assistant") != (example is not None):
                raise ValueError("an example is missing, or has no reply to train")
            if example is not None:
                state[5] += 1
                if (example, context, whole, lo, hi) != (state[5], start, end, start + formatted.index("\n") + 1, end - len(CLOSE)):
                    raise ValueError("an example differs from the transcript before and up to its reply")
                reply = unescaped(formatted[lo - start : hi - start])
                state[2] += len(reply)
                state[3].update(reply.encode())
        yield _rows(out, batch.schema.field(0).type, names)
    if state:
        yield _rows([row()], batch.schema.field(0).type, names)


def _rows(out, kind, names):
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of what :func:`format_chats` wrote, parsed from its output: one row per conversation.

    Every example is held against the transcript as parsed: its number, the length of its context, its end and its loss
    span. A reply without an example, or an example that differs, raises. A digest over a conversation is sequential by
    nature, so its turns stream through one task in order; memory holds one batch.
    """
    kind = dict(segments.dtypes)["conv_id"]
    spans = examples.select(F.col("conv_id").alias("c"), F.col("seq").alias("q"), "example", "context_chars", "example_chars", "loss_start", "loss_end")
    joined = segments.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("q")), "left")
    ordered = joined.select("conv_id", "formatted", "example", "context_chars", "example_chars", "loss_start", "loss_end", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
