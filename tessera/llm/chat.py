"""Chat formatting by prefix-target expansion.

A conversation is rendered once, as a chain of marked turns.  Every assistant
turn becomes a training example of its own: the context is everything before
it, and only the reply is trainable.  All examples of a conversation are
prefixes of the same rendering, so they are kept as (end, loss range) over
it; ``materialise`` expands them to one text per example when a consumer wants
that.

Template (fixed): ``<s>`` once; a system turn ``[SYS] .. [/SYS]``; a user turn
``[INST] .. [/INST]``; an assistant turn `` ..</s>``; any other role
``[ROLE name] .. [/ROLE]``.  Inside texts and role names a backslash is put
before every ``\\``, ``<``, ``[`` and ``]``, so no control string can come from a
text, and removing it restores the text exactly.

Rows are dealt out by ranges of (conversation, turn, role) and sorted, so a
conversation of any size is spread over several tasks, which render its parts
with positions of their own.  One row for each task then says where the part of
a conversation that began before has to go on (a scan over task totals), and
positions are shifted by that.  Memory is bounded by the longest turn.

Turns with equal number are ordered by role and text; repeated rows are turns
like others; null texts and roles are empty; a null conversation id is a
conversation of its own; a conversation without an assistant turn has no
example; an empty table has no conversations; texts of any length are kept
whole; columns other than the four named take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import cut_lineage

BEGIN = "<s>"
_ESCAPE = re.compile(r"([\\<\[\]])")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_BODY = r"((?:\\.|[^\\<\[\]])*)"
_TURN = re.compile(
    rf"\[SYS\] {_BODY} \[/SYS\]|\[INST\] {_BODY} \[/INST\]|\[ROLE {_BODY}\] {_BODY} \[/ROLE\]| {_BODY}</s>", re.DOTALL
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and the range of the reply in it (empty unless assistant)."""
    body = escape(text)
    if role == "assistant":
        return f" {body}</s>", 1, 1 + len(body)
    if role == "system":
        return f"[SYS] {body} [/SYS]", 0, 0
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    return f"[ROLE {escape(role)}] {body} [/ROLE]", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("a rendered conversation begins with <s>")
    out, at = [], len(BEGIN)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        system, user, role, other, reply = m.groups()
        if system is not None:
            out.append(("system", unescape(system)))
        elif user is not None:
            out.append(("user", unescape(user)))
        elif role is not None:
            out.append((unescape(role), unescape(other)))
        else:
            out.append(("assistant", unescape(reply)))
        at = m.end()
    return out


#: Examples whose texts are cut out of one copy of their conversation by ``materialise``.
EXAMPLES_OF_ONE = 64

_PART = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("segment", T.StringType()),
        T.StructField("end", T.LongType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)
_PART_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _sorted_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")


def _render_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of one task, numbered and placed as if every conversation began in it."""
    part, current, seq, at = TaskContext.get().partitionId(), object(), 0, 0
    for batch in batches:
        columns: list[list] = [[] for _ in _PART.names]
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            if conv != current:
                current, seq, at = conv, 0, 0
            turn, a, b = render_turn(role, text)
            reply = role == "assistant"
            row = (part, conv, seq, turn, at + len(turn), at + a if reply else None, at + b if reply else None)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            seq, at = seq + 1, at + len(turn)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_ARROW, strict=True)], names=_PART.names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task: its first and last conversation with their turns and characters in it."""
    first = last = part = None
    for batch in batches:
        for part, conv, seq, end in zip(*[batch.column(c).to_pylist() for c in ("part", "conv_id", "seq", "end")], strict=True):  # noqa: B007
            if last is not None and seq == 0:
                first = first or last
            last = (conv, seq + 1, end)
    if last is not None:
        whole = first is None
        row = (part, whole, *(first or last), *last)
        yield pa.RecordBatch.from_pylist([dict(zip(_EDGES, row, strict=True))], schema=pa.schema(list(zip(_EDGES, _EDGES_ARROW, strict=True))))


_EDGES = ["part", "whole", "first", "first_turns", "first_chars", "last", "last_turns", "last_chars"]
_EDGES_ARROW = [pa.int32(), pa.bool_(), *[pa.int64()] * 6]


def segments(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rendered turns: the conversation is the concatenation of its segments by seq.

    ``end`` counts code points from the conversation's beginning.  A segment with
    a null-free range belongs to an assistant turn: it is an example whose text is
    the conversation up to ``end`` and whose trainable part is [loss_start,
    loss_end).  Other turns have a null range.
    """
    turns = _sorted_turns(conversations, conv_col, turn_col, role_col, text_col)
    parts = cut_lineage(turns.mapInArrow(_render_parts, _PART))
    kinds = "part int, whole boolean, first long, first_turns long, first_chars long, last long, last_turns long, last_chars long"
    ahead, carried = [], None  # what of a task's first conversation lies in the tasks before
    for e in sorted(parts.mapInArrow(_edges, kinds).collect(), key=lambda e: e.part):  # a row for each task
        goes_on = carried is not None and carried[0] == e.first
        turns_ahead, chars_ahead = carried[1:] if goes_on else (0, 0)
        if goes_on:
            ahead.append((e.part, e.first, turns_ahead, chars_ahead))
        carried = (e.first, turns_ahead + e.first_turns, chars_ahead + e.first_chars) if e.whole else (e.last, e.last_turns, e.last_chars)
    begin = F.lit(len(BEGIN))
    seq, chars = F.lit(0), F.lit(0)
    if ahead:
        offsets = conversations.sparkSession.createDataFrame(ahead, "at_part int, at_conv long, turns_ahead long, chars_ahead long")
        parts = parts.join(F.broadcast(offsets), (F.col("part") == F.col("at_part")) & F.col("conv_id").eqNullSafe(F.col("at_conv")), "left")
        seq, chars = F.coalesce("turns_ahead", F.lit(0)), F.coalesce("chars_ahead", F.lit(0))
    placed = parts.select(
        "conv_id", (F.col("seq") + seq).alias("seq"), "segment", *[(F.col(c) + chars + begin).alias(c) for c in ("end", "loss_start", "loss_end")]
    )
    return placed.withColumn("segment", F.when(F.col("seq") == 0, F.concat(F.lit(BEGIN), "segment")).otherwise(F.col("segment")))


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn: (conv_id, example, end, loss_start, loss_end).

    The example's text is its conversation up to ``end``.
    """
    return rendered.where(F.col("loss_start").isNotNull()).select(
        "conv_id", F.col("seq").alias("example"), "end", "loss_start", "loss_end"
    )


def materialise(rendered: DataFrame) -> DataFrame:
    """Every example with its full text (context and reply).

    The output of one conversation grows with the square of its turns, which is
    what prefix expansion means; keep the shared form for very long ones.  The
    last example is the conversation's whole text, so one row has to hold that;
    its examples are cut out of several copies of it, dealt out by example.
    """
    own = examples(rendered)
    copies = F.ceil(F.count("loss_start") / EXAMPLES_OF_ONE).cast("int")
    whole = (
        rendered.groupBy("conv_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "").alias("whole"), copies.alias("copies"))
        .where(F.col("copies") > 0)
    )
    dealt = whole.select(F.col("conv_id").alias("of"), "whole", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    counts = rendered.groupBy("conv_id").agg(copies.alias("copies")).where(F.col("copies") > 1).select(F.col("conv_id").alias("of"), "copies")
    own = own.join(counts, own["conv_id"].eqNullSafe(counts["of"]), "left").drop("of")
    own = own.withColumn("mine", F.pmod(F.xxhash64("example"), F.coalesce("copies", F.lit(1))).cast("int"))
    joined = own.join(dealt, own["conv_id"].eqNullSafe(dealt["of"]) & (F.col("mine") == F.col("copy")))
    return joined.select("conv_id", "example", F.substring("whole", F.lit(1), F.col("end").cast("int")).alias("text"), "loss_start", "loss_end")


_DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_examples", T.LongType()),
    ]
)


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its segments and its examples.

    Roles and texts are parsed from the segments; the trainable text is cut out by
    the loss range of each expanded example and unescaped.  ``formatted_chars`` is
    the length of the rendered conversation, which all its examples share as their
    prefix.  A digest runs over a whole conversation in order, so one task streams
    each; it holds a turn at a time.
    """
    none = F.lit(None).cast("long")
    turns = rendered.select("conv_id", "seq", F.lit(0).alias("kind"), "segment", "end", none.alias("loss_start"), none.alias("loss_end"))
    own = examples(rendered).select("conv_id", F.col("example").alias("seq"), F.lit(1).alias("kind"), F.lit("").alias("segment"), "end", "loss_start", "loss_end")
    rows = turns.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, state, held, out = none, None, "", []

        def close() -> None:
            if current is not none:
                turns, all_hash, chars, loss_hash, end, found = state
                out.append((current, turns, all_hash.hexdigest(), chars, loss_hash.hexdigest(), end, found))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_DIGEST.names)
            out.clear()
            types = [pa.string() if n.endswith("sha256") else pa.int64() for n in _DIGEST.names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_DIGEST.names)

        for batch in batches:
            names = ("conv_id", "seq", "kind", "segment", "end", "loss_start", "loss_end")
            for conv, seq, kind, segment, end, a, b in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if kind == 0:
                    for role, text in parse(segment if seq == 0 else BEGIN + segment):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    held, state[4] = segment, end
                    continue
                # The example ends with the segment held, and its loss range lies in it.
                begin = end - len(held)
                if end != state[4] or a < begin:
                    raise ValueError(f"example {seq} of conversation {conv} doesn't end with its reply")
                reply = unescape(held[a - begin : b - begin])
                state[2] += len(reply)
                state[3].update(reply.encode())
                state[5] += 1
            yield flush()
        close()
        yield flush()

    return rows.mapInArrow(work, _DIGEST)


def conversation_report(conversations: DataFrame, **columns) -> DataFrame:
    return digest(segments(conversations, **columns))
