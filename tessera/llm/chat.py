"""Chat formatting from an event log.

A log has one row an event: conv_id, seq, event, message_id, role, text. The
events of one message are sorted by seq and folded: `message` starts it (a
second one starts another), `delta` appends, `edit` replaces, `regenerate` empties
it, `delete` drops it. Folding is by (conv_id, message_id), so a hot conversation's
messages fold in many tasks, each a stream over sorted events. Final messages are rendered, each into one segment,
by built-in functions; the segments of a conversation, by place, are its formatted
text. Readers of whole conversations stream over sorted segments and hold one at a time.

Template: `[INST] text [/INST]` for a user, `<<SYS>>text<</SYS>>` for a system,
`text</s>` for an assistant, `[ROLE]role[/ROLE]text</s>` for others. A control string inside
a text or role gets a backslash after its first character, one more than it has there;
reading takes one away. So no control string is left in a text, and every text comes back.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own;
null seq comes first; ties of seq go by message, role and text; an unknown event or one without a
message to act on (delta or edit first) starts a message; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches

# What may follow the first character of a control string.
TAILS = r"/?s>|/?INST\]|<SYS>>|</SYS>>|/?ROLE\]"
_INSIDE = rf"([<\[])(\\*)({TAILS})"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({TAILS})")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _INSIDE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def plain_log(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): a `message` event each."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("event"), F.col("turn").cast("string").alias("message_id"), "role", "text"
    )


def streamed_log(conversations: DataFrame) -> DataFrame:
    """The log that such turns leave when they are streamed: an empty message, a first draft that is edited and then regenerated, and the text in two
    deltas. Rows that share a turn are told apart by their place among them; seq is (turn, place, number of the event)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    event = lambda k, name, part: F.struct(F.lit(k).alias("step"), F.lit(name).alias("event"), part.alias("text"))
    events = [
        event(0, "message", F.lit("")), event(1, "delta", F.lit("a draft")), event(2, "edit", F.lit("a better draft")), event(3, "regenerate", F.lit(None).cast("string")),
        event(4, "delta", F.substr(text, F.lit(1), half)), event(5, "delta", F.substr(text, half + 1)),
    ]
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text))
    rows = conversations.select("conv_id", "turn", "role", place.alias("k"), F.array(*events).alias("events"))
    rows = rows.select("conv_id", "turn", "role", "k", F.inline("events"))
    return rows.select("conv_id", F.struct("turn", "k", "step").alias("seq"), "event", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), "k").alias("message_id"), "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """log -> conv_id, place (seq of the message's first event, message_id, number among its messages), role, text.

    Events are dealt by message and sorted by seq, and a task streams over them; it holds the pieces of one message, which are joined once.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = log.select("conv_id", "message_id", "seq", role.alias("role"), text.alias("text"), F.coalesce("event", F.lit("message")).alias("event"))
    kinds = dict(rows.dtypes)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, messages = None, None, []

        def emit(out: list) -> None:
            if now is not None:
                out += [(now[0], first, now[1], k, r, "".join(pieces)) for k, (r, pieces) in enumerate(messages)]

        schema = None
        for batch in batches:
            if schema is None:
                of = batch.schema.field
                schema = pa.schema([of("conv_id"), of("seq"), of("message_id"), pa.field("k", pa.int32()), of("role"), of("text")])
            out: list = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "message_id", "role", "text", "event")]
            for i, (conv, message, who, said, event) in enumerate(zip(*columns)):
                if (conv, message) != now:
                    emit(out)
                    now, first, messages = (conv, message), batch.column("seq")[i].as_py(), []
                if not messages or event not in ("delta", "edit", "regenerate", "delete"):
                    messages.append((who, [] if event in ("regenerate", "delete") else [said]))
                elif event == "delta":
                    messages[-1][1].append(said)
                elif event == "delete":
                    messages.pop()
                else:
                    messages[-1] = (messages[-1][0], [said] if event == "edit" else [])
            if out:
                yield _batch(out, schema)
        out = []
        emit(out)
        if out:
            yield _batch(out, schema)

    small_batches(log.sparkSession)
    rows = rows.repartition(shuffle_width(log.sparkSession), "conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", "seq", "role", "text", "event")
    done = rows.mapInArrow(folded, f"conv_id {kinds['conv_id']}, seq {kinds['seq']}, message_id {kinds['message_id']}, k int, role string, text string")
    return done.select("conv_id", F.struct("seq", "message_id", "k").alias("place"), "role", "text")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], names=schema.names)


def render(messages: DataFrame) -> DataFrame:
    """messages -> conv_id, place, segment, and the loss mask of the segment: loss_start and loss_end, in code points."""
    text, role = escape(F.col("text")), F.col("role")
    segment = (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .when(role == "assistant", F.concat(text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), text, F.lit("</s>")))
    )
    size = F.when(role == "assistant", F.length(text)).otherwise(0)
    return messages.select("conv_id", "place", segment.alias("segment"), F.lit(0).alias("loss_start"), size.alias("loss_end"))


def format_log(log: DataFrame) -> DataFrame:
    """log -> segments, sorted by conversation and place inside partitions that hold whole conversations."""
    segments = render(fold(log))
    return segments.repartition(shuffle_width(log.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")


def parse(text: str) -> list[tuple[str, str]]:
    """Formatted text back into (role, text) turns."""
    turns, at = [], 0
    while at < len(text):
        if text.startswith("[INST] ", at):
            end = text.index(" [/INST]", at + 6)
            turns.append(("user", unescape(text[at + 7 : end])))
            at = end + 8
        elif text.startswith("<<SYS>>", at):
            end = text.index("<</SYS>>", at)
            turns.append(("system", unescape(text[at + 7 : end])))
            at = end + 8
        else:
            role = "assistant"
            if text.startswith("[ROLE]", at):
                end = text.index("[/ROLE]", at)
                role, at = unescape(text[at + 6 : end]), end + 7
            end = text.index("</s>", at)
            turns.append((role, unescape(text[at:end])))
            at = end + 4
    return turns


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its sorted segments one at a time."""
    id_type = dict(segments.select("conv_id").dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def reader(batches):
        start = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        conv, state, begun, done = None, start(), False, []
        for batch in batches:
            for c, segment, lo, hi in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end"))):
                if not begun or c != conv:
                    if begun:
                        done.append((conv, *state))
                    conv, state, begun = c, start(), True
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learnt = unescape(segment[lo:hi])
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if len(done) >= 1000:
                yield _rows(done, names, batch.schema.field("conv_id").type)
                done = []
        if begun:
            done.append((conv, *state))
            yield _rows(done, names, batch.schema.field("conv_id").type)

    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.mapInArrow(reader, schema)


def _rows(done, names, id_type):
    rows = [(c, n, t.hexdigest(), chars, h.hexdigest(), size) for c, n, t, chars, h, size in done]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
