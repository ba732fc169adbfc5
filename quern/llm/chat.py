"""Chat formatting by incremental black-box rendering.

A template is only called, never read: each turn's span is what the rendering of one more turn adds to the rendering before
it, and the text inside is found against a rendering of the same turns with an empty last text.  A template whose longer
rendering doesn't begin with the shorter one rewrites history and is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.blocks import batched

Message = tuple[str, str]

_CONTROL = re.compile(r"\\|<(?=\||/s>)|\[(?=/?INST\])")


def escape(text: str) -> str:
    """Break control strings with a backslash behind their first character, and double backslashes."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """Undo :func:`escape`: a backslash behind ``<``, ``[`` or a backslash goes."""
    return re.sub(r"([<\[\\])\\", r"\1", text)


def render_marked(messages: list[Message]) -> str:
    """The template used here: marks for the start, the role's end and the end of each turn."""
    return "".join(f"<|turn|>{escape(role)}<|text|>{escape(text)}<|end|>\n" for role, text in messages)


@dataclass(frozen=True)
class Template:
    """``render`` is a black box; ``escape`` is how it writes a text, ``unescape`` the way back.

    ``history_free`` declares that a turn's rendering doesn't depend on the other turns or its place.
    """

    render: Callable[[list[Message]], str] = render_marked
    escape: Callable[[str], str] = escape
    unescape: Callable[[str], str] = unescape
    history_free: bool = False


MARKED = Template(history_free=True)


def parse_marked(formatted: str) -> list[Message]:
    """The turns of an output of :func:`render_marked`."""
    return [(unescape(role), unescape(text)) for role, text in re.findall(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", formatted, re.S)]


@dataclass
class Rendering:
    text: str
    #: (start, end, text start, text end) of each turn; empty if history was rewritten or a text wasn't found.
    spans: list[tuple[int, int, int, int]]
    #: First turn that changed what was rendered before it, or None.
    rewritten_at: int | None


def render_incrementally(messages: list[Message], template: Template) -> Rendering:
    before, spans, whole = "", [], True
    for k in range(len(messages)):
        now = template.render(messages[: k + 1])
        if not now.startswith(before):
            return Rendering(template.render(messages), [], k)
        role, text = messages[k]
        bare, wanted = template.render([*messages[:k], (role, "")]), template.escape(text)
        common = len(before)
        while common < min(len(bare), len(now)) and bare[common] == now[common]:
            common += 1
        # The text starts where the two part, or earlier if it begins like what follows it.
        at = next((p for p in range(common, len(before) - 1, -1) if now.startswith(wanted, p) and now[:p] == bare[:p] and now[p + len(wanted) :] == bare[p:]), None)
        whole &= at is not None
        spans.append((len(before), len(now), at or 0, (at or 0) + len(wanted)))
        before = now
    return Rendering(before, spans if whole else [], None)


FORMATTED = "session int, n_turns int, formatted string, rewritten_at int, spans array<struct<start:long,end:long,text_start:long,text_end:long,role:string>>"


def format_conversations(turns: DataFrame, template: Template = MARKED, session_turns: int | None = None) -> DataFrame:
    """One row for each conversation: conv_id, session, n_turns, formatted, rewritten_at, spans.

    Every prefix of a conversation is rendered as a whole, so the work grows with the square of its turns.  Where the template
    is declared free of history, ``session_turns`` cuts conversations into sessions of so many turns, with a row for each.

    ``turns`` has conv_id, turn, role and text.  Null role or text is empty; null turns come first; equal turns are ordered
    by role and text, and all are kept; a null conv_id is one conversation.  Texts are rendered whole, so a conversation with
    its renderings must fit into a task, and an output below Arrow's 2 GiB a value; batches of them are bounded by bytes.  Rows are dealt by conversation and sorted, and
    each task reads them as a stream, a conversation at a time; its sessions follow one another.
    """
    if session_turns is not None and not template.history_free:
        raise ValueError("sessions need a template that is free of history")
    id_type = turns.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, {FORMATTED}"
    id_kind = to_arrow_type(id_type)
    arrow = pa.schema(
        [("conv_id", id_kind), ("session", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("rewritten_at", pa.int32())]
        + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("role", pa.string())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, session, held = object(), 0, []

            def done() -> tuple:
                r = render_incrementally(held, template)
                spans = [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True), role=m[0]) for s, m in zip(r.spans, held, strict=False)]
                return current, session, len(held), r.text, r.rewritten_at, spans

            for batch in batches:
                for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if conv != current or len(held) == session_turns:
                        if held:
                            yield done()
                        session = session + 1 if conv == current else 0
                        current, held = conv, []
                    held.append((role or "", text or ""))
            if held:
                yield done()

        yield from batched(rows(), arrow, size=500)

    ordered = turns.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, template: Template = MARKED, parse: Callable[[str], list[Message]] = parse_marked) -> DataFrame:
    """Digests of what a reader finds in the output of :func:`format_conversations`: its turns and its loss mask."""
    id_type = formatted.schema["conv_id"].dataType
    id_kind, schema = to_arrow_type(id_type), f"conv_id {id_type.simpleString()}, {DIGEST}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, state = None, None
            for batch in batches:
                for conv, session, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if session == 0:
                        if state:
                            yield current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                        current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in parse(text):
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    for span in spans:
                        if span["role"] == "assistant":
                            learnt = template.unescape(text[span["text_start"] : span["text_end"]])
                            state[2] += len(learnt)
                            state[3].update(learnt.encode())
                    state[4] += len(text)
            if state:
                yield current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        arrow = pa.schema([("conv_id", id_kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        yield from batched(rows(), arrow)

    # No exchange in between: a conversation's sessions still follow one another.
    return formatted.select("conv_id", "session", "formatted", "spans").mapInArrow(run, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts look like control strings."""
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
