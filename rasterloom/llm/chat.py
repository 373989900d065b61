"""Conversations as training text with marked turns and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.templates import compile_template

TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
#: Characters of a formatted row beyond which a conversation goes on in another row.
ROW = 1 << 16

_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?))</s>", re.S)
_MARKED = re.compile(r"\\(\\?)")


def escape(text: str | None, control: tuple[str, ...] = CONTROL) -> str:
    """Double backslashes, then break every control string by one after its first letter."""
    text = (text or "").replace("\\", "\\\\")
    for c in control:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _MARKED.sub(r"\1", text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _format(template: str, control: tuple[str, ...], width: int):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.list_(pa.int64())))])

    def parts(conv, messages: Iterator[dict], render) -> Iterator[tuple]:
        text, spans, size, part = [], [], 0, 0
        for piece, generated in render(messages=messages):
            if size + len(piece) > width and size:
                yield conv, part, "".join(text), spans
                text, spans, size, part = [], [], 0, part + 1
            if generated and piece:
                spans.append([size, size + len(piece)])
            text.append(piece)
            size += len(piece)
        yield conv, part, "".join(text), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": lambda v: escape(v, control)})
        out, size = [], 0
        for (_, conv), turns in groupby(_rows(batches), key=lambda r: r[:2]):
            for row in parts(conv, ({"role": r[3] or "", "text": r[4] or ""} for r in turns), render):
                out.append(row)
                size += len(row[2])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL, width: int = ROW, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render every conversation: ``conv_id, part, text, loss``.

    ``loss`` has ``[start, end)`` code-point spans of the generated texts in the row.  A
    conversation of more than ``width`` characters goes on in further parts; a piece of
    the template's output is never parted, so no span is.  Rows follow one another by
    conversation and part within a partition.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of
    their own.  Null roles and texts are empty.  Rows with a null conversation id are one
    conversation.  Texts are formatted whole; an empty table gives an empty result.  Other columns play no part.
    """
    conv = F.col(f"`{conv_col}`").cast("long")
    rows = turns.select(conv.isNull().alias("none"), conv.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartition("none", "conv").sortWithinPartitions("none", "conv", "turn", "role", "text")
    return rows.mapInArrow(_format(template, control, width), "conv_id long, part long, text string, loss array<array<long>>")


def parse_turns(parts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted conversation, given in parts."""
    held = ""
    for part in parts:
        held += part
        at = 0
        for m in _TURN.finditer(held):
            at = m.end()
            yield unescape(m[1]), unescape(m[3] if m[2] is None else m[2])
        held = held[at:]
    if held:
        raise ValueError(f"{held[:40]!r} is no turn")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    out: list[tuple] = []
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        turns, loss, n, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def texts(rows=rows, loss=loss) -> Iterator[str]:
            nonlocal lost, chars
            for _, _, text, spans in rows:
                chars += len(text)
                for s, e in spans:
                    plain = unescape(text[s:e])
                    lost += len(plain)
                    loss.update(plain.encode())
                yield text

        for role, text in parse_turns(texts()):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True))))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts of formatted rows in order, as counts and digests."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
