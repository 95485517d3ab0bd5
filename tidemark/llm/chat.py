"""Chat formatting: typed content parts, a template with escaped control strings, and a loss mask.

A turn's content is a text or a list of typed parts.  A visitor flattens the
parts in order: texts are escaped, every image, audio clip, document or other
file leaves a placeholder, its reference, and the number of tokens that the
placeholder stands for.  Control strings inside texts and roles get one more
backslash behind their first character, so the template's own marks are the
only ones without, and formatting can be undone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import common as c
from tidemark.llm.turns import by_conversation

OPEN, CLOSE, TURN, TEXT = "<s>", "</s>", "[TURN]", "[TEXT]"
#: Strings that steer a model: this template's marks, and those of other templates.
CONTROL = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[TEXT]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: What follows the first character; a placeholder's mark carries its number.
_TAILS = "|".join(re.escape(s[1:]) for s in sorted(CONTROL, key=len, reverse=True)) + r"|(?:IMAGE|AUDIO|DOCUMENT|FILE):\d+\]"
ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})", re.A)
UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})", re.A)
PLACE = re.compile(r"\[(IMAGE|AUDIO|DOCUMENT|FILE):(\d+)\]", re.A)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder becomes; a missing or negative measure counts as none, and each is at least one token."""
    patch: int = 28            # pixels of an image patch's side
    audio_rate: float = 12.5   # tokens a second
    page: int = 256            # tokens a page

    def image(self, part: Mapping) -> int:
        return math.ceil(measure(part, "width") / self.patch) * math.ceil(measure(part, "height") / self.patch)

    def audio(self, part: Mapping) -> int:
        return math.ceil(measure(part, "seconds") * self.audio_rate)

    def document(self, part: Mapping) -> int:
        return math.ceil(measure(part, "pages")) * self.page

    def file(self, part: Mapping) -> int:
        return 1


def measure(part: Mapping, name: str) -> float:
    x = part.get(name)
    return x if x is not None and math.isfinite(x) and x > 0 else 0


@dataclass
class Flattener:
    """Visits the parts of a conversation in order and collects its formatted text, loss mask and attachments."""
    expansion: Expansion = field(default_factory=Expansion)
    trained: tuple[str, ...] = ("assistant",)
    out: list[str] = field(default_factory=list)
    at: int = 0
    mask: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def turn(self, number: int, role: str, parts: Sequence[Mapping]) -> None:
        self.write(OPEN + TURN + escape(role) + TEXT)
        for part in parts:
            self.visit(number, role, part)
        self.write(CLOSE)

    def visit(self, number: int, role: str, part: Mapping) -> None:
        kind = (part.get("kind") or "text").lower()
        if kind == "text":
            self.text(role, part.get("text") or "")
        else:
            self.attach(number, kind if kind in ("image", "audio", "document") else "file", part)

    def text(self, role: str, text: str) -> None:
        start = self.at
        self.write(escape(text))
        if role in self.trained and self.at > start:
            self.mask.append({"start": start, "end": self.at})

    def attach(self, number: int, kind: str, part: Mapping) -> None:
        k = len(self.attachments) + 1
        tokens = max(1, getattr(self.expansion, kind)(part))
        self.attachments.append({"number": k, "kind": kind, "ref": part.get("ref"), "turn": number, "start": self.at, "tokens": tokens})
        self.write(f"[{kind.upper()}:{k}]")


SPAN = T.ArrayType(c.struct(("start", c.LONG), ("end", c.LONG)))
ATTACHED = T.ArrayType(c.struct(("number", c.LONG), ("kind", c.STRING), ("ref", c.STRING), ("turn", c.LONG), ("start", c.LONG), ("tokens", c.LONG)))
FORMATTED = (("formatted", c.STRING), ("mask", SPAN), ("attachments", ATTACHED), ("placeholder_tokens", c.LONG))


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text",
                 expansion: Expansion = Expansion(), trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv, formatted, mask, attachments, placeholder_tokens): a row per conversation.

    ``content_col`` holds texts, or lists of parts: structs with ``kind``
    (text, image, audio, document; any other is a file) and, as far as they
    apply, ``text``, ``ref``, ``width``, ``height``, ``seconds`` and ``pages``.
    ``mask`` are the code-point ranges, end exclusive, of the texts of trained
    roles; placeholders and marks are never under it.  ``attachments`` number
    the placeholders in order, with their turn (from 0), place and tokens.
    Rows are taken by turn, null turns first, those of one turn by role and
    text.  A null text, list, part or role is empty; rows with a null id are one
    conversation; repeated rows are turns of their own; an empty table gives an
    empty result; other columns are not read.  A conversation is formatted as a
    whole in one task.
    """
    typed = isinstance(df.schema[content_col].dataType, T.ArrayType)
    rows = c.only(df, conv=conv_col, turn=turn_col, role=role_col, content=content_col)
    text = F.to_json("content") if typed else F.col("content")
    rows = rows.select("conv", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), *(["content"] if typed else []))

    def solve(rows: list[dict]) -> tuple:
        flat = Flattener(expansion, tuple(trained))
        for number, r in enumerate(rows):
            flat.turn(number, r["role"], [p for p in r["content"] or [] if p] if typed else [{"text": r["text"]}])
        return "".join(flat.out), flat.mask, flat.attachments, sum(a["tokens"] for a in flat.attachments)
    return by_conversation(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], solve, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """The turns of a formatted conversation: role, and parts as (``text``, text) or (kind, number)."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, body = turn[len(OPEN + TURN):].split(TEXT, 1)
        parts, at = [], 0
        for m in PLACE.finditer(body):
            parts += [("text", unescape(body[at:m.start()]))] * (m.start() > at) + [(m[1].lower(), m[2])]
            at = m.end()
        parts += [("text", unescape(body[at:]))] * (at < len(body))
        out.append((unescape(role), parts))
    return out


READ = (("turns", T.ArrayType(c.struct(("role", c.STRING), ("text", c.STRING)))), ("loss", c.STRING))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, formatted, turns, loss): the turns read from the formatted text alone, and the text under the loss mask.

    A placeholder is read as it stands in the text.  An empty text has no turns.
    """
    src = formatted.select("conv", "formatted", "mask")
    schema = c.struct(("conv", c.column_type(src, "conv")), ("formatted", c.STRING), *READ)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.small(batches, "formatted"):
            whole = b.column("formatted").to_pylist()
            turns = [[{"role": role, "text": "".join(x if k == "text" else f"[{k.upper()}:{x}]" for k, x in parts)} for role, parts in read_turns(t)] for t in whole]
            loss = ["".join(unescape(t[s["start"]:s["end"]]) for s in spans) for t, spans in zip(whole, b.column("mask").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("formatted"), pa.array(turns, kind), pa.array(loss, pa.string())], names=schema.names)
    return src.mapInArrow(task, schema)
