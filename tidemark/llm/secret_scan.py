"""Secret scans: fixed credential patterns, and sliding-window Shannon entropy with an allow list."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tidemark.llm import common as c

# --- fixed values: the base patterns ---
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
# --- end of fixed values ---

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Character class, the runs of it that hold a window, and the bits per character a window must reach.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    ("upper", re.compile(r"[0-9A-Z]{20,}"), 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.75),
)
#: High-entropy strings that are no secrets: UUIDs, numbers with separators, paths of words, dotted hosts.
#: Neighbouring parts share no character and give nothing back, so a match takes one pass.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"[0-9+/_=-]++",
    r"[A-Za-z]++(?:[/_=+-]++[A-Za-z]*+)*+\d{0,4}+",
    r"[/_=+-]*+[A-Za-z]++\d{0,4}+(?:[/_=+-]++(?:[A-Za-z]++\d{0,4}+|\d{1,8}+))*+[/_=+-]*+",
)
URL = re.compile(r"[a-z][a-z0-9+.-]*://\S*$|www\.\S*$", re.I)
#: Where a URL's own text ends and what follows is another word.
URL_END = re.compile(r"[\s\"'<>]|$")
#: Words of a URL whose path holds a credential; other path segments are names of things.
HOOK = re.compile(r"(?:^|[./_-])(?:(?:web)?hooks?|tokens?|secrets?|auth|bot\d+:)", re.I)
#: Characters before a candidate that are looked at.
BEFORE = 2_000
#: Digests are published on purpose.
DIGEST = re.compile(r"(?:sha-?\d+|md5|digest|checksum|integrity|commit)\W{0,3}$", re.I)


def hot_windows(s: str, limit: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged [start, end) runs of windows whose entropy reaches ``limit``.

    The sum of n log n over the counts changes by two terms per step, so a
    string costs time in proportion to its length.
    """
    if len(s) < width:
        return []
    term = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    count: dict[str, int] = {}
    total, top, found = 0.0, math.log2(width), []
    for i, ch in enumerate(s):
        if i >= width:  # first out, then in: a count never exceeds the window
            old = s[i - width]
            n = count[old]
            total += term[n - 1] - term[n]
            count[old] = n - 1
        n = count.get(ch, 0)
        total += term[n + 1] - term[n]
        count[ch] = n + 1
        if i >= width - 1 and top - total / width >= limit - 1e-9:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def in_path(url: str, rest: str) -> bool:
    """Whether a place of a URL, after ``url`` and before ``rest``, is a path segment that names a thing.

    Names and passwords before the host, parameters, fragments and the paths of
    hooks are none.
    """
    after = re.split(r"://|^www\.", url, maxsplit=1, flags=re.I)[-1]
    if "?" in after or "#" in after or "&" in after or HOOK.search(after):
        return False
    here = rest[:URL_END.search(rest).start()]
    return "/" in after or "@" not in re.split(r"[/?#]", here, maxsplit=1)[0]


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hot_runs(s: str) -> list[tuple[int, int]]:
    """Hot windows of the maximal runs of each class, by the limit of the class; those that overlap as one."""
    return joined([(m.start() + a, m.start() + b) for _, pattern, bits in CLASSES for m in pattern.finditer(s) for a, b in hot_windows(m[0], bits)])


def url_parts(s: str, allow: re.Pattern) -> list[tuple[int, str]]:
    """Stretches of a candidate in a URL between segments that are allowed."""
    out, begin = [], 0
    for m in re.finditer(r"[^/]+", s):
        if allow.fullmatch(m[0]):
            out.append((begin, s[begin:m.start()]))
            begin = m.end()
    return [(at, part) for at, part in [*out, (begin, s[begin:])] if len(part) >= WINDOW]


def spans(text: str, allow: re.Pattern) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; entropy spans that touch a base span are part of it."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or allow.fullmatch(s):
            continue
        before = text[max(0, m.start() - BEFORE):m.start()]
        if DIGEST.search(before[-16:]):
            continue
        parts = [(0, s)]
        if url := URL.search(before):
            if in_path(url[0], text[m.end():m.end() + BEFORE]):
                continue
            parts = url_parts(s, allow)
        for a, b in [(at + a, at + b) for at, part in parts for a, b in hot_runs(part)]:
            a, b = m.start() + a, m.start() + b
            mixed = any(ch.isdigit() for ch in text[a:b]) and any(ch.isalpha() for ch in text[a:b])
            if mixed and not any(x < b and a < y for _, x, y in base):
                more.append(("entropy", a, b))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def allow_list(extra: Sequence[str] = ()) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in (*ALLOWED, *extra)))


SPANS = T.ArrayType(c.struct(("kind", c.STRING), ("start", c.LONG), ("end", c.LONG)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ()) -> DataFrame:
    """(id, spans): every secret of every whole text, as code-point spans, end exclusive.

    ``allow`` adds patterns of whole strings that are no secrets.  A null or
    empty text has no spans; repeated rows give repeated results; an empty
    table an empty one; other columns are not read.
    """
    src = c.only(df, id=id_col, text=text_col)
    pattern = allow_list(allow)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.small(batches):
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t, pattern)] for t in c.texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, arrow)], ["id", "spans"])
    return src.mapInArrow(task, c.struct(("id", c.column_type(src, "id")), ("spans", SPANS)))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", allow: Sequence[str] = ()) -> DataFrame:
    """The same rows and columns; each secret becomes ``[SECRET]`` and the length follows.

    Overlapping spans are masked as one.  Rows without a secret are unchanged, null texts stay null.
    """
    pattern = allow_list(allow)
    names = df.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def mask(text: str | None) -> str | None:
        if not text or not (found := spans(text, pattern)):
            return text
        out, done = [], 0
        for _, a, b in found:
            if a >= done:
                out += [text[done:a], "[SECRET]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.small(batches, at):
            old = b.column(at).to_pylist()
            new = [mask(t) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if length is not None:
                sizes = [n if x == y else len(y) for x, y, n in zip(old, new, b.column(length).to_pylist())]
                cols[length] = pa.array(sizes, b.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return c.map_rows(df, task)
