"""Main-text extraction by maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score +1 in the open and
negatively inside furniture (menus, forms, adverts, comments of readers); tags
score negatively, with weights learned from pages whose markup labels the
article.  Furniture that is marked as such is left out wherever it stands.
One linear scan (the running sum restarted below zero) finds the
contiguous region of greatest score; its blocks, without furniture, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common as c

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
FORM = re.compile(r"<(?:form|fieldset)\b", re.I)
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# --- fixed values: element names of HTML ---
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
FURNITURE = frozenset("head nav aside form footer menu dialog button select option fieldset label input search".split())
#: Wrappers of controls; some pages stand in one as a whole.
FORMS = frozenset("form fieldset".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# --- end of fixed values ---

#: Words in class, id and role attributes that mark furniture.
MARKS = re.compile(r"""(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|promo|promoted|promotion|sponsor|sponsored|banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|aside|widget|related|recommended|
share|sharing|social|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|commentlist|replies|reply|respond|disqus|footer|contentinfo|complementary|pagination|pager|toolbar|skip|copyright|legal)(?:$|[\s_-])""".replace("\n", ""), re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|site-head)(?:$|[\s_-])", re.I)

#: A word in the open, a word of marked furniture and a tag of it: these are left out anyway and only part regions.
WORD, INSIDE, INSIDE_TAG = 1.0, -0.1, -0.25
#: Weights without training; ``fit`` learns them from labelled pages.
DEFAULT = {"": -1.5, "p": -0.5, "b": -0.25, "i": -0.25, "em": -0.25, "strong": -0.25, "br": -0.25, "span": -0.25, "a": -2.0, "li": -1.5, "ul": -2.0, "div": -2.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "article": -0.25, "main": -0.25, "h1": -0.5, "h2": -0.5, "h3": -0.5}


def events(page: str, marked: bool = True, forms: bool = True) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """(kind, value, inside furniture, inside an article, block) in page order; kind is text or tag.

    ``marked``: whether attributes mark furniture too, not only element names.
    ``forms``: whether a form is furniture, not only the controls in it.  An
    article inside a form is none, unless other furniture holds it.
    Elements left open end with the parent or, for paragraphs and items, with
    the next one; a closing tag without an opening one is ignored.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, in an article, furniture through a form alone
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        stop = m.start() if m else n
        bad, art, form = stack[-1][1:] if stack else (False, False, False)
        if stop > at:
            yield "text", page[at:stop], bad, art, False
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()  # the second form: a tag with a quote left open
        attributes = m[3] or ""
        if not name:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            yield "tag", name, bad, art, name in BLOCK
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            yield "tag", name, True, art, False
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        bad, art, form = stack[-1][1:] if stack else (False, False, False)
        if form and name in ("article", "main"):
            bad = form = False
        if not bad or form:
            marks = " ".join(x or y or z for x, y, z in ATTRIBUTE.findall(attributes)) if attributes and marked else ""
            own = name in FURNITURE and name not in FORMS or bool(marks and name not in ("html", "body", "article", "main") and MARKS.search(marks))
            if not own and not art:
                own = name == "header" or bool(marks and name != "article" and HEADER.search(marks))
            form = not own and (form or forms and name in FORMS)
            bad = own or form
        art = art or name in ("article", "main")
        yield "tag", name, bad, art, name in BLOCK
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, bad, art, form))


def region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the greatest sum; the earliest, longest on ties; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += x
        if total > best or total == best > 0 and start == span[0]:
            best, span = total, (start, i + 1)
    return span


def extract(page: str, weights: Mapping[str, float] = DEFAULT) -> str:
    """The main text of one page: blocks joined by a line break.

    Where attributes mark everything as furniture, as wrappers named after
    their sidebar do, only element names count.  Where a form holds all there
    is, only its controls are furniture.
    """
    text = text_of(list(events(page)), weights) or text_of(list(events(page, False)), weights)
    if not text and FORM.search(page):
        text = text_of(list(events(page, True, False)), weights) or text_of(list(events(page, False, False)), weights)
    return text


def text_of(seen: list[tuple[str, str, bool, bool, bool]], weights: Mapping[str, float]) -> str:
    other = weights.get("", -1.5)
    # white space and references do not matter for the score; a word is a run of non-space
    scores = [len(v.split()) * (INSIDE if bad else WORD) if k == "text" else INSIDE_TAG if bad else weights.get(v, other) for k, v, bad, _, _ in seen]
    a, b = region(scores)
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()
    # the region grows to whole blocks, and inside a labelled article to its ends
    while b < len(seen) and b > a and seen[b - 1][3] and seen[b][3]:
        b += 1
    while a > 0 and b > a and seen[a][3] and seen[a - 1][3]:
        a -= 1
    while a > 0 and not (seen[a - 1][0] == "tag" and seen[a - 1][4]):
        a -= 1
    while b < len(seen) and not (seen[b][0] == "tag" and seen[b][4]):
        b += 1
    for kind, value, bad, _, block in seen[a:b]:
        if kind == "text":
            if not bad:
                now.append(value)
        elif block:
            close()
        elif value == "br":
            now.append(" ")
    close()
    return "\n".join(blocks)


def fit(pages: DataFrame, limit: int = 400, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Tag weights from at most ``limit`` pages (first by a hash of the id) whose markup labels the article.

    A tag's weight is more negative the rarer it is inside articles than
    outside; no tag is positive.  Pages without a label teach nothing, and
    without any labelled page the defaults stand.
    """
    src = c.only(pages, id=id_col, html=html_col)
    chosen = c.label_sample(src.select("id").filter(F.col("id").isNotNull()).distinct(), limit)
    sample = src.join(F.broadcast(chosen), "id", "left_semi").filter(F.col("html").rlike("(?i)<(article|main)[ >]"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                for kind, value, bad, art, _ in events(page):
                    name = value if kind == "tag" else "#words"
                    (inside if art and not bad else outside)[name] += 1 if kind == "tag" else len(value.split())
        names = sorted(set(inside) | set(outside))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], ["tag", "inside", "outside"])
    schema = c.struct(("tag", c.STRING), ("inside", c.LONG), ("outside", c.LONG))
    rows = sample.mapInArrow(task, schema).groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy(F.desc(F.col("i") + F.col("o"))).limit(500).collect()
    words = next((r for r in rows if r["tag"] == "#words"), None)
    weights = dict(DEFAULT)
    if not words or not words["i"]:
        return weights
    base = math.log((words["o"] + 1) / (words["i"] + 1))
    for r in rows:
        if r["tag"] != "#words":
            odds = math.log((r["o"] + 1) / (r["i"] + 1)) - base  # how much more often outside than a word is
            weights[r["tag"]] = -min(8.0, max(0.25, odds))
    return weights


def main_text(pages: DataFrame, weights: Mapping[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every page, from its whole html.

    A null, empty or word-less page gives an empty text; unclosed elements end
    with their parent; repeated rows give repeated results; extra columns are not read.
    """
    src = c.only(pages, id=id_col, url=url_col, html=html_col)
    weights = dict(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                text = [extract(p, weights) for p in c.texts(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(text, pa.string())], ["id", "url", "text"])
    return src.mapInArrow(task, c.struct(("id", c.column_type(src, "id")), ("url", c.STRING), ("text", c.STRING)))
