"""HTML to text, as chains of native string expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import ENTITIES

BREAK = "\n"


def decode_entities(text: Column, ignore_case: bool = False) -> Column:
    """The seven entities, each decoded once: '&amp;' last, so that its result
    never takes part in another entity."""
    for entity, value in [e for e in ENTITIES if e[0] != "&amp;"] + [("&amp;", "&")]:
        text = F.regexp_replace(text, "(?i)" + entity, value) if ignore_case else F.replace(text, F.lit(entity), F.lit(value))
    return text


def strip_html(html: Column) -> Column:
    """Tags to blanks, entities decoded, whitespace collapsed."""
    text = decode_entities(F.regexp_replace(html, "<[^>]+>", " "))
    return F.when(F.length(html) > 0, F.trim(F.regexp_replace(text, r"[\s ]+", " ")))


def html_to_text(html: Column) -> Column:
    """Structure-preserving text: block ends become line breaks, list items
    dashes; text without any tag is returned as it is."""
    t = F.regexp_replace(html, r"<!--[\s\S]*?-->", " ")
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|tr|h[1-6]|blockquote)>", BREAK)
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", BREAK)
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", BREAK + "- ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, value in ENTITIES:
        t = F.regexp_replace(t, "(?i)" + entity, value)
    t = numeric_entities(t)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" *\n *", BREAK)
    t = F.regexp_replace(t, r"\n{3,}", BREAK * 2)
    return F.when(html.rlike("(?i)<[a-z!/]"), t).otherwise(html)


def numeric_entities(text: Column) -> Column:
    """Decimal character references decoded.

    The text is cut at the references and put together again, so each piece is
    looked at once."""
    pieces = F.split(text, r"&#\d+;")
    codes = F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1))
    # bytes of the code point in UTF-16, decoded as text
    chars = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.try_cast("bigint") % 65536), 4, "0")), "UTF-16BE"))
    joined = F.array_join(F.zip_with(pieces, F.concat(chars, F.array(F.lit(""))), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(F.size(codes) > 0, joined).otherwise(text)


def article_text(html: Column, min_chars: int = 40, limit: int = 50_000) -> Column:
    """Paragraph text of a page: page furniture dropped, long paragraphs kept."""
    t = html
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    raw = F.regexp_extract_all(t, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    plain = F.transform(raw, lambda p: F.trim(F.regexp_replace(decode_entities(F.regexp_replace(p, "<[^>]+>", " ")), r"[\s ]+", " ")))
    return F.substring(F.array_join(F.filter(plain, lambda p: F.length(p) > min_chars), "\n"), 1, limit)
