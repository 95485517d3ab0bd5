"""Token, claim and skill expressions, all native."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import fixed


@dataclass(frozen=True)
class Lexicon:
    positive: Sequence[str] = fixed.POSITIVE_TERMS
    negative: Sequence[str] = fixed.NEGATIVE_TERMS
    uncertainty: Sequence[str] = fixed.UNCERTAINTY_TERMS
    forward: Sequence[str] = fixed.FORWARD_TERMS


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def combined_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))))


def stripped(text: Column) -> Column:
    """Without white space at both ends, in one pass: a pattern would start anew at every blank."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def word_count(text: Column) -> Column:
    plain = stripped(text)
    return F.when(F.length(plain) > 0, F.size(F.split(plain, r"\s+"))).otherwise(0)


def words(text: Column, pattern: str = fixed.WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def hits(tokens: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*terms)))


def lexicon_score(tokens: Column, lex: Lexicon) -> Column:
    """(positive - negative) / (positive + negative) over tokens; none gives 0."""
    pos, neg = hits(tokens, lex.positive), hits(tokens, lex.negative)
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))


def mentions(text: Column, terms: Sequence[str]) -> Column:
    """Whether a whitespace-separated word of the text is one of the terms."""
    return F.arrays_overlap(F.split(F.lower(text), r"\s+"), literal_array(terms))


# --- claim tokens ---------------------------------------------------------------

# The tokeniser works on one padded string ("" " tok tok " "") so that each rule is
# a single pass of the regular-expression engine over the text.
_MARK = "\u0001"
_TO_Y = r" ([a-z-]{2,})ies(?= )"
_SUFFIX = (r" (?:([a-z-]+ss)es|([a-z-]{3,}[sxz]|[a-z-]{2,}(?:ch|sh))es|([a-z-]{4,})ingly|([a-z-]{4,})ing|([a-z-]{4,})edly|([a-z-]{4,})ed"
           r"|([a-z-]{4,})es|([a-z-]{3,}ss)|([a-z-]{4,})s)(?= )")


def stem_all(padded: Column) -> Column:
    """Light suffix stemming of every token of a padded string; short tokens and
    tokens with digits or symbols stay.  A token is changed by one suffix rule
    at most, then loses a final e."""
    s = F.regexp_replace(padded, _TO_Y, f" $1y{_MARK}")
    s = F.regexp_replace(s, _SUFFIX, f" $1$2$3$4$5$6$7$8$9{_MARK}")
    return F.replace(F.regexp_replace(s, rf" ([a-z-]{{4,}})e{_MARK}?(?= )", " $1"), F.lit(_MARK), F.lit(""))


def claim_words(text: Column) -> Column:
    """Tokens in order as they stand, without stop words; hyphenated tokens are followed by their parts."""
    s = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9+#./-]+", " "), F.lit(" "))
    s = F.regexp_replace(s, r"(?<= )[-./]+|[-./]+(?= )", "")

    def kept(t: Column) -> Column:
        return (F.length(t) > 1) & ~t.isin(*fixed.CLAIM_STOP_WORDS)

    def expand(t: Column) -> Column:
        return F.when(t.contains("-"), F.concat(F.array(t), F.filter(F.split(t, "-"), kept))).otherwise(F.array(t))
    raw = F.filter(F.split(s, " "), kept)
    return F.when(text.contains("-"), F.flatten(F.transform(raw, expand))).otherwise(raw)


def claim_tokens(text: Column) -> Column:
    """Stemmed tokens in order; hyphenated tokens are followed by their parts."""
    s = stem_all(F.concat(F.lit(" "), F.array_join(claim_words(text), " "), F.lit(" ")))
    return F.filter(F.split(F.trim(s), " +"), lambda t: t != "")


def bigrams(tokens: Column) -> Column:
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


STARTS_BLOCK = r"(?:[-*+]\s|\d+[.)]\s|#{1,6}\s|>\s|\|)"


def claims(text: Column) -> Column:
    """Array of (line, text): blocks of wrapped lines cut into sentences.

    Lines carry their number through one regular expression that joins a line
    to the block above it; blank lines and block markers stop the joining.
    """
    a, b = "\u0001", "\u0002"
    lines = F.split(text, "\r?\n")
    tagged = F.transform(lines, lambda l, i: F.concat(F.lit(a), (i + 1).cast("string"), F.lit(b), stripped(l)))
    joined = F.regexp_replace(F.array_join(tagged, "\n"), rf"(?<=[^\n{b}])\n{a}\d+{b}(?=[^\n])(?!{STARTS_BLOCK})", " ")
    blocks = F.filter(F.split(joined, "\n"), lambda s: ~F.endswith(s, F.lit(b)))

    def cut(block: Column) -> Column:
        line = F.regexp_extract(block, rf"^{a}(\d+){b}", 1).cast("int")
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(block, rf"^{a}\d+{b}", ""), r"^(?:[-*+]|\d+[.)])\s+", ""), r"^#{1,6}\s+", "")
        return F.struct(line.alias("line"), F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+(?=[A-Z(])"), stripped), lambda s: s != "").alias("text"))

    def sentences(block: Column) -> Column:
        return F.transform(block["text"], lambda s: F.struct(block["line"].alias("line"), s.alias("text")))
    return F.flatten(F.transform(F.transform(blocks, cut), sentences))  # the line is read once a block, not once a sentence


def bare_claim(line: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^[\s>*+-]*", ""), r"^#+\s*", ""), r"[*_`]", "")
    return stripped(t)


def substantive(line: Column) -> Column:
    """Stemming leaves the number of tokens as it is."""
    def holds(t: Column) -> Column:
        return (F.length(t) >= 25) & ~t.rlike(r"^-{3,}$|^={3,}$|^\|") & (F.size(claim_words(t)) >= 4)
    return F.element_at(F.transform(F.array(bare_claim(line)), holds), 1)  # the line is made bare once


def numeric_claims(text: Column) -> Column:
    """Numbers of a text in formatted and in bare form."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\d[\d,.]*\s*(?:%|k\+?|m\+?|b\+?|x)?"), F.lit(0))
    norm = F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(m, r"[\s,]", ""), r"\.$", ""))
    bare = F.transform(norm, lambda m: F.regexp_replace(m, r"[^0-9.]", ""))
    return F.array_distinct(F.filter(F.concat(norm, bare), lambda m: m != ""))


# --- skills ---------------------------------------------------------------------

def _escape(phrase: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in phrase)


@dataclass(frozen=True)
class Skill:
    """A label with the phrases (or ready regular expressions) that show it."""

    label: str
    phrases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


def find_skills(text: Column, vocabulary: Sequence[Skill]) -> Column:
    """Labels present in a text; a plain substring test runs before each regex."""
    lower = F.lower(text)

    def present(s: Skill) -> Column:
        tests = [F.contains(lower, F.lit(p.split()[0].lower())) &
                 text.rlike("(?i)(?<![A-Za-z0-9])" + r"[\s-]+".join(_escape(w) for w in p.split()) + "(?![A-Za-z0-9])") for p in s.phrases]
        tests += [text.rlike(p) for p in s.patterns]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out
    return F.array_compact(F.array(*[F.when(present(s), s.label) for s in vocabulary]))


def skill_fit(asked: Column, profile: Sequence[str]) -> Column:
    """Struct (score, have, missing) of asked skills against a profile."""
    mine = literal_array(profile)
    have, missing = F.filter(asked, lambda s: F.array_contains(mine, s)), F.filter(asked, lambda s: ~F.array_contains(mine, s))
    n = F.size(have).cast("double")
    score = F.round(0.5 * (n + 1) / (F.size(asked) + 2) + 0.5 * (1 - F.exp(-n / 4)), 4)
    none = F.array().cast("array<string>")
    some = F.size(asked) > 0
    return F.struct(F.when(some, score).alias("score"), F.when(some, have).otherwise(none).alias("have"), F.when(some, missing).otherwise(none).alias("missing"))


# --- instruction scrub ------------------------------------------------------------

def scrub(raw: Column) -> Column:
    """Struct (text, triggered): instruction-like passages replaced by a marker
    and the names of the rules that fired on the cleaned or the raw text."""
    from .markup import html_to_text
    text = F.regexp_replace(html_to_text(raw), "[​-‏‪-‮⁠-⁤﻿]", "")
    text = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    fired = []
    for name, pattern in fixed.INSTRUCTION_PATTERNS:
        p = pattern if name == "fence-escape" else "(?i)" + fixed.ascii_words(pattern)
        fired.append(F.when(text.rlike(p) | raw.rlike(p), name))
        text = F.regexp_replace(text, rf"(?=(\n?)){p}" if name == "role-marker" else p, ("$1" if name == "role-marker" else "") + fixed.REDACTION)
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.struct(clean.alias("text"), F.array_compact(F.array(*fired)).alias("triggered"))
