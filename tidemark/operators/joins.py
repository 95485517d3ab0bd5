"""Joins the programs perform: anti joins, candidate probes and name lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .selection import top_per_key


def normalize_url(url: Column) -> Column:
    """Query, fragment and trailing slashes dropped, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", ""), "/+$", ""))


def dedup_key(title: Column, company: Column, location: Column | None = None) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, company, location if location is not None else F.lit(""))]
    text = F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def anti_applied(postings: DataFrame, applied: DataFrame, url: str = "apply_url") -> DataFrame:
    """Postings whose normalised url and title+company key are both unknown to
    the applied log.  Each index is distinct before its anti join, so a hot
    key in the log cannot multiply work."""
    urls = applied.select(normalize_url(F.col("url")).alias("_u")).filter(F.col("_u") != "").distinct()
    keys = applied.select(dedup_key(F.col("title"), F.col("company")).alias("_k")).distinct()
    p = postings.withColumn("_u", normalize_url(F.col(url))).withColumn("_k", dedup_key(F.col("title"), F.col("company")))
    return p.join(urls, "_u", "left_anti").join(keys, "_k", "left_anti").drop("_u", "_k")


def applied_flag(postings: DataFrame, applied: DataFrame, key: str, url: str = "apply_url") -> DataFrame:
    """The postings with an ``applied`` column by the same two rules."""
    urls = applied.select(normalize_url(F.col("url")).alias("_u")).filter(F.col("_u") != "").distinct().withColumn("_hu", F.lit(True))
    keys = applied.select(dedup_key(F.col("title"), F.col("company")).alias("_k")).distinct().withColumn("_hk", F.lit(True))
    p = postings.withColumn("_u", normalize_url(F.col(url))).withColumn("_k", dedup_key(F.col("title"), F.col("company")))
    j = p.join(urls, "_u", "left").join(keys, "_k", "left")
    return j.withColumn("applied", F.coalesce("_hu", F.lit(False)) | F.coalesce("_hk", F.lit(False))).drop("_u", "_k", "_hu", "_hk")


def anti_existing(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return candidates.join(stored.select(key).distinct(), key, "left_anti")


def slug_candidates(company: Column) -> Column:
    """Joined and hyphenated slug of a company name, distinct and non-empty."""
    clean = F.trim(F.regexp_replace(F.lower(company), r"[^a-z0-9\s-]", ""))
    both = F.array(F.regexp_replace(clean, r"\s+", ""), F.regexp_replace(clean, r"\s+", "-"))
    return F.array_distinct(F.filter(both, lambda s: s != ""))


def cross_probe(companies: DataFrame, platforms: list[str], overrides: DataFrame, cache: DataFrame, now: Column,
                cache_days: int = 30, force: bool = False) -> DataFrame:
    """(company, platform, slug) still to probe.

    The platform list is a short literal, so each company emits its own few
    candidates.  Overrides always win; cached answers, hits and misses alike,
    hold for ``cache_days``; errors are not in the cache.
    """
    todo = companies.select("company", F.explode(F.array(*[F.lit(p) for p in platforms])).alias("platform"))
    todo = todo.join(overrides.select("company", "platform").distinct(), ["company", "platform"], "left_anti")
    if not force:
        age = (now.cast("double") - F.col("checked_at").cast("timestamp").cast("double")) / 86400
        fresh = cache.filter((F.col("origin") == "override") | (age < cache_days))
        todo = todo.join(fresh.select("company", "platform").distinct(), ["company", "platform"], "left_anti")
    return todo.select("company", "platform", F.explode(slug_candidates(F.col("company"))).alias("slug"))


# Ticker shape and the company suffixes a name may end in.
TICKER = r"^\^?[A-Z]{1,6}(?:[.\-][A-Z]{1,4})?$"
NAME_SUFFIX = r"\s+(inc|corp|corporation|company|co|ltd|plc|sa|nv|ag)\.?$"


def company_name(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9&' ]", ""))
    return F.regexp_replace(clean, NAME_SUFFIX, "")


def ticker_lookup(queries: DataFrame, aliases: DataFrame, text: str = "query", limit: int = 5) -> DataFrame:
    """Ranked symbols per free text: literal 1.0, alias 0.9, substring 0.7.

    Substring either way is an equi-join on a shared four-letter piece (both
    sides hold at least four letters when one contains the other), so no pair
    is formed that shares no piece.  Texts are reduced to distinct names first.
    """
    names = queries.select(F.col(text), F.trim(text).alias("_t")).distinct().withColumn("_n", company_name(F.col("_t")))
    literal = names.filter(F.col("_t").rlike(TICKER)).select(text, F.upper("_t").alias("symbol"), F.lit(1.0).alias("confidence"), F.lit("literal").alias("source"))
    a = aliases.select(F.lower("alias").alias("alias"), "symbol")
    exact = names.join(a, names["_n"] == a["alias"]).select(text, "symbol", F.lit(0.9).alias("confidence"), F.lit("alias").alias("source"))

    def pieces(c: Column) -> Column:
        n = F.length(c)
        return F.when(n >= 4, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substring(c, i, 4))))

    # the shorter side's first piece lies inside the longer side
    by_name = names.filter(F.length("_n") >= 4).select(text, "_n", F.substring("_n", 1, 4).alias("_p"))
    alias_pieces = a.select("alias", "symbol", F.explode(pieces(F.col("alias"))).alias("_p"))
    inside = by_name.join(alias_pieces, "_p").filter(F.col("alias").contains(F.col("_n")))
    alias_first = a.filter(F.length("alias") >= 4).select("alias", "symbol", F.substring("alias", 1, 4).alias("_p"))
    name_pieces = names.filter(F.length("_n") >= 4).select(text, "_n", F.explode(pieces(F.col("_n"))).alias("_p"))
    around = name_pieces.join(alias_first, "_p").filter(F.col("_n").contains(F.col("alias")))
    # aliases shorter than a piece are found by their whole text
    short = a.filter(F.length("alias") < 4)
    runs = names.filter(F.length("_n") >= 4).select(text, "_n", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("_n")), lambda i: F.array(*[F.substring(F.col("_n"), i, F.lit(k)) for k in (1, 2, 3)]))))).alias("alias"))
    tiny = runs.join(short, "alias")
    partial = (inside.select(text, "symbol").unionByName(around.select(text, "symbol")).unionByName(tiny.select(text, "symbol"))
               .select(text, "symbol", F.lit(0.7).alias("confidence"), F.lit("alias-partial").alias("source")))
    found = literal.unionByName(exact).unionByName(partial)
    best = top_per_key(found, [text, F.upper("symbol")], [F.desc("confidence"), "source"], 1)
    return top_per_key(best, [text], [F.desc("confidence"), "symbol"], limit, rank="rank")
