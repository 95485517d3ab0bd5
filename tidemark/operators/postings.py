"""Posting pipeline: classify, gate, score, deduplicate, re-judge.

Every rule is a column expression over one row, evaluated cheap title rules
first; only deduplication exchanges rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.dates import is_fresh
from ..functions.tokens import Skill, find_skills, skill_fit
from ..session import cut_lineage
from .joins import applied_flag, dedup_key
from .selection import first_per_key


@dataclass(frozen=True)
class Preferences:
    role_keywords: Sequence[str] = fixed.ROLE_KEYWORDS
    primary_roles: Sequence[str] = fixed.PRIMARY_ROLES
    similar_roles: Sequence[str] = fixed.SIMILAR_ROLES
    level_keywords: Sequence[str] = fixed.LEVEL_KEYWORDS
    grad_keywords: Sequence[str] = fixed.GRAD_KEYWORDS
    timing_keywords: Sequence[str] = fixed.TIMING_KEYWORDS
    excluded_titles: Sequence[str] = fixed.EXCLUDED_TITLES
    synonyms: Mapping[str, str] = field(default_factory=lambda: dict(fixed.SYNONYMS))
    location_weights: Mapping[str, float] = field(default_factory=lambda: dict(fixed.LOCATION_WEIGHTS))
    score_weights: Mapping[str, float] = field(default_factory=lambda: dict(fixed.SCORE_WEIGHTS))
    off_list: str = "drop"
    require_sponsorship: bool = True
    us_penalty: float = fixed.US_PENALTY
    similar_factor: float = fixed.SIMILAR_FACTOR
    resume_weight: float = 0.0
    max_age_days: float | None = None
    archive_after_days: float | None = 60
    experience_cap: int = fixed.EXPERIENCE_CAP


def fixed_digits(x: Column, digits: int = 4) -> Column:
    """A non-negative score to fixed digits, decided on its binary value."""
    return F.floor(x * 10 ** digits + 0.5) / 10 ** digits


# --- phrases ----------------------------------------------------------------------

def expand_synonyms(text: Column, synonyms: Mapping[str, str]) -> Column:
    """Whole-word abbreviations written out.

    The text is cut at its words; each word is looked up once in a map."""
    if not synonyms:
        return text
    word = r"[A-Za-z][A-Za-z0-9+#]*"
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    gaps = F.split(text, word)
    swapped = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w))
    return F.array_join(F.zip_with(gaps, F.concat(swapped, F.array(F.lit(""))), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def _expand_literal(phrase: str, synonyms: Mapping[str, str]) -> str:
    import re
    return re.sub(r"[A-Za-z][A-Za-z0-9+#]*", lambda m: synonyms.get(m.group(0).lower(), m.group(0)), phrase.strip()).strip()


def phrase_pattern(phrases: Sequence[str], synonyms: Mapping[str, str], lead: str = fixed.WORD_START, tail: str = fixed.WORD_END) -> str | None:
    """One alternation for a phrase list; word boundaries only next to word
    characters."""
    parts = []
    for p in phrases:
        term = _expand_literal(p, synonyms)
        if term:
            body = "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in term)
            parts.append((lead if term[0].isalnum() else "") + body + (tail if term[-1].isalnum() else ""))
    return "(?i)" + "|".join(f"(?:{p})" for p in parts) if parts else None


def match_phrases(text: Column, phrases: Sequence[str], synonyms: Mapping[str, str]) -> Column:
    pattern = phrase_pattern(phrases, synonyms)
    if pattern is None:
        return F.lit(False)
    return F.coalesce(expand_synonyms(text, synonyms).rlike(pattern), F.lit(False))


def keyword_prefilter(df: DataFrame, columns: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Rows whose text contains any keyword; no keywords keep all rows."""
    if not keywords:
        return df
    hay = F.lower(F.concat_ws(" ", *columns))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(hay, F.lit(k.lower()))
    return df.filter(hit)


# --- remote ------------------------------------------------------------------------

def any_match(text: Column, patterns: Sequence[str], cased: bool = False) -> Column:
    flag = "" if cased else "(?i)"
    return F.coalesce(text.rlike(flag + fixed.ascii_words("|".join(f"(?:{p})" for p in patterns))), F.lit(False))


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(text.rlike("(?i)" + fixed.ascii_words(p)), F.lit(p)) for p in patterns])


def before_disclaimer(body: Column) -> Column:
    cuts = [F.nullif(F.regexp_instr(body, F.lit("(?i)" + fixed.ascii_words(d))), F.lit(0)) for d in fixed.DISCLAIMERS]
    cut = F.least(*cuts)
    return F.when(cut.isNotNull(), F.substring(body, F.lit(1), cut - 1)).otherwise(body)


def remote_columns(location: Column, status: Column, description: Column) -> dict[str, Column]:
    """The three gates of the remote classifier and their reasons."""
    header = F.concat_ws(" ", F.nullif(location, F.lit("")), F.nullif(status, F.lit("")))
    body = F.coalesce(description, F.lit(""))
    both = F.concat(header, F.lit("\n"), body)
    claims = any_match(header, [fixed.CLAIMS_REMOTE]) | any_match(body, fixed.FULLY_REMOTE)
    fully = any_match(both, fixed.FULLY_REMOTE)
    signal = F.when(any_match(header, [fixed.HYBRID_BARE]), F.lit(fixed.HYBRID_BARE)).otherwise(first_pattern(before_disclaimer(body), fixed.HYBRID_SIGNALS))
    hybrid = signal.isNotNull() & ~fully
    scope = (F.when(any_match(both, fixed.CANADA_SCOPE), "canada")
             .when(any_match(both, fixed.US_SCOPE_CASED, cased=True) | any_match(both, fixed.US_SCOPE), "us")
             .when(any_match(both, fixed.GLOBAL_SCOPE), "global").otherwise("unknown"))
    reasons = F.array_compact(F.array(
        F.when(hybrid, F.concat(F.lit("hybrid signal: "), signal)).when(signal.isNotNull(), F.lit("says fully remote despite a hybrid mention; treated as remote")),
        F.concat(F.lit("scope: "), scope)))
    return {"claims_remote": claims, "is_hybrid": hybrid, "scope": scope, "qualifies": claims & ~hybrid & (scope != "us"), "reasons": reasons}


def evidence(location: Column, status: Column, description: Column) -> Column:
    """Spans (kind, text, place, start, end) behind the verdict."""
    header = F.concat_ws(" ", F.nullif(location, F.lit("")), F.nullif(status, F.lit("")))
    body = F.coalesce(description, F.lit(""))

    def span(kind: str, text: Column, patterns: Sequence[str], place: str, cased: bool = False) -> Column:
        flag = "" if cased else "(?i)"
        patterns = [fixed.ascii_words(p) for p in patterns]
        found = F.coalesce(*[F.when(text.rlike(flag + p), F.struct(F.lit(kind).alias("kind"), F.regexp_substr(text, F.lit(flag + p)).alias("text"), F.lit(place).alias("place"),
                                                                    (F.regexp_instr(text, F.lit(flag + p)) - 1).alias("start"),
                                                                    (F.regexp_instr(text, F.lit(flag + p)) - 1 + F.length(F.regexp_substr(text, F.lit(flag + p)))).alias("end"))) for p in patterns])
        return found
    hybrid = F.coalesce(span("hybrid", header, [fixed.HYBRID_BARE], "header"), span("hybrid", before_disclaimer(body), fixed.HYBRID_SIGNALS, "description"))
    scope = F.coalesce(*[span(f"scope_{n}", t, ps, place, cased) for n, ps, cased in (("canada", fixed.CANADA_SCOPE, False), ("us", fixed.US_SCOPE_CASED, True), ("us", fixed.US_SCOPE, False),
                                                                                     ("global", fixed.GLOBAL_SCOPE, False)) for t, place in ((header, "header"), (body, "description"))])
    return F.array_compact(F.array(span("claims", header, [fixed.CLAIMS_REMOTE], "header"), span("fully_remote", body, fixed.FULLY_REMOTE, "description"), hybrid, scope))


# --- location and scores --------------------------------------------------------------

def location_bucket(location: Column, status: Column, description: Column, prefs: Preferences) -> Column:
    """Highest-weight bucket that matches; null when stated but unmatched."""
    text = F.trim(F.concat_ws(" ", F.nullif(location, F.lit("")), F.nullif(status, F.lit(""))))
    remote = remote_columns(location, status, description)["qualifies"]
    out = F.when(F.length(text) == 0, F.lit("unknown"))
    for bucket in sorted(prefs.location_weights, key=lambda b: -prefs.location_weights[b]):
        hit = remote if bucket == "remote" else any_match(text, fixed.BUCKET_PATTERNS.get(bucket, (r"(?!)",)))
        out = out.when(hit, F.lit(bucket))
    return out


def restricted(title: Column, location: Column, description: Column, bucket: Column, prefs: Preferences) -> Column:
    """Fenced to the US with no word on sponsorship."""
    if not prefs.require_sponsorship:
        return F.lit(False)
    loc = F.coalesce(location, F.lit(""))
    body = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")))
    us = F.coalesce(bucket == "seattle", F.lit(False)) | any_match(loc, [fixed.US_RESTRICTED], cased=True) | any_match(body, [fixed.US_RESTRICTED], cased=True)
    us = us | (F.coalesce(bucket == "remote", F.lit(False)) & any_match(loc, [fixed.US_LOCATION], cased=True) & ~any_match(loc, [r"\bcanada\b"]))
    return us & ~any_match(body, [fixed.SPONSORSHIP])


def location_score(bucket: Column, fenced: Column, prefs: Preferences) -> Column:
    top = max(prefs.location_weights.values()) or 1.0
    weight = F.coalesce(*[F.when(bucket == b, F.lit(float(w) / top)) for b, w in prefs.location_weights.items()], F.lit(0.0))
    return F.when(fenced, weight * prefs.us_penalty).otherwise(weight)


def keyword_score(title: Column, description: Column, prefs: Preferences) -> Column:
    t, d = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    m = lambda c, ps: match_phrases(c, ps, prefs.synonyms)
    primary = prefs.primary_roles or prefs.role_keywords
    every = [*primary, *prefs.similar_roles]
    role = F.when(m(t, primary), 1.0).when(m(t, prefs.similar_roles), prefs.similar_factor).when(m(d, every), 0.4).otherwise(0.0)
    level = F.when(m(t, prefs.level_keywords), 1.0).when(m(d, prefs.level_keywords), 0.5).otherwise(0.0)
    timing = F.when(m(t, prefs.timing_keywords), 1.0).when(m(d, prefs.timing_keywords), 0.7).otherwise(0.0)
    return 0.5 * role + 0.3 * level + 0.2 * timing


def scored(df: DataFrame, prefs: Preferences, vocabulary: Sequence[Skill] = (), profile: Sequence[str] = ()) -> DataFrame:
    """Adds bucket, the part scores and the match score."""
    loc, desc, title = F.col("location"), F.col("description"), F.col("title")
    status = F.col("remote_status") if "remote_status" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("location_bucket", location_bucket(loc, status, desc, prefs))
    df = df.withColumn("unsponsored_us", F.col("location_bucket").isNotNull() & restricted(title, loc, desc, F.col("location_bucket"), prefs))
    df = df.withColumn("_l", F.when(F.coalesce("location_bucket", F.lit("unknown")) == "unknown", 0.0).otherwise(location_score(F.col("location_bucket"), F.col("unsponsored_us"), prefs)))
    df = df.withColumn("_k", keyword_score(title, desc, prefs))
    pref = prefs.score_weights["location"] * F.col("_l") + prefs.score_weights["keyword"] * F.col("_k")
    if prefs.resume_weight > 0 and vocabulary:
        fit = skill_fit(find_skills(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(desc, F.lit(""))), vocabulary), profile)
        df = df.withColumn("_fit", fit).withColumn("resume_score", F.col("_fit.score")).withColumn("resume_skills", F.struct("_fit.have", "_fit.missing")).drop("_fit")
        w = prefs.resume_weight
        score = F.when(F.col("resume_score").isNull(), pref).otherwise((1 - w) * pref + w * F.col("resume_score"))
    else:
        df, score = df.withColumn("resume_score", F.lit(None).cast("double")), pref
    return (df.withColumn("match_score", fixed_digits(score)).withColumn("location_score", fixed_digits(F.col("_l"))).withColumn("keyword_score", fixed_digits(F.col("_k"))).drop("_l", "_k"))


# --- gate ---------------------------------------------------------------------------

def max_years(description: Column) -> Column:
    """Highest "N[-M]+ years" with "experience" within sixty characters.

    The text is cut at its year mentions.  Each mention sees the last sixty
    characters before it and the first sixty after it, whatever they hold.
    """
    p = "(?i)" + fixed.ascii_words(fixed.YEARS_MENTION)
    n = fixed.EXPERIENCE_CHARS
    found = F.regexp_extract_all(description, F.lit(p), F.lit(0))
    low = F.regexp_extract_all(description, F.lit(p), F.lit(1))
    high = F.regexp_extract_all(description, F.lit(p), F.lit(2))
    gaps = F.split(description, p)

    def starts() -> Column:
        """0-based start of every mention: gap and mention lengths added up."""
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(steps, zero, lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["g"])).alias("out")), lambda s: s["out"])

    rows = F.arrays_zip(starts().alias("at"), found.alias("m"), low.alias("lo"), high.alias("hi"))

    def years(x: Column) -> Column:
        begin = F.greatest(F.lit(0), x["at"] - n)
        near = F.substring(description, begin + 1, x["at"] + F.length(x["m"]) + n - begin)
        lo, hi = x["lo"].try_cast("bigint"), F.nullif(x["hi"], F.lit("")).try_cast("bigint")
        return F.when(near.rlike("(?i)experience"), F.greatest(lo, hi))
    return F.array_max(F.transform(rows, years))


def gate_reason(df: DataFrame, prefs: Preferences, now: Column) -> Column:
    """First failing rule, null when the posting is kept."""
    title = F.coalesce("title", F.lit(""))
    years = max_years(F.col("description"))
    fresh = is_fresh(F.col("posted_date"), F.col("first_seen_at"), now, prefs.max_age_days)
    role = match_phrases(title, prefs.role_keywords, prefs.synonyms) | match_phrases(title, prefs.grad_keywords, prefs.synonyms)
    off = F.col("location_bucket").isNull() if prefs.off_list == "drop" else F.lit(False)
    return (F.when(~fresh, "stale").when(match_phrases(title, prefs.excluded_titles, prefs.synonyms), "seniority").when(~role, "off-role")
            .when(F.coalesce(years > prefs.experience_cap, F.lit(False)), "experience").when(off, "off-location"))


def gated(df: DataFrame, prefs: Preferences, now: Column, **kw) -> DataFrame:
    s = scored(df, prefs, **kw)
    return s.withColumn("reason", gate_reason(s, prefs, now))


# --- duplicates -----------------------------------------------------------------------

def dedup_exact(df: DataFrame, url: str = "apply_url", order: Sequence[str] = ("first_seen_at", "id")) -> DataFrame:
    return first_per_key(df, [url], list(order))


def pieces(keys: DataFrame) -> DataFrame:
    """Adds a row per three-letter piece ``g`` of a key padded on both sides; a
    repeated piece is numbered, so every position counts."""
    padded = F.concat(F.lit("##"), F.col("key"), F.lit("##"))
    cut = F.transform(F.sequence(F.lit(1), F.length("key") + 2), lambda i: F.substring(padded, i, F.lit(3)))
    rows = keys.select("*", F.posexplode(cut).alias("_at", "_g"))
    nth = F.row_number().over(W.partitionBy("key", "_g").orderBy("_at"))
    return rows.withColumn("g", F.concat("_g", nth.cast("string"))).drop("_at", "_g")


def rare_pieces(keys: DataFrame, threshold: float) -> DataFrame:
    """(key, _t, _n, g): for each key its rarest pieces, one more than the edits allowed can change.

    One edit changes at most three padded pieces, so two keys within d edits
    share all but 3d of their numbered pieces; when each key keeps only its
    rarest 3d + 1 pieces, a pair within the distance still meets on one of them.
    """
    every = pieces(keys)
    freq = every.groupBy("g").agg(F.count("*").alias("_f"))
    # the longest partner of a key of length n has n / (1 - t) letters
    allowed = F.floor(F.floor(F.col("_n") / (1 - threshold) + 1e-9) * threshold + 1e-9).cast("int")
    ranked = every.join(freq, "g").groupBy("key", "_t", "_n").agg(F.array_sort(F.collect_list(F.struct("_f", "g"))).alias("_gs"))
    return ranked.select("key", "_t", "_n", F.explode(F.slice("_gs", 1, 3 * allowed + 1)).alias("s")).select("key", "_t", "_n", F.col("s.g").alias("g"))


def candidates(rare: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, lim): keys that share a rare piece, have near titles and lengths within ``lim`` edits."""
    a = rare.select(F.col("key").alias("a"), F.col("_n").alias("na"), F.col("_t").alias("ta"), "g").join(titles, "ta").drop("ta")
    b = rare.select(F.col("key").alias("b"), F.col("_n").alias("nb"), F.col("_t").alias("tb"), "g")
    lim = F.floor(F.greatest("na", "nb") * threshold + 1e-9).cast("int")
    met = a.join(b, ["tb", "g"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= lim))
    return met.select("a", "b", lim.alias("lim")).distinct()


def similar_keys(keys: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct keys within a relative edit distance,
    whose titles (when given) are within it too: a long company and place must
    not hide another discipline.

    No pair within the distance is missed.  Titles, of which there are few,
    are paired first; keys then meet only under two near titles and one of
    their rarest pieces (``rare_pieces``), and lengths that differ too much
    never meet.  The edit distance stops counting at its limit.
    """
    titled = "title_key" in keys.columns
    k = keys.groupBy("key").agg(F.min("title_key" if titled else F.lit("")).alias("_t")).withColumn("_n", F.length("key")).filter(F.col("_n") > 0)
    if titled:
        k = cut_lineage(k)
        names = k.select("_t").distinct()
        near = similar_keys(names.select(F.col("_t").alias("key")), threshold)
        titles = names.select(F.col("_t").alias("ta"), F.col("_t").alias("tb")).unionByName(near.select(F.col("a").alias("ta"), F.col("b").alias("tb"))).unionByName(near.select(F.col("b").alias("ta"), F.col("a").alias("tb")))
    else:
        titles = keys.sparkSession.createDataFrame([("", "")], "ta string, tb string")
    met = candidates(rare_pieces(k, threshold), titles, threshold)
    return met.filter(F.expr("levenshtein(a, b, lim)") >= 0).select("a", "b")


def components(nodes: DataFrame, pairs: DataFrame, rank: str = "rank") -> DataFrame:
    """(key, root): the best-ranked key of each connected group.

    Labels move along the pairs and along labels already found, so a chain is
    halved each round; the loop ends when nothing changes.
    """
    edge = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(nodes.select("key", F.col(rank).alias("label")))
    while True:
        seen = edge.join(label, edge["b"] == label["key"]).groupBy("a").agg(F.min("label").alias("_m"))
        step = label.join(seen, label["key"] == seen["a"], "left").select("key", "label", F.least("label", "_m").alias("_new"))
        # follow the label's own label
        owner = nodes.join(label, "key").select(F.col(rank).alias("_new"), F.col("label").alias("_up"))
        nxt = cut_lineage(step.join(owner, "_new", "left").select("key", "label", F.least("_new", "_up").alias("_new")))
        changed = nxt.filter(F.col("_new") < F.col("label")).limit(1).count()
        label = nxt.select("key", F.col("_new").alias("label"))
        if not changed:
            return label


def dedup_fuzzy(df: DataFrame, threshold: float = 0.2, id_col: str = "id") -> DataFrame:
    """Adds ``duplicate_of``: the earliest id of the row's group of near keys.

    Equal keys collapse first, so a title posted a million times is one node;
    the similarity join and the grouping see distinct keys only.
    """
    keyed = df.withColumn("key", dedup_key(F.col("title"), F.col("company"), F.col("location")))
    nodes = cut_lineage(keyed.groupBy("key").agg(F.min(id_col).alias("rank"), F.min(dedup_key(F.col("title"), F.lit(""))).alias("title_key")))
    root = components(nodes, similar_keys(nodes, threshold))
    return keyed.join(root, "key").withColumnRenamed("label", "duplicate_of").drop("key")


def merge_sources(df: DataFrame, group: str, source: str = "source", order: Sequence[str] = ("first_seen_at", "id")) -> DataFrame:
    """Distinct sources per kept posting in first-seen order; each (group,
    source) is one row before lists are built."""
    first = df.groupBy(group, source).agg(F.min(F.struct(*order)).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_o", source)))
    return first.groupBy(group).agg(F.transform(rows, lambda s: s[source]).alias("sources"))


# --- runs -------------------------------------------------------------------------------

def ingest(raw: DataFrame, applied: DataFrame, prefs: Preferences, now: Column) -> tuple[DataFrame, DataFrame]:
    """One discovery run: (kept rows with sources, report of the run)."""
    g = applied_flag(gated(raw, prefs, now), applied, "id")
    g = cut_lineage(g.withColumn("reason", F.coalesce("reason", F.when(F.col("applied"), "applied"))))
    kept = g.filter(F.col("reason").isNull())
    by_url = kept.groupBy("apply_url").agg(F.min(F.struct("first_seen_at", "id")).alias("_f"))
    kept = kept.join(by_url, "apply_url").withColumn("_url_id", F.col("_f.id")).drop("_f")
    fuzzy = dedup_fuzzy(kept.filter(F.col("id") == F.col("_url_id")))
    roots = fuzzy.select(F.col("id").alias("_url_id"), "duplicate_of")
    members = cut_lineage(kept.join(roots, "_url_id").drop("_url_id"))
    final = members.filter(F.col("id") == F.col("duplicate_of")).join(merge_sources(members, "duplicate_of"), "duplicate_of")
    counts = g.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    dup = members.agg(F.lit("duplicates").alias("reason"), F.count_if(F.col("id") != F.col("duplicate_of")).alias("n"))
    return final, counts.unionByName(dup)


def rejection_report(g: DataFrame, by: list[str]) -> DataFrame:
    return g.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def rescore(stored: DataFrame, applied: DataFrame, prefs: Preferences, now: Column) -> DataFrame:
    """Re-judge new and archived rows; archive or restore them, then sweep age."""
    rows = stored.filter(F.col("status").isin(*fixed.REWORKABLE))
    s = applied_flag(scored(rows, prefs), applied, "id")
    title = F.coalesce("title", F.lit(""))
    role = match_phrases(title, prefs.role_keywords, prefs.synonyms) | match_phrases(title, prefs.grad_keywords, prefs.synonyms)
    off = F.col("location_bucket").isNull() if prefs.off_list == "drop" else F.lit(False)
    fresh = is_fresh(F.col("posted_date"), F.col("first_seen_at"), now, prefs.max_age_days)
    reason = (F.when(match_phrases(title, prefs.excluded_titles, prefs.synonyms), "seniority").when(~role, "off-role").when(off, "off-location")
              .when(~fresh, "stale").when(F.col("applied"), "applied"))
    s = s.withColumn("reason", reason).withColumn("new_status", F.when(F.col("reason").isNotNull(), "archived").otherwise("new"))
    if prefs.archive_after_days:
        old = F.col("first_seen_at").cast("timestamp") < now - F.make_dt_interval(days=F.lit(int(prefs.archive_after_days)))
        s = s.withColumn("swept", (F.col("new_status") == "new") & old)
    else:
        s = s.withColumn("swept", F.lit(False))
    change = (F.when((F.col("new_status") == "archived") & (F.col("status") != "archived"), "archived")
              .when((F.col("new_status") == "new") & (F.col("status") == "archived"), "restored").otherwise("unchanged"))
    return s.withColumn("change", change).withColumn("final_status", F.when(F.col("swept"), "archived").otherwise(F.col("new_status")))
