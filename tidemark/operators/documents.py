"""Document and text operators.

Documents are scored one by one with native expressions, summed per (symbol,
day), and only those daily sums fan out over the as-of grid.  The fan-out
therefore grows with the calendar; a symbol or source that holds a third of
all documents only makes its daily sums larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.finance import ratio
from ..functions.tokens import (Lexicon, bigrams, claim_tokens, claims, combined_text, lexicon_score, mentions, numeric_claims,
                                substantive, word_count, words)
from .selection import first_per_key, top_per_key
from .windows import Grid, members, window_blocks, window_bounds

NEWS = ["news_baseline", "news_recent"]
WORDS_AT_ONCE = 1 << 22  # counted together in a task
ROWS_AT_ONCE = 1 << 12   # of terms and blocks


def doc_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("combined", combined_text(F.col("title"), F.col("text"))).withColumn("word_count", word_count(F.col("text")))


def doc_scores(docs: DataFrame, lex: Lexicon, scorer: Column | None = None) -> DataFrame:
    """Per document: sentiment, hedging, forward-looking and length.

    ``scorer`` may be any column expression, for instance a pandas UDF over
    ``combined``; the lexicon is the default.
    """
    d = doc_columns(docs).withColumn("_tok", words(F.col("combined")))
    score = scorer if scorer is not None else lexicon_score(F.col("_tok"), lex)
    tokens = F.col("_tok")
    return d.select("doc_id", "symbol", "published", "source", "kind", F.col("score").alias("tone"), "word_count", score.alias("sentiment"),
                    F.exists(tokens, lambda t: t.isin(*lex.uncertainty)).alias("uncertain"),
                    mentions(F.col("combined"), lex.uncertainty).alias("hedged"), mentions(F.col("combined"), lex.forward).alias("forward"))


def daily_sums(scores: DataFrame, by: list[str]) -> DataFrame:
    s = F.col("sentiment")
    community, forward = F.col("kind") == "community", F.col("forward")
    return scores.groupBy(*by, "published").agg(
        F.count("*").alias("n"), F.sum(s).alias("s1"), F.sum(s * s).alias("s2"), F.count_if(s > 0.05).alias("n_pos"), F.count_if(s < -0.05).alias("n_neg"),
        F.count_if("uncertain").alias("n_unc"), F.count_if("hedged").alias("n_hedged"), F.sum("word_count").alias("words"),
        F.count_if(community).alias("n_com"), F.sum(F.when(community, s)).alias("com_s"), F.count_if(forward).alias("n_fwd"), F.sum(F.when(forward, s)).alias("fwd_s"),
        F.sum("tone").alias("tone_s"), F.count("tone").alias("tone_n"))


def universe(keys: DataFrame, grid: Grid) -> DataFrame:
    """Every key at every grid date: each key row emits the grid itself."""
    ks = F.sequence(F.lit(0), F.lit(grid.last_index))
    return keys.withColumn("as_of", F.explode(F.transform(ks, grid.at)))


def window_sums(daily: DataFrame, by: list[str], grid: Grid, names: list[str]) -> DataFrame:
    sums = [c for c in daily.columns if c not in (*by, "published")]
    return (members(daily, "published", grid, names).groupBy(*by, "as_of", "ds").agg(*[F.sum(c).alias(c) for c in sums]))


def window_days(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    spans = {}
    for n in ("news_baseline", "news_recent", "macro"):
        start, end = window_bounds(F.col("as_of"), n)
        spans[n] = F.datediff(end, start)
    return F.coalesce(*[F.when(c == n, d) for n, d in spans.items()])


def sentiment_columns() -> dict[str, Column]:
    """Mean, population deviation and shares from the sums of a window."""
    n = F.col("n")
    mean = F.col("s1") / n
    return {"sentiment_mean": mean, "sentiment_std": F.when(n > 0, F.sqrt(F.greatest(F.col("s2") / n - mean * mean, F.lit(0.0)))),
            "positive_share": F.col("n_pos") / n, "negative_share": F.col("n_neg") / n,
            "sentiment_net": F.col("n_pos") / n - F.col("n_neg") / n}


def sentiment_summary(scores: DataFrame, grid: Grid, by: list[str], names: list[str]) -> DataFrame:
    w = window_sums(daily_sums(scores, by), by, grid, names)
    return w.select(*by, "as_of", "ds", F.col("n").alias("n_docs"), *[c.alias(k) for k, c in sentiment_columns().items()])


def burst_ratio(daily: DataFrame, by: list[str], grid: Grid, names: list[str]) -> DataFrame:
    """Busiest seven days from an active day over the window's weekly average.

    Rows are (window, day) counts, so a window's frame is bounded by its days.
    """
    m = members(daily.select(*by, "published", "n"), "published", grid, names)
    keys = [*by, "as_of", "ds"]
    frame = W.partitionBy(*keys).orderBy(F.unix_date("published")).rangeBetween(0, 6)
    g = m.select(*keys, "n", F.sum("n").over(frame).alias("_week")).groupBy(*keys).agg(F.max("_week").alias("_best"), F.sum("n").alias("_n"), F.count("*").alias("_days"))
    days = window_days("ds")
    return g.select(*keys, F.when((days >= 14) & (F.col("_days") >= 2), F.col("_best") / (F.col("_n") / days * 7)).alias("burst_ratio"))


def text_stats(scores: DataFrame, grid: Grid, by: list[str], names: list[str], keys: DataFrame | None = None) -> DataFrame:
    """The text block per (key, as_of, window); empty windows give nulls."""
    daily = daily_sums(scores, by)
    sums = window_sums(daily, by, grid, names)
    distinct = scores.select(*by, "source", "published").distinct()
    sources = (members(distinct, "published", grid, names).groupBy(*by, "as_of", "ds", "source").agg(F.lit(1).alias("_one"))
               .groupBy(*by, "as_of", "ds").agg(F.count("*").alias("_sources")))
    on = [*by, "as_of", "ds"]
    base = keys if keys is not None else scores.select(*by).distinct()
    base = universe(base, grid).withColumn("ds", F.explode(F.array(*[F.lit(n) for n in names])))
    j = base.join(sums, on, "left").join(sources, on, "left").join(burst_ratio(daily, by, grid, names), on, "left")
    n = F.col("n")
    return j.select(*on, F.coalesce(n, F.lit(0)).cast("double").alias("n_docs"), (F.coalesce(n, F.lit(0)) / F.greatest(F.lit(1), window_days("ds"))).alias("docs_per_day"),
                    *[c.alias(k) for k, c in sentiment_columns().items()], (F.col("n_unc") / n).alias("uncertainty_rate"), (F.col("words") / n).alias("mean_word_count"),
                    (F.col("_sources") / n).alias("source_diversity"), (F.col("n_com") / n).alias("community_share"), "burst_ratio",
                    ratio(F.col("tone_s"), F.col("tone_n")).alias("provider_tone_mean"))


def sentiment_shift(stats: DataFrame, novelty: DataFrame | None = None) -> DataFrame:
    """Recent window against baseline window per (symbol, as_of)."""
    on = ["symbol", "as_of"]
    cols = ["n_docs", "docs_per_day", "sentiment_mean", "sentiment_std", "negative_share", "sentiment_net"]
    side = lambda ds, tag: stats.filter(F.col("ds") == ds).select(*on, *[F.col(c).alias(f"{tag}_{c}") for c in cols])
    j = side("news_baseline", "b").join(side("news_recent", "r"), on)
    d = lambda c: F.col(f"r_{c}") - F.col(f"b_{c}")
    out = j.select(*on, d("sentiment_mean").alias("shift_sentiment_delta"), d("sentiment_net").alias("shift_sentiment_net_delta"),
                   d("negative_share").alias("shift_negative_share_delta"),
                   F.when(F.col("b_sentiment_std") > 0, ratio(d("sentiment_mean"), F.col("b_sentiment_std"))).alias("shift_sentiment_zscore"),
                   ratio(F.col("r_docs_per_day"), F.col("b_docs_per_day")).alias("shift_attention_ratio"), d("docs_per_day").alias("shift_attention_delta"))
    if novelty is not None:
        out = out.join(novelty.select(*on, F.col("vocab_novelty").alias("shift_vocab_novelty")), on, "left")
    return out


def block_counts(rows: DataFrame, block_of: dict[date, int]) -> DataFrame:
    """(symbol, term, b, n): how often a term comes in each block of days, from (symbol, _d, _w) with the words of a document.

    A task sends one row per (symbol, term) and range of documents; days of no block are left out.
    """
    first, n_blocks = min(block_of), max(block_of.values()) + 1
    place = np.full((max(block_of) - first).days + 1, -1)
    for d, k in block_of.items():
        place[(d - first).days] = k
    start = (first - date(1970, 1, 1)).days

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        day = part.column(1).cast(pa.int32()).fill_null(start - 1).to_numpy().astype(np.int64) - start
        block = np.where((day >= 0) & (day < len(place)), place[np.clip(day, 0, len(place) - 1)], -1)
        symbol = part.column(0).dictionary_encode(null_encoding="encode")
        size = np.diff(part.column(2).offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        word = part.column(2).flatten().dictionary_encode()
        code, here = word.indices.to_numpy().astype(np.int64), block[row] >= 0
        row, n_words = row[here], len(word.dictionary)
        entry, times = np.unique((symbol.indices.to_numpy()[row] * n_words + code[here]) * n_blocks + block[row], return_counts=True)
        key = entry // n_blocks
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate([at, [len(key)]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((entry % n_blocks).astype(np.int32), times.astype(np.int64))]
        return pa.RecordBatch.from_arrays([symbol.dictionary.take(pa.array(key[at] // n_words)), word.dictionary.take(pa.array(key[at] % n_words)), *lists], ["symbol", "term", "b", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(2).offsets.to_numpy()
            ends, lo = ends - ends[0], 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS_AT_ONCE, "right")) - 1)
                yield count(b.slice(lo, hi - lo))
                lo = hi

    kind = rows.schema["symbol"].dataType.simpleString()
    return rows.select("symbol", "_d", "_w").mapInArrow(task, f"symbol {kind}, term string, b array<int>, n array<long>")


def likely_tops(terms: DataFrame, windows: list[tuple[date, str]], blocks: list[list[int]], top_n: int) -> DataFrame:
    """(symbol, term, as_of, ds, n): terms that may be among the ``top_n`` of a window, from (symbol, term, b, n) sorted by symbol and term.

    A term that ``top_n`` terms of its own partition beat is left out.  A task
    holds the best ``top_n`` counts of every window of one symbol.
    """
    inside = np.zeros((len(blocks), len(windows)))
    for k, w in enumerate(blocks):
        inside[k, w] = 1.0
    dates, names = pa.array([w[0] for w in windows], pa.date32()), pa.array([w[1] for w in windows])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = (), None
        for whole in batches:
            symbols = whole.column(0).dictionary_encode(null_encoding="encode")
            code = symbols.indices.to_numpy()
            cuts = sorted({0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), *range(0, whole.num_rows, ROWS_AT_ONCE), whole.num_rows})
            for lo, hi in zip(cuts, cuts[1:]):
                part, symbol = whole.slice(lo, hi - lo), (whole.column(0)[lo].as_py(),)
                if symbol != at:
                    at, best = symbol, np.zeros((top_n, len(windows)))
                row = np.repeat(np.arange(hi - lo), np.diff(part.column(2).offsets.to_numpy()))
                b, n = (part.column(j).flatten().to_numpy() for j in (2, 3))
                per = np.bincount(row * len(blocks) + b, n, (hi - lo) * len(blocks)).reshape(hi - lo, -1) @ inside
                both = np.partition(np.vstack([best, per]), hi - lo, axis=0)[hi - lo:]
                r, w = np.nonzero((per > best.min(axis=0)) & (per >= both.min(axis=0)))  # on equal counts an earlier term wins
                best = both
                rows, of = pa.array(r), pa.array(w)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), dates.take(of), names.take(of), pa.array(per[r, w].astype(np.int64))], ["symbol", "term", "as_of", "ds", "n"])

    kind = terms.schema["symbol"].dataType.simpleString()
    return terms.select("symbol", "term", "b", "n").mapInArrow(task, f"symbol {kind}, term string, as_of date, ds string, n long")


def vocab_novelty(docs: DataFrame, grid: Grid, top_n: int = 100, stop=fixed.NOVELTY_STOP_WORDS) -> DataFrame:
    """Share of the recent window's top terms absent from the baseline's.

    Terms are counted per block of days that share their windows; the blocks
    of a term meet in one row, and only terms that may be in a window's top
    list leave its task.
    """
    block_of, windows, blocks = window_blocks(docs.sparkSession, grid, NEWS)
    long = F.filter(words(F.col("combined"), fixed.LONG_WORD), lambda w: ~w.isin(*stop))
    found = block_counts(doc_columns(docs).select("symbol", F.to_date("published").alias("_d"), F.coalesce(long, F.array().cast("array<string>")).alias("_w")), block_of)
    lists = F.collect_list(F.struct("b", "n"))
    joined = found.groupBy("symbol", "term").agg(lists.alias("_l")).select("symbol", "term", *[F.flatten(F.col(f"_l.{c}")).alias(c) for c in ("b", "n")])
    counts = likely_tops(joined.sortWithinPartitions("symbol", "term"), windows, blocks, top_n)
    top = top_per_key(counts, ["symbol", "as_of", "ds"], [F.desc("n"), "term"], top_n).select("symbol", "as_of", "ds", "term")
    # both lists meet on the term: one row per (window pair, term)
    per_term = top.groupBy("symbol", "as_of", "term").agg(F.count_if(F.col("ds") == "news_recent").alias("_r"), F.count_if(F.col("ds") == "news_baseline").alias("_b"))
    g = per_term.groupBy("symbol", "as_of").agg(F.sum("_r").alias("n_recent"), F.sum("_b").alias("_nb"), F.count_if((F.col("_r") > 0) & (F.col("_b") == 0)).alias("n_new"))
    return g.filter((F.col("n_recent") > 0) & (F.col("_nb") > 0)).select("symbol", "as_of", "n_recent", "n_new", (F.col("n_new") / F.col("n_recent")).alias("vocab_novelty"))


def window_corpus(docs: DataFrame, grid: Grid, names: list[str], max_docs: int = 2000) -> DataFrame:
    """The newest documents of each window as one text in date order."""
    d = doc_columns(docs).select("doc_id", "symbol", "published", "combined")
    m = top_per_key(members(d, "published", grid, names), ["symbol", "as_of", "ds"], [F.desc("published"), F.desc("doc_id")], max_docs)
    rows = F.array_sort(F.collect_list(F.struct("published", "doc_id", "combined")))
    return m.groupBy("symbol", "as_of", "ds").agg(F.count("*").alias("n_docs"), F.array_join(F.transform(rows, lambda s: s["combined"]), "\n\n").alias("corpus"))


def url_dedup(docs: DataFrame) -> DataFrame:
    """The first document per url, or per title where the url is missing."""
    return first_per_key(docs, [F.coalesce("url", "title")], ["published", "doc_id"])


# Fixed value: a run of capitalised words.
NAME_RUN = r"\b[A-Z][A-Za-z&.'-]{2,}(?:\s+[A-Z][A-Za-z&.'-]{2,})*"


def name_variants(docs: DataFrame) -> DataFrame:
    """(symbol, variant): names inferred from titles, and the symbol itself.

    A run counts once per title; it must appear in at least a tenth of the
    titles, which bounds the variants of a symbol by ten times the runs of an
    average title.
    """
    n = docs.groupBy("symbol").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 10)).alias("_min"))
    runs = docs.select("symbol", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(NAME_RUN), F.lit(0)))).alias("run"))
    common = runs.groupBy("symbol", "run").agg(F.count("*").alias("_c")).join(n, "symbol").filter(F.col("_c") >= F.col("_min"))
    parts = common.select("symbol", F.explode(F.concat(F.array("run"), F.filter(F.split("run", r"\s+"), lambda p: F.length(p) > 3))).alias("variant"))
    own = n.select("symbol", F.explode(F.array(F.upper("symbol"), F.lower("symbol"), F.initcap("symbol"))).alias("variant"))
    return parts.unionByName(own).filter(F.length("variant") > 1).distinct()


def redact(docs: DataFrame, variants: DataFrame, chars: int = 600) -> DataFrame:
    """First characters of each document without names and years."""
    quoted = F.concat(F.lit(r"\Q"), F.col("variant"), F.lit(r"\E"))
    longest_first = F.array_sort(F.collect_list(F.struct((-F.length("variant")).alias("l"), quoted.alias("q"))))
    pattern = variants.groupBy("symbol").agg(F.concat(F.lit(r"\b(?:"), F.array_join(F.transform(longest_first, lambda s: s["q"]), "|"), F.lit(r")\b")).alias("_p"))
    j = docs.select("doc_id", "symbol", "title", "text").join(pattern, "symbol")
    head = F.substring(combined_text(F.col("title"), F.col("text")), 1, chars)
    named = F.regexp_replace(head, F.col("_p"), F.lit("the company"))
    return j.select("doc_id", "symbol", F.regexp_replace(named, r"\b(19|20)\d{2}\b", "[year]").alias("redacted"))


def split_claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, claim_no, line, claim): the substantive sentences of each text."""
    c = docs.select(key, F.posexplode(claims(F.col(text))).alias("claim_no", "c"))
    return c.select(key, "claim_no", F.col("c.line").alias("line"), F.col("c.text").alias("claim")).filter(substantive(F.col("claim")))


def corpus_terms(corpus: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct tokens, bigrams and numbers of a reference corpus."""
    t = corpus.select(claim_tokens(F.col(text)).alias("_t"), numeric_claims(F.col(text)).alias("_n"))
    one = lambda c: t.select(F.explode(c).alias("term")).distinct().withColumn("hit", F.lit(1))
    return one(F.col("_t")), one(bigrams(F.col("_t"))), one(F.col("_n"))


def claim_support(claim_rows: DataFrame, corpus: DataFrame, keys: list[str], threshold: float = 0.55) -> DataFrame:
    """Share of each claim's tokens and bigrams found in a corpus.

    Tokens and bigrams of a claim become 64-bit hashes where they are cut, and
    are looked up in the distinct hashes of the corpus; the lookup never
    multiplies rows.  Spark broadcasts the terms only when their measured size
    allows it and splits hot terms otherwise.  A claim's rows leave one task
    as one sum per claim.
    """
    tokens, pairs, _ = corpus_terms(corpus)
    hashed = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.xxhash64("term").alias("term"), "hit")
    known = hashed(tokens, 1).unionByName(hashed(pairs, 2)).distinct()
    tagged = lambda c, kind: F.transform(c, lambda t: F.struct(F.lit(kind).alias("kind"), F.xxhash64(t).alias("term")))
    c = claim_rows.select(*keys, claim_tokens(F.col("claim")).alias("_t"))
    terms = c.select(*keys, F.inline(F.concat(tagged(F.col("_t"), 1), tagged(bigrams(F.col("_t")), 2))))
    found = terms.join(known, ["kind", "term"], "left")
    share = lambda kind: F.avg(F.when(F.col("kind") == kind, F.coalesce("hit", F.lit(0))))
    g = found.groupBy(*keys).agg(share(1).alias("unigram"), F.coalesce(share(2), F.lit(0.0)).alias("bigram"))
    score = F.least(F.lit(1.0), F.col("unigram") * 0.75 + F.col("bigram") * 0.25 + F.when(F.col("unigram") >= 0.95, 0.05).otherwise(0.0))
    return g.select(*keys, "unigram", "bigram", F.round(score, 3).alias("score"), (F.round(score, 3) < threshold).alias("low_overlap"))


def unsupported_numbers(claim_rows: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, number): numbers of a claim that a corpus holds in no form."""
    _, _, numbers = corpus_terms(corpus)
    known = numbers.select(F.col("term"))
    n = claim_rows.select(*keys, F.explode(numeric_claims(F.col("claim"))).alias("number")).filter(~F.col("number").rlike(r"^(19|20)\d{2}$"))
    n = n.withColumn("_bare", F.regexp_replace("number", r"[^0-9.]", ""))
    left = n.join(known.withColumnRenamed("term", "number"), "number", "left_anti")
    return left.join(known.withColumnRenamed("term", "_bare"), "_bare", "left_anti").select(*keys, "number")
