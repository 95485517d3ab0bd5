"""Model queries: Spark ML on panels, labels and documents."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.fixed import STOP_WORDS
from ..operators import documents as doc
from ..operators import evaluation as ev
from ..operators import models as md
from ..operators import returns as ret
from ..operators import sparse as sp
from ..operators.windows import edges
from ..session import cut_lineage
from ..sources import views
from ..sources.tables import table, text_table
from . import panel as pn
from .cte import PRICES, with_
from .q_panel import TARGET, wide_panel
from .q_documents import LEX
from .q_returns import BY, rounded
from .q_windows import GRID28, MONTHLY
from .registry import query

@query("preprocess_numeric", with_(PRICES, GRID28, TARGET, """e AS (SELECT symbol, as_of, vol_21d, LN(adj_close) AS lvl FROM t1 JOIN grid ON date < as_of AND (nxt IS NULL OR nxt >= as_of) WHERE as_of < DATE '2000-09-01'),
l AS (SELECT 'eq_vol_21d' AS feature, vol_21d AS v FROM e UNION ALL SELECT 'eq_level', CASE WHEN dayofmonth(as_of) % 3 <> 0 THEN lvl END FROM e),
m AS (SELECT feature, QUANTILE_CONT(v, 0.5) AS med FROM l GROUP BY feature)""") + """
SELECT feature, ROUND(ANY_VALUE(med), 6) AS median, ROUND(AVG(COALESCE(v, med)), 6) AS mean, ROUND(STDDEV_POP(COALESCE(v, med)), 6) AS std FROM l JOIN m USING (feature) GROUP BY feature""")
def _(spark, sf):
    w = ret.history(BY).rowsBetween(-20, 0)
    f = ret.with_returns(views.prices(spark, sf), BY).withColumn("eq_vol_21d", F.when(F.count("lr").over(w) >= 5, F.stddev_samp("lr").over(w) * (252 ** 0.5)))
    at = edges(f, MONTHLY, by=BY).filter(F.col("as_of") < F.lit("2000-09-01").cast("date"))
    at = at.select("eq_vol_21d", F.when(F.dayofmonth("as_of") % 3 != 0, F.log("adj_close")).alias("eq_level"))
    return rounded(md.numeric_profile(at, ["eq_vol_21d", "eq_level"]), ["feature"])


STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
TFIDF = f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(lower(text), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOPS}, x)) AS w FROM documents),
g AS (SELECT doc_id, UNNEST(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM g GROUP BY ALL), n AS (SELECT COUNT(*) AS n FROM documents),
v AS (SELECT term, LN((n + 1) / (COUNT(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term, n HAVING COUNT(*) BETWEEN 2 AND 0.85 * n ORDER BY SUM(tf) DESC, term LIMIT 20000),
x AS (SELECT doc_id, term, tf * idf AS v FROM tf JOIN v USING (term))
SELECT doc_id, term, ROUND(v / SQRT(SUM(v * v) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM x"""


@query("tfidf_text", TFIDF)
def _(spark, sf):
    return md.tfidf_rows(text_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").withColumn("tfidf", F.round("tfidf", 6))


@query("adaptive_svd")
def _(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    rows, vocab = md.tfidf_matrix(d, "doc_id", "text")
    rows = cut_lineage(rows)
    svd = sp.SparseSVD(md.SVD_COMPONENTS).fit(rows, len(vocab))
    return svd.transform(rows, "doc_id").select("doc_id", F.size("svd").alias("n_components"), F.aggregate("svd", F.lit(0.0), lambda s, v: s + v * v).alias("energy"))


PANEL_ORDER = ["meta_as_of", "meta_symbol"]
# of the 30 tree candidates those that end in minutes on one machine; the README has the figures
GRID_TREES = ["forest_4_10_200", "forest_4_20_200", "forest_6_10_200", "forest_6_20_200", "boosted_2_0.1_100", "boosted_3_0.1_100"]


@query("models_baseline")
def _(spark, sf):
    panel = cut_lineage(wide_panel(spark, sf))
    return md.grid_search(panel, PANEL_ORDER, pn.numeric_features(panel), 5, ev.purge_gap(28), [md.RIDGE_ALPHA], md.baseline_models())


@query("grid_search")
def _(spark, sf):
    panel = cut_lineage(wide_panel(spark, sf))
    trees = {k: v for k, v in md.grid_candidates().items() if k in GRID_TREES}
    return md.grid_search(panel, PANEL_ORDER, pn.numeric_features(panel), 5, ev.purge_gap(28), md.ALPHAS, trees)


@query("importance_by_group")
def _(spark, sf):
    panel = cut_lineage(wide_panel(spark, sf))
    cols = pn.numeric_features(panel)
    ready = cut_lineage(md.NumericBranch(cols).fit(panel).transform(panel, "features").select("target", "features"))
    groups, top = md.importances(md.baseline_models()["random_forest"].fit(ready), cols, spark)
    return groups.select(F.lit("group").alias("kind"), F.col("grp").alias("name"), "importance").unionByName(top.select(F.lit("feature").alias("kind"), F.col("feature").alias("name"), "importance"))


@query("ablation")
def _(spark, sf):
    panel = cut_lineage(wide_panel(spark, sf))
    corpus = doc.window_corpus(views.docs(spark, sf), MONTHLY, ["news_recent"]).select(F.col("symbol").alias("meta_symbol"), F.col("as_of").alias("meta_as_of"), F.col("corpus").alias("text_recent"))
    return md.ablation(panel.join(corpus, PANEL_ORDER, "left"), PANEL_ORDER, pn.numeric_features(panel), "text_recent", 5, ev.purge_gap(28))


def labelled_docs(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", "text", "n_chars", "lang")
    j = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id")
    from ..functions.tokens import word_count
    wc = word_count(F.col("text")).cast("double")
    j = j.select("doc_id", "y", "text", F.log1p(F.col("n_chars").cast("double")).alias("x_chars"), F.log1p(wc).alias("x_words"),
                 F.try_divide(F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double"), F.col("n_chars").cast("double")).alias("x_digits"), (F.col("lang") == "en").cast("double").alias("x_en"))
    return ev.stratified_split(j.na.fill(0.0), "y", "doc_id", 0.25, 7)


X = ["x_chars", "x_words", "x_digits", "x_en"]


def scored_by(model, df):
    return model.transform(df).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


@query("logistic_floor")
def _(spark, sf):
    d = cut_lineage(VectorAssembler(inputCols=X, outputCol="features").transform(labelled_docs(spark, sf)).select("doc_id", "y", "features", "split"))
    train = d.filter(F.col("split") == "train")
    return ev.classification_metrics(scored_by(md.logistic_floor(train.count()).fit(train), d.filter(F.col("split") == "test")), [])


@query("mlp_reference")
def _(spark, sf):
    d = cut_lineage(VectorAssembler(inputCols=X, outputCol="features").transform(labelled_docs(spark, sf)).select("doc_id", "y", "features", "split"))
    model = md.mlp_reference(len(X)).fit(d.filter(F.col("split") == "train"))
    return ev.classification_metrics(scored_by(model, d.filter(F.col("split") == "test")), [])


@query("naive_bayes_text")
def _(spark, sf):
    d = labelled_docs(spark, sf).select("doc_id", "y", "text", "split")
    train = d.filter(F.col("split") == "train")
    b = md.TextBranch("text", ngrams=False).fit(train)
    model = md.naive_bayes().fit(b.transform(train, "features"))
    p = model.transform(b.transform(d.filter(F.col("split") == "test"), "features")).select("y", F.col("prediction").cast("int").alias("pred"))
    return ev.class_report(p, "y", "pred")
