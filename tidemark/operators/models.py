"""Spark ML pipelines over the panel, labels and documents."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import STOP_WORDS
from ..session import cut_lineage
from . import gram
from .evaluation import fold_roles, group_quantiles, regression_metrics
from .sparse import SparseRidge
from .terms import packed_words, plain, tfidf_entries, tfidf_vectors, vocabulary

# Model settings.
RIDGE_ALPHA = 1.0
FOREST = dict(numTrees=200, maxDepth=6, minInstancesPerNode=20, featureSubsetStrategy="all", seed=0)
BOOSTED = dict(maxIter=200, stepSize=0.05, maxDepth=3, subsamplingRate=0.8, seed=0)
TEXT = dict(max_features=20_000, min_df=2.0, max_df=0.85)
SVD_COMPONENTS = 24
ABLATION_ALPHA = 10.0
ALPHAS = [0.1, 1.0, 10.0, 100.0]
GRID = dict(forest_trees=(200, 400), forest_depth=(4, 6, 10), forest_leaf=(10, 20), boosted_rounds=(100, 200), boosted_step=(0.02, 0.05, 0.1), boosted_depth=(2, 3, 4))


def routed_columns(panel: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, text) feature columns; meta and target never reach a model."""
    numeric = [f.name for f in panel.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short")
               and not f.name.startswith("meta_") and f.name != "target" and f.name not in ("fold", "role")]
    return numeric, [c for c in panel.columns if c.startswith("text_")]


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, median, mean, std): exact median; mean and population deviation after the median is filled in."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "v")
    med = group_quantiles(long, ["feature"], "v", {"median": 0.5}).select("feature", "median")
    filled = long.join(med, "feature").withColumn("v", F.coalesce("v", "median"))
    return filled.groupBy("feature").agg(F.max("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


class NumericBranch:
    """Median imputation and standard scaling, fitted on the rows given to fit.

    A feature without a value is 0 everywhere, one without spread is only centred.
    """

    def __init__(self, cols: list[str]):
        self.cols = cols

    def fit(self, df: DataFrame) -> "NumericBranch":
        rows = {r["feature"]: r for r in numeric_profile(df, self.cols).collect()}  # one row per feature
        self.profile = [rows.get(c) for c in self.cols]
        return self

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        def scaled(c: str, p) -> Column:
            if p is None or p["median"] is None:
                return F.lit(0.0)
            return (F.coalesce(F.col(c).cast("double"), F.lit(p["median"])) - F.lit(p["mean"])) / F.lit(p["std"] or 1.0)
        return df.withColumn(out, array_to_vector(F.array(*[scaled(c, p) for c, p in zip(self.cols, self.profile)])))


class TextBranch:
    """Word 1-2-grams, document-frequency bounds, tf-idf with smooth idf + 1,
    unit length."""

    def __init__(self, column: str, max_features: int = TEXT["max_features"], min_df: float = TEXT["min_df"], max_df: float = TEXT["max_df"], ngrams: bool = True):
        self.column, self.max_features, self.min_df, self.max_df, self.ngrams = column, max_features, min_df, max_df, ngrams

    def _terms(self, df: DataFrame) -> DataFrame:
        c = self.column
        df = plain(df.withColumn(f"{c}__t", F.coalesce(F.col(c), F.lit(""))), f"{c}__t")
        df = RegexTokenizer(inputCol=f"{c}__t", outputCol=f"{c}__w", pattern=r"(?U)\w\w+", gaps=False).transform(df)
        df = StopWordsRemover(inputCol=f"{c}__w", outputCol=f"{c}__s", stopWords=STOP_WORDS).transform(df)
        if not self.ngrams:
            return df.withColumn(f"{c}__g", F.col(f"{c}__s"))
        df = NGram(n=2, inputCol=f"{c}__s", outputCol=f"{c}__b").transform(df)
        return df.withColumn(f"{c}__g", F.concat(f"{c}__s", f"{c}__b"))

    def fit(self, df: DataFrame) -> "TextBranch":
        c = self.column
        terms = cut_lineage(self._terms(df).select(f"{c}__g"))  # each text is tokenised once
        self.counter = CountVectorizer(inputCol=f"{c}__g", outputCol=f"{c}__tf", vocabSize=self.max_features, minDF=self.min_df, maxDF=self.max_df).fit(terms)
        idf = IDF(inputCol=f"{c}__tf", outputCol=f"{c}__i").fit(self.counter.transform(terms))
        self.document_frequency = idf.docFreq
        self.scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol=f"{c}__tf", outputCol=f"{c}__x")
        return self

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        c = self.column
        x = self.scale.transform(self.counter.transform(self._terms(df)))
        x = Normalizer(p=2.0, inputCol=f"{c}__x", outputCol=out or f"{c}__tfidf").transform(x)
        return x.drop(*[f"{c}__{s}" for s in ("t", "w", "s", "b", "g", "tf", "x")])


def tfidf_matrix(df: DataFrame, key: str, text: str, max_features: int = TEXT["max_features"], min_df: float = TEXT["min_df"], max_df: float = TEXT["max_df"]) -> tuple[DataFrame, list[str]]:
    """(rows, terms): the text branch with a row (key, idx, val) for every row of ``df``, and the vocabulary in its order.

    Word 1-2-grams without stop words; terms of at least ``min_df`` and at most
    a share ``max_df`` of the texts, the ``max_features`` most frequent (ties
    by term).  Rows have unit length; rows of one key have the same, a null key
    has none.  Nothing but counts of likely terms is exchanged (``terms``).
    """
    packed = packed_words(df, [key], text)
    vocab = vocabulary(packed, None, [df.count()], max_features, min_df, max_df)
    rows = tfidf_vectors(packed, [key], None, vocab, 1).select(key, F.explode(F.array_repeat("val", F.col("_c").cast("int"))).alias("val"), "idx")
    known = lambda c: F.when(F.col(key).isNotNull(), F.col(c)).otherwise(F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select(key, known("idx"), known("val")), [r["term"] for r in sorted(vocab, key=lambda r: r["term"])]


def tfidf_rows(df: DataFrame, key: str, text: str, max_features: int = TEXT["max_features"], min_df: float = TEXT["min_df"], max_df: float = TEXT["max_df"]) -> DataFrame:
    """(key, term, tfidf): the rows of ``tfidf_matrix`` with an entry a row, once for every key."""
    packed = packed_words(df, [key], text)
    vocab = vocabulary(packed, None, [df.count()], max_features, min_df, max_df)
    return tfidf_entries(tfidf_vectors(packed.filter(F.col(key).isNotNull()), [key], None, vocab, 1), key, sorted(r["term"] for r in vocab))


def fold_tfidf(texts: DataFrame, rows: DataFrame, keys: list[str], text: str, max_features: int = TEXT["max_features"], min_df: float = TEXT["min_df"], max_df: float = TEXT["max_df"], stride: int = 0) -> DataFrame:
    """(keys, fold, idx, val): ``tfidf_matrix`` of the texts of every fold, the vocabulary learned on its train rows.

    ``rows`` are those of ``fold_roles`` for the same keys, without texts.
    Each text is cut into terms once.  The terms of fold f are numbered in
    their order from ``f * stride``; a null text has no terms.
    """
    roles = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], "roles")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    placed = texts.filter(F.col(text).isNotNull()).join(roles, same).select(*keys, "roles", text)
    packed = packed_words(placed, [*keys, "roles"], text, unique=True)
    packed = packed.withColumn("_train", F.transform("roles", lambda r: r.eqNullSafe("train"))).withColumn("_read", F.transform("roles", lambda r: r.isNotNull())).drop("roles")
    trained = rows.agg(F.max(F.size("roles")).alias("k")).first()["k"] or 0
    sizes = rows.agg(*[F.count_if(F.col("roles")[k].eqNullSafe("train")).alias(f"n{k}") for k in range(trained)]).first() if trained else []
    vocab = vocabulary(packed, "_train", list(sizes), max_features, min_df, max_df)
    return tfidf_vectors(packed, keys, "_read", vocab, len(sizes), stride).select(*keys, F.col("g").alias("fold"), "idx", "val")


def ablation(panel: DataFrame, order: list[str], cols: list[str], text: str, n_splits: int, gap: int, alpha: float = ABLATION_ALPHA, max_features: int = TEXT["max_features"], tol: float = 1e-9) -> DataFrame:
    """(features, n, r2, rmse, mae) of ridge on the numeric columns, the text, and both, over the same folds.

    Numeric columns are filled with the train median and scaled; the text is
    the tf-idf of its 1-2-grams, vocabulary of the train rows.  Nothing is
    made dense over the vocabulary: all folds and sets are solved together by
    conjugate gradients (``sparse.SparseRidge``).
    """
    labelled = panel.filter(gram.number("target").isNotNull())
    rows = cut_lineage(fold_roles(labelled.select(*order, "target", *cols), order, n_splits, gap))
    words = fold_tfidf(labelled.select(*order, text), rows, order, text, max_features, stride=max_features + len(cols))
    numeric = cut_lineage(gram.filled_folds(rows, cols, "target", order).withColumn("_x", vector_to_array("features")).drop("features"))
    stats = numeric.filter(F.col("role") == "train").select("fold", F.posexplode("_x").alias("j", "x")).groupBy("fold", "j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("_s"))  # one entry per column
    stride = max_features + len(cols)
    scaled = F.zip_with("_x", "_s", lambda x, s: F.when(s["s"] > F.abs(s["m"]) * 1e-12, (x - s["m"]) / s["s"]).otherwise(0.0))
    entries = F.filter(F.transform(scaled, lambda v, j: F.struct((F.col("fold") * stride + max_features + j).cast("int").alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    wide = numeric.join(stats, "fold").select(*order, "fold", "role", "target", entries.alias("_n"))
    both = lambda c, kind, n: F.concat(F.coalesce(c, F.array().cast(f"array<{kind}>")), n).alias(c)
    joined = wide.join(words, ["fold", *order], "left")
    ready = cut_lineage(joined.select("fold", "role", "target", both("idx", "int", F.col("_n.i")), both("val", "double", F.col("_n.v"))))
    is_text = np.arange(stride) < max_features
    masks = np.column_stack([~is_text, is_text, np.ones(stride, bool)]).astype(float)
    model = SparseRidge(alpha, tol).fit(ready.filter(F.col("role") == "train"), "target", list(range(n_splits)), stride, masks, dense=max_features)
    p = model.transform(ready.filter(F.col("role") == "valid"), ["target"])
    named = p.select(F.col("target").alias("y"), F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in ("numeric", "text", "both")]), "p")).alias("features", "p"))
    return regression_metrics(named, by="features").filter(F.col("features").isNotNull()).select("features", "n", "r2", "rmse", "mae")


def baseline_models(*, trees: int | None = None, rounds: int | None = None) -> dict[str, object]:
    """The tree candidates by name; ridge comes from ``gram`` with penalty RIDGE_ALPHA."""
    forest = {**FOREST, **({"numTrees": trees} if trees else {})}
    boosted = {**BOOSTED, **({"maxIter": rounds} if rounds else {})}
    return {"random_forest": RandomForestRegressor(featuresCol="features", labelCol="target", **forest),
            "gradient_boosting": GBTRegressor(featuresCol="features", labelCol="target", **boosted)}


def grid_candidates() -> dict[str, object]:
    """The tree candidates of the grid by name: 12 forests and 18 boosted ensembles."""
    out: dict[str, object] = {}
    for depth in GRID["forest_depth"]:
        for leaf in GRID["forest_leaf"]:
            for trees in GRID["forest_trees"]:
                out[f"forest_{depth}_{leaf}_{trees}"] = RandomForestRegressor(featuresCol="features", labelCol="target", **{**FOREST, "maxDepth": depth, "minInstancesPerNode": leaf, "numTrees": trees})
    for depth in GRID["boosted_depth"]:
        for step in GRID["boosted_step"]:
            for rounds in GRID["boosted_rounds"]:
                out[f"boosted_{depth}_{step}_{rounds}"] = GBTRegressor(featuresCol="features", labelCol="target", maxDepth=depth, stepSize=step, maxIter=rounds, seed=0)
    return out


def grid_search(panel: DataFrame, order: list[str], cols: list[str], n_splits: int, gap: int, alphas: list[float], trees: dict[str, object], threads: int = 8) -> DataFrame:
    """(candidate, n, r2, rmse, mae) pooled over the same folds, best R2 first.

    ``order`` is unique per row.  All ridge penalties come from one scan
    (``gram``).  Tree candidates are Spark ML fits on the folds' train rows;
    ``threads`` of them are submitted at a time, since each is a chain of
    small jobs.  A fold without train or validation rows is passed over.
    """
    rows = cut_lineage(gram.fold_roles_of(panel, order, cols, n_splits, gap))
    scores = gram.ridge_scores(rows, cols, "target", order, alphas)
    ready = cut_lineage(gram.filled_folds(rows, cols, "target", order))
    folds = [r["fold"] for r in ready.groupBy("fold").agg(F.countDistinct("role").alias("n")).filter("n = 2").orderBy("fold").collect()]  # one row per fold

    def predict(job: tuple[str, int]) -> DataFrame:
        name, k = job
        part = ready.filter(F.col("fold") == k)
        model = trees[name].fit(part.filter(F.col("role") == "train"))
        return model.transform(part.filter(F.col("role") == "valid")).select(F.lit(name).alias("candidate"), F.col("target").alias("y"), F.col("prediction").alias("p"))

    jobs = [(name, k) for name in trees for k in folds]
    if jobs:
        with ThreadPoolExecutor(threads) as pool:
            pred = reduce(DataFrame.unionByName, pool.map(predict, jobs))
        pooled = regression_metrics(pred, by="candidate").filter(F.col("candidate").isNotNull())
        scores = scores.unionByName(pooled.select("candidate", "n", "r2", "rmse", "mae"))
    return scores.orderBy(F.desc("r2"))


def logistic_floor(n: int, c: float = 1.0) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100)


def mlp_reference(width: int, hidden: int = 32) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=[width, hidden, hidden, 2], maxIter=60, seed=0)


def naive_bayes(label: str = "y") -> NaiveBayes:
    return NaiveBayes(featuresCol="features", labelCol=label, modelType="multinomial", smoothing=1.0)


def importances(model, cols: list[str], spark, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Importances summed by column prefix, and the top features."""
    rows = [(c, c.split("_")[0], float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    df = spark.createDataFrame(rows, "feature string, grp string, importance double")
    return df.groupBy("grp").agg(F.sum("importance").alias("importance")), df.orderBy(F.desc("importance"), "feature").limit(top)
