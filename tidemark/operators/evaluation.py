"""Splits and metrics.

Ranks, quantiles and cuts are exact and distributed: rows are first counted
per distinct value, then numbered by a range-partitioned sort, so neither a
hot value nor a large table ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.finance import ratio
from .ranking import average_ranks, hash_order, hash_positions, running_total, sorted_positions, with_row
from .selection import top_per_key
from .windows import DEFAULT_HORIZON, label_days

# Fixed values.
CLIP = 1e-7
MAJORITY, FLOOR = "majority", "logistic"


def purge_gap(step_days: int = 7, horizon: int = DEFAULT_HORIZON) -> int:
    return max(1, -(-label_days(horizon) // step_days))


def group_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any size."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    s = running_total(counts, [*groups, value], {"__n": "__less"})
    extent = s.groupBy(*groups).agg(F.min("__less").alias("__start"), F.sum("__n").alias("__size"))
    s = (s.join(extent, groups) if groups else with_row(s, extent)).withColumn("__rel", F.col("__less") - F.col("__start"))
    aggs, outs = [F.max("__size").alias("n")], []
    for name, q in probs.items():
        pos = (F.col("__size") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(F.when((F.col("__rel") <= k) & (k < F.col("__rel") + F.col("__n")), F.col(value)))
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_f_{name}")]
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")).alias(name))
    return s.groupBy(*groups).agg(*aggs).select(*groups, "n", *outs)


# --- splits -----------------------------------------------------------------

def _placed(panel: DataFrame, order: list[str], n_splits: int, gap: int) -> DataFrame:
    """Rows with their position and the size of a block; too small a panel is an error."""
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    p = sorted_positions(panel, [], order, "_pos", "_n")
    size = F.floor(F.col("_n") / (n_splits + 1))
    return p.withColumn("_size", F.when(size <= gap, F.raise_error(F.lit("panel too small for the purge gap")).cast("bigint")).otherwise(size))


def _role(fold: Column, gap: int, min_train: int | None = None) -> Column:
    """What a placed row is in a fold: train, valid or null."""
    train_end = F.col("_size") * (fold + 1)
    start = train_end + gap
    end = F.least(start + F.col("_size"), F.col("_n"))
    usable = (start < F.col("_n")) & (train_end >= (F.lit(min_train) if min_train else F.col("_size")))
    return F.when(usable & (F.col("_pos") < train_end), "train").when(usable & (F.col("_pos") >= start) & (F.col("_pos") < end), "valid")


def walk_forward(panel: DataFrame, order: list[str], n_splits: int = 5, gap: int = 5, min_train: int | None = None) -> DataFrame:
    """Rows with (fold, role): expanding train, purge gap, validation block."""
    p = _placed(panel, order, n_splits, gap).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return p.withColumn("role", _role(F.col("fold"), gap, min_train)).filter(F.col("role").isNotNull()).drop("_pos", "_n", "_size")


def fold_roles(panel: DataFrame, order: list[str], n_splits: int = 5, gap: int = 5, min_train: int | None = None) -> DataFrame:
    """The folds of ``walk_forward`` with every row once: an array ``roles`` holds its role in each fold."""
    p = _placed(panel, order, n_splits, gap)
    return p.withColumn("roles", F.array(*[_role(F.lit(k), gap, min_train) for k in range(n_splits)])).drop("_pos", "_n", "_size")


def _cut(val_size: float, test_size: float) -> Column:
    """Side of a group from its position among n groups."""
    n = F.col("n")
    n_test, n_val = (F.greatest(F.lit(1), F.bround(n * s).cast("long")) for s in (test_size, val_size))
    small = n - n_test - n_val < 1
    side = F.when(F.col("pos") >= n - n_test, "test").when(F.col("pos") >= n - n_test - n_val, "val").otherwise("train")
    return F.when(small, F.raise_error(F.lit("too few groups for the split"))).otherwise(side)


def split_grouped(df: DataFrame, group: str, seed: int = 0, val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    """Whole groups to train / val / test in seeded hash order."""
    placed = hash_positions(df.select(group).distinct(), [], group, seed)
    return placed.select(group, _cut(val_size, test_size).alias("split"))


def split_chronological(df: DataFrame, group: str, ts: str, val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    first = df.groupBy(group).agg(F.min(ts).alias("first_ts"))
    return sorted_positions(first, [], ["first_ts", group]).select(group, "first_ts", _cut(val_size, test_size).alias("split"))


def split_rows(df: DataFrame, key: str, seed: int = 0, val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    """Row-level split, wrong on purpose: it tears groups apart."""
    return hash_positions(df, [], key, seed).withColumn("split", _cut(val_size, test_size)).drop("pos", "n")


def group_leak(rows: DataFrame, group: str) -> DataFrame:
    """Share of test groups that also have train rows."""
    per = rows.groupBy(group).agg(F.max(F.col("split") == "test").alias("_t"), F.max(F.col("split") == "train").alias("_r"))
    n, leaked = F.count_if("_t"), F.count_if(F.col("_t") & F.col("_r"))
    return per.agg(n.alias("n_test_groups"), leaked.alias("n_leaked"), ratio(leaked, n).alias("leak_share"))


def stratified_split(df: DataFrame, klass: str, key: str, test_size: float, seed: int = 0) -> DataFrame:
    """Rows to train / test keeping class shares, in seeded hash order."""
    p = hash_positions(df, [klass], key, seed)
    return p.withColumn("split", F.when(F.col("pos") < F.bround(F.col("n") * test_size), "test").otherwise("train")).drop("pos", "n")


def undersample(df: DataFrame, klass: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per class, chosen in seeded hash order."""
    return top_per_key(df.withColumn("_h", hash_order(F.col(key), seed)), [klass], ["_h", key], cap).drop("_h")


# --- regression -----------------------------------------------------------------

def regression_metrics(pred: DataFrame, by: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """R2, RMSE, MAE and n per fold and pooled (null fold), on finite pairs."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    finite = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
    e = a - b
    g = pred.filter(finite).rollup(by).agg(F.count("*").alias("n"), F.sum(e * e).alias("_sse"), F.sum(F.abs(e)).alias("_sae"), (F.var_pop(a) * F.count("*")).alias("_sst"))
    ok = F.col("n") >= 2
    return g.select(by, "n", F.when(ok, 1 - ratio(F.col("_sse"), F.col("_sst"))).alias("r2"), F.when(ok, F.sqrt(F.col("_sse") / F.col("n"))).alias("rmse"),
                    F.when(ok, F.col("_sae") / F.col("n")).alias("mae"))


def same_sign(y: str, p: str) -> Column:
    return F.when(F.col(y) != 0, (F.signum(p) == F.signum(y)).cast("double"))


def directional_accuracy(pred: DataFrame, by: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    return pred.rollup(by).agg(F.avg(same_sign(y, p)).alias("directional_accuracy"), F.count_if(F.col(y) != 0).alias("n"))


def information_coefficient(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Spearman correlation with average ranks; a constant side gives null.

    Equal pairs are counted first, so a hot value is one row in the joins."""
    pairs = pred.groupBy(y, p).agg(F.count("*").alias("_c"))
    j = pairs.join(average_ranks(pred, y, "_ry"), y).join(average_ranks(pred, p, "_rp"), p)
    c, a, b = F.col("_c"), F.col("_ry"), F.col("_rp")
    s = j.agg(F.sum(c).alias("n"), F.sum(c * a).alias("a"), F.sum(c * b).alias("b"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb"), F.sum(c * a * b).alias("ab"))
    n = F.col("n")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / n, F.col("bb") - F.col("b") * F.col("b") / n
    cov = F.col("ab") - F.col("a") * F.col("b") / n
    return s.select("n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("information_coefficient"))


def hit_rate_top(pred: DataFrame, q: float = 0.1, y: str = "y", p: str = "p") -> DataFrame:
    size = pred.withColumn("_a", F.abs(p))
    cut = group_quantiles(size, [], "_a", {"_cut": 1 - q}).withColumnRenamed("n", "_n")
    top = with_row(size, cut).filter(F.col("_a") >= F.col("_cut"))
    g = top.agg(F.max("_n").alias("_n"), F.avg(same_sign(y, p)).alias("_h"), F.count_if(F.col(y) != 0).alias("n_top"))
    return g.select("n_top", F.when(F.col("_n") >= 20, F.col("_h")).alias("hit_rate"))


def zero_baseline(rets: DataFrame, by: list[str], horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """Predict zero, the trailing return, or the shrunk drift."""
    w = W.partitionBy(*by).orderBy("date")
    year = w.rowsBetween(-251, 0)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return rets.select(*by, "date", F.lit(0.0).alias("zero"), F.sum("lr").over(w.rowsBetween(-20, 0)).alias("trailing_21"),
                       F.when(F.count("lr").over(upto) > 60, F.avg("lr").over(year) * horizon * 0.25).otherwise(0.0).alias("drift"))


# --- classification ---------------------------------------------------------------

def clipped(p: str) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col(p).cast("double")))


def auc(pred: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Mann-Whitney area with ties counted half, per group.

    Scores are counted per distinct value; negatives below a value are an
    exclusive running total in score order."""
    c = pred.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))
    s = running_total(c, [*by, p], {"_neg": "_below"})
    ext = s.groupBy(*by).agg(F.min("_below").alias("_start"), F.sum("_pos").alias("n1"), F.sum("_neg").alias("n0"))
    s = s.join(ext, by) if by else with_row(s, ext)
    area = F.sum(F.col("_pos") * (F.col("_below") - F.col("_start") + F.col("_neg") / 2))
    g = s.groupBy(*by).agg(area.alias("_u"), F.max("n1").alias("n1"), F.max("n0").alias("n0"))
    return g.select(*by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("_u") / (F.col("n1") * F.col("n0").cast("double"))).alias("roc_auc"))


def classification_metrics(pred: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    q, t = clipped(p), F.col(y).cast("double")
    rest = pred.groupBy(*by).agg((-F.avg(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg((q - t) * (q - t)).alias("brier"),
                                 F.avg(((q >= 0.5) == (t == 1)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    a = auc(pred.withColumn("_q", q), by, y, "_q").select(*by, "roc_auc")
    return rest.join(a, by) if by else with_row(rest, a)


def null_se(n1: Column, n0: Column) -> Column:
    return F.sqrt(ratio(n0 + n1 + 1, 12.0 * n0 * n1))


def auc_null_se(pred: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    a = auc(pred, by, y, p)
    se = null_se(F.col("n1"), F.col("n0"))
    return a.select(*by, "n1", "n0", "roc_auc", se.alias("null_se"), (F.abs(F.col("roc_auc") - 0.5) > 3 * se).alias("canary_leak"))


def compare_models(pred: DataFrame, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """Every model against the floor and the constant base-rate guess."""
    m = classification_metrics(pred, [model], y, p)
    ref = lambda name, tag: m.filter(F.col(model) == name).select(F.col("roc_auc").alias(f"_auc_{tag}"), F.col("log_loss").alias(f"_ll_{tag}"))
    j = with_row(with_row(m, ref(FLOOR, "f")), ref(MAJORITY, "m"))
    return j.select(model, "n", "roc_auc", "log_loss", "brier", "accuracy", (F.col("roc_auc") - F.col("_auc_f")).alias("d_auc"), (F.col("log_loss") - F.col("_ll_f")).alias("d_log_loss"),
                    ((F.col(model) != MAJORITY) & (F.col("log_loss") > 1.05 * F.col("_ll_m"))).alias("overconfident"))


def confusion(pred: DataFrame, y: str, p: str) -> DataFrame:
    return pred.groupBy(y, p).agg(F.count("*").alias("n"))


def class_report(pred: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1, support per class and the macro F1."""
    c = confusion(pred, y, p)
    rows = c.select(F.inline(F.array(
        F.struct(F.col(y).alias("klass"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(p).alias("klass"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))))
    g = rows.groupBy("klass").agg(F.sum("support").alias("support"), F.sum("predicted").alias("_p"), F.sum("hit").alias("_h"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    g = g.select("klass", "support", z(ratio(F.col("_h"), F.col("_p"))).alias("precision"), z(ratio(F.col("_h"), F.col("support"))).alias("recall"))
    g = g.withColumn("f1", z(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return g.withColumn("macro_f1", F.avg("f1").over(W.partitionBy(F.lit(0))))  # one row per class


def threshold_sweep(pred: DataFrame, thresholds: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """F1 at each threshold and the best one.

    A row only needs to know how many thresholds it reaches, so rows collapse
    into one count per bin and the sweep accumulates over the bins.
    """
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(p) >= t))
    bins = pred.groupBy(reached.alias("_b")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count("*").alias("_all"))
    spark = pred.sparkSession
    ts = spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds, 1)], "i int, threshold double")
    allb = spark.range(len(thresholds) + 1).select(F.col("id").cast("int").alias("_b")).join(bins, "_b", "left").na.fill(0)
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, 0)  # one row per threshold
    total = F.sum("_pos").over(W.partitionBy(F.lit(0)))
    cum = allb.select("_b", F.sum("_pos").over(w).alias("tp"), F.sum("_all").over(w).alias("predicted"), total.alias("positives"))
    f = cum.join(ts, cum["_b"] == ts["i"]).withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), F.col("predicted") + F.col("positives")), F.lit(0.0)))
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold"))).over(W.partitionBy(F.lit(0)))
    return f.select("threshold", "tp", "predicted", "f1", (F.col("threshold") == best).alias("is_best"))
