"""As-of grids, calendar windows and window membership.

All windows are half-open: a row dated on the as-of day belongs to no feature
window.  A regular grid is described by (start, end, step) and never joined:
a row computes the grid points it belongs to, so membership needs no range
join, no broadcast and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

EQUITY_MONTHS, INDEX_MONTHS, NEWS_MONTHS, RECENT_MONTHS, MACRO_MONTHS = 60, 24, 12, 2, 6
DEFAULT_HORIZON = 21

# name -> (months back to the start, months back to the end)
WINDOW_MONTHS = {
    "prices_equity": (EQUITY_MONTHS, 0),
    "prices_index": (INDEX_MONTHS, 0),
    "news_baseline": (NEWS_MONTHS, RECENT_MONTHS),
    "news_recent": (RECENT_MONTHS, 0),
    "macro": (MACRO_MONTHS, 0),
}


@dataclass(frozen=True)
class Grid:
    """Regular as-of dates: start, start+step, ... up to end."""

    start: date
    end: date
    step: int = 7

    @staticmethod
    def of(start: str, end: str, step: int = 7) -> "Grid":
        if step < 1:
            raise ValueError("step must be at least one day")
        return Grid(date.fromisoformat(start), date.fromisoformat(end), step)

    @property
    def last_index(self) -> int:
        return (self.end - self.start).days // self.step

    def at(self, k: Column) -> Column:
        return F.date_add(F.lit(self.start), (k * self.step).cast("int"))

    def points(self, first_day: Column, last_day: Column) -> Column:
        """Array of grid dates inside the closed interval, null when none."""
        lo = F.greatest(F.lit(0), F.ceil(F.datediff(first_day, F.lit(self.start)) / F.lit(self.step)).cast("int"))
        hi = F.least(F.lit(self.last_index),
                     F.floor(F.datediff(last_day, F.lit(self.start)) / F.lit(self.step)).cast("int"))
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), self.at))


def label_days(horizon: int) -> int:
    """Calendar days that cover ``horizon`` trading days, with holiday slack."""
    return horizon * 7 // 5 + 5


def shift_months(d: Column, months: int) -> Column:
    """Calendar month shift clamped to the month end."""
    return F.add_months(d, months)


def clip(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows with start <= column < end; the predicate reaches the scan."""
    kind = df.schema[column].dataType.simpleString()
    return df.filter((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))


def as_of_grid(spark: SparkSession, grid: Grid, *, horizon: int = DEFAULT_HORIZON, today: date | None = None) -> DataFrame:
    """Grid dates whose forward window has fully elapsed by ``today``."""
    points = spark.range(grid.last_index + 1).select(grid.at(F.col("id")).alias("as_of"))
    return labellable(points, horizon=horizon, today=today)


def labellable(as_of: DataFrame, *, horizon: int = DEFAULT_HORIZON, today: date | None = None) -> DataFrame:
    cut = F.lit(today) if today else F.current_date()
    return as_of.filter(F.date_add("as_of", label_days(horizon)) <= cut)


def label_window(as_of: DataFrame, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    return as_of.select("as_of", F.col("as_of").alias("start"),
                        F.date_add("as_of", label_days(horizon)).alias("end"))


def window_bounds(as_of: Column, name: str) -> tuple[Column, Column]:
    back_from, back_to = WINDOW_MONTHS[name]
    return F.add_months(as_of, -back_from), (F.add_months(as_of, -back_to) if back_to else as_of)


def window_spec(as_of: DataFrame) -> DataFrame:
    """Five half-open windows per as-of date, one row each."""
    specs = []
    for name in WINDOW_MONTHS:
        start, end = window_bounds(F.col("as_of"), name)
        specs.append(F.struct(F.lit(name).alias("name"), start.alias("start"), end.alias("end"),
                              F.datediff(end, start).alias("days")))
    return as_of.select("as_of", F.inline(F.array(*specs)))


def window_array(day: Column, grid: Grid, names: list[str]) -> Column:
    """Every (as_of, window) that contains a day, as an array of structs.

    The day fixes the grid points it can belong to: candidates come from
    arithmetic on the grid, the exact calendar rule is applied afterwards.
    """
    def points_of(name: str) -> Column:
        back_from, back_to = WINDOW_MONTHS[name]
        nearest = F.date_add(day, 1) if back_to == 0 else F.date_add(day, 27 * back_to)
        candidates = grid.points(nearest, F.date_add(day, 31 * back_from + 1))

        def inside(a: Column) -> Column:
            start, end = window_bounds(a, name)
            return (day >= start) & (day < end)

        found = F.coalesce(F.filter(candidates, inside), F.array().cast("array<date>"))
        return F.transform(found, lambda a: F.struct(a.alias("as_of"), F.lit(name).alias("ds")))

    return F.concat(*[points_of(n) for n in names])


def members(df: DataFrame, column: str, grid: Grid, names: list[str]) -> DataFrame:
    """Every row once per (as_of, window) that contains it: no join and no
    exchange; the output is as partitioned as the input."""
    return df.select("*", F.inline(window_array(F.to_date(column), grid, names)))


def window_blocks(spark: SparkSession, grid: Grid, names: list[str]) -> tuple[dict[date, int], list[tuple[date, str]], list[list[int]]]:
    """(block of a day, windows, windows of a block): days that lie in exactly the same windows form a block.

    Both hold one entry per calendar day at most; a day outside every window has none.
    """
    first = grid.start - timedelta(days=31 * max(WINDOW_MONTHS[n][0] for n in names) + 1)
    days = spark.range((grid.end - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
    block_of, windows, blocks = {}, {}, {}
    for r in days.select("d", window_array(F.col("d"), grid, names).alias("w")).filter(F.size("w") > 0).orderBy("d").collect():
        inside = tuple(windows.setdefault((w["as_of"], w["ds"]), len(windows)) for w in r["w"])
        block_of[r["d"]] = blocks.setdefault(inside, len(blocks))
    return block_of, list(windows), [list(b) for b in blocks]


def edges(bars: DataFrame, grid: Grid, *, by: list[str], date_col: str = "date", inclusive: bool = False) -> DataFrame:
    """The last row before each as-of date (at or before it when ``inclusive``).

    A row is the edge for exactly the grid points between its own day and the
    next row's day, so the pick is one ``lead`` and one ``explode``.
    """
    w = W.partitionBy(*by).orderBy(date_col)
    first = F.col(date_col) if inclusive else F.date_add(date_col, 1)
    following = F.lead(date_col).over(w)
    last = F.coalesce(F.date_sub(following, 1) if inclusive else following, F.lit(grid.end))
    return (bars.withColumn("_first", first).withColumn("_last", last)
            .withColumn("as_of", F.explode(grid.points(F.col("_first"), F.col("_last"))))
            .drop("_first", "_last"))


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str,
              values: list[str], strict: bool = False) -> DataFrame:
    """Backward as-of join: the latest right row at or before each left row.

    Both sides are unioned and the last right value is carried forward, which
    costs one exchange by key and has no non-equi join.  ``strict`` looks only
    before the left time.
    """
    rank_left, rank_right = (0, 1) if strict else (1, 0)
    packed = F.struct(*[F.col(v) for v in values])
    lhs = left.select(*[F.col(b) for b in by], F.col(left_time).alias("_t"), F.lit(rank_left).alias("_o"),
                      F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
                      F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_r"))
    rhs = right.select(*[F.col(b) for b in by], F.col(right_time).alias("_t"), F.lit(rank_right).alias("_o"),
                       F.lit(None).cast(lhs.schema["_l"].dataType).alias("_l"), packed.alias("_r"))
    w = W.partitionBy(*by).orderBy("_t", "_o").rowsBetween(W.unboundedPreceding, 0)
    carried = lhs.unionByName(rhs).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return carried.filter(F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def asof_calendar(left: DataFrame, right: DataFrame, *, left_day: str, right_day: str, values: list[str],
                  strict: bool = False) -> DataFrame:
    """Backward as-of join against one series that all keys share.

    The left side is first reduced to its distinct days, so the ordered pass
    sees one row per calendar day; the values come back by an equi-join.
    """
    days = left.select(F.lit(0).alias("_k"), F.col(left_day).alias("_day")).distinct()
    series = right.select(F.lit(0).alias("_k"), F.col(right_day).alias("_rday"), *values)
    found = asof_join(days, series, by=["_k"], left_time="_day", right_time="_rday", values=values, strict=strict)
    return left.join(found.drop("_k"), F.col(left_day) == F.col("_day"), "left").drop("_day")


def window_summary(bars: DataFrame, docs: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Per (symbol, as_of, window): bar summary, and document summary.

    Documents are counted per (symbol, day, source) before they fan out over
    the grid, so the fan-out grows with the calendar and not with the corpus.
    """
    px = (members(bars.filter(F.col("adj_close").isNotNull()), "date", grid, ["prices_equity", "prices_index"])
          .groupBy("symbol", "as_of", "ds")
          .agg(F.count("*").alias("n_bars"), F.min_by("adj_close", "date").alias("_f"),
               F.max_by("adj_close", "date").alias("_l")))
    enough = F.col("n_bars") >= 2
    px = px.select("symbol", "as_of", "ds", "n_bars", F.when(enough, F.col("_f")).alias("first_close"),
                   F.when(enough, F.col("_l")).alias("last_close"),
                   F.when(enough, F.col("_l") / F.col("_f") - 1).alias("total_return"))
    daily = docs.groupBy("symbol", "source", "published").agg(F.count("*").alias("n"))
    per_source = (members(daily, "published", grid, ["news_baseline", "news_recent", "macro"])
                  .groupBy("symbol", "as_of", "ds", "source").agg(F.sum("n").alias("n")))
    top = W.partitionBy("symbol", "as_of", "ds").orderBy(F.desc("n"), "source")
    spans = {n: F.datediff(window_bounds(F.col("as_of"), n)[1], window_bounds(F.col("as_of"), n)[0])
             for n in ("news_baseline", "news_recent", "macro")}
    days = F.coalesce(*[F.when(F.col("ds") == n, v) for n, v in spans.items()])
    tx = (per_source.withColumn("_rank", F.row_number().over(top))
          .groupBy("symbol", "as_of", "ds")
          .agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_sources"),
               F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= 5, F.struct("_rank", "source")))),
                           lambda s: s["source"]).alias("top_sources"))
          .withColumn("documents_per_day", F.col("n_documents") / F.greatest(F.lit(1), days)))
    return px, tx
