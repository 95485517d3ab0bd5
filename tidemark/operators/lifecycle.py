"""Health, lifecycle and ledger state in batch form.

Each is written as something that adds up (counts since a point, composed
transition tables), so a source or id with a third of all events is folded in
pieces and never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import TRANSITIONS
from ..session import cut_lineage
from .ranking import _before, _numbered, with_previous

STATES = tuple(TRANSITIONS)
INDEX = {s: i for i, s in enumerate(STATES)}
LEGAL = {(a, b) for a, to in TRANSITIONS.items() for b in to}


def health_delta(events: DataFrame, source: str, ok: str, order: list[str]) -> DataFrame:
    """Per source: whether it succeeded, and its failures since the last success."""
    at = F.struct(*order)
    last = events.filter(F.col(ok)).groupBy(source).agg(F.max(at).alias("_last"))
    j = events.select(source, ok, at.alias("_at")).join(last, source, "left")
    since = F.count_if(~F.col(ok) & (F.col("_last").isNull() | (F.col("_at") > F.col("_last"))))
    return j.groupBy(source).agg(F.max(F.col("_last").isNotNull()).alias("succeeded"), since.alias("failures"))


def health_state(delta: DataFrame, previous: DataFrame | None, source: str) -> DataFrame:
    """Retry count and status after a batch of outcomes."""
    if previous is not None:
        p = previous.select(source, F.col("retry_count").alias("_r"))
        delta = delta.join(p, source, "full_outer")
        count = F.when(F.col("succeeded"), F.col("failures")).otherwise(F.coalesce("_r", F.lit(0)) + F.coalesce("failures", F.lit(0)))
    else:
        count = F.col("failures")
    status = F.when(F.col("retry_count") == 0, "ok").when(F.col("retry_count") >= 3, "permanent-fail").otherwise("render-failed")
    return delta.select(source, count.alias("retry_count")).withColumn("status", status)


def legal_pairs(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(LEGAL), "from_status string, to_status string")


def run_machine(state: int, to: str) -> int:
    return INDEX[to] if (STATES[state], to) in LEGAL else state


# --- a run of events as one number: three bits of leaving state per entering state

ONES = sum(1 << 3 * s for s in range(len(STATES)))
SAME = sum(s << 3 * s for s in range(len(STATES)))
#: Adjacent rows of one block, and blocks in one block of the level above.
BLOCK = 256


def by_status(to: str, values: dict[str, int], other: int) -> Column:
    pairs = ", ".join(f"'{s}', {v}L" for s, v in values.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), F.col(to)), F.lit(other).cast("long"))


def leaving(table: str, state: str | int) -> str:
    """State in which a table leaves what enters it in ``state``, as SQL."""
    return f"(shiftright({table}, CAST(3 * {state} AS INT)) & 7L)"


def composed(first: str, then: str) -> str:
    """The table of two runs, one after the other, as SQL."""
    return "(" + " + ".join(f"shiftleft({leaving(then, f'(shiftright({first}, {3 * s}) & 7L)')}, {3 * s})" for s in range(len(STATES))) + ")"


def prefixes(df: DataFrame, rows: int) -> DataFrame:
    """(_at, _table) with positions 0, 1, ...: the table of all rows up to each one."""
    block = F.floor(F.col("_at") / BLOCK).alias("_over")
    lists = df.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("_at", "_table"))).alias("_list"))
    table = composed("run.t", "row._table")
    out = f"""aggregate(_list, named_struct('t', {SAME}L, 'out', CAST(array() AS array<bigint>)),
                        (run, row) -> named_struct('t', {table}, 'out', concat(run.out, array({table})))).out"""
    f = lists.select("_over", F.inline(F.arrays_zip(F.col("_list._at").alias("_at"), F.expr(out).alias("_table"))))
    if rows <= BLOCK:
        return f.select("_at", "_table")
    f = cut_lineage(f)
    ends = f.groupBy(F.col("_over").alias("_at")).agg(F.max_by("_table", "_at").alias("_table"))
    entered = prefixes(ends, -(-rows // BLOCK)).select((F.col("_at") + 1).alias("_over"), F.col("_table").alias("_enter"))
    return f.join(entered, "_over", "left").select("_at", F.coalesce(F.expr(composed("_enter", "_table")), "_table").alias("_table"))


def status_machine(events: DataFrame, key: str, order: list[str], to: str = "to_status", start: str = "new") -> DataFrame:
    """Every event with the state before it and whether it was legal.

    Later legality depends on earlier acceptance, so this is a fold.  An event
    is a table that maps any entering state to a leaving one, packed into a
    long, and tables compose, so the fold is a prefix scan: rows are sorted
    once over the whole cluster, cut into blocks of ``BLOCK`` adjacent rows and
    folded there; blocks are folded in the same way, level by level.  An id
    with most of the rows is spread over blocks like any other.  A status that
    is null or unknown is illegal and changes nothing; an empty table gives an
    empty one.  ``order`` must end in a unique column.
    """
    cols = [key, *[c for c in order if c != key], to]
    first = INDEX[start]
    moves = {s: sum(run_machine(x, s) << 3 * x for x in range(len(STATES))) for s in STATES}
    masks = {s: sum(1 << x for x in range(len(STATES)) if (STATES[x], s) in LEGAL) for s in STATES}
    s = _numbered(events.select(*cols), [key, *order])
    row = F.struct("_row", F.struct(*cols).alias("_event"), by_status(to, moves, SAME).alias("_own"), by_status(to, masks, 0).alias("_mask"))
    here = ["_part", F.floor(F.col("_row") / BLOCK).alias("_block")]
    s = s.groupBy(*here).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    # a new id inside a block starts afresh, whatever enters the block
    k = "`" + key.replace("`", "``") + "`"
    anew = f"NOT (run.k <=> e._event.{k})"
    head = f"get(_rows, 0)._event.{k}"
    whole = f"""aggregate(_rows, named_struct('k', {head}, 't', {SAME}L), (run, e) -> named_struct('k', e._event.{k},
                 't', IF({anew}, {leaving("e._own", first)} * {ONES}L, {composed("run.t", "e._own")})))"""
    s = cut_lineage(s.select("*", F.expr(f"named_struct('k', {head})").alias("_first"), F.expr(whole).alias("_run")))

    blocks = s.select("_part", "_block", "_first", F.struct("_run.k").alias("_last"), F.col("_run.t").alias("_table"))
    offsets = _before(blocks.groupBy("_part").agg(F.count("*").alias("_n")), "_n", "_off")
    blocks = blocks.join(offsets, "_part").withColumn("_at", F.col("_off") + F.col("_block"))
    earlier = blocks.select((F.col("_at") + 1).alias("_at"), F.col("_last").alias("_gone"))
    fresh = F.col("_gone").isNull() | ~F.col("_gone").eqNullSafe(F.col("_first"))
    blocks = cut_lineage(blocks.join(earlier, "_at", "left").select("_at", "_part", "_block", "_table", fresh.alias("_fresh")))
    tables = blocks.select("_at", F.expr(f"IF(_fresh, {leaving('_table', first)} * {ONES}L, _table)").alias("_table"))
    # every prefix begins afresh, so its table leaves all states alike
    after = prefixes(tables, blocks.count()).select((F.col("_at") + 1).alias("_at"), F.col("_table").bitwiseAND(F.lit(7)).alias("_left"))
    entering = blocks.join(after, "_at", "left").select("_part", "_block", F.when(F.col("_fresh"), F.lit(first)).otherwise(F.col("_left")).cast("long").alias("_enter"))

    now = f"IF({anew}, {first}L, run.s)"
    states = F.expr(f"""aggregate(_rows, named_struct('k', _first.k, 's', _enter, 'out', CAST(array() AS array<bigint>)),
                        (run, e) -> named_struct('k', e._event.{k}, 's', {leaving("e._own", now)}, 'out', concat(run.out, array({now})))).out""")
    rows = s.join(entering, ["_part", "_block"]).select(F.inline(F.arrays_zip(F.col("_rows").alias("_e"), states.alias("_state"))))
    legal = F.expr("shiftright(_e._mask, CAST(_state AS INT)) & 1L = 1L")
    names = F.expr("array(" + ", ".join(f"'{x}'" for x in STATES) + ")")
    return rows.select(*[F.col("_e._event")[c].alias(c) for c in cols], F.get(names, F.col("_state").cast("int")).alias("from_status"), legal.alias("legal"))


def final_status(machine: DataFrame, key: str, order: list[str], to: str = "to_status") -> DataFrame:
    accepted = F.max(F.when(F.col("legal"), F.struct(*order, to)))
    return machine.groupBy(key).agg(F.coalesce(accepted[to], F.lit("new")).alias("status"), F.count_if("legal").alias("n_applied"), F.count_if(~F.col("legal")).alias("n_illegal"))


def transition_counts(events: DataFrame, key: str, order: list[str], to: str = "to_status") -> DataFrame:
    """Raw consecutive pairs per id, with their share and legality."""
    e = with_previous(events.select(key, *order, to), [key], order, [to]).filter(F.col("prev").isNotNull())
    c = e.groupBy(F.col(f"prev.{to}").alias("from_status"), F.col(to).alias("to_status")).agg(F.count("*").alias("n"))
    return c.join(legal_pairs(events).withColumn("_legal", F.lit(True)), ["from_status", "to_status"], "left").select("from_status", "to_status", "n", F.coalesce("_legal", F.lit(False)).alias("legal"))


def pending_ids(candidates: DataFrame, ledger: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Candidates whose latest ledger entry is not done."""
    latest = ledger.groupBy(key).agg(F.max(F.struct(*order, status))[status].alias("_s"))
    done = latest.filter(F.col("_s") == "done").select(key)
    return candidates.select(key).distinct().join(done, key, "left_anti")
