"""Conversation structure repair: turns are aligned to every feasible length of an alternating grammar.

A legal conversation is nothing, or an optional system turn and then pairs of
user and assistant.  The turns are aligned to the strings of that grammar by
Wagner and Fischer's table.  All strings end alike, so one table over suffixes
serves every length: ``rest[i][r]`` is the cheapest way to turn the rows from i
on into the last r letters.  The table is a band (Ukkonen): a script that costs
at most the incumbent deletes and inserts a bounded number of turns.  The
cheapest lengths are then traced together and their audits compared letter by
letter; the least one wins.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import common as c
from tidemark.llm.turns import by_conversation

# --- fixed values: costs of the edits, white space and sentence ends ---
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# --- end of fixed values ---

FAR = np.int64(1) << 40
PAIRS = {"su", "ua", "au"}


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): ``b``lank, ``d``uplicate, ``t``runcated, or ``-``."""
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(SPACE)
        out.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ENDS else "t")
        seen.add((role, text))
    return out


def kinds(rows: list[tuple[str, str]], fault: list[str]) -> str:
    """A letter per row: its role's initial (``x`` for any other), upper case if truncated, ``.`` if it has to go."""
    out = []
    for (role, _), f in zip(rows, fault):
        k = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("." if f in "bd" else k.upper() if f == "t" else k)
    return "".join(out)


def incumbent(code: str) -> int:
    """The cost of a plain repair: truncated rows go, the others take the role that is due."""
    cost = due = taken = 0
    system = False
    for k in code:
        if not k.islower():
            cost += DELETE
        elif k == "s" and not taken and not system:
            system = True
        else:
            cost += k != "ua"[due]
            due, taken = 1 - due, taken + 1
    if due:  # the last one has no partner
        cost, taken = cost + DELETE, taken - 1
    return min(DELETE * len(code), cost + (DELETE if system and not taken else 0))


class Table:
    """Costs of turning the rows from i on into the last r letters, in a band of r around the rows that are left.

    Only every ``step``-th row stays; the others are computed again on the way
    back, so memory grows with the root of a conversation's length times its band.
    """

    def __init__(self, code: str, limit: int):
        n = len(code)
        self.code, self.n = code, n
        self.low, self.high = limit // DELETE + 1, limit // INSERT  # a system turn takes a row and none of the r letters
        self.width = self.low + self.high + 1
        self.step = max(1, math.isqrt(n))
        r = np.arange(self.width) - self.low
        last = np.where(r >= 0, np.abs(r) * INSERT, FAR)
        self.kept = {n: (last, np.full(self.width, FAR))}
        now = self.kept[n]
        for i in range(n - 1, -1, -1):
            now = self.before(i, now)
            if i % self.step == 0:
                self.kept[i] = now
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def first(self, i: int) -> int:
        """The letters at position 0 of row i's band."""
        return self.n - i - self.low

    def letters(self, r: np.ndarray) -> np.ndarray:
        """Whether the letter r from the end is a user's."""
        return r % 2 == 0

    def before(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row i from row i + 1: costs without and with a system turn still to come."""
        rest, system = after
        k = self.code[i]
        r = self.first(i) + np.arange(self.width)
        # the band of row i + 1 starts one letter lower: r sits there one place further
        gone = np.append(rest[1:], FAR) + DELETE
        take = self.taking(k, r) + rest
        best = np.where(r >= 0, np.minimum(gone, take), FAR)
        best = np.minimum(FAR, np.minimum.accumulate(best - INSERT * r) + INSERT * r)
        best = np.where(r >= 0, best, FAR)
        later = np.append(system[1:], FAR) + DELETE
        if k in "sS":
            own = np.append(rest[1:], FAR) + (TRUNCATED if k == "S" else 0)
            later = np.minimum(later, np.where((r >= 2) & (r % 2 == 0), own, FAR))
        return best, np.minimum(later, FAR)

    def taking(self, k: str, r: np.ndarray) -> np.ndarray:
        """The cost of making a row the letter r from the end, by keeping or reroling it."""
        if k == ".":
            return np.full(len(r), FAR)
        fits = self.letters(r) if k in "uU" else ~self.letters(r) if k in "aA" else np.zeros(len(r), bool)
        return np.where(r >= 1, np.where(fits, 0, REROLE) + (TRUNCATED if k.isupper() else 0), FAR)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            self.block.clear()
            top = min(self.n, (i // self.step + 1) * self.step)
            now = self.kept[top]
            for j in range(top - 1, i - 1, -1):
                now = self.block[j] = self.before(j, now)
            for j in range(i - 1, i // self.step * self.step, -1):
                now = self.block[j] = self.before(j, now)
        return self.block[i]

    def cost(self, i: int, r: np.ndarray, system: bool) -> np.ndarray:
        at = r - self.first(i)
        inside = (at >= 0) & (at < self.width) & (r >= 0)
        return np.where(inside, self.row(i)[system][np.clip(at, 0, self.width - 1)], FAR)


def aligned(code: str) -> tuple[int, str]:
    """The least cost and, of the scripts of that cost to any legal length, the least audit."""
    n = len(code)
    limit = incumbent(code)
    table = Table(code, limit)
    lengths = np.arange(0, n + table.high + 1)
    plain = lengths[lengths % 2 == 0]
    ends = [plain, plain[plain >= 2]]
    cost = [table.cost(0, ends[s], bool(s)) for s in (0, 1)]
    least = int(min(x.min(initial=FAR) for x in cost))
    # letters to come of every script that is still among the least, without and with a system turn to come
    live = [e[x == least] for e, x in zip(ends, cost)]
    audit, i, left = [], 0, least
    while i < n or any(len(x) and x.max() > 0 for x in live) or len(live[1]):
        rest, system = live
        steps: list[tuple[str, int, list[np.ndarray], list[np.ndarray]]] = []
        if i < n:
            k = code[i]
            steps.append(("D", 1, [rest, system], [np.full(len(rest), DELETE), np.full(len(system), DELETE)]))
        steps.append(("I", 0, [rest - 1, system[:0]], [np.where(rest >= 1, INSERT, FAR), system[:0]]))
        if i < n and k != ".":
            extra = TRUNCATED if k.isupper() else 0
            fits = table.letters(rest) if k in "uU" else ~table.letters(rest) if k in "aA" else np.zeros(len(rest), bool)
            keep = np.where((rest >= 1) & fits, extra, FAR)
            own = system if k in "sS" else system[:0]
            steps.append(("K", 1, [np.concatenate([rest - 1, own]), system[:0]], [np.concatenate([keep, np.full(len(own), extra)]), system[:0]]))
            steps.append(("R", 1, [rest - 1, system[:0]], [np.where((rest >= 1) & ~fits, REROLE + extra, FAR), system[:0]]))
        for letter, rows, to, price in steps:
            after = [t[(p < FAR) & (p + table.cost(i + rows, t, bool(s)) == left)] for s, (t, p) in enumerate(zip(to, price))]
            if len(after[0]) or len(after[1]):
                # every script that takes this step here pays the same for it
                paid = next(int(p[(p < FAR) & (p + table.cost(i + rows, t, bool(s)) == left)][0]) for s, (t, p) in enumerate(zip(to, price)) if len(after[s]))
                audit.append(letter)
                live, i, left = [np.unique(x) for x in after], i + rows, left - paid
                break
        else:
            raise AssertionError("no step of the least cost")
    return least, "".join(audit)


remembered = lru_cache(1 << 15)(aligned)


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits of an audit."""
    out: list[tuple[str, str]] = []
    i = 0
    for step in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if step == "I":
            out.append((due, ""))
            continue
        role, text = rows[i]
        i += 1
        if step != "D":
            out.append((role if step == "K" else due, text))
    return out


def mended(rows: list[dict]) -> tuple:
    rows = [r for r in rows if r["present"]]
    turns = {r["turn"] for r in rows if r["turn"] is not None}
    pairs = [(r["role"], r["text"]) for r in rows]
    fault = faults(pairs)
    code = kinds(pairs, fault)
    cost, audit = (remembered if len(code) <= 64 else aligned)(code)
    roles = [role[:1] for role, _ in pairs]
    illegal = sum(a + b not in PAIRS for a, b in zip(roles, roles[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    out = [{"role": role, "text": text} for role, text in repaired(pairs, audit)]
    return gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, out


RESULT = (*((n, c.LONG) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", c.STRING),
          ("repaired", T.ArrayType(c.struct(("role", c.STRING), ("text", c.STRING)))))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row per conversation.

    Turns are taken in order, null turns first; rows of one turn by role and
    text.  A null role or text is one space.  The rows with a null id are one
    conversation.  Rows for which ``present`` is not true only name their
    conversation; one without other rows has zeros, an empty audit and no
    turns.  A role that begins with none of s, u and a, an empty one too, can
    only be given another or deleted.  Repeated rows count as often as they
    occur; an empty table gives an empty result; other columns are not read.
    A conversation is repaired as a whole in one task.
    """
    named = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    own = [c.col(source).alias(name) for name, source in named.items()]
    rows = df.select(*own, (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.select("conv", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "present")
    return by_conversation(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], mended, RESULT)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): planted faults by a hash of id and turn, to measure the repair with.

    Of twenty hash values 0 drops the row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it and 4 makes it a user's.  Nulls are one space,
    in the hashed key as well.
    """
    own = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows = c.only(df, **own)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(text("conv"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("fate")
    rows = rows.select("conv", "turn", text("role").alias("role"), text("text").alias("text"), fate)
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))))
    changed = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("fate") != 0).alias("present"))
