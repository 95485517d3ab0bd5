"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into symbols (insult, threat,
target, negation, reported speech, other).  A scope transducer reads them and
sends each insult or threat out with the role it has there: plain, aimed at a
target, negated or reported.  Both are composed word by word, only for clauses
that hold an insult or a threat.  The clause scores, by role, are the features
of a small logistic model.  Insults are learned from labelled documents as
words and word beginnings; the closed-class words are fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import common as c
from tidemark.llm.sketch import sketch

# --- fixed values: closed-class words of the grammar (en, de, fr, es) ---
TARGET = frozenset("you your yours yourself youre u he she they them him her du dich dir dein deine euch ihr sie er tu te toi ton ta vous votre il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split())
NEGATION = frozenset("not no never neither nor without isn't aren't wasn't don't nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun aucune nunca jamás sin tampoco".split())
REPORTED = frozenset("said says say told called calls quoted quote wrote reported alleged sagte sagt schrieb nannte zitierte dit disait écrit appelé dijo dice escribió llamó citó".split())
THREAT = frozenset("kill killing murder stab shoot strangle behead lynch töten umbringen ermorden erschießen tuer égorger poignarder matar asesinar apuñalar degollar".split())
# --- end of fixed values ---

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
APOSTROPHE = re.compile(r"['’]")
#: A character that may stand inside a word, as the grammar or ``spoken`` cut them.
INNER = re.compile(r"(?:[^\W\d_]|['’])+")
CLAUSE_END = re.compile(r"[.!?;:\n|…]")
QUOTE = re.compile(r"[\"“”„«»]")
LONGEST_CLAUSE = 2_000
ROLES = ("plain", "aimed", "negated", "reported", "threat", "threat_aimed")
#: Bias, insults in any role, how that changes if aimed, negated or reported, threats, aimed threats:
#: what they weigh before any label is seen, and how firmly.
PRIOR = np.array([-3.0, 2.5, 0.5, -1.5, -1.5, 1.5, 4.0])
FIRMNESS = np.array([0.02, 0.05, 0.5, 0.5, 0.5, 0.5, 0.5])
#: Doubled log-likelihood gain at which a word marks toxic texts beyond chance among a million words.
CERTAIN = 28.0
NEGATED_FOR = 3


@dataclass
class Lexicon:
    """Insults: whole words and word beginnings with their weights."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        if self.starts:
            for k in range(PREFIX[0], min(len(word), PREFIX[-1]) + 1):
                best = max(best, self.starts.get(word[:k], 0.0))
        return best


class Lexical:
    """Word -> (symbol, weight)."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __call__(self, word: str) -> tuple[str, float]:
        """A word with an apostrophe is one step: a negation as a whole, else the strongest of its parts, which are the words of ``spoken``."""
        parts = APOSTROPHE.split(word)
        if len(parts) == 1:
            return self.plain(word)
        if "'".join(parts) in NEGATION:
            return "negation", 0.0
        return max(map(self.plain, parts), key=lambda x: (x[1], x[0] != "other"))

    def plain(self, word: str) -> tuple[str, float]:
        if w := self.lexicon.weight(word):
            return "insult", w
        if word in THREAT:
            return "threat", 1.0
        for symbol, words in (("negation", NEGATION), ("target", TARGET), ("reported", REPORTED)):
            if word in words:
                return symbol, 0.0
        return "other", 0.0


class Scope:
    """Symbols -> (role, weight).  A state is (words still negated, reported, target seen)."""

    start = (0, False, False)

    def step(self, state: tuple[int, bool, bool], symbol: str, weight: float) -> tuple[tuple[int, bool, bool], tuple[str, float] | None]:
        left, reported, target = state
        if symbol == "negation":
            return (NEGATED_FOR, reported, target), None
        if symbol == "reported":
            return (left, True, target), None
        if symbol == "target":
            return (max(0, left - 1), reported, True), None
        nxt = (max(0, left - 1), reported, target)
        if symbol == "insult":
            return nxt, ("negated" if left else "reported" if reported else "aimed" if target else "plain", weight)
        if symbol == "threat":
            return nxt, ("reported", weight) if left or reported else ("threat_aimed" if target else "threat", weight)
        return nxt, None


class Grammar:
    """The two transducers composed, run over the clauses that hold a trigger."""

    def __init__(self, lexicon: Lexicon):
        self.lexical, self.scope = Lexical(lexicon), Scope()
        self.triggers = ahocorasick.Automaton()
        for w in {*lexicon.words, *lexicon.starts, *THREAT}:
            self.triggers.add_word(w, w)
        self.triggers.make_automaton()

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of the clauses around triggers, each once."""
        done = 0
        for end, word in self.triggers.iter(text):
            begin = end - len(word) + 1
            if begin < done or begin and text[begin - 1].isalpha():
                continue
            low = max(done, begin - LONGEST_CLAUSE)
            if low > done and INNER.match(text, low - 1, low) and (m := INNER.match(text, low, begin)):
                low = m.end()  # not inside a word
            a = low
            for m in CLAUSE_END.finditer(text, low, begin):
                a = m.end()
            m = CLAUSE_END.search(text, end, min(len(text), end + LONGEST_CLAUSE))
            done = m.end() if m else min(len(text), end + LONGEST_CLAUSE)
            if not m and INNER.match(text, done - 1, done) and (m := INNER.match(text, done)):
                done = m.end()
            yield a, done

    def clause(self, text: str) -> list[tuple[str, float]]:
        state, out = self.scope.start, []
        quotes = [m.start() for m in QUOTE.finditer(text)]
        for m in WORD.finditer(text):
            symbol, weight = self.lexical(m[0])
            state, sent = self.scope.step(state, symbol, weight)
            if sent:
                inside = len(quotes) > 1 and sum(q < m.start() for q in quotes) % 2 == 1
                out.append((sent[0] if not inside or sent[0] == "negated" else "reported", sent[1]))
        return out

    def features(self, text: str | None) -> list[float]:
        """log(1 + weight of the insults), the parts of it that are aimed, negated and reported, log(1 + threats) by target."""
        total = dict.fromkeys(ROLES, 0.0)
        low = (text or "").lower()
        if low:
            for a, b in self.clauses(low):
                for role, weight in self.clause(low[a:b]):
                    total[role] += weight
        insults = sum(total[r] for r in ROLES[:4])
        x = math.log1p(insults)
        parts = [x * total[r] / insults if insults else 0.0 for r in ROLES[1:4]]
        return [x, *parts, math.log1p(total["threat"]), math.log1p(total["threat_aimed"])]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, grammar: Grammar, texts: list[str | None]) -> list[float]:
        x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), len(ROLES))
        return (1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:])))).tolist()


PREFIX = (4, 5, 6)


def spoken(text: Column) -> Column:
    """Distinct lower-case words of a text, and their beginnings marked with a star."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))

    def starts(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 2), *map(starts, PREFIX)))


def learn_lexicon(rows: DataFrame, toxic: int, clean: int, least: int, purity: float) -> Lexicon:
    """Words and beginnings that mark toxic texts beyond chance; then, greedily, those that explain toxic texts still unexplained.

    Greedy cover finds rare insults without taking in the other words of toxic
    texts: once a text is explained, its remaining words earn nothing.
    """
    said = rows.select("h", "toxic", F.explode(spoken(F.col("text"))).alias("f"))
    counts = said.groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = F.log((F.col("t") + 0.1) / (toxic + 0.2)) - F.log((F.col("n") + 0.5) / (clean + 1.0))
    good = counts.filter(F.col("t") >= least).withColumn("w", odds).filter(F.col("w") >= purity)
    pairs = said.filter("toxic = 1").join(good, "f").groupBy("f").agg(F.first("w").alias("w"), F.first("n").alias("n"), F.collect_set("h").alias("hs")).collect()
    left = [(r["f"], r["w"], r["n"], set(r["hs"])) for r in pairs]
    found = Lexicon()
    base = toxic / (toxic + clean)

    def gain_in_likelihood(t: int, n: int) -> float:
        return 2 * sum(k * math.log(k / (t + n) / p) for k, p in ((t, base), (n, 1 - base)) if k)
    sure = sorted((r for r in left if gain_in_likelihood(len(r[3]), r[2]) >= CERTAIN), key=lambda r: (r[0].endswith("*"), -len(r[0]), r[0]))
    explained = set().union(*(r[3] for r in sure))
    under: dict[str, set] = {}  # what longer beginnings and whole words under a beginning explain
    for f, w, _, hs in sure:
        name, part = f.rstrip("*"), f.endswith("*")
        if part and len(hs - under.get(name, set())) < least:
            continue  # a beginning must add to them
        (found.starts if part else found.words)[name] = float(w)
        for k in PREFIX:
            if k < len(name) or k == len(name) and not part:
                under.setdefault(name[:k], set()).update(hs)
    left = [(f, w, n, hs - explained) for f, w, n, hs in left if len(hs - explained) >= least]
    while left:
        gain = lambda r: (len(r[3]) * r[1] / (1 + r[2]), not r[0].endswith("*"), len(r[0]), r[0])
        f, w, n, hs = max(left, key=gain)
        if len(hs) < least:
            break
        (found.starts if f.endswith("*") else found.words)[f.rstrip("*")] = float(w)
        left = [(g, v, m, rest) for g, v, m, s in left if g != f and len(rest := s - hs) >= least]
    return found


def fit(docs: DataFrame, labels: DataFrame, limit: int = 24_000, least: int = 3, purity: float = 2.5,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and role weights from at most ``limit`` labelled documents (first by a hash of the id).

    Equal texts count once, and so do near copies, as far as their smallest
    shingle hashes agree.  Without toxic or without clean labels the prior weights stand.
    """
    known = c.only(labels, id=id_col, toxic=label_col).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    chosen = c.label_sample(known.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")), limit)
    src = c.only(docs, id=id_col, text=text_col)
    rows = src.join(F.broadcast(chosen), "id").select(F.xxhash64("text").alias("h"), "text", "toxic")
    rows = rows.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = c.written(rows.withColumn("s", sketch(F.col("text"), 4)))
    spread = rows.select("h", "s", "toxic")
    for k in range(1, 5):  # copies that share the k-th smallest hash leave one
        by = F.coalesce(F.get("s", F.lit(k - 1)), F.col("h"))
        spread = spread.groupBy(by.alias("_k"), "toxic").agg(F.min(F.struct("h", "s")).alias("m")).select("m.h", "m.s", "toxic")
    rows = c.written(rows.drop("s", "toxic").join(spread.select("h", "toxic"), "h"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicon(rows, n.get(1, 0), n.get(0, 0), least, purity) if n.get(1) and n.get(0) else Lexicon()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            x = [grammar.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])
    # equal feature rows collapse, so the driver sees few of the at most ``limit`` rows
    parts = rows.mapInArrow(task, c.struct(("x", T.ArrayType(c.DOUBLE)), ("toxic", c.INT)))
    got = parts.groupBy("x", "toxic").agg(F.count("*").alias("n")).orderBy("x", "toxic").collect()
    return Model(lexicon, logistic(np.array([r["x"] for r in got]).reshape(len(got), len(ROLES)), np.array([r["toxic"] for r in got], float), np.array([r["n"] for r in got], float)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic weights (bias first) by Newton's method, drawn to PRIOR."""
    w = PRIOR.copy()
    x = np.column_stack([np.ones(len(x)), x])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (n * (y - p)) - FIRMNESS * (w - PRIOR)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(FIRMNESS)
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, features) of every whole text.

    A null, empty or trigger-free text gets the score of no match; repeated
    rows give repeated results; an empty table an empty one.
    """
    src = c.only(docs, id=id_col, text=text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(grammar, b.column("text").to_pylist()), pa.float64())], ["id", "score"])
    return src.mapInArrow(task, c.struct(("id", c.column_type(src, "id")), ("score", c.DOUBLE)))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose text scores below ``limit``."""
    grammar: list[Grammar] = []

    def keep(texts: list[str | None]) -> list[bool]:
        if not grammar:
            grammar.append(Grammar(model.lexicon))
        return [s < limit for s in model.score(grammar[0], texts)]
    return c.filter_rows(docs, text_col, keep)
