"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector.  An n-gram is bound as the product of
its letters' vectors, each permuted (rolled) by its place; a text is the sum
(bundle) of its n-grams; a language is the sum of its texts' unit bundles.  A
text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import common as c

WIDTH = 1024
SCALE = 1 << 20
#: Characters of one step, and n-grams of one product.
SLICE = 500_000
BLOCK = 2048
GROUP = 1_000


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


class Encoder:
    """Bundles of texts.  Letter and n-gram vectors follow from the seed alone, so all tasks agree."""

    DENSE = 192     # letters up to which n-grams are numbered through a table
    LETTERS = 4096  # letters at which all are forgotten
    GRAMS = 16_384  # n-gram vectors held at once

    def __init__(self, width: int = WIDTH, seed: int = 11):
        self.width, self.seed = width, seed
        self.forget()

    def draw(self, code_point: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=[self.seed, code_point])).integers(0, 2, self.width)
        return (bits * 2 - 1).astype(np.int8)

    def forget(self) -> None:
        self.symbol = np.where(letter_table(), -1, 0).astype(np.int32)  # 0: any run of other characters
        self.letters = [self.draw(0x20)]
        self.slot = np.full(self.DENSE ** 3, -1, np.int32)
        self.reset()

    def reset(self) -> None:
        self.slot.fill(-1)
        self.rows: dict[int, int] = {}
        self.grams = np.zeros((1024, self.width), np.int8)

    def bind(self, fresh: list[tuple[int, int, int]]) -> None:
        """Vectors of n-grams not held yet; there is room for them."""
        while len(self.rows) + len(fresh) > len(self.grams):
            self.grams = np.resize(self.grams, (2 * len(self.grams), self.width))
        for i, j, k in fresh:
            r = self.rows[i << 42 | j << 21 | k] = len(self.rows)
            self.grams[r] = np.roll(self.letters[i], 2) * np.roll(self.letters[j], 1) * self.letters[k]

    def numbers(self, codes: np.ndarray, dense: bool) -> np.ndarray:
        """Rows of distinct n-grams, at most ``GRAMS``; holds until the next call."""
        if dense:
            split = lambda x: (x // self.DENSE ** 2, x // self.DENSE % self.DENSE, x % self.DENSE)
        else:
            split = lambda x: (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF)
        for again in (False, True):
            grams = [split(x) for x in codes[self.slot[codes] < 0].tolist()] if dense else [split(x) for x in codes.tolist()]
            fresh = [g for g in grams if g[0] << 42 | g[1] << 21 | g[2] not in self.rows]
            if again or len(self.rows) + len(fresh) <= self.GRAMS:
                break
            self.reset()
        self.bind(fresh)
        at = [self.rows[i << 42 | j << 21 | k] for i, j, k in grams]
        if not dense:
            return np.array(at, np.int64)
        self.slot[codes[self.slot[codes] < 0]] = at
        return self.slot[codes]

    def symbols(self, texts: list[str]) -> np.ndarray:
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
        sym = self.symbol[codes]
        new = np.unique(codes[sym < 0]).tolist()
        if len(new) and len(self.letters) + len(new) > self.LETTERS:
            self.forget()
            new = np.unique(codes[self.symbol[codes] < 0]).tolist()
        for cp in new:
            self.symbol[cp] = len(self.letters)
            self.letters.append(self.draw(cp))
        return self.symbol[codes] if new else sym

    def bundle(self, texts: list[str], inner: list[tuple[int, int]] | None = None) -> np.ndarray:
        """(texts x width) sums; a text without letters is all zero.

        Of a slice of a longer text only the letters in its ``inner`` range
        give n-grams; what lies around them are their neighbours.
        """
        out = np.zeros((len(texts), self.width), np.float32)
        sym = self.symbols(texts)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        from_, to = (np.array(x) for x in zip(*(inner or [(0, len(t)) for t in texts])))
        keep = np.empty(len(sym), bool)
        keep[:1] = sym[:1] > 0
        keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)
        where = np.flatnonzero(keep)
        s = np.concatenate([[0], sym[keep], [0]]).astype(np.int32)
        doc = np.searchsorted(first, where, "right") - 1
        # n-grams are centred on a kept letter, so every word gives one per letter
        centre = (s[1:-1] > 0) & (where >= (first + from_)[doc]) & (where < (first + to)[doc])
        a, b, d, doc = s[:-2][centre].astype(np.int64), s[1:-1][centre], s[2:][centre], doc[centre]
        if not len(doc):
            return out
        dense = len(self.letters) <= self.DENSE
        if dense:
            code = (a * self.DENSE + b) * self.DENSE + d
            seen = np.zeros(self.DENSE ** 3, bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
            place = np.zeros(self.DENSE ** 3, np.int32)
            place[distinct] = np.arange(len(distinct))
            at = place[code]
        else:
            distinct, at = np.unique(a << 42 | b.astype(np.int64) << 21 | d, return_inverse=True)
        for k in range(0, len(distinct), BLOCK):
            here = (at >= k) & (at < k + BLOCK) if len(distinct) > BLOCK else slice(None)
            row = self.numbers(distinct[k:k + BLOCK], dense)
            n = len(row)
            counts = np.bincount(doc[here] * n + (at[here] - k), minlength=len(texts) * n).reshape(len(texts), n)
            out += counts.astype(np.float32) @ self.grams[row].astype(np.float32)
        return out

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """Groups of texts of bounded size; a very long text in slices with a letter of context, which are added up."""
        out = np.zeros((len(texts), self.width), np.float64)
        group: list[int] = []
        parts: list[str] = []
        inner: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                np.add.at(out, group, self.bundle(parts, inner))
            for x in (group, parts, inner):
                x.clear()
            size = 0
        for i, t in enumerate(texts):
            t = (t or "").lower()
            for k in range(0, len(t), SLICE):
                low = max(0, k - 1)
                part = t[low:k + SLICE + 1]
                group.append(i)
                parts.append(part)
                inner.append((k - low, min(len(t), k + SLICE) - low))
                size += len(part)
                if size > SLICE or len(parts) >= 128:
                    flush()
        flush()
        return out


def encoder(width: int, seed: int) -> Encoder:
    return c.held(("language", width, seed), lambda: Encoder(width, seed))


class Model:
    """Language names and their unit prototypes."""

    def __init__(self, names: list[str], sums: np.ndarray, width: int, seed: int):
        self.names, self.width, self.seed = names, width, seed
        norm = np.linalg.norm(sums, axis=1, keepdims=True) if len(names) else 1.0
        self.prototypes = sums / np.where(norm > 0, norm, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for k in range(0, len(texts), GROUP):
            lang, score = self.group(texts[k:k + GROUP])
            langs += lang
            scores += score
        return langs, scores

    def group(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        v = encoder(self.width, self.seed).bundles(texts)
        norm = np.linalg.norm(v, axis=1)
        cos = v @ self.prototypes.T / np.where(norm > 0, norm, 1)[:, None]
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best], 0, 1)
        return [self.names[b] if n > 0 else "und" for b, n in zip(best, norm)], [float(s) if n > 0 else 0.0 for s, n in zip(score, norm)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 2_000, width: int = WIDTH, seed: int = 11) -> Model:
    """Prototypes from about ``per_language`` labelled texts of each language (the rows first by a hash of the id), 50,000 in all.

    Rows without a language or id are not learned from; null texts and texts
    without letters add nothing.  The driver gets ``width`` numbers per language.
    """
    src = c.only(docs, id=id_col, text=text_col, lang=lang_col)
    chosen = c.label_sample(src.filter(F.col("lang").isNotNull() & F.col("id").isNotNull()).select("id", "lang"), per_language, "lang")
    train = src.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").filter(F.col("lang").isNotNull()).select("lang", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in c.small(batches):
            add(total, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

    def add(total: dict[str, np.ndarray], b: pa.RecordBatch) -> None:
        v = encoder(width, seed).bundles(b.column("text").to_pylist())
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        unit = np.rint(v / np.where(norm > 0, norm, 1) * SCALE).astype(np.int64)  # whole numbers: sums do not depend on order
        lang = np.array(b.column("lang").to_pylist(), object)
        for name in set(lang):
            total[name] = total.get(name, 0) + unit[lang == name].sum(axis=0)
    parts = train.mapInArrow(task, c.struct(("lang", c.STRING), ("v", T.ArrayType(c.LONG))))
    rows = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in rows})
    sums = np.zeros((len(names), width))
    for r in rows:
        sums[names.index(r["lang"]), r["k"]] = r["x"]
    return Model(names, sums, width, seed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every whole text.

    ``und`` with score 0 for a null text, a text without letters, or a model
    without languages; ties go to the first name.  Repeated rows give repeated
    results, an empty table an empty one.
    """
    src = c.only(docs, id=id_col, text=text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.small(batches):
            lang, score = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])
    return src.mapInArrow(task, c.struct(("id", c.column_type(src, "id")), ("lang_pred", c.STRING), ("score", c.DOUBLE)))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.05) -> DataFrame:
    """The rows, unchanged, whose text has a language with a cosine of at least ``least``."""
    def keep(texts: list[str | None]) -> list[bool]:
        return [lang != "und" and score >= least for lang, score in zip(*model.predict(texts))]
    return c.filter_rows(docs, text_col, keep)
