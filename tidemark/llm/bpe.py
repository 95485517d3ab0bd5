"""Byte-level BPE: greedy longest match speculates, pair checks verify, only failing words are merged exactly.

A token sequence is the result of BPE exactly when every token is the encoding
of its own bytes and no two neighbours could merge across their border before
the merges inside them ran.  Greedy longest match finds that sequence for most
words; the check runs over all adjacent pairs of a batch at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common as c
from tidemark.llm.pieces import Table, buffers, covering, steps

# --- fixed values: the pattern that splits text before merging (byte-level BPE, 50k) ---
SPACE = r"\p{White_Space}"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+")
# --- end of fixed values ---

NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[ch] for ch in s)
        names = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*names.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in names.items():
            self.bytes[i] = raw(s)
        self.ids = {self.bytes[i]: i for i in names.values()}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            i, j, t = names[a], names[b], names[a + b]
            self.merge[i, j] = (r, t)
            self.rank[t], self.left[t], self.right[t] = r, i, j
        keys = np.array([i * size + j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.key_rank = size, keys[order], np.arange(len(keys))[order]
        self.starts = {t[:k] for t in self.ids for k in range(1, len(t) + 1)}
        # a token that BPE itself would spell otherwise is never proposed
        made = np.flatnonzero(self.rank >= 0)
        stands = np.ones(size, bool)
        stands[made] = self.holds(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            stands[t] &= stands[self.left[t]] and stands[self.right[t]]
        self.stands = stands

    def holds(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of neighbours stays apart.

        Undoes the merges along the border from the last to the first; at each
        step the tokens that then met must not have had a merge due before one
        of them was used up.
        """
        n = len(a)
        ok = np.ones(n, bool)
        live = np.arange(n)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(n, NEVER) if limit is None else limit.astype(np.int64)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            due = np.where(self.keys[at] == key, self.key_rank[at], NEVER)
            fails = due < limit
            ok[live[fails]] = False
            ra, rb = self.rank[a], self.rank[b]
            more = ~fails & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            undo_right = rb >= ra  # equal merges run from the left, so the right one is the later
            limit = np.where(undo_right, rb + 1, ra)
            a, b = np.where(undo_right, a, self.right[a]), np.where(undo_right, self.left[b], b)
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n = [], 0, len(word)
        ids, starts = self.ids, self.starts
        while i < n:
            j, best, end = i + 1, ids[word[i:i + 1]], i + 1
            while j < n:
                j += 1
                piece = word[i:j]
                if piece not in starts:
                    break
                t = ids.get(piece)
                if t is not None:
                    best, end = t, j
            out.append(best)
            i = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """BPE by its definition: the earliest merge first, from the left; n log n through a heap."""
        tok = [self.ids[word[i:i + 1]] for i in range(len(word))]
        n = len(tok)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((tok[i], tok[i + 1])))]
        heapify(heap)
        while heap:
            _, i, x, y, t = heappop(heap)
            j = nxt[i]
            if tok[i] != x or j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = t, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if m := merge.get((t, tok[k])):
                    heappush(heap, (m[0], i, t, tok[k], m[1]))
            if (p := prev[i]) >= 0 and (m := merge.get((tok[p], t))):
                heappush(heap, (m[0], p, tok[p], t, m[1]))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words the check sent to exact merging."""
        out = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for w in out for t in w), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(out)), lengths)
        bad = np.zeros(len(out), bool)
        bad[of[~self.stands[flat]]] = True
        inner = np.flatnonzero(of[1:] == of[:-1])
        bad[of[inner[~self.holds(flat[inner], flat[inner + 1])]]] = True
        fails = np.flatnonzero(bad)
        for k in fails.tolist():
            out[k] = self.exact(words[k])
        return out, len(fails)


class Codec:
    """Encodes and decodes the texts of one task."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.table = Table(self.learn)
        special = sorted(self.v.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = [s.encode() for s in special]

    def learn(self, pieces: list[bytes]) -> list[list[int]]:
        cut = [SPLIT.findall(p.decode("utf-8", "replace")) for p in pieces]
        new = list(dict.fromkeys(w for ws in cut for w in ws))
        known = dict(zip(new, self.v.encode_words([w.encode() for w in new])[0]))
        return [known[ws[0]] if len(ws) == 1 else [t for w in ws for t in known[w]] for ws in cut]

    def one(self, text: str) -> np.ndarray:
        """A text with special tokens or white space beyond ASCII, word by word."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else (text,)):
            if k % 2:
                out.append(self.v.special[part])
            elif part:
                words = [w.encode() for w in SPLIT.findall(part)]
                distinct = list(set(words))
                known = dict(zip(distinct, self.v.encode_words(distinct)[0]))
                for w in words:
                    out += known[w]
        return np.array(out, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(position of the first text, ids of each text), a bounded step at a time."""
        data, off = buffers(column)
        for a, b in steps(off):
            part, ends = data[off[a]:off[b]], off[a:b + 1] - off[a]
            out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (b - a)
            if len(part):
                start, end = covering(part, ends)
                ids, to, _ = self.table.runs(part, start, end)
                bound = np.concatenate([[0], to])[np.searchsorted(start, ends)]
                out = [ids[x:y] for x, y in zip(bound[:-1], bound[1:])]
                for k in self.odd(part, ends):
                    out[k] = self.one(part[ends[k]:ends[k + 1]].tobytes().decode("utf-8", "replace"))
            yield a, out

    def odd(self, data: np.ndarray, ends: np.ndarray) -> list[int]:
        """Texts that must not be cut at ASCII white space alone."""
        found = [np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))]
        if len(data) > 2:
            x, y, z = data[:-2], data[1:-1], data[2:]
            e2 = np.flatnonzero(x == 0xE2)
            y2, z2 = y[e2], z[e2]
            found.append(e2[(y2 == 0x80) & ((z2 <= 0x8A) | (z2 == 0xA8) | (z2 == 0xA9) | (z2 == 0xAF)) | (y2 == 0x81) & (z2 == 0x9F)])
            found += [np.flatnonzero((x == a) & (y == b) & (z == 0x80)) for a, b in ((0xE1, 0x9A), (0xE3, 0x80))]
        raw = data.tobytes()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                found.append(np.array([at]))
                at = raw.find(mark, at + 1)
        return np.unique(np.searchsorted(ends, np.concatenate(found), "right") - 1).tolist()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return c.held(("bpe", path), lambda: Codec(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): the token ids of every whole text, as little-endian unsigned 32-bit integers.

    ``decoded`` adds the text that the ids decode to, in the same pass.
    Special tokens written in a text are themselves; no others are added.  A
    null or empty text has no ids; repeated rows give repeated results.
    ``path`` is the vocabulary file, installed on every executor.
    """
    src = c.only(df, id=id_col, text=text_col)
    more = (("decoded", c.STRING),) if decoded else ()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            for at, got in tool.encode(b.column("text")):
                packed = [x.astype("<u4").tobytes() for x in got]
                cols = [b.column("id").slice(at, len(got)), pa.array(packed, pa.binary())]
                if decoded:
                    cols.append(pa.array([tool.decode(x) for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", *(n for n, _ in more)])
    return src.mapInArrow(task, c.struct(("id", c.column_type(src, "id")), ("ids", c.BINARY), *more))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of each id sequence (null: empty), special tokens written out."""
    schema = c.T.StructType([*df.schema.fields, c.T.StructField("decoded", c.STRING)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                text = [codec(path).decode(x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, "decoded"])
    return df.mapInArrow(task, schema)


def n_tokens(ids: str = "ids") -> c.Column:
    return (F.octet_length(ids) / 4).cast("long")
