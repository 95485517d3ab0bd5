"""Packing documents into training sequences by order-preserving dynamic programming.

The token stream of a partition is cut into windows of at most ``size``
tokens.  Window ends are chosen among all document ends (free), all sentence
ends and all other tokens (both for a penalty), so that padding plus penalties
are least.  Since padding is linear in the window's start, the best start is
the minimum of a sliding window, kept in a monotone queue: each cut place is
entered and left once.
"""

from __future__ import annotations

import itertools
import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import common as c
from tidemark.llm.pieces import Table, buffers, steps, tight

SIZE = 4096
SENTENCE_PENALTY = 4.0
INNER_PENALTY = 32.0
BLOCK = 1 << 20
SENTENCE_END = re.compile("(?:[.!?]|…|。)(?:[\"')\\]]|”|’)*$".encode())


def cut_points(ends: list[int], sentences: np.ndarray, start: int) -> tuple[list[int], list[float]]:
    """Every document end and every sentence end behind ``start``, with their penalties."""
    docs = np.asarray(ends, np.int64)
    place = np.union1d(docs, sentences)
    place = place[place > start]
    return place.tolist(), np.where(np.isin(place, docs), 0.0, SENTENCE_PENALTY).tolist()


def windows(place: list[int], penalty: list[float], start: int, size: int, inner: float | None = None) -> tuple[list[int], int]:
    """The window ends of least cost, and where the last, unfinished window begins.

    cost(j, i) = size - (place[i] - place[j]) + penalty[i], so the best j for i
    minimises cost[j] + place[j] over the places within ``size`` before i.
    With ``inner`` a window may also end at any token between the places, for
    that penalty.  Of the tokens with the same best start the last one, where a
    window is full, costs as much in cost[j] + place[j] and reaches farthest:
    only it is entered, when its start leaves the queue, and nothing is lost.
    """
    spot, best, back = [start], [start + 0.0], [-1]  # best: cost + place
    queue: deque[int] = deque([0])

    def enter(at: int, j: int, extra: float) -> None:
        key = best[j] + size + extra
        spot.append(at)
        best.append(key)
        back.append(j)
        while queue and best[queue[-1]] >= key:
            queue.pop()
        queue.append(len(spot) - 1)
    for at, extra in zip(place, penalty):
        while spot[queue[0]] < at - size:
            full = spot[queue[0]] + size
            if inner is not None and full > spot[-1]:
                enter(full, queue[0], inner)
            queue.popleft()
        enter(at, queue[0], extra)
    last = len(spot) - 1
    i = min(itertools.takewhile(lambda k: spot[last] - spot[k] < size, range(last, -1, -1)), key=lambda k: best[k] - spot[k])
    # the places of less than a window before the end: the cheapest one starts what is carried on
    tail, ends = spot[i], []
    while i > 0:
        ends.append(spot[i])
        i = back[i]
    return ends[::-1], tail


def binary_parts(n: int, size: int) -> list[int]:
    """A remainder as powers of two, the largest first: such sequences need no padding."""
    return [size] * (n // size) + [1 << k for k in range(size.bit_length(), -1, -1) if n % size >> k & 1]


class Words:
    """Ids of texts: white-space separated pieces, each distinct one encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = Table(self.learn, lambda w: SENTENCE_END.search(w) is not None, lower=True)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, pieces: list[bytes]) -> list[list[int]]:
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [e.ids for e in got]

    def marked(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and token counts at sentence ends, of one text with special tokens."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        stop = [m.end() for m in re.finditer(r"\S+", text) if SENTENCE_END.search(m[0].encode("utf-8", "replace"))]
        to = np.maximum.accumulate(np.array([b for _, b in got.offsets], np.int64))
        return np.array(got.ids, np.uint32), np.searchsorted(to, np.array(stop, np.int64), "right")

    def encode(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(position of the first text, [(ids, token counts at sentence ends)]), a bounded step at a time."""
        data, off = buffers(column)
        for a, b in steps(off):
            part, ends = data[off[a]:off[b]], off[a:b + 1] - off[a]
            none = np.zeros(0, np.int64)
            out = [(np.zeros(0, np.uint32), none)] * (b - a)
            if len(part):
                start, end = tight(part, ends)
                ids, to, flags = self.table.runs(part, start, end)
                stop = to[flags]
                bound = np.concatenate([[0], to])[np.searchsorted(start, ends)]
                cut = np.searchsorted(stop, bound, "right")
                out = [(ids[x:y], stop[i:j] - x) for x, y, i, j in zip(bound[:-1], bound[1:], cut[:-1], cut[1:])]
                raw = part.tobytes()
                for mark in self.marks:
                    if mark in raw:  # special tokens written in a text are not cut
                        for k in range(b - a):
                            text = raw[ends[k]:ends[k + 1]]
                            if mark in text:
                                out[k] = self.marked(text.decode("utf-8", "replace"))
            yield a, out


def words(path: str) -> Words:
    return c.held(("packing", path), lambda: Words(path))


class Packer:
    """Collects documents of one task and emits their pieces, block by block."""

    def __init__(self, task: int, size: int):
        self.next, self.size = task << 33, size
        self.reset(0)

    def reset(self, start: int) -> None:
        self.start = start
        self.docs: list[tuple] = []      # (id, ids, tokens, first token in the stream, tokens emitted before)
        self.ends: list[int] = []
        self.sentences: list[np.ndarray] = []
        self.end = start

    def add(self, doc_id, ids: bytes, sentences: np.ndarray) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, ids, n, self.end))
        self.sentences.append(sentences + self.end)
        self.end += n
        self.ends.append(self.end)

    def pieces(self, ends: list[int]) -> list[tuple]:
        """Rows of the windows that end at ``ends``; drops the documents that are finished."""
        rows, k, at = [], 0, self.start
        for end in ends:
            begin = at
            while at < end:
                doc_id, ids, n, first = self.docs[k]
                stop = min(end, first + n)
                rows.append((doc_id, at - first, stop - at, ids[(at - first) * 4:(stop - first) * 4], n, self.next, at - begin))
                at = stop
                if stop == first + n:
                    k += 1
            self.next += 1
        self.start = at
        self.docs, self.ends = self.docs[k:], self.ends[k:]
        return rows

    def flush(self, final: bool) -> list[tuple]:
        if self.end == self.start:
            return []
        sentences = np.concatenate(self.sentences) if self.sentences else np.zeros(0, np.int64)
        place, penalty = cut_points(self.ends, sentences, self.start)
        ends, tail = windows(place, penalty, self.start, self.size, INNER_PENALTY)
        if final:
            for n in binary_parts(self.end - tail, self.size):
                tail += n
                ends.append(tail)
        rows = self.pieces(ends)
        self.sentences = [sentences[sentences > self.start]]
        return rows


PIECE = (("start", c.LONG), ("length", c.LONG), ("ids", c.BINARY), ("doc_tokens", c.LONG), ("sequence_id", c.LONG), ("offset", c.LONG))


def pack(df: DataFrame, path: str, end_id: int = 2, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece of a document.

    Documents keep the order of their partition; nothing is shuffled, and a
    task holds one block of tokens besides the document in hand.  Each
    document's ids end with ``end_id``, so a null or empty text is one id.
    The end of a partition is cut into powers of two, which need no padding.
    Repeated rows are packed as often as they occur; an empty table gives no piece.
    """
    if size & (size - 1):
        raise ValueError("the sequence size must be a power of two")
    src = c.only(df, id=id_col, text=text_col)
    kind = c.column_type(src, "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, arrow = Packer(TaskContext.get().partitionId(), size), None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["id", *(n for n, _ in PIECE)])
        for b in batches:
            arrow = b.schema.field("id").type
            for at, got in words(path).encode(b.column("text")):
                for doc_id, (tokens, sentences) in zip(b.column("id").slice(at, len(got)).to_pylist(), got):
                    packer.add(doc_id, np.append(tokens, np.uint32(end_id)).astype("<u4").tobytes(), sentences)
                    if packer.end - packer.start >= BLOCK and (rows := packer.flush(False)):
                        yield batch(rows)
        if rows := packer.flush(True):
            yield batch(rows)
    return src.mapInArrow(task, c.struct(("id", kind), *PIECE))
