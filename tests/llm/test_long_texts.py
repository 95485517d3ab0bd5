"""Texts with more distinct pieces than a table holds."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import bpe, packing, pieces


@pytest.mark.parametrize("tool", [lambda: packing.Words(public_tokenizers.path("word_bpe_49k.json")), lambda: bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))])
def test_one_long_text_of_distinct_pieces(monkeypatch, tool):
    text = " ".join(f"{i * 7919:x}." for i in range(3000))
    texts = pa.array(["short one. two", text, None, "x" * 900 + " end.", text[:500]])
    flat = lambda t: [y.tolist() for _, got in t.encode(texts) for x in got for y in (x if isinstance(x, tuple) else (x,))]
    want = flat(tool())
    for name, value in (("BITS", 10), ("SLOTS", 1024), ("FULL", 400), ("STEP", 300)):
        monkeypatch.setattr(pieces, name, value)
    assert flat(tool()) == want


def test_table_is_emptied_between_ranges(monkeypatch):
    for name, value in (("BITS", 10), ("SLOTS", 1024), ("FULL", 400), ("STEP", 300)):
        monkeypatch.setattr(pieces, name, value)
    words = [str(i).encode() for i in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    start, end = pieces.tight(data, np.array([0, len(data)]))
    table = pieces.Table(lambda ws: [[int(w)] for w in ws], lambda w: w.endswith(b"7"))
    ids, ends, flags = table.runs(data, start, end)
    assert ids.tolist() == list(range(3000)) and ends.tolist() == list(range(1, 3001))
    assert np.flatnonzero(flags).tolist() == list(range(7, 3000, 10))
