"""Strings that break hash tables, windows and patterns: equal hashes, runs of one character, ruled lines."""

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, pieces, secret_scan


def thue_morse(n, zero, one):
    return "".join(one if i.bit_count() % 2 else zero for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_of_equal_hash_are_told_apart(n):
    words = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]
    text = " ".join([words[0], "x", words[1], words[0], words[1]])
    table = pieces.Table(lambda ws: [[len(w), *w] for w in ws])
    data = np.frombuffer(text.encode(), np.uint8)
    for _ in range(2):
        ids, ends, _ = table.runs(data, *pieces.tight(data, np.array([0, len(data)])))
        got = [bytes(x[1:].astype(np.uint8)).decode() for x in np.split(ids, ends[:-1])]
        assert got == text.split()
    for path, tool, ids in ((public_tokenizers.path("byte_bpe_50k.json"), bpe.Codec, lambda x: x), (public_tokenizers.path("word_bpe_49k.json"), packing.Words, lambda x: x[0])):
        want = Tokenizer.from_file(path)
        want.no_truncation(), want.no_padding()
        texts = [words[0], words[1], text]
        got = [ids(x).tolist() for _, part in tool(path).encode(pa.array(texts)) for x in part]
        assert got == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("run", ["0", "a", "A", "-", "/", "9"])
@pytest.mark.parametrize("n", [19, 20, 21, 24, 40, 100])
def test_runs_of_one_character(run, n):
    allow = secret_scan.allow_list()
    for text in (f"id {run * n}ab end", f"{run * n}Version1a", f"{run * n}a1b2", f"key_{run * n}9Z"):
        for kind, a, b in secret_scan.spans(text, allow):
            assert kind != "entropy" and 0 <= a < b <= len(text)
    assert secret_scan.hot_windows(run * n, 0.1) == []


@pytest.mark.parametrize("text", ["a" + "=-" * 5000 + "12345x", "=" * 10_000 + "a12345", "a1" + "-b2" * 5000 + "/12345678901x", "1=" * 10_000 + "x", "a-" * 10_000 + "1" * 9])
def test_separators_take_one_pass(text):
    start = time.perf_counter()
    secret_scan.spans(text, secret_scan.allow_list())
    assert time.perf_counter() - start < 1
