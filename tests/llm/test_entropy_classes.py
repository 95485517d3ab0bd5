"""Entropy by the runs of a candidate, and secrets in URLs."""

import random

import pytest

from tidemark.llm import secret_scan

KEY = "Zk3Qx9LmT7vRb2YwN8sHc4PdF6gJ1aUe"


def entropy(text):
    return [text[a:b] for k, a, b in secret_scan.spans(text, secret_scan.allow_list()) if k == "entropy"]


def covered(text):
    return {i for _, a, b in secret_scan.spans(text, secret_scan.allow_list()) for i in range(a, b)}


@pytest.mark.parametrize("n", [20, 24, 32])
def test_hex_run_keeps_its_limit_beside_other_characters(n):
    r = random.Random(n)
    found = 0
    for _ in range(200):
        key = "".join(r.choice("0123456789ABCDEF") for _ in range(n))
        hot = covered(key)
        found += bool(hot)
        for before, after in (("key_", ""), ("", "="), ("x-", "/y")):
            assert {i + len(before) for i in hot} <= covered(before + key + after), key
        assert not hot or covered(key[:n // 2] + key[n // 2:].lower()), key
    assert found > 180


def test_secrets_in_urls():
    for text in (f"https://user:{KEY}@host.example/x", f"https://host.example/a/b?sig={KEY}&x=1", f"www.host.example/?t={KEY}", f"https://hooks.host.example/services/T000/{KEY}", f"git clone https://{KEY}@host.example"):
        assert any(KEY in g for g in entropy(text)), text
    for clean in (f"https://host.example/{KEY}", f"https://host.example/a/b/{KEY}/c", "https://host.example/?next=internationalization/of/documents-2024", f"https://host.example/{KEY} mail me@host.example"):
        assert entropy(clean) == [], clean
