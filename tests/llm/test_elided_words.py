"""Scoring reads the words that training learns from."""

from tidemark.llm import toxicity

G = toxicity.Grammar(toxicity.Lexicon({"idiot": 2.0, "imbécile": 3.0}, {"vequ": 3.0}))


def roles(text):
    return [r for a, b in G.clauses(text) for r, _ in G.clause(text[a:b])]


def test_parts_of_elided_words():
    assert roles("l'idiot parle") == ["plain"] and roles("un tas d’imbécile") == ["plain"]
    assert roles("the idiot's hat") == ["plain"] and roles("d'vequté") == ["plain"]
    assert roles("you're an idiot") == ["aimed"]
    assert roles("he isn't an idiot") == ["negated"] and roles("he isn’t an idiot") == ["negated"]
    assert roles("ce n'est pas un vrai d'imbécile") == ["negated"]


def test_forced_cut_keeps_words_whole():
    for n in range(1_960, 2_010):
        text = "idiot " + "a" * (n - 7) + " imbécile " + "b" * 30
        assert len(roles(text)) == 2, n
        text = "idiot " + "a " * 1000 + "a" * (n - 1_960) + " l'imbécile"
        assert len(roles(text)) == 2, n
    for n in range(1_990, 2_010):  # the part of a word after a cut is no word
        assert roles("xidiot" + " " * n + "idiot") == ["plain"], n
