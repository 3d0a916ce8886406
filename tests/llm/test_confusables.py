import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import confusables as C

SAME = [("paper", "рареr"), ("final", "ﬁnal"), ("café", "café"), ("a b", "a b"), ("non-breaking", "non‑breaking"), ("ＡＢＣ１", "ABC1"), ("Å", "Å"), ("3 µm", "3 μm"), ("pa​per", "paper"), ("статья", "cтaтья"), ("한글", unicodedata.normalize("NFD", "한글")), ("ベース", "ﾍﾞｰｽ")]
APART = [("10²", "102"), ("①", "1"), ("½", "1/2"), ("naïve", "naive"), ("Mix", "mix"), ("a, b", "a b"), ("data set", "dataset"), ("l", "I"), ("“a”", '"a"')]


def form(t):
    return C.Speller(C.default_vocabulary()).text(t)


def test_same_and_apart():
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in APART:
        assert form(a) != form(b), (a, b)


def test_words_keep_their_script():
    assert form("cтaтья") == "статья"
    assert form("рареr") == "paper"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeopcxyAEстатьяй еοό​ﬁ-‐ 1²дvν", max_size=20), st.text(alphabet="aeopcxyAEстатьяй еοό​ﬁ-‐ 1²дvν", max_size=20))
def test_form_is_equal_exactly_where_the_skeleton_is(a, b):
    s = C.Speller(C.default_vocabulary())
    assert C.skeleton(s.text(a)) == C.skeleton(a)
    assert s.text(s.text(a)) == s.text(a)
    assert (s.text(a) == s.text(b)) == (C.skeleton(a) == C.skeleton(b))


def test_automaton_costs():
    trie = C.Trie(["paper", "pepper"])
    assert trie.match("рареr") == (0, "paper")
    assert trie.match("papr") is None and trie.match("papr", C.EDIT) == (C.EDIT, "paper")
    assert trie.match("pαper") is None and trie.match("pαper", 1) == (1, "paper")
    assert C.Trie(["paper", "pапер"]).match("рaper") == (0, "paper")
    assert trie.match("") is None


def test_twins(spark):
    rows = [(1, "a paper"), (2, "a рареr"), (3, "a paper"), (4, "a Paper"), (5, None), (6, None), (7, ""), (8, "​"), (9, "ﬁt"), (10, "fit " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS form_id", "2 AS salt")
    got = {tuple(r) for r in C.twins(df).collect()}
    assert got == {(1, 2), (2, 3), (7, 8)}
    assert C.twins(df.limit(0)).count() == 0


# Words with a letter that stands for another in this word only, and the word; letters that keep their own meaning.
DOUBTED = [("pαper", "paper"), ("netωork", "network"), ("modeɡ", "modeɡ"), ("learnınɡ", "learning"), ("ехаmple", "example"), ("tᴏken", "token"), ("evaluaтion", "evaluation"), ("sαmρle", "sample")]
KEPT = ["α", "σ-algebra", "βVAE", "την ημέρα", "тест кот", "Fα", "ɑɡı", "наш метод"]


def test_the_words_decide_what_doubtful_letters_stand_for():
    with_words, without = C.Speller(C.default_vocabulary()), C.Speller(())
    assert sum(with_words.text(a) == b for a, b in DOUBTED) == len(DOUBTED)
    # Without the trie most of them stay apart from the word they read as.
    assert sum(without.text(a) == without.text(b) for a, b in DOUBTED) < len(DOUBTED) / 2
    for t in KEPT:
        assert with_words.text(t) == without.text(t)


def test_hot_copies_on_both_sides(spark):
    df = spark.createDataFrame([(i, "paper" if i % 3 else "рaper") for i in range(90)], "doc_id bigint, text string")
    assert C.twins(df).count() == 30 * 60


def test_missing_vocabularies_are_an_error_unless_none_are_asked_for(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a paper"), (2, "a рареr")], "doc_id bigint, text string")
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    for run in (C.default_vocabulary, lambda: C.forms(df), lambda: C.twins(df)):
        with pytest.raises(RuntimeError, match="public_tokenizers"):
            run()
    assert [tuple(r) for r in C.twins(df, vocabulary_paths=()).collect()] == [(1, 2)]
