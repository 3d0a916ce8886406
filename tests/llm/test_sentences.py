import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import sentences as S


def split(text):
    _, s, e = S.units([text])
    return [text[a:b] for a, b in zip(s, e)]


CASES = [
    ["All annotators live in the U.S.", "The gap vs. XNet is 0.14 points, cf. Sec. 3."],
    ['The rebuttal says "Why not? It is cheap." but gives no evidence.', "k-means would be a simple check."],
    ["Is it true, as Foo et al. (2099) claim?", "Really?!", "(The same holds for X.)", "Yes."],
    ["The server goes down at 5 p.m.", "It is slow."],
    ["Die Werte, z. B. 0.26 auf X, sind nicht belegt.", "Warum wurde das am 12. Mai geändert?"],
    ["Результаты составляют 31, т. е. прирост мал.", "На рис. 4 нет оценки."],
    ["审稿人指出“数据有问题。结果不可信。”，作者没有回应。", "图3很好。"],
    ["著者は「問題ない。再現できる。」と述べている。", "なぜですか？"],
    ['심사평에서 "근거가 없다. 다시 하라."라고 지적했다.', "왜 그렇습니까?"],
    ["재현 절차가 빠져 있다.", "speech separation 과제를 논의해 주십시오."],
    ["यह लेख विधि प्रस्तुत करता है।", "डॉ. शर्मा सहमत हैं।"],
    ["The authors claim robustness, i.e. that F1 stays above 0.110 ± 0.03, but Eq. (3) disagrees.", "St. dev. is missing."],
]


@pytest.mark.parametrize("parts", CASES)
def test_sentences_in_a_row(parts):
    wide = "一" <= parts[0][0] <= "鿿"
    assert split(("" if wide else " ").join(parts)) == parts


def test_layouts():
    assert split("## Strengths\nGood paper. Clear.\n\n1) First. Second.\n2) Third.") == ["## Strengths", "Good paper.", "Clear.", "1) First.", "Second.", "2) Third."]
    assert split("Fine.\n\nKind regards\nJo Doe\nTel: 555-0100") == ["Fine.", "Kind regards", "Jo Doe", "Tel: 555-0100"]
    wrapped = "The description of the evaluation protocol is limited in scope\nand should be rewritten. It is unclear whether the release\nplan uses the same seeds."
    assert split(wrapped) == ["The description of the evaluation protocol is limited in scope\nand should be rewritten.", "It is unclear whether the release\nplan uses the same seeds."]
    assert split("not.At the same time, no.") == ["not.", "At the same time, no."]
    assert split("Dear authors,\nThe paper is fine.") == ["Dear authors,", "The paper is fine."]
    assert split("ผลดี งานเขียนอ่านง่าย") == ["ผลดี", "งานเขียนอ่านง่าย"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n?!\"“”()。「」A1-*:\r", max_size=60), max_size=6))
def test_units_cover_all_but_white_space(texts):
    row, s, e = S.units(texts)
    for i, t in enumerate(texts):
        spans = [(a, b) for r, a, b in zip(row, s, e) if r == i]
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)
        covered = {k for a, b in spans for k in range(a, b)}
        assert all(k in covered or t[k].isspace() for k in range(len(t)))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, len(S.CLASSES) - 1), max_size=400), st.integers(1, 50))
def test_scan_equals_a_plain_run(events, chunk):
    depth, signed, want = 0, False, []
    for c in events:
        want.append(c in (S.DOCUMENT, S.HARD, S.CLOSING) or c == S.END and depth == 0 or c == S.LINE and (signed or depth == 0) or c == S.WRAP and signed)
        depth = 0 if c in (S.DOCUMENT, S.HARD, S.CLOSING) else depth + 1 if c == S.OPEN else max(0, depth - 1) if c == S.CLOSE else depth
        signed = False if c in (S.DOCUMENT, S.HARD) else c == S.CLOSING or signed
    assert S.transduce(np.array(events, np.int8), chunk).tolist() == want


def test_any_depth_length_and_width():
    nested = "A (b [c “d «e f» g” h] i. J k l) done."
    assert split(nested + " So it is.") == [nested, "So it is."]
    for n in (5, 60, 3000):
        assert len(split("Write to " + "a" * n + "@mail.example.The rest.")) == 1
    wrapped = "The authors compare all of their own results with the\nBERT model on two tasks."
    assert split(wrapped)[0] == wrapped and split(wrapped + "\n\n" + "It goes on and on, " * 40 + "and ends.")[0] == wrapped
    assert split("We use the U.S. Navy data. All live in the U.S. The rest do not.") == ["We use the U.S. Navy data.", "All live in the U.S.", "The rest do not."]
    assert len(split("a." * 200_000)) >= 1


def test_batches_do_not_matter():
    texts = [" ".join(p) for p in CASES] * 3 + ["", None, "   "]
    together = S.units(texts)
    alone = [(i, a, b) for i, t in enumerate(texts) for _, a, b in zip(*S.units([t]))]
    assert list(zip(*map(list, together))) == alone


def test_operator(spark):
    rows = [("r1", "One. Two.", 1), ("r1", "One. Two.", 2), ("r2", None, 1), ("r3", "", 1), (None, "Three.", 1), ("long", "It is so. " * 20_000, 1)]
    df = spark.createDataFrame(rows, "review_id string, text string, unit_start int")
    got = S.sentence_units(df, "review_id", "text", "reviews")
    assert got.where("record_id = 'r1'").count() == 2
    assert got.where("record_id = 'long'").count() == 20_000
    assert got.where("record_id IS NULL").count() == 1
    assert S.sentence_units(df.limit(0), "review_id", "text", "reviews").count() == 0
