import os
import re

import numpy as np
import pandas as pd
import pytest

from scholia.llm import pii, pii_table
from scholia.llm.pii_table import labelled_rows


@pytest.fixture(scope="module")
def field():
    return pii.trained()


def test_held_out_accuracy(field):
    rows = labelled_rows(400, seed=12345)
    hit = missed = extra = 0
    for (_, gold), found in zip(rows, pii.spans(field, [t for t, _ in rows])):
        g, f = set(gold), set(found)
        hit, missed, extra = hit + len(g & f), missed + len(g - f), extra + len(f - g)
    assert hit / (hit + missed) > 0.9 and hit / (hit + extra) > 0.9


def test_traps_stay(field):
    for t in ["We sample 1000-0000-5000 items in three rounds.", "as in Vesprey et al. (2087)", "The Vesprey kernel is a standard tool here.", "Contact [EMAIL] was already masked."]:
        assert pii.spans(field, [t]) == [[]]


def test_masking_keeps_the_rest(field):
    text = "As Mirela Tandova told me, write to m.tandova@uni-x.example or call +44 7700 900123 \r\n today."
    found = pii.spans(field, [text])[0]
    done = pii.masked(text, found)
    assert "[EMAIL]" in done and "[PHONE]" in done and done.endswith(" \r\n today.") and "@" not in done
    assert pii.masked(None, []) is None and pii.masked("plain", []) == "plain"


def test_pruned_decoding_is_exact(field):
    texts = [t for t, _ in labelled_rows(120, seed=5)]
    tokens, _, _, counts = pii.lex(texts)
    scores = field.emissions(field.rows(tokens), counts)
    got, at = field.decode(scores, counts), 0
    moves = field.moves + pii._allowed()
    for n in counts:
        if n:
            best, back = scores[at] + field.first + pii._allowed()[0], []
            for t in range(1, n):
                step = best[:, None] + moves
                back.append(step.argmax(0))
                best = step.max(0) + scores[at + t]
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert np.array_equal(got[at : at + n], path[::-1])
        at += n


def test_operator(spark, field):
    rows = [("a", "Please contact Ondrik Valmoor at o.valmoor@x.example for the raw logs.", "x"), ("a", "Please contact Ondrik Valmoor at o.valmoor@x.example for the raw logs.", "y"), ("b", None, "x"), ("c", "", "x")]
    df = spark.createDataFrame(rows, "review_id string, text string, kind string")
    got = pii.personal_spans(df, "review_id", "text", "reviews", field).collect()
    assert sorted((r.record_id, r.kind) for r in got) == [("a", "email"), ("a", "name")]
    assert pii.personal_spans(df.limit(0), "review_id", "text", "reviews", field).count() == 0
    assert df.select(pii.redacted(df, "text", field).alias("t")).where("t IS NULL").count() == 1
    long = "All is well. " * 30_000
    assert pii.spans(field, [long]) == [[]]


def _marked(line):
    """A line of the held-out file as its text and spans; [N:...] marks a name, E, P, I, A the other kinds."""
    text, spans, kinds = "", [], {"N": "name", "E": "email", "P": "phone", "I": "id", "A": "address"}
    at = 0
    for m in re.finditer(r"\[([NEPIA]):((?:[^\[\]]|\[[a-z]+\])+)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), kinds[m[1]]))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def test_held_out_sentences_of_other_form(field):
    """Sentences written by hand, none made by the generator and none from the tables."""
    with open(os.path.join(os.path.dirname(__file__), "pii_heldout.txt"), encoding="utf-8") as f:
        rows = [_marked(x.replace("\\n", "\n")) for x in f.read().splitlines()]
    hit = missed = extra = 0
    for (_, gold), found in zip(rows, pii.spans(field, [t for t, _ in rows])):
        g, f = set(gold), set(found)
        hit, missed, extra = hit + len(g & f), missed + len(g - f), extra + len(f - g)
    # Measured when written: 0.70 found, 0.93 of what is found right; what is missed are names, most of them.
    assert hit / (hit + missed) > 0.65 and hit / (hit + extra) > 0.85


def test_no_context_stands_in_the_tables(sf):
    """No fixed piece of 18 characters of the labelled table occurs in the test tables."""
    pieces = {x for t in (*pii_table.WITH, *pii_table.WITHOUT) for x in re.split(r"\{\w\}", t) if len(x) >= 18}
    parts = {"reviews": "text", "excerpts": "text", "documents": "text", "assemble_live_smoke3": "plan_text"}
    texts = "\n".join(t for name, c in parts.items() for t in pd.read_parquet(f"{os.path.dirname(sf)}/sf0.01/{name}.parquet", columns=[c])[c].dropna().unique())
    assert pieces and not [x for x in pieces if x in texts]
