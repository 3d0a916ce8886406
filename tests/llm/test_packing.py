import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_fill_never_exceeds(sizes):
    s = np.array(sorted(sizes, reverse=True), np.int64)
    w = packing.fill(s, 100)
    assert len(w) == len(s)
    assert not len(s) or np.bincount(w, s).max() <= 100


def test_differencing_classic_and_even():
    w, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16] and sorted(np.bincount(w, [8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(0)
    s = np.sort(rng.integers(1, 300, 2000))[::-1]
    _, sums = packing.differencing(s, 40)
    assert sums.max() - sums.min() <= 5


def test_whole_and_cut_documents(spark):
    rows = [(1, 5), (2, 10), (3, 25), (4, 0), (5, None), (6, 5), (None, 3)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.packed(sizes, [("p", 10)]).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 10
    three = got[got.doc_id == 3].sort_values("piece")
    assert three.n_tokens.tolist() == [10, 10, 5] and three.token_start.tolist() == [0, 10, 20]
    assert got[got.doc_id != 3].groupby("doc_id").size().max() == 1
    assert set(got.doc_id.dropna()) == {1, 2, 3, 4, 5, 6} and got.n_tokens.sum() == 48
    assert packing.packed(sizes.limit(0), [("p", 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.packed(sizes, [("p", 0)])


def test_null_and_repeated_ids_beyond_the_capacity(spark):
    sizes = spark.createDataFrame([(None, 25), (None, 25), (1, 25), (1, 25), (None, None)], "doc_id bigint, n_tokens bigint")
    got = packing.packed(sizes, [("p", 10)])
    assert got.groupBy("container_id").sum("n_tokens").toPandas()["sum(n_tokens)"].max() <= 10
    assert got.toPandas().n_tokens.sum() == 100
