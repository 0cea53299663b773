"""Learning from equal sentences once, with their number, against learning from each."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mosaique.llm import toxicity


def table(bags: list[tuple[int, int, list[tuple[tuple[int, ...], int]]]]) -> pa.Table:
    """Of (label, sentences without features, [(features, times)])."""
    ints = pa.list_(pa.int32())
    return pa.table({
        "label": pa.array([b[0] for b in bags], pa.int32()),
        "n_plain": pa.array([b[1] for b in bags], pa.int32()),
        "times": pa.array([[n for _, n in b[2]] for b in bags], ints),
        "n_words": pa.array([[len(x) for x, _ in b[2]] for b in bags], ints),
        "word": pa.array([[w for x, _ in b[2] for w in x] for b in bags], ints),
    })


def test_equal_sentences_count_as_often_as_they_occur():
    rnd = random.Random(5)
    merged = [(k % 2, rnd.randrange(4), [((0, 2) if k % 2 else (1,), rnd.randrange(1, 9)), ((2,), rnd.randrange(1, 5))]) for k in range(40)]
    merged += [(0, 1, []), (1, 0, [])]
    each = [(label, plain, [(x, 1) for x, n in found for _ in range(n)]) for label, plain, found in merged]
    (bias, weights), (bias_each, weights_each) = (toxicity._maximise(table(b), 3) for b in (merged, each))
    assert bias == pytest.approx(bias_each, abs=1e-6) and np.allclose(weights, weights_each, atol=1e-6)
    assert weights[0] > 1 > weights[1]


def test_a_fit_has_no_bounds_but_on_documents():
    bounds = toxicity.fit.__defaults__
    assert bounds[-3:] == (None, 1, None)
