"""How far lists are read, and whole numbers beyond doubles."""

import numpy as np
import pytest

from wordmill.llm import topk


def product(q_ids, q, ids, x, k):
    out = []
    for qid, own in zip(q_ids.tolist(), q.tolist()):
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in zip(ids.tolist(), x.tolist()) if i != qid)[:k]
        out += [(qid, i, -s) for s, i in scores]
    return sorted(out)


def test_skewed_lists_are_left_unread():
    r = np.random.default_rng(1)
    x = np.floor(1000 * r.random((3000, 4)) ** 30).astype(np.int64)  # few large entries in each list
    ids = np.arange(3000)
    q = r.integers(1, 9, (20, 4))
    lists = topk.Lists(ids, x.astype(np.float64))
    found, stopped = topk.aggregate(lists, np.arange(20), q.astype(np.float64), 5)
    assert stopped.max() <= 3000 // 4 and sorted(found) == product(np.arange(20), q, ids, x, 5)


def test_bounds_that_never_close_read_everything():
    x = np.ones((100, 3), np.int64)
    ids = np.arange(100)
    found, stopped = topk.aggregate(topk.Lists(ids, x.astype(np.float64)), ids[:30], x[:30].astype(np.float64), 5)
    assert (stopped == 100).all() and sorted(found) == product(ids[:30], x[:30], ids, x, 5)


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 29])
def test_signs_and_sizes(size):
    r = np.random.default_rng(size)
    x = r.integers(-size, size + 1, (400, 5))
    x[::7] = x[0]
    ids = r.permutation(400)
    got = topk.search(ids[:50], x[:50], ids, x, 7)
    assert sorted(got) == product(ids[:50], x[:50], ids, x, 7)


def test_a_score_beyond_64_bits():
    x = np.full((3, 2), 1 << 40)
    with pytest.raises(OverflowError, match="64 bits"):
        topk.search(np.array([1]), x[:1], np.array([1, 2, 3]), x, 2)
