"""Memory of the neighbour search: a block is measured in small matrices."""

import tracemalloc

import numpy as np
import pandas as pd

from flowsieve.operators.balance import BLOCK_ROWS, _nearest_block


def test_a_block_is_searched_in_small_matrices():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(BLOCK_ROWS, 8))
    points = pd.DataFrame({"id": np.arange(BLOCK_ROWS), "v": list(x), "copies": 1})
    tracemalloc.start()
    near = _nearest_block(points.iloc[:512], points, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    for i in (0, 255, 511):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert near[near["id"] == i]["neighbour"].tolist() == np.argsort(d)[:5].tolist()


def test_a_chunk_of_a_block_is_one_product_and_few_pairs(monkeypatch):
    """The k nearest are picked from group minima: no wide row is partitioned whole."""
    widths, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kw: widths.append(a.size) or partition(a, *args, **kw))
    x = np.random.default_rng(6).normal(size=(BLOCK_ROWS, 8))
    points = pd.DataFrame({"id": np.arange(BLOCK_ROWS), "v": list(x), "copies": 1})
    near = _nearest_block(points.iloc[:64], points, 5)
    assert len(near) == 5 * 64 and max(widths) <= 64 * 32 * 5


def test_rows_without_numbers_and_repeated_ids_are_no_neighbours():
    x = np.random.default_rng(7).normal(size=(1500, 3))
    x[::100], x[7::100] = np.nan, np.inf
    ids = np.arange(1500) // 2
    near = _nearest_block(*[pd.DataFrame({"id": ids, "v": list(x), "copies": 1})] * 2, 5)
    good = np.flatnonzero(np.isfinite(x).all(axis=1))
    for i in good[:40]:
        d = np.sqrt(((x[good] - x[i]) ** 2).sum(axis=1))
        d[ids[good] == ids[i]] = np.inf
        want = ids[good][np.lexsort((good, d))[:5]]
        assert set(want.tolist()) <= set(near[near["id"] == ids[i]]["neighbour"].tolist())
    assert not near["neighbour"].isin(set(ids[~np.isfinite(x).all(axis=1)]) - set(ids[good])).any()
