"""Draws of people whose blocks are added up before they are sent."""

import numpy as np
import pytest

from tallygrid.operators import inference


def test_blocks_are_added_up_before_they_are_sent(spark):
    n, reps = 300, list(range(5, 605))
    rows = [(f"p{k}" if k else None, k % 2, "a" if k % 3 else None, 1 + k % 2) for k in range(n)]
    df = spark.createDataFrame(rows, "person string, item int, klass string, n long")
    assert inference.shelf_depth(9, 4) == 3
    drawn = inference.drawn_people(df, reps, 5, 0, 1).toPandas()
    assert not drawn.duplicated(["rep", "item", "klass"]).any()
    assert set(drawn["rep"]) == set(reps) and (drawn["w"] > 0).all()
    # Each person has one item, and answers once or twice: people drawn are as many as there are.
    assert set((drawn["w"] / (1 + drawn["item"])).groupby(drawn["rep"]).sum()) == {n}
    means = drawn.groupby(["item", "klass"], dropna=False)["w"].sum() / len(reps)
    assert means.sort_values().tolist() == pytest.approx([50, 100, 100, 200], rel=0.05)


def test_cells_alone_are_not_shared():
    assert inference.shelf_depth(13, inference.SHARED_CELLS + 1) == 0
    assert [inference.shelf_depth(d, 100) for d in (0, 6, 8, 13, 20)] == [0, 0, 2, 5, 5]


def test_draws_are_one_stream():
    counts = np.array([3, 0, 7, 120, 5, 1])
    one = lambda: np.random.Generator(np.random.PCG64(8))
    rng = one()
    alone = [np.bincount(rng.integers(0, 9, c), minlength=9).tolist() for c in counts]
    for step in (1, 2, 64):
        assert inference.drawn_times(counts, 9, one(), step).tolist() == alone
    assert inference.dealt(counts, 9, one()).tolist() == [[1] * 9, *alone]


def test_splits_made_before_are_the_same():
    way = [{"level": 0, "node": 0, "right": True, "left": 3, "size": 10}, {"level": 1, "node": 1, "right": False, "left": 4, "size": 7}, {"level": 2, "node": 2, "right": False, "left": 0, "size": 4}]
    known = {}
    first = inference.block_counts(way, 50, 1, 0, known)
    assert set(known) == {(0, 0), (1, 1)}
    assert (inference.block_counts(way, 50, 1, 0, known) == first).all() and (inference.block_counts(way, 50, 1, 0) == first).all()


def test_answers_are_read_twice(spark):
    """Once for all cells and once for the people drawn, whatever is made of them."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [("h", f"p{k}", f"i{k % 2}", "a" if k % 3 else "b", 1) for k in range(60)] + [("m", None, f"i{j}", k, 9) for j in range(2) for k in "ab"]
    df = spark.createDataFrame(rows, "source string, person string, item string, klass string, n int")
    got = inference.response_bootstrap(df.mapInPandas(counted, df.schema), 6, 0, crossed="h").collect()
    assert read.value <= 2 * len(rows)
    assert got == inference.response_bootstrap(df, 6, 0, crossed="h").collect()
