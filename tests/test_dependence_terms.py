"""Statistics of random tables with the same margins, from what each cell adds."""

import numpy as np
import pytest

from tallygrid.operators import inference


def test_terms_add_up_to_the_statistics():
    rng = np.random.default_rng(0)
    for table in ([[3, 1], [2, 5]], [[0, 4, 1], [7, 0, 2], [0, 0, 3]], [[5]], [[1, 2, 3]], [[900, 20], [40, 3000]], [[0, 0], [2, 3]]):
        table = np.array(table)
        tables = np.concatenate((table[None], inference.margin_tables(table.sum(1), table.sum(0), 60, rng)))
        bits, apart = inference.dependence(tables)
        assert bits == pytest.approx(inference.information(tables), abs=1e-14)
        assert apart == pytest.approx(inference.independence_distance(tables), abs=1e-14)
    assert inference.dependence(tables[:0]).shape == (2, 0)


def test_logarithms_follow_a_cells_values(monkeypatch):
    """So many random tables take as many logarithms as their cells have values, not one for each cell of each table."""
    sizes, terms = [], inference.dependence_terms
    monkeypatch.setattr(inference, "dependence_terms", lambda n, *margins: sizes.append(len(n)) or terms(n, *margins))
    table = np.array([[6, 2, 4], [1, 7, 3]])
    null = inference.null_values(table, inference.dependence, 5000, np.random.default_rng(2))
    assert null.shape == (2, 5000) and sum(sizes) == 2 * (8 + 10 + 8)


def test_tables_come_in_the_same_stream():
    rows, columns = np.array([12, 11, 4]), np.array([7, 9, 11])
    rng, other = (np.random.default_rng(5) for _ in range(2))
    got = inference.margin_tables(rows, columns, 40, rng)
    left, out = np.tile(columns, (40, 1)), np.zeros((40, 3, 3), int)
    for i in range(2):
        need = np.full(40, rows[i])
        for j in range(2):
            out[:, i, j] = other.hypergeometric(left[:, j], left[:, j + 1 :].sum(1), need)
            need = need - out[:, i, j]
        out[:, i, 2] = need
        left -= out[:, i]
    out[:, 2] = left
    assert (got == out).all()
