"""Large products, whose rows are finished where they are summed."""

import pytest

from sparkmat.matrix import SparseMatrix
from sparkmat.operators import incremental, maintained, multiply, rows
from sparkmat.plans import mcl as plans
from sparkmat.shared import stored, write_bucketed, write_table

from tests.test_matrix import dense_product, some


@pytest.fixture(params=[(10**6, 2**25), (7, 40)])  # blocks at once, or a few entries at a time
def large(monkeypatch, request):
    """Every product counts as one of large operands, and indices of more than three entries as long."""
    monkeypatch.setattr(rows, "LARGE_NNZ", 0)
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(multiply, "SENT_NNZ", 0)
    monkeypatch.setattr(multiply, "PACKED", 10)
    monkeypatch.setattr(rows, "BLOCK_WORK", 500)
    monkeypatch.setattr(multiply, "AT_ONCE", request.param[0])
    monkeypatch.setattr(rows, "HELD_NNZ", request.param[1])


@pytest.mark.parametrize("strategy", ["auto", "hier", "heavy"])
def test_large_operands(spark, large, strategy):
    a, b = some(spark, 161, 40, 30, 300), some(spark, 162, 30, 50, 400)
    assert multiply.spgemm(a, b, strategy).entries() == dense_product(a, b)


def test_transposes_are_stored_once(spark, large, monkeypatch):
    made = []
    monkeypatch.setattr(rows, "stored", lambda df, name: made.append(name) or stored(df, name))
    monkeypatch.setattr(rows, "write_bucketed", lambda df, name, *how: made.append(name) or write_bucketed(df, name, *how))
    a = some(spark, 163, 30, 20, 200)
    assert multiply.spgemm(a, a.T).entries() == dense_product(a, a.T)
    assert made == ["operand", "by_index"]


def test_digests_of_rows(spark, large):
    a = some(spark, 164, 30, 30, 250)
    expected = {}
    for (i, j), v in dense_product(a, a).items():
        n, s, sj = expected.get(i, (0, 0.0, 0.0))
        expected[i] = n + 1, s + v, sj + v * (j + 1)
    assert {r.i: (r.n, r.s, r.sj) for r in rows.product_digests(a, a).collect()} == expected


def test_clustering_of_large_matrices_writes_no_product(spark, monkeypatch):
    a = some(spark, 165, 25, 25, 200)
    expected, sizes = plans.mcl(a, 2, 0.05)
    expected = expected.entries()
    made = []
    monkeypatch.setattr(rows, "LARGE_NNZ", 0)
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(plans, "write_table", lambda df, name: made.append(name) or write_table(df, name))
    out, found = plans.mcl(a, 2, 0.05)
    assert out.entries() == pytest.approx(expected) and found == sizes
    assert made == ["mcl", "mcl"]


def test_large_maintained_products_write_deltas_alone(spark, monkeypatch):
    """A delta reaches all blocks and repeats entries of its operand; one of more entries than C is summed into it."""
    monkeypatch.setattr(rows, "LARGE_NNZ", 0)
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(maintained.LoggedProduct, "BLOCK_WORK", 300)
    a, b = some(spark, 166, 40, 30, 300), some(spark, 167, 30, 20, 200)
    product = maintained.maintained(a, b)
    da, db = some(spark, 168, 40, 30, 20), some(spark, 169, 30, 20, 4)
    whole, a, b = product.nnz(), SparseMatrix.from_entries(spark, [(*k, v) for k, v in (a + da).entries().items()], 40, 30), b + db
    expected = dense_product(a, b)
    assert product.update(da, db) < whole == product.sizes[0]
    assert product.nnz() == len(expected) and product.nnz_a() == a.nnz() and len(product.parts) == 2
    assert product.c.entries() == expected
    da = some(spark, 171, 40, 30, 300)
    product.update(da)  # more entries than C has: summed into it
    assert len(product.parts) == 1 and product.c.entries() == dense_product(a + da, b)
    product.close()


def test_large_batches_are_counted_from_dealt_tables(spark, monkeypatch):
    a = some(spark, 172, 20, 20, 80)
    keys = ("nnz_a_global", "nnz_b_global", "nnz_c_global", "csum_a_global", "csum_b_global")
    expected = [[r[k] for k in keys] for r in incremental.run_batches(a, a, 3, 5)]
    monkeypatch.setattr(rows, "LARGE_NNZ", 0)
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(incremental, "apply_update", lambda *_: pytest.fail("operands are not written again"))
    assert [[r[k] for k in keys] for r in incremental.run_batches(a, a, 3, 5)] == expected
