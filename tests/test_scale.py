"""What products shuffle and hold as their operands grow."""

import pyarrow as pa
import pytest

from sparkmat.matrix import SparseMatrix
from sparkmat.operators import algebra, incremental, multiply, structure
from sparkmat.shared import write_table
from sparkmat.sources import generators
from sparkmat.streaming.updates import current, summed_stream, updates_stream

from tests.test_matrix import dense_product, some


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(monkeypatch):
    """Every product counts as a large one."""
    monkeypatch.setattr(multiply, "PLAIN_WORK", 0)
    monkeypatch.setattr(multiply, "BLOCK_WORK", 100)
    monkeypatch.setattr(multiply, "PACKED", 3)


@pytest.mark.parametrize("strategy", multiply.STRATEGIES)
def test_large_products_in_blocks(spark, large, strategy):
    a, b = some(spark, 61, 40, 30, 300), some(spark, 62, 30, 50, 400)
    assert multiply.spgemm(a, b, strategy).entries() == dense_product(a, b)
    if strategy != "broadcast":  # packed rows are dealt to blocks of C, above which nothing is shuffled
        above, _ = plan(multiply.spgemm(a, b, strategy).df).split("direct_shuffle_partition_id", 1)
        assert above.count("Exchange") == 1 and above.count("Generate") == 2


def test_large_products_of_nothing(spark, large):
    none = SparseMatrix.from_entries(spark, [], 5, 5)
    assert multiply.spgemm(none, none).entries() == {}


def test_generated_operands_are_not_sent_to_all(spark, monkeypatch):
    """Exploded rows are not taken for few by the planner's guess."""
    monkeypatch.setattr(multiply, "SMALL_SIDE", 100)
    x = SparseMatrix(spark.range(1000).selectExpr("id AS i", "0L AS j", "1.0D AS v"), 1000, 1)
    assert "BroadcastExchange" not in plan(multiply.spgemm(generators.stencil(spark, "27pt", 10, 10, 10), x).df)
    assert "BuildRight" in plan(multiply.spgemm(generators.banded(spark, 1000, 3, 2, "j"), x, "broadcast").df)  # the vector


def test_sums_of_products(spark):
    a, b, c = some(spark, 63, 20, 15, 90), some(spark, 64, 15, 20, 90), some(spark, 65, 20, 20, 100)
    assert multiply.fused_multiply_add(c, a, b).entries() == (c + a @ b).entries()
    p = algebra.random_permutation(20, 3, spark)
    assert multiply.permuted_product(a, b, p, p).entries() == algebra.permute(a @ b, p, p).entries()
    with pytest.raises(ValueError):
        multiply.sum_of_products([(a, b), (a, c)])


def test_all_heavy_indices(spark):
    """One index of more products than all others may have together leaves the bound of heavy ones as it is."""
    left = spark.range(2000).selectExpr("id AS i", "0L AS k", "1.0D AS a")
    right = spark.range(2000).selectExpr("0L AS k", "id AS j", "1.0D AS b")
    (one,) = multiply.heavy_indices(left, right, 50).collect()
    assert (one["pa"], one["pb"]) == (283, 283)


def test_entries_that_share_no_block_travel_unpacked(spark, large, monkeypatch):
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(multiply, "BLOCK_WORK", 300)  # no index makes more products
    a, b = some(spark, 71, 40, 30, 300), some(spark, 72, 30, 50, 400)
    expected = dense_product(a, b)
    for strategy in ("auto", "summa", "salted"):
        c = multiply.spgemm(a, b, strategy)
        assert c.entries() == expected
        above, _ = plan(c.df).split("direct_shuffle_partition_id", 1)
        assert above.count("Exchange") == 1 and above.count("Generate") == 1


def test_entries_of_a_product_are_counted_without_values(spark, monkeypatch):
    a, b = some(spark, 73, 20, 15, 80), some(spark, 74, 15, 20, 70)
    nnz = len(dense_product(a, b))
    for row_work in (10**6, 20, 0):  # no row, some rows and all rows are heavy
        monkeypatch.setattr(multiply, "ROW_WORK", row_work)
        assert multiply.product_nnz(a, b) == nnz
    assert multiply.product_nnz(a, SparseMatrix.from_entries(spark, [], 15, 20)) == 0


def test_batches_of_a_square_update_it_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(incremental, "write_table", lambda df, name: made.append(name) or write_table(df, name))
    monkeypatch.setattr(incremental, "spgemm", lambda *_: pytest.fail("values are not asked for"))
    a = some(spark, 75, 20, 20, 80)
    nnz = [r["nnz_c_global"] for r in incremental.run_batches(a, a, 2, 5)]
    assert made == ["updates", "operand", "operand"]
    assert nnz[-1] <= len(dense_product(a, a)) and nnz == sorted(nnz)


def test_structure_of_a_large_product_has_no_row_a_multiplication(spark, large):
    a, b = some(spark, 76, 20, 15, 60), some(spark, 77, 15, 20, 50)
    pattern = structure.symbolic(a, b)
    assert pattern.pairs is None
    new = a.with_df(a.df.selectExpr("i", "j", "v * 3 - 1 AS v"))
    assert structure.numeric(pattern, new, b).entries() == pytest.approx(dense_product(new, b))
    with pytest.raises(ValueError):
        structure.numeric(pattern, some(spark, 78, 20, 15, 60), b)


def test_small_right_sides_go_to_all_packed(spark, large, monkeypatch):
    """Of the square's product with A only its own entries are shuffled, not with a row of A each."""
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(multiply, "BLOCK_WORK", 1000)
    a = some(spark, 79, 20, 20, 90)
    c = multiply.power(a, 3)
    assert "BroadcastHashJoin" in plan(c.df) and "SortMergeJoin" not in plan(c.df)
    assert c.entries() == (a @ a @ a).entries()


@pytest.mark.parametrize("ncols", [40, 2**31, 2**45])
def test_rows_are_summed_as_they_come(monkeypatch, ncols):
    """However batches cut rows, each entry comes once, also where one row is more than is held at once."""
    monkeypatch.setattr(multiply, "AT_ONCE", 10)
    monkeypatch.setattr(multiply, "PIECE", 4)
    met = [(i, float(k - 3), [(i * k) % 40, (k + 1) % 40, ncols - 1], [1.0, -2.0, 0.0]) for i in (2, 3, 7) for k in range(5 * i)]
    index = multiply._index_type(ncols)
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*met), (pa.int64(), pa.float64(), pa.list_(pa.int32() if index == "int" else pa.int64()), pa.list_(pa.float64())))], ["i", "a", "js", "bs"])
    expected = {}
    for i, a, js, bs in met:
        for j, b in zip(js, bs):
            expected[i, j] = expected.get((i, j), 0.0) + a * b
    for size in (1, 4, 1000):
        rows = [r for b in multiply._sums_of_rows(ncols, index)(whole.slice(k, size) for k in range(0, len(met), size)) for r in b.to_pylist()]
        entries = [((r["i"], j), v) for r in rows for j, v in zip(r["js"], r["vs"])]
        assert len(entries) == len(expected) and dict(entries) == expected
    assert list(multiply._sums_of_rows(ncols, index)(iter([]))) == []


def test_sums_of_a_stream_lie_on_disk(spark, tmp_path):
    source, changes, checkpoint = (str(tmp_path / name) for name in ("in", "changes", "checkpoint"))
    a = some(spark, 80, 20, 20, 90)
    a.df.repartition(3).write.parquet(source)
    query = summed_stream(updates_stream(spark, source, 2), changes, checkpoint)
    query.awaitTermination()
    assert all(any(m.startswith("rocksdb") for m in p["stateOperators"][0]["customMetrics"]) for p in query.recentProgress)
    assert len(query.recentProgress) == 2 and current(spark, changes, 20, 20).entries() == a.entries()


def test_chunks_of_a_large_product_send_the_operands_once(spark, large, monkeypatch):
    made = []
    monkeypatch.setattr(multiply, "write_table", lambda df, name, **how: made.append(name) or write_table(df, name, **how))
    monkeypatch.setattr(multiply, "spgemm", lambda *_: pytest.fail("a chunk's operands are not sent again"))
    a, b = some(spark, 81, 40, 30, 300), some(spark, 82, 30, 50, 400)
    a = a + SparseMatrix.from_entries(spark, [(7, k, 2.0) for k in range(30)], 40, 30)  # a row of much work
    expected = dense_product(a, b)
    for how in ({"chunks": 1}, {"budget": 2500}):
        made.clear()
        assert multiply.spgemm_chunked(a, b, **how).entries() == expected
        assert made.count("met") == 1 and made.count("chunk") > 1
    none = SparseMatrix.from_entries(spark, [], 40, 30)
    assert multiply.spgemm_chunked(none, none.T, chunks=4).entries() == {}


def test_blocks_follow_the_work_and_not_the_partitions(spark, monkeypatch):
    """A row of B is sent to each block that needs it, so many partitions alone make no more blocks."""
    monkeypatch.setattr(multiply, "PLAIN_WORK", 0)
    monkeypatch.setattr(multiply, "SMALL_SIDE", 0)
    monkeypatch.setattr(multiply, "SENT_NNZ", 0)
    monkeypatch.setattr(multiply, "_partitions", lambda df: 12)
    a, b = some(spark, 83, 40, 30, 300), some(spark, 84, 30, 50, 400)
    c = multiply.spgemm(a, b)
    (dealt,) = [line for line in plan(c.df).splitlines() if "direct_shuffle_partition_id" in line]
    assert f", {2 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in dealt
    assert c.entries() == dense_product(a, b)


def test_places_where_entries_meet_grow_with_them(spark, large, monkeypatch):
    monkeypatch.setattr(multiply, "MET_ENTRIES", 100)
    a, b = some(spark, 85, 40, 30, 300), some(spark, 86, 30, 50, 400)
    places = [line for line in plan(multiply.spgemm(a, b, "row1d").df).splitlines() if "REPARTITION_BY_NUM" in line and "direct" not in line]
    n = -(-(a.nnz() + b.nnz()) // 100)
    assert n > 4 and len(places) == 2 and all(f"{n}), REPARTITION_BY_NUM" in line for line in places)
