"""Products in tiles, by requests, with heavy indices, in chunks of work, on stored structures, over semirings; products kept up to date."""

import math
import random
import statistics

import pytest

from sparkmat.matrix import SparseMatrix
from sparkmat.operators import bitmaps, layout, maintained, multiply, segments, semiring, structure
from sparkmat.shared import temporary_path
from sparkmat.sources.matrix_market import read_mtx, write_array
from sparkmat.streaming.updates import compact, current, summed_stream, updates_stream

from tests.test_matrix import dense_product, some


def executed(df):
    """The plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


@pytest.mark.parametrize(("strategy", "deals"), [("summa", "direct_shuffle_partition_id(t#"), ("hier", "direct_shuffle_partition_id(t#"), ("row1d", "direct_shuffle_partition_id(block#")])
def test_no_exchange_carries_products(spark, strategy, deals):
    """Both operands are dealt by the block of C; the join and the sum find their rows in place."""
    from sparkmat.shared import write_table

    a, b = some(spark, 1, 40, 30, 200), some(spark, 2, 30, 50, 200)
    a, b = a.with_df(write_table(a.df, "a")), b.with_df(write_table(b.df, "b"))
    c = multiply.spgemm(a, b, strategy, grid=3, slices=2)
    plan = c.df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above, plan
    dealt = [line for line in exchanges(c.df) if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and all(deals in line for line in dealt)
    if strategy != "row1d":
        assert len(exchanges(c.df)) == 2
    assert c.entries() == dense_product(a, b)


def test_tiles_of_any_shape(spark):
    for n, k, m in ((7, 1, 3), (2, 2, 9)):
        a, b = some(spark, 3, n, k, min(n * k, 4)), some(spark, 4, k, m, min(k * m, 5))
        for strategy in ("summa", "hier", "row1d", "heavy"):
            assert multiply.spgemm(a, b, strategy, grid=3, slices=3).entries() == dense_product(a, b)


def test_requests_name_each_needed_row_once(spark):
    a = SparseMatrix.from_entries(spark, [(0, 3, 1.0), (1, 3, 1.0), (5, 3, 1.0), (5, 4, 1.0)], 6, 6)
    got = multiply.requests(a.df.selectExpr("i", "j AS k"), 3).collect()
    assert sorted(map(tuple, got)) == [(0, 3), (1, 3), (1, 4)]


def test_heavy_index_is_split(spark):
    """One index holds a tenth of all entries; no task gets much more than the median."""
    n = 3000
    rng = random.Random(1)
    left = [(i, 0 if i % 10 == 0 else 1 + rng.randrange(n), 1.0) for i in range(n)]
    right = [(0 if j % 10 == 0 else 1 + rng.randrange(n), j, 1.0) for j in range(n)]
    a, b = SparseMatrix.from_entries(spark, left, n, n + 1), SparseMatrix.from_entries(spark, right, n + 1, n)
    ra, rb = a.df.selectExpr("i", "j AS k", "v AS a"), b.df.selectExpr("i AS k", "j", "v AS b")
    (heavy,) = multiply.heavy_indices(ra, rb, 1000).collect()
    assert heavy["k"] == 0 and heavy["na"] / heavy["pa"] * heavy["nb"] / heavy["pb"] <= 1000
    split = multiply._split_heavy(ra, rb, 1000).groupBy("k", "x", "y").count().where("k = 0").collect()
    assert len(split) > 50 and max(r["count"] for r in split) <= 3 * statistics.median(r["count"] for r in split)
    joined = multiply._split_heavy(ra, rb, 1000)
    assert {(r.i, r.j): r.v for r in multiply._summed(joined).collect()} == multiply.spgemm(a, b, "shuffle").entries()


def test_few_heavy_indices(spark):
    left = spark.range(100).selectExpr("id AS i", "id % 50 AS k", "1.0D AS a")
    right = spark.range(100).selectExpr("id % 50 AS k", "id AS j", "1.0D AS b")
    assert multiply.heavy_indices(left, right, 3).count() == 50
    assert multiply.heavy_indices(left, right, 3, most=10).count() <= 10


def test_chunks_keep_the_budget(spark):
    rng = random.Random(2)
    work = {i: rng.choice([1, 5, 20, 300]) for i in range(200)}
    frame = spark.createDataFrame(list(work.items()), "i long, work long")
    chunks = {}
    for r in multiply.chunks_by_work(frame, 100).collect():
        chunks.setdefault(r.chunk, []).append(r.work)
    assert all(sum(c) <= 100 or len(c) == 1 for c in chunks.values()) and sum(map(len, chunks.values())) == 200
    a, b = some(spark, 5, 30, 20, 150), some(spark, 6, 20, 25, 120)
    for how in ({"budget": 300}, {"chunks": 2}):
        assert multiply.spgemm_chunked(a, b, **how).entries() == dense_product(a, b)
    none = SparseMatrix.from_entries(spark, [], 30, 20)
    assert multiply.spgemm_chunked(none, b, budget=5).entries() == {}
    with pytest.raises(ValueError):
        multiply.spgemm_chunked(a, b)


def test_estimates_and_plans(spark):
    a, b = some(spark, 7, 60, 60, 900), some(spark, 8, 60, 60, 900)
    nnz = multiply.spgemm(a, b).nnz()
    assert structure.estimate_nnz(a, b) == nnz  # exact below 2^LG columns
    assert abs(structure.estimate_nnz(a, b, lg=4) - nnz) <= 0.5 * nnz
    plan = structure.plan_product(a, b)
    assert plan.nnz == nnz and plan.flops > nnz and plan.strategy == "hier"
    assert structure.planned_product(a, b).entries() == dense_product(a, b)
    thin = SparseMatrix.identity(spark, 60)
    assert structure.plan_product(thin, thin).strategy == "auto"
    assert structure.estimate_nnz(SparseMatrix.from_entries(spark, [], 5, 5), SparseMatrix.identity(spark, 5)) == 0


def test_one_structure_for_two_value_sets(spark):
    a, b = some(spark, 9, 20, 15, 90), some(spark, 10, 15, 20, 80)
    stored = structure.symbolic(a, b)
    assert stored.pairs.count() == multiply.flops(a, b).first()[0]
    for f in ("v", "v * 3 - 1"):
        na, nb = a.with_df(a.df.selectExpr("i", "j", f"{f} AS v")), b.with_df(b.df.selectExpr("i", "j", f"{f} + 0.5 AS v"))
        c = structure.numeric(stored, na, nb)
        assert c.entries() == pytest.approx(dense_product(na, nb))
        assert "k#" not in executed(c.df)  # places only, the contraction index is not met again
    with pytest.raises(ValueError):
        structure.numeric(stored, some(spark, 11, 20, 15, 90), b)


def brute_closure(a, best, step, one):
    n, d = a.nrows, {}
    for (i, j), v in a.entries().items():
        d[i, j] = v
    for i in range(n):
        d[i, i] = best(d.get((i, i), one), one)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                if (i, k) in d and (k, j) in d:
                    v = step(d[i, k], d[k, j])
                    d[i, j] = best(d[i, j], v) if (i, j) in d else v
    return d


@pytest.mark.parametrize(("name", "best", "step", "one"), [("min_plus", min, lambda a, b: a + b, 0.0), ("max_min", max, min, math.inf), ("or_and", max, lambda a, b: 1.0, 1.0)])
def test_closures(spark, name, best, step, one):
    a = some(spark, 12, 12, 12, 18)
    want = a if name != "or_and" else a.pattern()
    assert semiring.closure(a, name).entries() == brute_closure(want, best, step, one)
    if name == "min_plus":
        chain = SparseMatrix.from_entries(spark, [(k, k + 1, 1.0) for k in range(20)], 21, 21)
        assert semiring.closure(chain, name).entries()[0, 20] == 20.0


def test_closures_that_do_not_end(spark):
    with pytest.raises(ValueError):
        semiring.closure(SparseMatrix.from_entries(spark, [(0, 1, -1.0), (1, 0, -1.0)], 2, 2), "min_plus")
    with pytest.raises(ValueError):
        semiring.closure(SparseMatrix.identity(spark, 2), "plus_times")
    assert semiring.multiply(some(spark, 1, 5, 5, 9), some(spark, 2, 5, 5, 9)).entries() == dense_product(some(spark, 1, 5, 5, 9), some(spark, 2, 5, 5, 9))


@pytest.mark.parametrize("static", [False, True])
def test_maintained_product(spark, static):
    a, b = some(spark, 13, 40, 30, 150), some(spark, 14, 30, 20, 100)
    product = maintained.MaintainedProduct(a, b, static, blocks=8)
    assert product.c.entries() == dense_product(a, b) and product.nnz() == product.rows_written
    da = SparseMatrix.from_entries(spark, [(0, 3, 5.0), (1, 7, -2.0)], 40, 30)  # one block of rows
    written = product.update(da)
    now = a + da
    assert product.c.entries() == dense_product(now, b)
    assert written == sum(1 for i, _ in product.c.entries() if i < 5) < product.nnz()
    db = SparseMatrix.from_entries(spark, [(3, 0, 4.0), (9, 9, 1.0)], 30, 20)
    if static:
        with pytest.raises(ValueError):
            product.update(None, db)
    else:
        product.update(da, db)
        assert product.c.entries() == dense_product(now + da, b + db)
    assert product.update() == 0
    nothing = SparseMatrix.from_entries(spark, [], 40, 30)
    before = product.c.entries()
    assert product.update(nothing) == 0 and product.c.entries() == before
    product.close()


def test_superseded_tables_go(spark):
    import os

    from sparkmat.shared import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    a = some(spark, 15, 30, 30, 200)
    before = set(os.listdir(root))
    product = maintained.MaintainedProduct(a, a, blocks=4)
    for k in range(2):
        product.update(some(spark, 20 + k, 30, 30, 50), some(spark, 30 + k, 30, 30, 50))
        assert len(set(os.listdir(root)) - before) <= 2 + 4  # the operands, and tables of blocks
    product.close()
    assert set(os.listdir(root)) <= before


def test_stream_restarts_in_mid_stream(spark):
    """Two files are summed, the query ends; it goes on from its checkpoint with the third, and runs a failed batch again."""
    source, changes, checkpoint = (temporary_path(spark, n) for n in ("inserts", "changes", "checkpoint"))
    parts = [some(spark, 40 + k, 10, 10, 40) for k in range(4)]
    for m in parts[:2]:
        m.df.coalesce(1).write.mode("append").parquet(source)
    summed_stream(updates_stream(spark, source), changes, checkpoint).awaitTermination()
    assert current(spark, changes, 10, 10).entries() == (parts[0] + parts[1]).entries()
    parts[2].df.coalesce(1).write.mode("append").parquet(source)
    query = summed_stream(updates_stream(spark, source), changes, checkpoint)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len((parts[0] + parts[1] + parts[2]).entries())
    whole = parts[0] + parts[1] + parts[2]
    assert current(spark, changes, 10, 10).entries() == whole.entries()
    last = compact(spark, changes)
    assert last == 1 and current(spark, changes, 10, 10).entries() == whole.entries()
    parts[3].df.coalesce(1).write.mode("append").parquet(source)
    summed_stream(updates_stream(spark, source), changes, checkpoint).awaitTermination()
    assert current(spark, changes, 10, 10).entries() == (whole + parts[3]).entries()


def test_bitmaps(spark):
    keys = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, 100_000]
    frame = spark.createDataFrame([(k,) for k in keys + keys + [None]], "k long")
    sets = bitmaps.bitmaps(frame)
    assert sum(r.n for r in bitmaps.sizes(sets).collect()) == len(keys)
    asked = SparseMatrix.from_entries(spark, [(0, k, 1.0) for k in range(0, 110_000, 1)], 1, 110_000)
    assert sorted(j for _, j in bitmaps.selected(asked, sets).entries()) == keys
    other = bitmaps.bitmaps(spark.createDataFrame([(k,) for k in (1, 8, 9, 65536, 200_000)], "k long"))
    both = bitmaps.selected(asked, bitmaps.intersection(sets, other))
    assert sorted(j for _, j in both.entries()) == [1, 8, 65536]
    assert sum(r.n for r in bitmaps.sizes(bitmaps.union(sets, other)).collect()) == len(keys) + 2
    a, b = some(spark, 50, 20, 90, 60), some(spark, 51, 90, 20, 60)
    for got, want in zip(bitmaps.reduced_operands(a, b), layout.reduced_operands(a, b), strict=True):
        assert got.entries() == want.entries()


def test_segments(spark):
    a = some(spark, 52, 12, 200, 500)
    rows = segments.segmented(a, 7)
    assert max(len(r.idx) for r in rows.collect()) == 7
    starts = {r.i: r.ptr for r in layout.exclusive_pointers(a).collect()}
    assert all(r.start == starts[r.i] + 7 * r.segment and r.first == r.idx[0] and r.last == r.idx[-1] for r in rows.collect())
    place, want = {}, []
    for i, j in sorted(a.entries()):
        place[i] = place.get(i, -1) + 1
        want.append((i, place[i], j))
    assert sorted((r.i, r.pos, r.j) for r in segments.entries(rows).collect()) == want
    x = spark.range(0, 200, 2).selectExpr("id AS j", "CAST(id AS double) AS x")
    sums = {}
    for (i, j), v in a.entries().items():
        if j % 2 == 0:
            sums[i] = sums.get(i, 0.0) + v * j
    assert {r.i: r.v for r in segments.product_with_vector(rows, x).collect()} == sums
    asked = spark.createDataFrame([(i, j) for i in range(12) for j in range(0, 200, 3)], "i long, j long")
    assert {(r.i, r.j): r.v for r in segments.lookup(rows, asked).collect()} == {k: v for k, v in a.entries().items() if k[1] % 3 == 0}


def test_segments_of_a_row_of_a_million(spark):
    one = SparseMatrix(spark.range(1_000_000).selectExpr("0L AS i", "id AS j", "CAST(id % 10 AS double) AS v"), 1, 1_000_000)
    rows = segments.segmented(one)
    assert rows.selectExpr("count(*)", "max(size(idx))", "sum(size(idx))").first()[:] == (977, 1024, 1_000_000)
    ones = spark.range(1_000_000).selectExpr("id AS j", "1.0D AS x")
    assert segments.product_with_vector(rows, ones).first()["v"] == 4_500_000.0


def test_array_files_in_many_splits(spark, tmp_path):
    a = some(spark, 53, 37, 23, 300)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        write_array(a, str(tmp_path / "parts"))
        assert read_mtx(spark, str(tmp_path / "parts")).entries() == a.entries()
        lines = ["%%MatrixMarket matrix array real general", "% a comment", "", "37 23"] + [f"{a.entries().get((i, j), 0.0)}" for j in range(23) for i in range(37)]
        lines.insert(200, "% one more")
        (tmp_path / "one.mtx").write_text("\n".join(lines) + "\n")
        got = read_mtx(spark, str(tmp_path / "one.mtx"))
        assert got.entries() == a.entries() and (got.nrows, got.ncols) == (37, 23)
        for kind, below, sign in (("symmetric", 0, 1), ("skew-symmetric", 1, -1)):
            cells = {(i, j): float(i * 50 + j + 1) for j in range(41) for i in range(j + below, 41)}
            (tmp_path / f"{kind}.mtx").write_text("\n".join([f"%%MatrixMarket matrix array real {kind}", "41 41", *map(str, cells.values())]))
            want = cells | {(j, i): sign * v for (i, j), v in cells.items() if i != j}
            assert read_mtx(spark, str(tmp_path / f"{kind}.mtx")).entries() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
