import random

import pytest

from sparkmat.functions.text import parse_grid, parse_size
from sparkmat.matrix import SparseMatrix
from sparkmat.operators import algebra, incremental, layout
from sparkmat.operators.multiply import STRATEGIES, flops, spgemm, triple_product
from sparkmat.plans.mcl import mcl
from sparkmat.sources import generators, logs
from sparkmat.sources.matrix_market import read_mtx, write_mtx
from sparkmat.streaming.updates import accumulate, updates_stream


def some(spark, seed, n, m, nnz):
    rng = random.Random(seed)
    keys = rng.sample([(i, j) for i in range(n) for j in range(m)], nnz)
    return SparseMatrix.from_entries(spark, [(i, j, float(rng.randint(1, 9))) for i, j in keys], n, m)


def dense_product(a, b):
    out = {}
    for (i, k), x in a.entries().items():
        for (k2, j), y in b.entries().items():
            if k == k2:
                out[i, j] = out.get((i, j), 0.0) + x * y
    return out


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_agree(spark, strategy):
    a, b = some(spark, 1, 13, 9, 40), some(spark, 2, 9, 11, 35)
    got = spgemm(a, b, strategy, grid=3, slices=2)
    assert got.entries() == dense_product(a, b)
    assert (got.nrows, got.ncols) == (13, 11)


def test_shapes_must_fit(spark):
    with pytest.raises(ValueError):
        spgemm(some(spark, 1, 3, 4, 5), some(spark, 1, 3, 4, 5))


def test_algebra(spark):
    a, b = some(spark, 3, 8, 8, 20), some(spark, 4, 8, 8, 20)
    assert (a @ b).T.entries() == (b.T @ a.T).entries()
    assert (a @ SparseMatrix.identity(spark, 8)).entries() == a.entries()
    cancelled = algebra.add(a, a, 1.0, -1.0)
    assert cancelled.nnz() == 20 and set(cancelled.entries().values()) == {0.0}
    sums = {}
    for (i, _), v in algebra.normalize(a).entries().items():
        sums[i] = sums.get(i, 0) + v
    assert all(abs(s - 1) < 1e-12 for s in sums.values())
    assert flops(a, b).first()[0] == sum(1 for (_, k) in a.entries() for (k2, _) in b.entries() if k == k2)


def test_empty_matrix(spark):
    none, a = SparseMatrix.from_entries(spark, [], 5, 5), some(spark, 5, 5, 5, 6)
    assert (none @ a).nnz() == 0 and (a + none).entries() == a.entries()
    assert layout.info(none).first()["nnz"] == 0
    assert flops(none, a).first()[0] == 0


def test_pointers_over_many_ranges(spark):
    a = some(spark, 6, 50, 50, 300)
    ptr = {r.i: r.ptr for r in layout.pointers(a).collect()}
    total = 0
    for i in range(50):
        total += sum(1 for (r, _) in a.entries() if r == i)
        assert ptr[i] == total


def test_bitmask_fixtures(spark):
    def mask(keys):
        m = SparseMatrix.from_entries(spark, [(0, k, 1.0) for k in keys], 1, 8)
        return layout.packed_mask(layout.nonempty(m))

    assert mask([1, 3, 5]).first()["mask"] == 42
    assert mask([0, 1, 3, 4, 6, 7]).first()["mask"] == 219
    both = layout.masks_intersected(mask([0, 1, 3, 4, 6, 7]), mask([1, 2, 4, 5, 7]))
    assert both.first()["mask"] == 146


def test_parity_bands_intersect_modulo_six(spark):
    n = 60
    for parity in (0, 1):
        for r in (0, 1, 2):
            a = generators.banded(spark, n, 2, parity, "j")
            b = generators.banded(spark, n, 3, r, "i")
            keys = {x.k for x in layout.nonempty(a, "j").intersect(layout.nonempty(b, "i")).collect()}
            assert keys == {k for k in range(n) if k % 2 == parity and k % 3 == r}


@pytest.mark.parametrize("d", [1, 2, 3])
def test_prolongation_is_the_scaled_transpose_of_restriction(spark, d):
    p, r = generators.prolongation(spark, *[3] * d), generators.restriction(spark, *[3] * d)
    assert p.entries() == {(j, i): v * 2**d for (i, j), v in r.entries().items()}
    sums = {}
    for (i, _), v in p.entries().items():
        sums[i] = sums.get(i, 0) + v
    assert set(sums.values()) == {1.0}


def test_stencil_sizes(spark):
    n = 4
    want = {"3pt": 3 * n - 2, "5pt": 5 * n**2 - 4 * n, "9pt": (3 * n - 2) ** 2, "7pt": 7 * n**3 - 6 * n**2, "27pt": (3 * n - 2) ** 3}
    for kind, nnz in want.items():
        assert generators.stencil(spark, kind, *[n] * generators.STENCILS[kind]).nnz() == nnz
    a, r, p = generators.stencil(spark, "3pt", 7), generators.restriction(spark, 4), generators.prolongation(spark, 4)
    assert triple_product(r, a, p).entries() == spgemm(spgemm(r, a), p).entries()


def test_matrix_market(spark, tmp_path):
    a = some(spark, 7, 6, 9, 15)
    write_mtx(a, str(tmp_path / "a"))
    back = read_mtx(spark, str(tmp_path / "a"))
    assert (back.nrows, back.ncols, back.entries()) == (6, 9, a.entries())
    path = tmp_path / "s.mtx"
    path.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 2\n2 1\n3 3\n")
    assert read_mtx(spark, str(path)).entries() == {(1, 0): 1.0, (0, 1): 1.0, (2, 2): 1.0}


def test_updates(spark):
    a = some(spark, 8, 10, 10, 50)
    parts = incremental.disjoint_updates(a, 3, 10).collect()
    assert sorted(r.batch for r in parts) == [-1] * 20 + [0] * 10 + [1] * 10 + [2] * 10
    assert {(r.i, r.j): r.v for r in parts} == a.entries()
    records = list(incremental.run_batches(a, a, 2, 5, static_b=True, warmup=1))
    assert [r["nnz_a_global"] for r in records] == [45, 50] and records[0]["is_warmup"] == 1


def test_apportion(spark):
    sizes = spark.createDataFrame([(0, 50), (1, 30), (2, 20)], "rank long, n long")
    assert {r["rank"]: r.alloc for r in incremental.apportion(sizes, 7, 5).collect()} == {0: 4, 1: 2, 2: 1}
    capped = {r["rank"]: r.alloc for r in incremental.apportion(sizes, 18, 5).collect()}
    assert sum(capped.values()) == 18 and capped[0] <= 10 and capped[1] <= 6 and capped[2] <= 4


def test_mcl_counts(spark):
    a = some(spark, 9, 12, 12, 60)
    out, sizes = mcl(a, 2, 0.05)
    assert len(sizes) == 2 and out.nnz() == sizes[-1][1] and all(p <= n for n, p in sizes)


def test_text_functions():
    assert parse_grid("2x3") == (2, 3)
    assert (parse_size("12", 100), parse_size("5%", 1000), parse_size("0.001%", 100)) == (12, 50, 1)
    with pytest.raises(ValueError):
        parse_grid("0x2")


def test_logs(spark, tmp_path):
    (tmp_path / "hns_strong_16_2x2_archaea_kokkos_nospcomm_async_nopermute.out").write_text(
        "STARTING spgemm round: 0\n<Timer>[spgemm] 99 ms\nSTARTING spgemm round: 1\n\x1b[32m<Timer>[spgemm] 1357.5 ms\x1b[0m\n"
        "<[process 3]>[wait_for_input] n=4,avg=2.5,sum=10.0\n<[process 3]>[spm_time] 4.0 ms\n<[process 3]>[spm_time] 2.0 ms\n"
    )
    (tmp_path / "comm_vol_4_2x2_archaea.out").write_text("<[p 0, t 0, m A, r 0, hier 0]>[x] 10 B, y\n<[p 0, t 0, m B, r 0, hier 0]>[x] 5 B\n<[p 1, t 0, m A, r 0, hier 1]>[x] 7 B\n")
    (tmp_path / "hns_mcl_16_archaea_async_0.002.out").write_text("===== ITERATION 0 =====\n<Timer rank 0>[mcl_spgemm] 5.0 ms\n<Timer rank 1>[mcl_spgemm] 7.0 ms\n===== ITERATION 1 =====\n<Timer>[spgemm] 3.0 ms\n")
    lines = logs.read_lines(spark, str(tmp_path))
    times = {(r.phase, r["rank"], r["round"]): r.ms for r in logs.phase_times(logs.spgemm_metrics(lines)).collect() if r.file.startswith("hns_strong")}
    assert times == {("spgemm", None, 1): 1357.5, ("wait_for_input", 3, 1): 10.0, ("spm_time", 3, 1): 6.0}
    assert [(r["rank"], r.bytes) for r in logs.communication_volume(lines).collect()] == [(0, 15)]
    assert {(r.iter, r.ms) for r in logs.iteration_times(lines).collect()} == {(0, 7.0), (1, 3.0)}
    facts = {r.kind: (r.matrix, r.ngpus) for r in logs.file_facts(lines).collect()}
    assert facts == {"hns_strong": ("archaea", 16), "comm_vol": ("archaea", 4), "hns_mcl": ("archaea", 16)}
    done = {r.file[:4]: r.complete for r in logs.completeness(lines, "ITERATION", "spgemm\\]").collect()}
    assert done["comm"] is False


def test_stream(spark, tmp_path):
    for k, rows in enumerate([[(0, 0, 1.0), (0, 1, 2.0)], [(0, 1, 3.0), (2, 2, 4.0)]]):
        spark.createDataFrame(rows, "i long, j long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    start = SparseMatrix.from_entries(spark, [(1, 1, 9.0)], 3, 3)
    query = accumulate(updates_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "ck"), start, lambda m, n: seen.append(m.entries()))
    query.awaitTermination(120)
    assert seen[-1] == {(0, 0): 1.0, (0, 1): 5.0, (2, 2): 4.0, (1, 1): 9.0} and len(seen) == 2
