"""Logs of every kind of program: mean times, contexts over splits, diagnosis."""

import pytest

from sparkmat.sources import logs


@pytest.fixture()
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"{name.replace('__', '.')}").write_text(text)
        return str(tmp_path)

    return write


def times(spark, path):
    return {r.file: (r.kind, r.n, r.ms) for r in logs.runtimes(logs.read_lines(spark, path)).collect()}


def test_runtimes_by_kind(spark, folder):
    path = folder(
        combblas_strong_ldoor_4__out="\x1b[96m<Timer>[spgemm] 900 ms\x1b[0m\n<Timer>[spgemm] 100 ms\nother\n<Timer>[spgemm] 110 ms\n",
        combblas_strong_ldoor_16__out="<Timer>[spgemm] 70.5 ms\n",
        trilinos_strong_ldoor_4__out="<Timer>[spgemm] 5 ms\n<Timer>[spgemm] n=10,avg=1902.2,sum=3\n<Timer>[spgemm] n=10,avg=1,sum=3\n",
        trilinos_strong_ldoor_4_permute__out="<Timer>[spgemm] 5 ms\n",
        hns_strong_16_2x2_ldoor_kokkos_nospcomm_async_nopermute__out="<Timer>[spgemm] 7 ms\nSTARTING spgemm round: 0\n<Timer>[spgemm] 900 ms\nSTARTING spgemm round: 1\n<Timer>[spgemm] 10 ms\n<Timer>[spgemm] n=2,avg=99\n"
        "STARTING spgemm round: 2\n<Timer>[spgemm] 20 ms\n",
        notes__txt="<Timer>[spgemm] 1 ms\n",
    )
    assert times(spark, path) == {
        "combblas_strong_ldoor_4.out": ("combblas_strong", 2, 105.0),
        "combblas_strong_ldoor_16.out": ("combblas_strong", 1, 70.5),
        "trilinos_strong_ldoor_4.out": ("trilinos_strong", 1, 1902.2),
        "hns_strong_16_2x2_ldoor_kokkos_nospcomm_async_nopermute.out": ("hns_strong", 2, 15.0),
    }


def test_context_over_splits(spark, folder):
    """A marker holds on through the splits of a file that have none."""
    name = "hns_strong_16_2x2_ldoor_kokkos_nospcomm_async_nopermute.out"
    text = "".join(f"STARTING spgemm round: {r}\n" + "".join(f"<Timer>[spgemm] {r}.5 ms {'x' * 40}\n" for _ in range(60)) for r in range(4))
    path = folder(**{name.replace(".", "__"): "before\n" + text})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = logs.read_lines(spark, path)
        got = logs.with_context(lines, r"STARTING spgemm round:\s*(\d+)", "round").where("line LIKE '<Timer%'").selectExpr("round", "substring(line, 17, 1) AS said").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 240 and all(str(r["round"]) == r.said for r in got)


def test_diagnosis(spark, folder):
    path = folder(
        hns_strong_16_4x4_m_kokkos_spcomm_async_nopermute__out="spgemm round: 3\nA stored in CSC\n",
        hns_strong_64_4x4_m_kokkos_spcomm_async_nopermute__out="spgemm round: 3\nA stored in CSC\n",  # never supported
        hns_strong_64_4x4_m_kokkos_nospcomm_async_nopermute__out="spgemm round: 3\n",
        hns_strong_4_2x2_m_kokkos_nospcomm_async_nopermute__out="spgemm round: 3 spgemm round: 3\nA stored in CSC\n",
        trilinos_strong_m_4__out="x Done spgemm\n", combblas_strong_m_4__out="2D Multiplication done\n2D Multiplication done\n", hns_mcl_4_m_async_0__002__out="Done MCL\n", other__txt="Done MCL\n",
    )
    assert {(r.program, r.file[:18], r.complete) for r in logs.diagnosis(logs.read_lines(spark, path)).collect()} == {
        ("hns", "hns_strong_16_4x4_", True), ("hns", "hns_strong_64_4x4_", False), ("hns", "hns_strong_4_2x2_m", False),
        ("trilinos", "trilinos_strong_m_", True), ("combblas", "combblas_strong_m_", False), ("mcl", "hns_mcl_4_m_async_", True),
    }
