"""The catalogue of sparse-matrix queries over the test tables, each with equal SQL.

Base matrices: S supplier x part, O part x order, CP customer x part (sums of
quantities; O counts), NT customer x supplier nations (dense), G a square one
(part x order modulo the number of parts, about 30 entries a row), U hour x user (counts of
events), CS customer x supplier nation, E transitions between event types.
All are made of whole tables and grow with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmat.functions.text import parse_size, stem
from sparkmat.matrix import SparseMatrix
from sparkmat.operators import algebra, bitmaps, incremental, layout, loganalytics, maintained, multiply, rows, segments, semiring, structure
from sparkmat.plans.mcl import mcl, trace
from sparkmat.shared import temporary_path, write_table
from sparkmat.sources import generators, logs
from sparkmat.sources.catalog import MATRICES, matrices, read_benchmark_csv, write_benchmark_csv
from sparkmat.sources.matrix_market import read_mtx, read_parquet, write_array, write_mtx, write_parquet
from sparkmat.streaming.updates import current, summed_stream, updates_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supplier_part(spark, sf):
    df = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    return SparseMatrix.of(df, load(spark, sf, "supplier").count(), load(spark, sf, "part").count(), "l_suppkey", "l_partkey")


def part_order(spark, sf):
    df = load(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("v"))
    return SparseMatrix.of(df, load(spark, sf, "part").count(), load(spark, sf, "orders").count(), "l_partkey", "l_orderkey")


def customer_part(spark, sf):
    lines, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
    return SparseMatrix.of(df, load(spark, sf, "customer").count(), load(spark, sf, "part").count(), "o_custkey", "l_partkey")


def nation_trade(spark, sf):
    lines, orders, customers, suppliers = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    df = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.sum("l_quantity").alias("v"))
    )
    return SparseMatrix.of(df, 25, 25, "c_nationkey", "s_nationkey")


def square(spark, sf):
    n = load(spark, sf, "part").count()
    df = load(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_orderkey") % n).alias("j")).agg(F.sum("l_quantity").alias("v"))
    return SparseMatrix.of(df, n, n, "l_partkey", "j")


def hour_user(spark, sf):
    df = load(spark, sf, "events").groupBy(F.hour("ts").alias("i"), "user_id").agg(F.count("*").alias("v"))
    return SparseMatrix.of(df, 24, load(spark, sf, "customer").count(), "i", "user_id")


def customer_nation(spark, sf):
    lines, orders, suppliers = (load(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey).groupBy("o_custkey", "s_nationkey").agg(F.sum("l_quantity").alias("v"))
    return SparseMatrix.of(df, load(spark, sf, "customer").count(), 25, "o_custkey", "s_nationkey")


def event_transitions(spark, sf):
    events = load(spark, sf, "events")
    types = events.select("event_type").distinct().withColumn("n", F.row_number().over(Window.orderBy("event_type")) - 1)  # a few types
    following = events.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next IS NOT NULL")
    numbered = following.groupBy("event_type", "next").agg(F.count("*").alias("v")).join(types.withColumnRenamed("n", "i"), "event_type")
    df = numbered.join(types.select(F.col("event_type").alias("next"), F.col("n").alias("j")), "next")
    n = types.count()
    return SparseMatrix.of(df, n, n)


S = "s AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
O = "o AS (SELECT l_partkey AS i, l_orderkey AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"  # noqa: E741
CP = "cp AS (SELECT o_custkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
NT = """nt AS (SELECT c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
N = "(SELECT count(*) FROM part)"
G = f"g AS (SELECT l_partkey AS i, l_orderkey % {N} AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
U = "u AS (SELECT hour(ts)::BIGINT AS i, user_id AS j, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"
CS = """cs AS (SELECT o_custkey AS i, s_nationkey::BIGINT AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def product_sql(a: str, b: str, left="i, j", right="i, j") -> str:
    """SQL of the product of two coordinate tables; left and right name row and column."""
    (ai, ak), (bk, bj) = left.split(", "), right.split(", ")
    return f"SELECT a.{ai} AS i, b.{bj} AS j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.{ak} = b.{bk} GROUP BY 1, 2"


def by_row(m: SparseMatrix) -> DataFrame:
    """A row for each row of a large result: its entries, their sum, and their sum by columns."""
    return rows.row_digests(m)


def by_row_sql(with_: str, body: str) -> str:
    return f"WITH {with_}, x AS ({body}) SELECT i, count(*) AS n, sum(v) AS s, sum(v * (j + 1)) AS sj FROM x GROUP BY i"


# --- products -------------------------------------------------------------------------------------

COSUPPLY = f"WITH {S} {product_sql('s', 's', 'i, j', 'j, i')}"


@query("spgemm_supplier_cosupply", COSUPPLY)
def spgemm_supplier_cosupply(spark, sf):
    s = supplier_part(spark, sf)
    return multiply.spgemm(s, s.T).df


@query("spgemm_part_copurchase", f"WITH {O} {product_sql('o', 'o', 'i, j', 'j, i')}")
def spgemm_part_copurchase(spark, sf):
    o = part_order(spark, sf)
    return multiply.spgemm(o, o.T).df


@query("spgemm_rect_customer_supplier", f"WITH {S}, {CP} {product_sql('cp', 's', 'i, j', 'j, i')}")
def spgemm_rect_customer_supplier(spark, sf):
    return multiply.spgemm(customer_part(spark, sf), supplier_part(spark, sf).T).df


def _with_strategy(strategy):
    def run(spark, sf):
        s = supplier_part(spark, sf)
        return multiply.spgemm(s, s.T, strategy).df

    return run


for _name, _strategy in (("broadcast", "broadcast"), ("shuffle", "shuffle"), ("summa", "summa"), ("hier", "hier"), ("semijoin", "semijoin"), ("1d_row", "row1d"), ("salted", "salted")):
    query(f"spgemm_{_name}", COSUPPLY)(_with_strategy(_strategy))


@query("spgemm_square_power3", by_row_sql(f"{G}, g2 AS ({product_sql('g', 'g')})", product_sql("g2", "g")))
def spgemm_square_power3(spark, sf):
    return by_row(multiply.power(square(spark, sf), 3))


@query("spgemm_event_transitions", """
WITH t AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS n FROM (SELECT DISTINCT event_type FROM events)),
n AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
e AS (SELECT a.n AS i, b.n AS j, count(*)::DOUBLE AS v FROM n JOIN t a ON a.event_type = n.event_type JOIN t b ON b.event_type = n.nx GROUP BY 1, 2)
""" + product_sql("e", "e"))  # fmt: skip
def spgemm_event_transitions(spark, sf):
    e = event_transitions(spark, sf)
    return multiply.spgemm(e, e).df


@query("spgemm_flops", f"WITH {S}, a AS (SELECT j AS k, count(*) AS n FROM s GROUP BY 1) SELECT sum(n * n)::BIGINT AS flops FROM a")
def spgemm_flops(spark, sf):
    s = supplier_part(spark, sf)
    return multiply.flops(s, s.T)


@query("spma", by_row_sql(f"{G}, p AS ({product_sql('g', 'g')})", "SELECT i, j, sum(v) AS v FROM (SELECT * FROM g UNION ALL SELECT * FROM p) GROUP BY 1, 2"))
def spma(spark, sf):
    g = square(spark, sf)
    return by_row(multiply.fused_multiply_add(g, g, g))


# --- sums, scaling, selection ---------------------------------------------------------------------


@query("spadd", f"WITH {G} SELECT i, j, sum(v) AS v FROM (SELECT * FROM g UNION ALL SELECT j AS i, i AS j, v FROM g) GROUP BY 1, 2")
def spadd(spark, sf):
    g = square(spark, sf)
    return algebra.add(g, g.T).df


@query("spadd_scaled", f"WITH {G} SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM g UNION ALL SELECT j AS i, i AS j, -3 * v AS v FROM g) GROUP BY 1, 2")
def spadd_scaled(spark, sf):
    g = square(spark, sf)
    return algebra.add(g, g.T, 2.0, -3.0).df


@query("transpose", f"WITH {S} SELECT j AS i, i AS j, v FROM s")
def transpose(spark, sf):
    return supplier_part(spark, sf).T.df


@query("coalesce_duplicates", "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def coalesce_duplicates(spark, sf):
    return SparseMatrix.of(load(spark, sf, "lineitem"), 1, 1, "l_suppkey", "l_partkey", "l_quantity").coalesced().df


@query("pattern", f"WITH {S} SELECT i, j, 1.0::DOUBLE AS v FROM s")
def pattern(spark, sf):
    return supplier_part(spark, sf).pattern().df


@query("normalize_rows", f"WITH {NT} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM nt")
def normalize_rows(spark, sf):
    return algebra.normalize(nation_trade(spark, sf), "i").df.withColumn("v", F.round("v", 9))


@query("normalize_cols", f"WITH {NT} SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 9) AS v FROM nt")
def normalize_cols(spark, sf):
    return algebra.normalize(nation_trade(spark, sf), "j").df.withColumn("v", F.round("v", 9))


@query("row_sums", f"WITH {NT} SELECT i, sum(v) AS s FROM nt GROUP BY 1")
def row_sums(spark, sf):
    return algebra.axis_sums(nation_trade(spark, sf), "i")


@query("scale_columns", f"WITH {NT} SELECT i, j, v * sum(v) OVER (PARTITION BY j) AS v FROM nt")
def scale_columns(spark, sf):
    nt = nation_trade(spark, sf)
    return algebra.scale(nt, algebra.axis_sums(nt, "j"), "j").df


@query("inflate", f"WITH {NT} SELECT i, j, round(v * v / sum(v * v) OVER (PARTITION BY i), 9) AS v FROM nt")
def inflate(spark, sf):
    return algebra.inflate(nation_trade(spark, sf)).df.withColumn("v", F.round("v", 9))


@query("prune", f"WITH {G} SELECT i, j, v FROM g WHERE abs(v) > 30")
def prune(spark, sf):
    return algebra.prune(square(spark, sf), 30.0).df


@query("self_loops", f"WITH {G} SELECT i, j, v FROM g WHERE i <> j UNION ALL SELECT k AS i, k AS j, 1.0::DOUBLE AS v FROM (SELECT unnest(range({N})) AS k)")
def self_loops(spark, sf):
    return algebra.set_self_loops(square(spark, sf)).df


@query("permute_symmetric", f"WITH {G} SELECT (i * 7 + 3) % {N} AS i, (j * 7 + 3) % {N} AS j, v FROM g")
def permute_symmetric(spark, sf):
    g = square(spark, sf)
    p = algebra.arithmetic_permutation(g.nrows, 7, 3, spark)
    return algebra.permute(g, p, p).df


@query("permute_roundtrip", by_row_sql(G, product_sql("g", "g")))
def permute_roundtrip(spark, sf):
    """The square of the permuted matrix, permuted back."""
    g = square(spark, sf)
    p = write_table(algebra.random_permutation(g.nrows, 1, spark), "permutation")
    g = algebra.permute(g, p, p)
    g = g.with_df(write_table(g.df, "permuted"))
    return rows.product_digests(*multiply.permuted_operands(g, g, algebra.inverse(p), algebra.inverse(p)))


# --- layout ---------------------------------------------------------------------------------------


@query("row_ptr", f"WITH {S}, n AS (SELECT s_suppkey AS i, count(s.i) AS n FROM supplier LEFT JOIN s ON s.i = s_suppkey GROUP BY 1) SELECT i, (sum(n) OVER (ORDER BY i))::BIGINT AS ptr FROM n")
def row_ptr(spark, sf):
    return layout.pointers(supplier_part(spark, sf), "i")


@query("col_ptr", f"WITH {S}, n AS (SELECT p_partkey AS j, count(s.i) AS n FROM part LEFT JOIN s ON s.j = p_partkey GROUP BY 1) SELECT j, (sum(n) OVER (ORDER BY j))::BIGINT AS ptr FROM n")
def col_ptr(spark, sf):
    return layout.pointers(supplier_part(spark, sf), "j")


@query("row_displacements", f"WITH {S}, n AS (SELECT s_suppkey AS i, count(s.i) AS n FROM supplier LEFT JOIN s ON s.i = s_suppkey GROUP BY 1) SELECT i, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS ptr FROM n")
def row_displacements(spark, sf):
    return layout.exclusive_pointers(supplier_part(spark, sf), "i")


@query("row_nnz_from_ptr", f"WITH {S} SELECT s_suppkey AS i, count(s.i) AS n FROM supplier LEFT JOIN s ON s.i = s_suppkey GROUP BY 1")
def row_nnz_from_ptr(spark, sf):
    return layout.counts_of_pointers(layout.pointers(supplier_part(spark, sf), "i"), "i")


@query("csr_rows", f"WITH {G} SELECT i, (row_number() OVER (PARTITION BY i ORDER BY j) - 1)::BIGINT AS pos, j, v FROM g")
def csr_rows(spark, sf):
    return layout.flattened(layout.compressed_rows(square(spark, sf), "i"), "i")


@query("csc_columns", f"WITH {G} SELECT j, (row_number() OVER (PARTITION BY j ORDER BY i) - 1)::BIGINT AS pos, i, v FROM g")
def csc_columns(spark, sf):
    return layout.flattened(layout.compressed_rows(square(spark, sf), "j"), "j")


@query("row_ranks", f"WITH {G} SELECT i, j, v, row_number() OVER (ORDER BY i, j) AS rank FROM g")
def row_ranks(spark, sf):
    return layout.ranked(square(spark, sf).df, ["i", "j"], "rank")


@query("tile_index", f"WITH {G}, d AS (SELECT ({N} + 3) // 4 AS h, ({N} + 1) // 2 AS w) SELECT i, j, v, i // h // 2 AS tile_r, i // h % 2 AS slice, j // w AS tile_c, i % h AS local_i, j % w AS local_j FROM g, d")
def tile_index(spark, sf):
    return layout.tiles(square(spark, sf), 2, 2, 2)


@query("tile_nnz_balance", f"""WITH {G}, t AS (SELECT i // (({N} + 3) // 4) AS a, j // (({N} + 1) // 2) AS b, count(*) AS n FROM g GROUP BY 1, 2)
SELECT count(*) AS n_tiles, max(n) AS max_nnz, sum(n)::BIGINT AS total_nnz, max(n) * 8 / sum(n)::DOUBLE AS imbalance FROM t""")
def tile_nnz_balance(spark, sf):
    return layout.tile_balance(square(spark, sf), 2, 2, 2)


@query("nnz_stats", f"WITH {S} SELECT count(*) AS nnz, count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_cols FROM s")
def nnz_stats(spark, sf):
    s = supplier_part(spark, sf)
    rows = s.df.groupBy("i").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nnz"), F.count("*").alias("n_rows"))
    return rows.crossJoin(layout.nonempty(s, "j").agg(F.count("*").alias("n_cols")))  # one row each


@query("matrix_info", f"""WITH {S}, n AS (SELECT s_suppkey AS i, count(s.i) AS n FROM supplier LEFT JOIN s ON s.i = s_suppkey GROUP BY 1), p AS (SELECT count(*) AS c FROM part)
SELECT count(*) AS nrows, any_value(c) AS ncols, sum(n)::BIGINT AS nnz, sum(n) * 100.0::DOUBLE / (count(*) * any_value(c)) AS density, avg(n) AS avg_row, max(n) AS max_row, min(n) AS min_row FROM n, p""")
def matrix_info(spark, sf):
    return layout.info(supplier_part(spark, sf))


@query("validate_matrix", f"WITH {S} SELECT count(*) AS nnz, 0::BIGINT AS n_bad_row, count(*) FILTER (WHERE j >= 100) AS n_bad_col, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, 0::BIGINT AS n_repeated FROM s")
def validate_matrix(spark, sf):
    s = supplier_part(spark, sf)
    return layout.validate(SparseMatrix(s.df, s.nrows, 100))


@query("nonempty_mask", f"WITH {G} SELECT DISTINCT j AS k FROM g")
def nonempty_mask(spark, sf):
    return layout.nonempty(square(spark, sf), "j")


@query("packed_bitmask", f"WITH {G}, k AS (SELECT DISTINCT j AS k FROM g) SELECT k // 8 AS word, bit_or(1 << (k % 8)::INT)::BIGINT AS mask FROM k GROUP BY 1")
def packed_bitmask(spark, sf):
    return layout.packed_mask(layout.nonempty(square(spark, sf), "j"))


@query("mask_intersection", f"""WITH {U}, {CS}, c AS (SELECT DISTINCT j AS k FROM u INTERSECT SELECT DISTINCT i AS k FROM cs)
SELECT k // 8 AS word, bit_or(1 << (k % 8)::INT)::BIGINT AS mask FROM c GROUP BY 1""")
def mask_intersection(spark, sf):
    u, cs = hour_user(spark, sf), customer_nation(spark, sf)
    return layout.masks_intersected(layout.packed_mask(layout.nonempty(u, "j")), layout.packed_mask(layout.nonempty(cs, "i")))


@query("compress_a", f"WITH {U}, {CS} SELECT j AS i, i AS j, v FROM cs WHERE i IN (SELECT j FROM u)")
def compress_a(spark, sf):
    """Of nations x customers only the customers that are users meet something in users x hours."""
    return layout.reduced_operands(customer_nation(spark, sf).T, hour_user(spark, sf).T)[0].df


@query("compress_b", f"WITH {U}, {CS} SELECT i, j, v FROM cs WHERE i IN (SELECT j FROM u)")
def compress_b(spark, sf):
    return layout.reduced_operands(hour_user(spark, sf), customer_nation(spark, sf))[1].df


@query("densify", f"WITH {CS} SELECT i, " + ", ".join(f'coalesce(sum(v) FILTER (WHERE j = {k}), 0) AS "{k}"' for k in range(25)) + " FROM cs GROUP BY i")
def densify(spark, sf):
    return customer_nation(spark, sf).df.groupBy("i").pivot("j", list(range(25))).agg(F.sum("v")).fillna(0.0)


@query("matrix_checksum", f"""WITH {S}, t AS (SELECT ((xor(xor(i << 40, j << 16), CAST(CAST(CAST(v AS FLOAT) AS BIT) AS INTEGER)::BIGINT))::HUGEINT * {layout.CHECKSUM_FACTOR}) % 18446744073709551616 AS t FROM s)
SELECT CAST((sum(t) + {layout.CHECKSUM_OFFSET}) % 18446744073709551616 AS VARCHAR) AS checksum FROM t""")
def matrix_checksum(spark, sf):
    return layout.checksum(supplier_part(spark, sf))


# --- generators -----------------------------------------------------------------------------------


def _stencil_sql(kind: str, n: int) -> str:
    d = generators.STENCILS[kind]
    dims, index = "xyz"[:d], " + ".join(f"({c}) * {n**k}" for k, c in enumerate("xyz"[:d]))
    moved = " + ".join(f"(d{c} <> 0)::INT" for c in dims)
    column = " + ".join(f"({c} + d{c}) * {n**k}" for k, c in enumerate(dims))
    value = {"9pt": "CASE m WHEN 0 THEN 8 WHEN 1 THEN -2 ELSE -1 END", "27pt": "CASE m WHEN 0 THEN 26 WHEN 1 THEN -4 ELSE -1 END"}.get(kind, f"CASE m WHEN 0 THEN {2 * d} ELSE -1 END")
    source = ", ".join(f"(SELECT range AS {c} FROM range({n})), (SELECT range AS d{c} FROM range(-1, 2))" for c in dims)
    inside = " AND ".join(f"{c} + d{c} BETWEEN 0 AND {n - 1}" for c in dims)
    few = "" if kind in ("9pt", "27pt") else " AND m <= 1"
    return f"SELECT ({index})::BIGINT AS i, ({column})::BIGINT AS j, ({value})::DOUBLE AS v FROM (SELECT *, {moved} AS m FROM {source}) WHERE {inside}{few}"


def _restriction_sql(d: int, n: int) -> str:
    dims, fine = "xyz"[:d], 2 * n - 1
    row = " + ".join(f"{c} * {n**k}" for k, c in enumerate(dims))
    column = " + ".join(f"(2 * {c} + d{c}) * {fine**k}" for k, c in enumerate(dims))
    moved = " + ".join(f"(d{c} <> 0)::INT" for c in dims)
    source = ", ".join(f"(SELECT range AS {c} FROM range({n})), (SELECT range AS d{c} FROM range(-1, 2))" for c in dims)
    inside = " AND ".join(f"2 * {c} + d{c} BETWEEN 0 AND {fine - 1}" for c in dims)
    return f"SELECT ({row})::BIGINT AS i, ({column})::BIGINT AS j, pow(0.5, {moved} + {d})::DOUBLE AS v FROM {source} WHERE {inside}"


def _prolongation_sql(d: int, n: int) -> str:
    return f"SELECT j AS i, i AS j, v * {2**d} AS v FROM ({_restriction_sql(d, n)})"


for _kind, _n in (("3pt", 50), ("5pt", 12), ("9pt", 12), ("7pt", 6), ("27pt", 6)):
    query(f"stencil_{generators.STENCILS[_kind]}d_{_kind}", _stencil_sql(_kind, _n))(lambda spark, sf, k=_kind, n=_n: generators.stencil(spark, k, *[n] * generators.STENCILS[k]).df)
for _d, _n in ((1, 20), (2, 6), (3, 4)):
    query(f"restrict_{_d}d", _restriction_sql(_d, _n))(lambda spark, sf, d=_d, n=_n: generators.restriction(spark, *[n] * d).df)
    query(f"prolong_{_d}d", _prolongation_sql(_d, _n))(lambda spark, sf, d=_d, n=_n: generators.prolongation(spark, *[n] * d).df)


def _galerkin_sql(d: int, n: int, kind: str) -> str:
    return f"WITH r AS ({_restriction_sql(d, n)}), p AS ({_prolongation_sql(d, n)}), a AS ({_stencil_sql(kind, 2 * n - 1)}), ra AS ({product_sql('r', 'a')}) {product_sql('ra', 'p')}"


def _galerkin(d: int, n: int, kind: str):
    def run(spark, sf):
        sizes, fine = [n] * d, [2 * n - 1] * d
        return multiply.triple_product(generators.restriction(spark, *sizes), generators.stencil(spark, kind, *fine), generators.prolongation(spark, *sizes)).df

    return run


query("galerkin_rap_1d", _galerkin_sql(1, 20, "3pt"))(_galerkin(1, 20, "3pt"))
query("galerkin_rap_2d", _galerkin_sql(2, 6, "5pt"))(_galerkin(2, 6, "5pt"))


@query("restrict_t_times_a", f"WITH r AS ({_restriction_sql(2, 6)}), a AS ({_stencil_sql('5pt', 6)}) {product_sql('r', 'a', 'j, i')}")
def restrict_t_times_a(spark, sf):
    return multiply.spgemm(generators.restriction(spark, 6, 6).T, generators.stencil(spark, "5pt", 6, 6)).df


@query("band_columns", "SELECT y AS i, x AS j, 1.0::DOUBLE AS v FROM (SELECT range AS x FROM range(60)), (SELECT range AS y FROM range(60)) WHERE x % 3 = 2 AND y >= x AND y < x + CASE WHEN x < 30 THEN x + 1 ELSE 60 - x END")
def band_columns(spark, sf):
    return generators.banded(spark, 60, 3, 2, "j").df


# --- clustering -----------------------------------------------------------------------------------


def _mcl_sql(rounds: int, tolerance: float, axis: str = "i", both: bool = False, counts: bool = False) -> str:
    norm = lambda t: f"SELECT i, j, v / sum(v) OVER (PARTITION BY {axis}) AS v FROM {t}"
    parts = [NT, f"l0 AS ({norm('nt')})", f"r0 AS (SELECT * FROM {'l0' if both else 'nt'})"]
    tail = []
    for k in range(rounds):
        parts += [
            f"e{k} AS ({product_sql(f'l{k}', f'r{k}')})",
            f"q{k} AS (SELECT i, j, v * v AS v FROM e{k})",
            f"f{k} AS ({norm(f'q{k}')})",
            f"l{k + 1} AS (SELECT * FROM f{k} WHERE abs(v) > {tolerance})",
            f"r{k + 1} AS (SELECT * FROM l{k + 1})",
        ]
        tail.append(f"SELECT {k}::BIGINT AS iter, (SELECT count(*) FROM f{k}) AS nnz, (SELECT count(*) FROM l{k + 1}) AS nnz_pruned")
    return f"WITH {', '.join(parts)} " + (" UNION ALL ".join(tail) if counts else f"SELECT i, j, round(v, 6) AS v FROM l{rounds}")


def _rounded(m: SparseMatrix) -> DataFrame:
    return m.df.withColumn("v", F.round("v", 6))


@query("mcl_1iter", _mcl_sql(1, 0.01))
def mcl_1iter(spark, sf):
    return _rounded(mcl(nation_trade(spark, sf), 1, 0.01)[0])


@query("mcl_3iter", _mcl_sql(3, 0.002))
def mcl_3iter(spark, sf):
    return _rounded(mcl(nation_trade(spark, sf), 3, 0.002)[0])


@query("mcl_col_variant", _mcl_sql(2, 0.01, "j", True))
def mcl_col_variant(spark, sf):
    return _rounded(mcl(nation_trade(spark, sf), 2, 0.01, axis="j", normalize_right=True)[0])


@query("mcl_nnz_trace", _mcl_sql(3, 0.002, counts=True))
def mcl_nnz_trace(spark, sf):
    a = nation_trade(spark, sf)
    return trace(a, mcl(a, 3, 0.002)[1])


# --- incremental updates --------------------------------------------------------------------------

SPLIT = f"""{G}, z AS (SELECT greatest(1, floor(count(*) * 5 / 100.0 + 0.5))::BIGINT AS size FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY (i * 7919 + j * 104729 + 1) % 1000003, i, j) AS n FROM g),
u AS (SELECT i, j, v, CASE WHEN (n - 1) // size < 4 THEN (n - 1) // size ELSE -1 END AS batch FROM r, z)"""


def percent(m: SparseMatrix, size: str = "5%") -> int:
    return parse_size(size, m.nnz())


@query("inc_split", f"WITH {SPLIT} SELECT i, j, v, batch FROM u")
def inc_split(spark, sf):
    g = square(spark, sf)
    return incremental.disjoint_updates(g, 4, percent(g))


@query("inc_apply", f"WITH {SPLIT} SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM u WHERE batch <= 0 UNION ALL SELECT j AS i, i AS j, v FROM g) GROUP BY 1, 2")
def inc_apply(spark, sf):
    g = square(spark, sf)
    u = incremental.disjoint_updates(g, 4, percent(g))
    base = incremental.apply_update(g.with_df(u.where("batch = -1")), g.with_df(u.where("batch = 0")))
    return incremental.apply_update(base, g.T).df


@query("inc_last_wins", f"""WITH {G}, b AS (SELECT l_partkey AS i, l_orderkey % {N} AS j, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT i, j, sum(v) AS v FROM (SELECT * FROM b UNION ALL SELECT j AS i, i AS j, v FROM g) GROUP BY 1, 2""")
def inc_last_wins(spark, sf):
    """A base of lines with repeated keys, of which the last line's quantity counts, and an update."""
    g = square(spark, sf)
    lines = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), (F.col("l_orderkey") % g.ncols).alias("j"), F.col("l_quantity").alias("v"), "l_orderkey", "l_linenumber")
    return incremental.apply_update(g.with_df(incremental.last_wins(lines, ["l_orderkey", "l_linenumber", "v"])), g.T).df


BATCHES = f"""WITH {SPLIT}, b AS (SELECT range AS k FROM range(4)), m AS (SELECT k, i, j, v FROM u, b WHERE batch <= k),
c AS (SELECT DISTINCT x.k, x.i, y.j FROM m x JOIN m y ON x.k = y.k AND x.j = y.i)
SELECT k AS batch_idx, (SELECT count(*) FROM m WHERE m.k = b.k) AS nnz_a, (SELECT count(*) FROM c WHERE c.k = b.k) AS nnz_c FROM b"""
RECORD = "batch_idx long, is_warmup int, update_size long, nnz_a_global long, nnz_b_global long, nnz_c_global long, spgemm_ms double, csum_a_global string, csum_b_global string"


def batch_records(spark, sf) -> DataFrame:
    g = square(spark, sf)
    g = g.with_df(write_table(g.df, "operand"))  # counted, ranked and dealt
    return spark.createDataFrame(list(incremental.run_batches(g, g, 4, percent(g), warmup=1)), RECORD)  # a row for each batch


@query("inc_batches_nnz", BATCHES)
def inc_batches_nnz(spark, sf):
    return batch_records(spark, sf).select("batch_idx", F.col("nnz_a_global").alias("nnz_a"), F.col("nnz_c_global").alias("nnz_c"))


@query("inc_batches_csv", f"SELECT batch_idx, (batch_idx < 1)::INT AS is_warmup, nnz_a, nnz_c, true AS timed FROM ({BATCHES})")
def inc_batches_csv(spark, sf):
    """The record of each batch, written as CSV and read again."""
    path = temporary_path(spark, "batches")
    write_benchmark_csv(batch_records(spark, sf), path)
    return read_benchmark_csv(spark, path, RECORD).select("batch_idx", "is_warmup", F.col("nnz_a_global").alias("nnz_a"), F.col("nnz_c_global").alias("nnz_c"), (F.col("spgemm_ms") > 0).alias("timed"))


@query("inc_delta_equals_full", by_row_sql(G, product_sql("g", "g")))
def inc_delta_equals_full(spark, sf):
    """G G from the product of a part of G and the rest of it as an update."""
    g = square(spark, sf)
    g = g.with_df(write_table(g.df, "operand"))  # counted and ranked
    u = write_table(incremental.disjoint_updates(g, 1, percent(g)), "updates")
    a, d = g.with_df(u.where("batch = -1")), g.with_df(u.where("batch = 0"))
    product = maintained.maintained(a, a)
    product.update(d, d)
    return product.digests()


@query("hamilton_alloc", f"""WITH {S}, n AS (SELECT i AS rank, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT rank, n, 1000 * n // sum(n) OVER () AS q, (1000 * n) % (sum(n) OVER ()) AS rem FROM n),
w AS (SELECT rank, n, q + (row_number() OVER (ORDER BY rem DESC, rank) <= 1000 - sum(q) OVER ())::INT AS want, n // 10 AS cap FROM q),
c AS (SELECT rank, n, least(want, cap) AS got, cap - least(want, cap) AS room, sum(want - least(want, cap)) OVER () AS over FROM w)
SELECT rank, n, (got + greatest(0, least(room, over - coalesce(sum(room) OVER (ORDER BY room DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS alloc FROM c""")
def hamilton_alloc(spark, sf):
    sizes = supplier_part(spark, sf).df.groupBy(F.col("i").alias("rank")).agg(F.count("*").alias("n"))
    return incremental.apportion(sizes, 1000, 10)


# --- benchmark times, from events -----------------------------------------------------------------

METRICS = """m AS (SELECT event_id, user_id % 8 AS rank, event_id % 6 AS round, event_type AS phase, value AS ms,
  CASE user_id % 4 WHEN 0 THEN 'archaea' WHEN 1 THEN 'eukarya' WHEN 2 THEN 'mouse_gene' ELSE 'ldoor' END AS matrix,
  CASE event_id % 3 WHEN 0 THEN 'async' WHEN 1 THEN 'summa' ELSE 'workstealing' END AS impl,
  CASE event_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 64 ELSE 256 END AS ngpus,
  CASE event_id % 5 WHEN 0 THEN '2x2' WHEN 1 THEN '4x4' ELSE '8x8' END AS grid
  FROM events WHERE value > 0)"""


def metrics(spark, sf) -> DataFrame:
    """Rows shaped like benchmark times, derived from ``events``."""
    pick = lambda key, first, second, other, third=None: F.when(key == 0, first).when(key == 1, second).otherwise(other) if third is None else F.when(key == 0, first).when(key == 1, second).when(key == 2, other).otherwise(third)
    e, u = F.col("event_id"), F.col("user_id")
    return load(spark, sf, "events").where("value > 0").select(
        "event_id", (u % 8).alias("rank"), (e % 6).alias("round"), F.col("event_type").alias("phase"), F.col("value").alias("ms"),
        pick(u % 4, "archaea", "eukarya", "mouse_gene", "ldoor").alias("matrix"),
        pick(e % 3, "async", "summa", "workstealing").alias("impl"),
        pick(e % 4, 16, 64, 256).alias("ngpus"),
        pick(e % 5, "2x2", "4x4", "8x8").alias("grid"),
    )


@query("log_mean_runtime", f"WITH {METRICS} SELECT ngpus, impl, round(avg(ms), 6) AS avg_ms FROM m WHERE phase = 'click' AND round <> 0 GROUP BY 1, 2")
def log_mean_runtime(spark, sf):
    return loganalytics.mean_runtime(metrics(spark, sf), "click", ["ngpus", "impl"]).withColumn("avg_ms", F.round("avg_ms", 6))


@query("log_runtime_pivot", f"""WITH {METRICS} SELECT matrix, ngpus, round(coalesce(avg(ms) FILTER (WHERE impl = 'async'), 0), 6) AS async,
round(coalesce(avg(ms) FILTER (WHERE impl = 'summa'), 0), 6) AS summa, round(coalesce(avg(ms) FILTER (WHERE impl = 'workstealing'), 0), 6) AS workstealing FROM m GROUP BY 1, 2""")
def log_runtime_pivot(spark, sf):
    names = ["async", "summa", "workstealing"]
    out = loganalytics.pivoted(metrics(spark, sf), ["matrix", "ngpus"], "impl", "ms", names, 0.0)
    return out.select("matrix", "ngpus", *[F.round(n, 6).alias(n) for n in names])


@query("log_phase_breakdown", f"WITH {METRICS}, a AS (SELECT impl, phase, rank, avg(ms) AS ms FROM m GROUP BY ALL) SELECT impl, phase, round(avg(ms), 6) AS avg_ms FROM a GROUP BY ALL")
def log_phase_breakdown(spark, sf):
    return loganalytics.phase_breakdown(metrics(spark, sf), ["impl"]).withColumn("avg_ms", F.round("avg_ms", 6))


@query("log_rank_breakdown", f"WITH {METRICS} SELECT impl, phase, rank, round(avg(ms), 6) AS avg_ms FROM m GROUP BY ALL")
def log_rank_breakdown(spark, sf):
    return loganalytics.rank_breakdown(metrics(spark, sf), ["impl"]).withColumn("avg_ms", F.round("avg_ms", 6))


@query("log_comm_time", f"""WITH {METRICS}, a AS (SELECT impl, rank, phase, avg(ms) AS ms FROM m WHERE phase IN ('click', 'view') GROUP BY ALL), b AS (SELECT impl, rank, sum(ms) AS ms FROM a GROUP BY ALL)
SELECT impl, round(max(ms), 6) AS comm_ms FROM b GROUP BY ALL""")
def log_comm_time(spark, sf):
    return loganalytics.comm_time(metrics(spark, sf), ["impl"], ["click", "view"]).withColumn("comm_ms", F.round("comm_ms", 6))


@query("log_strong_scaling", f"WITH {METRICS}, a AS (SELECT ngpus, impl, phase, avg(ms) AS ms FROM m GROUP BY ALL) SELECT ngpus, impl, round(sum(ms), 6) AS total_ms FROM a GROUP BY ALL")
def log_strong_scaling(spark, sf):
    return loganalytics.strong_scaling(metrics(spark, sf), ["ngpus", "impl"]).withColumn("total_ms", F.round("total_ms", 6))


@query("log_geomean_speedup", f"""WITH {METRICS}, a AS (SELECT impl, matrix, avg(ms) AS ms FROM m WHERE ngpus = 256 AND matrix IN ('archaea', 'eukarya', 'isolates_subgraph4', 'mouse_gene') GROUP BY ALL)
SELECT a.impl, round(exp(avg(ln(a.ms / o.ms))), 6) AS speedup, count(*) AS n_matrices FROM a JOIN a o ON o.matrix = a.matrix AND o.impl = 'async' WHERE a.impl <> 'async' GROUP BY 1""")
def log_geomean_speedup(spark, sf):
    out = loganalytics.geomean_speedup(metrics(spark, sf), "async", 256, ["archaea", "eukarya", "isolates_subgraph4", "mouse_gene"])
    return out.withColumn("speedup", F.round("speedup", 6))


@query("log_comm_volume", f"""WITH {METRICS}, a AS (SELECT ngpus, matrix, grid, rank, sum(floor(ms))::BIGINT AS bytes FROM m GROUP BY ALL), g AS (SELECT ngpus, matrix, grid, avg(bytes) AS bytes FROM a GROUP BY ALL)
SELECT ngpus, matrix, round(arg_min(bytes, grid), 6) AS small_grid_bytes, round(arg_max(bytes, grid), 6) AS large_grid_bytes, count(*) AS n_grids FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def log_comm_volume(spark, sf):
    volume = metrics(spark, sf).groupBy("ngpus", "matrix", "grid", "rank").agg(F.sum(F.floor("ms")).alias("bytes"))
    out = loganalytics.grid_extremes(volume)
    return out.withColumns({c: F.round(c, 6) for c in ("small_grid_bytes", "large_grid_bytes")})


@query("log_mcl_totals", f"WITH {METRICS}, a AS (SELECT matrix, impl, round, max(ms) AS ms FROM m GROUP BY ALL) SELECT matrix, impl, round(sum(ms), 6) AS total_ms FROM a GROUP BY ALL")
def log_mcl_totals(spark, sf):
    return loganalytics.clustering_totals(metrics(spark, sf), ["matrix", "impl"]).withColumn("total_ms", F.round("total_ms", 6))


@query("log_mcl_series", f"WITH {METRICS}, a AS (SELECT matrix, impl, round, max(ms) AS ms FROM m GROUP BY ALL) SELECT matrix, impl, (row_number() OVER (PARTITION BY matrix, impl ORDER BY round) - 1)::INT AS pos, ms FROM a")
def log_mcl_series(spark, sf):
    return loganalytics.clustering_series(metrics(spark, sf), ["matrix", "impl"]).select("matrix", "impl", F.posexplode("series").alias("pos", "ms"))


@query("log_describe", f"""WITH {METRICS} SELECT ngpus, impl, count(ms) AS count, round(avg(ms), 6) AS mean, round(stddev_samp(ms), 6) AS std, min(ms) AS min,
round(quantile_cont(ms, 0.25), 6) AS q25, round(quantile_cont(ms, 0.5), 6) AS q50, round(quantile_cont(ms, 0.75), 6) AS q75, max(ms) AS max FROM m GROUP BY 1, 2""")
def log_describe(spark, sf):
    out = loganalytics.describe(metrics(spark, sf), ["ngpus", "impl"], "ms")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query("batch_stats", f"""WITH {METRICS} SELECT impl, count(*) AS n, round(sum(ms), 6) AS total_ms, round(avg(ms), 6) AS avg_ms, round(coalesce(stddev_samp(ms), 0), 6) AS std_ms, min(ms) AS min_ms, max(ms) AS max_ms
FROM m WHERE round >= 3 GROUP BY 1""")
def batch_stats(spark, sf):
    records = metrics(spark, sf).select("impl", F.col("round").alias("batch_idx"), F.col("ms").alias("spgemm_ms"))
    return incremental.batch_stats(records, 3, ["impl"]).withColumns({c: F.round(c, 6) for c in ("total_ms", "avg_ms", "std_ms")})


@query("mtx_roundtrip", f"WITH {G} SELECT i, j, v FROM g")
def mtx_roundtrip(spark, sf):
    """G written as Matrix Market text and read again."""
    path = temporary_path(spark, "mtx")
    write_mtx(square(spark, sf), path)
    return read_mtx(spark, path).df


# --- pointers, places, chunks ----------------------------------------------------------------------


@query("ptr_after_filter", f"WITH {S}, k AS (SELECT * FROM s WHERE abs(v) > 30), n AS (SELECT s_suppkey AS i, count(k.i) AS n FROM supplier LEFT JOIN k ON k.i = s_suppkey GROUP BY 1) SELECT i, (sum(n) OVER (ORDER BY i))::BIGINT AS ptr FROM n")
def ptr_after_filter(spark, sf):
    """The pointers of what a filter leaves."""
    return layout.pointers(algebra.prune(supplier_part(spark, sf), 30.0), "i")


@query("ptr_check", f"""WITH {S}, n AS (SELECT s_suppkey AS i, count(s.i) AS n FROM supplier LEFT JOIN s ON s.i = s_suppkey GROUP BY 1),
p AS (SELECT (i * 7 + 3) % (SELECT count(*) FROM supplier) AS i, (sum(n) OVER (ORDER BY i))::BIGINT AS ptr FROM n), q AS (SELECT i, ptr, ptr - coalesce(lag(ptr) OVER (ORDER BY i), 0) AS d FROM p)
SELECT 'right' AS kind, count(*) AS n_ptr, 0::BIGINT AS n_decreasing, true AS ends_at_nnz FROM n
UNION ALL SELECT 'disordered', count(*), count(*) FILTER (WHERE d < 0), arg_max(ptr, i) = (SELECT count(*) FROM s) FROM q""")
def ptr_check(spark, sf):
    """Pointers as they should be, and in disorder."""
    s = supplier_part(spark, sf)
    ptr, nnz = layout.pointers(s, "i"), s.nnz()
    moved = ptr.select(((F.col("i") * 7 + 3) % s.nrows).alias("i"), "ptr")
    return layout.check_pointers(ptr, nnz).withColumn("kind", F.lit("right")).unionByName(layout.check_pointers(moved, nnz).withColumn("kind", F.lit("disordered")))


@query("position_owners", f"WITH {S}, r AS (SELECT i, row_number() OVER (ORDER BY i, j) - 1 AS pos FROM s) SELECT pos, i FROM r WHERE pos % 100 = 0")
def position_owners(spark, sf):
    """The row of every hundredth entry, by its place."""
    s = supplier_part(spark, sf)
    return layout.owners(layout.pointers(s, "i"), spark.range(0, s.nnz(), 100).withColumnRenamed("id", "pos"))


@query("element_range", f"WITH {S}, r AS (SELECT *, row_number() OVER (ORDER BY i, j) - 1 AS pos FROM s) SELECT i, j, v FROM r WHERE pos >= 1000 AND pos < 3000")
def element_range(spark, sf):
    return layout.element_range(supplier_part(spark, sf), 1000, 3000).df


@query("row_blocks", f"WITH {S} SELECT i % 8 AS block, count(DISTINCT i) AS n_rows, count(*) AS nnz FROM s GROUP BY 1")
def row_blocks(spark, sf):
    return layout.row_blocks(supplier_part(spark, sf), 8)


@query("spgemm_chunked", COSUPPLY)
def spgemm_chunked(spark, sf):
    s = supplier_part(spark, sf)
    return multiply.spgemm_chunked(s, s.T, 4).df


@query("matrix_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MATRICES) + ") AS t(set, matrix)")
def matrix_catalog(spark, sf):
    return matrices(spark)


# --- logs: events written as benchmark logs and parsed again ---------------------------------------

FILE_NAME = "concat('hns_strong_', ngpus, '_', grid, '_', matrix, '_kokkos_nospcomm_', impl, '_nopermute.out')"
#: Every seventh event is a summary line.
SUMMARY = "event_id % 7 = 0"


def spgemm_logs(spark, sf) -> str:
    """A folder of logs: in each file rounds in order, and in a round a line for each event."""
    path = temporary_path(spark, "logs")
    m = metrics(spark, sf).withColumn("file", F.expr(FILE_NAME))
    line = f"concat('<[process ', rank, ']>[', phase, '] ', IF({SUMMARY}, concat('n=2,avg=', ms / 2, ',sum=', ms), concat(ms, ' ms')))"
    timed = m.select("file", "round", F.col("event_id").alias("at"), F.expr(line).alias("line"))
    marks = m.select("file", "round").distinct().select("file", "round", F.lit(-1).cast("long").alias("at"), F.expr("concat('STARTING spgemm round: ', round)").alias("line"))
    logs.write_lines(timed.unionByName(marks), path, ["round", "at"])
    return path


FILES = f"f AS (SELECT *, {FILE_NAME} AS file FROM m)"


@query("log_parse_times", f"""WITH {METRICS}, {FILES}, t AS (SELECT file, phase, rank, round, sum(ms) AS ms FROM f WHERE round <> 0 AND NOT ({SUMMARY}) GROUP BY ALL
UNION ALL SELECT file, phase, rank, round, arg_max(ms, event_id) AS ms FROM f WHERE round <> 0 AND {SUMMARY} GROUP BY ALL)
SELECT d.matrix, d.ngpus, d.impl, d.grid, phase, rank::INT AS rank, round::INT AS round, round(ms, 6) AS ms FROM t JOIN (SELECT DISTINCT file, matrix, ngpus, impl, grid FROM f) d ON d.file = t.file""")
def log_parse_times(spark, sf):
    """Times by phase, process and round: the round is the last marker above the line, single values are summed, of summaries the last counts."""
    lines = logs.read_lines(spark, spgemm_logs(spark, sf))
    times = logs.phase_times(logs.spgemm_metrics(lines)).join(logs.file_facts(lines), "file")
    return times.select("matrix", "ngpus", "impl", "grid", "phase", "rank", "round", F.round("ms", 6).alias("ms"))


@query("log_parse_flat", f"""WITH {METRICS}, {FILES}, x AS (SELECT *, ({SUMMARY}) AS summary FROM f)
SELECT file, phase, rank::INT AS rank, stat, count(*) AS n_lines, round(sum(CASE stat WHEN 'n' THEN CASE WHEN summary THEN 2 ELSE 1 END WHEN 'avg' THEN CASE WHEN summary THEN ms / 2 ELSE ms END ELSE ms END), 6) AS total
FROM x, (VALUES ('n'), ('avg'), ('sum')) AS s(stat) WHERE stat <> 'sum' OR summary GROUP BY ALL""")
def log_parse_flat(spark, sf):
    """Timer strings as a row for each statistic."""
    flat = logs.spgemm_metrics(logs.read_lines(spark, spgemm_logs(spark, sf)))
    return flat.groupBy("file", "phase", "rank", "stat").agg(F.count("*").alias("n_lines"), F.round(F.sum("ms"), 6).alias("total"))


@query("log_completeness", f"WITH {METRICS}, {FILES} SELECT file, count(DISTINCT round) AS n_start, count(*) FILTER (WHERE phase = 'click') AS n_end, n_start = n_end AS complete FROM f GROUP BY file")
def log_completeness(spark, sf):
    return logs.completeness(logs.read_lines(spark, spgemm_logs(spark, sf)), "STARTING spgemm round", r"\[click\]")


@query("log_parse_iterations", f"WITH {METRICS} SELECT concat('hns_mcl_', ngpus, '_', matrix, '_', impl, '_0.002.out') AS file, round::INT AS iter, max(ms) AS ms FROM m GROUP BY 1, 2")
def log_parse_iterations(spark, sf):
    """Clustering logs: the slowest process of each iteration."""
    path = temporary_path(spark, "logs")
    m = metrics(spark, sf).withColumn("file", F.expr("concat('hns_mcl_', ngpus, '_', matrix, '_', impl, '_0.002.out')"))
    timed = m.select("file", "round", F.col("event_id").alias("at"), F.expr("concat('<Timer rank ', rank, '>[mcl_spgemm] ', ms, ' ms')").alias("line"))
    marks = m.select("file", "round").distinct().select("file", "round", F.lit(-1).cast("long").alias("at"), F.expr("concat('===== ITERATION ', round, ' =====')").alias("line"))
    logs.write_lines(timed.unionByName(marks), path, ["round", "at"])
    return logs.iteration_times(logs.read_lines(spark, path))


@query("log_parse_volume", f"WITH {METRICS} SELECT ngpus, matrix, grid, rank::INT AS rank, sum(floor(ms))::BIGINT AS bytes FROM m WHERE event_id % 2 = 0 GROUP BY ALL")
def log_parse_volume(spark, sf):
    """Volume logs: bytes of each process on the lines of level 0; odd events are of level 1."""
    path = temporary_path(spark, "logs")
    line = "concat('<[p ', rank, ', t 0, m A, r 0, hier ', event_id % 2, ']>[send] ', CAST(floor(ms) AS bigint), ' B')"
    rows = metrics(spark, sf).select(F.expr("concat('comm_vol_', ngpus, '_', grid, '_', matrix, '.out')").alias("file"), F.expr(line).alias("line"), "event_id")
    logs.write_lines(rows, path, ["event_id"])
    lines = logs.read_lines(spark, path)
    return logs.communication_volume(lines).join(logs.file_facts(lines), "file").select("ngpus", "matrix", "grid", "rank", "bytes")


@query("p2p_describe", "SELECT user_id % 7 AS threads, count(*) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events WHERE value > 0 GROUP BY 1")
def p2p_describe(spark, sf):
    """A table of message times, written as CSV with a header, read by a given schema, and described."""
    path = temporary_path(spark, "p2p")
    write_benchmark_csv(load(spark, sf, "events").where("value > 0").select((F.col("user_id") % 7).alias("threads"), F.col("value").alias("us")), path)
    out = loganalytics.describe(read_benchmark_csv(spark, path, "threads long, us double"), ["threads"], "us")
    return out.select("threads", "count", F.round("mean", 6).alias("mean"), "min", "max")


# --- logs of every kind of program ------------------------------------------------------------------


def write_logs(spark, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (file, line, ..) as log files, read again."""
    path = temporary_path(spark, "logs")
    logs.write_lines(rows, path, order)
    return logs.read_lines(spark, path)


@query("log_parse_trilinos", f"WITH {METRICS} SELECT matrix, ngpus::INT AS ngpus, 1::BIGINT AS n, round(arg_min(ms, event_id), 6) AS ms FROM m GROUP BY 1, 2")
def log_parse_trilinos(spark, sf):
    """Trilinos logs: single times that don't count, then summaries, of which the first one's mean does."""
    m = metrics(spark, sf).withColumn("file", F.expr("concat('trilinos_strong_', matrix, '_', ngpus, '.out')"))
    line = "stack(2, 0, '<Timer>[spgemm] 12345.0 ms', 1, concat('<Timer>[spgemm] n=10,avg=', ms, ',min=0.5,max=99999.0')) AS (part, line)"
    lines = write_logs(spark, m.select("file", "event_id", F.expr(line)), ["event_id", "part"])
    return logs.runtimes(lines).join(logs.file_facts(lines), ["file", "kind"]).select("matrix", "ngpus", "n", F.round("ms", 6).alias("ms"))


@query("log_parse_combblas", f"""WITH {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY matrix, ngpus ORDER BY event_id) AS place, count(*) OVER (PARTITION BY matrix, ngpus) AS c FROM m)
SELECT matrix, ngpus::INT AS ngpus, count(*) AS n, round(avg(ms), 6) AS ms FROM r WHERE place > 1 OR c = 1 GROUP BY 1, 2""")
def log_parse_combblas(spark, sf):
    """CombBLAS logs, in colours: the first time of a file is its warm-up."""
    m = metrics(spark, sf).withColumn("file", F.expr("concat('combblas_strong_', matrix, '_', ngpus, '.out')"))
    line = F.concat(F.lit("\x1b[96m<Timer>[spgemm] "), F.col("ms").cast("string"), F.lit(" ms\x1b[0m"))
    lines = write_logs(spark, m.select("file", "event_id", line.alias("line")), ["event_id"])
    return logs.runtimes(lines).join(logs.file_facts(lines), ["file", "kind"]).select("matrix", "ngpus", "n", F.round("ms", 6).alias("ms"))


@query("log_parse_rounds", f"WITH {METRICS} SELECT matrix, ngpus::INT AS ngpus, impl, grid, count(*) AS n, round(avg(ms), 6) AS ms FROM m WHERE round > 0 GROUP BY ALL")
def log_parse_rounds(spark, sf):
    """Our own logs: times of the whole product, without those of round 0; summaries beside them don't count."""
    m = metrics(spark, sf).withColumn("file", F.expr(FILE_NAME))
    line = "stack(2, 0, concat('<Timer>[spgemm] ', ms, ' ms'), 1, '<Timer>[spgemm] n=3,avg=1.0') AS (part, line)"
    marks = m.select("file", "round").distinct().select("file", "round", F.lit(-1).cast("long").alias("event_id"), F.lit(0).alias("part"), F.expr("concat('STARTING spgemm round: ', round)").alias("line"))
    lines = write_logs(spark, m.select("file", "round", "event_id", F.expr(line)).unionByName(marks), ["round", "event_id", "part"])
    return logs.runtimes(lines).join(logs.file_facts(lines), ["file", "kind"]).select("matrix", "ngpus", "impl", "grid", "n", F.round("ms", 6).alias("ms"))


@query("log_diagnosis", f"""WITH {METRICS}, t AS (
  SELECT 'hns' AS program, {FILE_NAME} AS file, round = 3 AS a, phase = 'click' AND user_id % 50 = 0 AS b, true AS two FROM (SELECT m.*, user_id FROM m JOIN events USING (event_id))
  UNION ALL SELECT 'trilinos', concat('trilinos_strong_', matrix, '_', ngpus, '.out'), event_id % 500 = 0, false, false FROM m
  UNION ALL SELECT 'combblas', concat('combblas_strong_', matrix, '_', ngpus, '.out'), event_id % 700 = 0, false, false FROM m
  UNION ALL SELECT 'mcl', concat('hns_mcl_', ngpus, '_', matrix, '_', impl, '_0.002.out'), event_id % 900 = 0, false, false FROM m)
SELECT program, file, CASE WHEN bool_or(two) THEN count(*) FILTER (WHERE a) = 1 AND count(*) FILTER (WHERE b) = 1 ELSE count(*) FILTER (WHERE a) = 1 END AS complete FROM t GROUP BY 1, 2""")
def log_diagnosis(spark, sf):
    """Which runs have printed what a finished run of their program prints once."""
    m = metrics(spark, sf).join(load(spark, sf, "events").select("event_id", "user_id"), "event_id")
    said = lambda test, text: F.expr(f"IF({test}, '{text}', '-')")
    printed = lambda name, line: F.struct(F.expr(name).alias("file"), line.alias("line"))
    rows = m.select("event_id", F.explode(F.array(
        printed(FILE_NAME, F.concat_ws("; ", said("round = 3", "STARTING spgemm round: 3"), said("phase = 'click' AND user_id % 50 = 0", "A stored in CSC"))),
        printed("concat('trilinos_strong_', matrix, '_', ngpus, '.out')", said("event_id % 500 = 0", "Done spgemm")),
        printed("concat('combblas_strong_', matrix, '_', ngpus, '.out')", said("event_id % 700 = 0", "2D Multiplication done")),
        printed("concat('hns_mcl_', ngpus, '_', matrix, '_', impl, '_0.002.out')", said("event_id % 900 = 0", "Done MCL")),
    )).alias("l")).select("event_id", "l.file", "l.line")
    return logs.diagnosis(write_logs(spark, rows, ["event_id"]))


@query("p2p_describe_by_buffer", """SELECT user_id % 7 AS threads, event_type AS buffer_label, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events WHERE value > 0 GROUP BY 1, 2""")
def p2p_describe_by_buffer(spark, sf):
    """Message times described by threads and buffer, with deviation and quartiles."""
    path = temporary_path(spark, "p2p")
    write_benchmark_csv(load(spark, sf, "events").where("value > 0").select((F.col("user_id") % 7).alias("threads"), F.col("event_type").alias("buffer_label"), F.col("value").alias("us")), path)
    out = loganalytics.describe(read_benchmark_csv(spark, path, "threads long, buffer_label string, us double"), ["threads", "buffer_label"], "us")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


# --- products by their structure --------------------------------------------------------------------

SKEWED = f"w AS (SELECT l_suppkey AS i, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE l_partkey END AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def skewed_supplier_part(spark, sf):
    """Supplier x part, but a tenth of all orders is for part 0."""
    lines = load(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_orderkey") % 10 == 0, 0).otherwise(F.col("l_partkey")).alias("j"), "l_quantity")
    df = lines.groupBy("l_suppkey", "j").agg(F.sum("l_quantity").alias("v"))
    return SparseMatrix.of(df, load(spark, sf, "supplier").count(), load(spark, sf, "part").count(), "l_suppkey", "j")


@query("spgemm_heavy", f"WITH {SKEWED} {product_sql('w', 'w', 'i, j', 'j, i')}")
def spgemm_heavy(spark, sf):
    """One contraction index of very many products is split, the others meet once."""
    w = skewed_supplier_part(spark, sf)
    return multiply.spgemm(w, w.T, "heavy").df


@query("heavy_indices", f"WITH {SKEWED}, d AS (SELECT j AS k, count(*) AS na FROM w GROUP BY 1) SELECT k, na, na AS nb, ceil(na / sqrt(5000.0::DOUBLE))::BIGINT AS parts FROM d WHERE na * na > 5000")
def heavy_indices(spark, sf):
    """The contraction indices of more than 5,000 products, and in how many parts each side is cut."""
    w = skewed_supplier_part(spark, sf)
    left, right = w.df.select("i", F.col("j").alias("k")), w.df.select(F.col("j").alias("k"), F.col("i").alias("j"))
    return multiply.heavy_indices(left, right, 5_000).where("pa = pb").select("k", "na", "nb", F.col("pa").alias("parts"))


WORK = f"{S}, n AS (SELECT j, count(*) AS n FROM s GROUP BY 1), t AS (SELECT s.i, sum(n.n)::BIGINT AS work FROM s JOIN n ON n.j = s.j GROUP BY 1)"


@query("row_work", f"WITH {WORK} SELECT i, work FROM t")
def row_work(spark, sf):
    """Multiplications that each row of S S' takes."""
    s = supplier_part(spark, sf)
    return multiply.row_work(s, s.T)


@query("chunks_by_work", f"""WITH {WORK}, h AS (SELECT 50000 AS half), p AS (SELECT i, work, half, sum(CASE WHEN work <= half THEN work ELSE 0 END) OVER (ORDER BY i) AS e FROM t, h)
SELECT i, work, (CASE WHEN work <= half THEN (e - work) // half ELSE -1 - i END)::BIGINT AS chunk FROM p""")
def chunks_by_work(spark, sf):
    """Rows of S S' in chunks of at most 100,000 multiplications."""
    s = supplier_part(spark, sf)
    return multiply.chunks_by_work(multiply.row_work(s, s.T), 100_000)


@query("spgemm_planned", COSUPPLY)
def spgemm_planned(spark, sf):
    """The strategy is chosen from the sizes of the operands, the multiplications and an estimate of the result's entries."""
    s = supplier_part(spark, sf)
    return structure.planned_product(s, s.T).df


@query("nnz_estimate", f"""WITH {S}, {O}, {G}, a AS (SELECT 'S' AS matrix, count(*) AS nnz FROM ({product_sql('s', 's', 'i, j', 'j, i')}) UNION ALL SELECT 'O', count(*) FROM ({product_sql('o', 'o', 'i, j', 'j, i')})
UNION ALL SELECT 'G', count(*) FROM ({product_sql('g', 'g')})) SELECT matrix, nnz, true AS within_10_percent FROM a""")
def nnz_estimate(spark, sf):
    """The entries of S S', O O' and G G, and whether the estimate from sketches comes within ten percent."""
    s, o, g = (m.with_df(write_table(m.df, "operand")) for m in (supplier_part(spark, sf), part_order(spark, sf), square(spark, sf)))
    rows = []
    for name, a, b in (("S", s, s.T), ("O", o, o.T), ("G", g, g)):
        nnz = multiply.product_nnz(a, b)
        rows.append((name, nnz, abs(structure.estimate_nnz(a, b) - nnz) <= 0.1 * nnz))
    return spark.createDataFrame(rows, "matrix string, nnz long, within_10_percent boolean")  # three rows


@query("spgemm_numeric", f"WITH {S}, s2 AS (SELECT i, j, v * v + 1 AS v FROM s) {product_sql('s2', 's2', 'i, j', 'j, i')}")
def spgemm_numeric(spark, sf):
    """New values on the pattern of S S', whose structure is stored."""
    s = supplier_part(spark, sf)
    s = s.with_df(write_table(s.df, "operand"))  # its pattern and its values
    stored = structure.symbolic(s, s.T)
    new = s.with_df(s.df.withColumn("v", F.col("v") * F.col("v") + 1))
    return structure.numeric(stored, new, new.T).df


# --- paths ------------------------------------------------------------------------------------------

#: Orders of part i that hold no less than 50 of it lead to the part of the order's number: about 0.6 ways out of a part.
ROADS = f"r AS (SELECT l_partkey AS i, l_orderkey % {N} AS j, min(l_linenumber)::DOUBLE AS v FROM lineitem WHERE l_quantity >= 50 GROUP BY 1, 2)"


def roads(spark, sf):
    n = load(spark, sf, "part").count()
    df = load(spark, sf, "lineitem").where("l_quantity >= 50").groupBy("l_partkey", (F.col("l_orderkey") % n).alias("j")).agg(F.min("l_linenumber").alias("v"))
    return SparseMatrix.of(df, n, n, "l_partkey", "j")


def _paths_sql(best: str, step: str, start: str) -> str:
    """All paths without a repeated place; in this graph they are few."""
    return f"""WITH RECURSIVE {ROADS}, p AS (SELECT i, j, v, [i, j] AS seen FROM r WHERE i <> j UNION ALL SELECT p.i, r.j, {step}, list_append(p.seen, r.j) FROM p JOIN r ON r.i = p.j WHERE NOT list_contains(p.seen, r.j))
SELECT i, j, {best} AS v FROM (SELECT i, j, v FROM p UNION ALL SELECT k, k, {start} FROM (SELECT unnest(range({N})) AS k)) GROUP BY 1, 2"""


@query("closure_shortest", _paths_sql("min(v)", "p.v + r.v", "0.0::DOUBLE"))
def closure_shortest(spark, sf):
    return semiring.closure(roads(spark, sf), "min_plus").df


@query("closure_widest", _paths_sql("max(v)", "least(p.v, r.v)", "'Infinity'::DOUBLE"))
def closure_widest(spark, sf):
    return semiring.closure(roads(spark, sf), "max_min").df


@query("closure_reachable", _paths_sql("max(v)", "1.0::DOUBLE", "1.0::DOUBLE").replace("SELECT i, j, v, [i, j]", "SELECT i, j, 1.0::DOUBLE AS v, [i, j]"))
def closure_reachable(spark, sf):
    return semiring.closure(roads(spark, sf), "or_and").df


# --- products kept up to date, sums kept by a stream ---------------------------------------------------


def _maintained(spark, sf, static: bool) -> DataFrame:
    g = square(spark, sf)
    g = g.with_df(write_table(g.df, "operand"))  # counted, ranked and multiplied
    rows = [(r["batch_idx"], r["nnz_a"], r["nnz_c"]) for r, _ in maintained.maintained_batches(g, g, 4, percent(g), static_b=static)]
    return spark.createDataFrame(rows, "batch_idx long, nnz_a long, nnz_c long")  # a row for each batch


@query("inc_batches_maintained", BATCHES)
def inc_batches_maintained(spark, sf):
    """The entries of A and of A A after each batch, from a product of which only touched blocks are written anew."""
    return _maintained(spark, sf, False)


@query("inc_batches_static", BATCHES.replace("JOIN m y ON x.k = y.k AND x.j = y.i", "JOIN g y ON x.j = y.i"))
def inc_batches_static(spark, sf):
    """The same with a B that stays, written once in buckets of its contraction index."""
    return _maintained(spark, sf, True)


@query("inc_maintained_equals_full", by_row_sql(G, product_sql("g", "g")))
def inc_maintained_equals_full(spark, sf):
    """After all batches the product is that of the whole operands."""
    g = square(spark, sf)
    g = g.with_df(write_table(g.df, "operand"))  # counted, ranked and multiplied
    for _, product in maintained.maintained_batches(g, g, 1, percent(g), static_b=True):
        pass
    return product.digests()


@query("stream_sum", "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def stream_sum(spark, sf):
    """Lines as a stream of inserts, in three batches of eight files, summed by part and supplier in the state store."""
    source, changes, checkpoint = (temporary_path(spark, name) for name in ("inserts", "changes", "checkpoint"))
    lines = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    lines.repartition(3 * 8).write.parquet(source)
    summed_stream(updates_stream(spark, source, 8), changes, checkpoint).awaitTermination()
    return current(spark, changes, 0, 0).df


# --- bitmaps, segments, array files -------------------------------------------------------------------


@query("bitmap_buckets", f"WITH {U} SELECT CASE WHEN k > 0 THEN 1 + (k - 1) // 32768 ELSE k // 32768 END AS bucket, count(*) AS n FROM (SELECT DISTINCT j AS k FROM u) GROUP BY 1")
def bitmap_buckets(spark, sf):
    """How many users have events, from bitmaps merged over both halves of the day."""
    u = hour_user(spark, sf).df
    return bitmaps.sizes(bitmaps.union(bitmaps.bitmaps(u.where("i < 12"), "j"), bitmaps.bitmaps(u.where("i >= 12"), "j")))


@query("bitmap_semijoin", f"WITH {U}, {CS} SELECT i, j, v FROM cs WHERE i IN (SELECT j FROM u)")
def bitmap_semijoin(spark, sf):
    """Customers that are users, found by exchanged bitmaps."""
    return bitmaps.reduced_operands(hour_user(spark, sf), customer_nation(spark, sf))[1].df


@query("spgemm_bitmap", f"WITH {U}, {CS} {product_sql('u', 'cs')}")
def spgemm_bitmap(spark, sf):
    """Hours x nations from operands that bitmaps have reduced."""
    a, b = bitmaps.reduced_operands(hour_user(spark, sf), customer_nation(spark, sf))
    return multiply.spgemm(a, b).df


@query("packed_bitmask_gaps", f"WITH {G}, k AS (SELECT DISTINCT j AS k FROM g WHERE v > 90) SELECT k // 8 AS word, bit_or(1 << (k % 8)::INT)::BIGINT AS mask FROM k GROUP BY 1")
def packed_bitmask_gaps(spark, sf):
    """The columns of a pruned matrix, many of which are empty."""
    return layout.packed_mask(layout.nonempty(algebra.prune(square(spark, sf), 90.0), "j"))


@query("csr_segments", f"WITH {G} SELECT i, (row_number() OVER (PARTITION BY i ORDER BY j) - 1)::BIGINT AS pos, j, v FROM g")
def csr_segments(spark, sf):
    """Rows in segments of eight entries, and their entries again."""
    return segments.entries(segments.segmented(square(spark, sf), 8))


@query("csr_segment_product", f"WITH {G} SELECT i, sum(v * (j % 7 + 1)) AS v FROM g GROUP BY 1")
def csr_segment_product(spark, sf):
    """Segmented rows times a vector."""
    g = square(spark, sf)
    x = spark.range(g.ncols).select(F.col("id").alias("j"), (F.col("id") % 7 + 1).cast("double").alias("x"))
    return segments.product_with_vector(segments.segmented(g, 8), x)


@query("csr_segment_lookup", f"WITH {G} SELECT a.i, a.j, a.v FROM g a JOIN g b ON a.i = b.j AND a.j = b.i")
def csr_segment_lookup(spark, sf):
    """Entries that have one across the diagonal, looked up in segmented rows."""
    g = square(spark, sf)
    return segments.lookup(segments.segmented(g, 8), g.T.df)


@query("mtx_array_roundtrip", f"WITH {CS} SELECT i, j, v FROM cs")
def mtx_array_roundtrip(spark, sf):
    """A matrix written as an array file, a value a line, and read by line numbers."""
    path = temporary_path(spark, "mtx")
    write_array(customer_nation(spark, sf), path)
    return read_mtx(spark, path).df


# --- clustering of a sparse matrix that grows ---------------------------------------------------------


def _mcl_rows_sql(rounds: int, tolerance: float) -> str:
    return _mcl_sql(rounds, tolerance).replace(NT, G).replace("FROM nt", "FROM g").replace(f"SELECT i, j, round(v, 6) AS v FROM l{rounds}", f"SELECT i, count(*) AS n, round(sum(v), 6) AS s, round(max(v), 6) AS most FROM l{rounds} GROUP BY i")


@query("mcl_sparse", _mcl_rows_sql(2, 0.0053))
def mcl_sparse(spark, sf):
    """Two rounds on G, a digest for each row."""
    m = mcl(square(spark, sf), 2, 0.0053)[0]
    return m.df.groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("s"), F.round(F.max("v"), 6).alias("most"))


# --- grids of parts: stencils, restriction and prolongation applied to quantities ------------------------


def _side(spark, sf, d: int) -> int:
    """The side of the largest d-dimensional grid that the parts fill."""
    return int(load(spark, sf, "part").count() ** (1 / d) + 1e-9)


def part_quantities(spark, sf, size: int) -> SparseMatrix:
    """A column of the quantities ordered of the first ``size`` parts, a place of the grid each."""
    df = load(spark, sf, "lineitem").where(F.col("l_partkey") < size).groupBy("l_partkey").agg(F.sum("l_quantity").alias("v")).withColumn("j", F.lit(0))
    return SparseMatrix.of(df, size, 1, "l_partkey", "j")


def _moved_sql(d: int) -> str:
    return " + ".join(f"(d{c} <> 0)::INT" for c in "xyz"[:d])


def _grid_sql(d: int, side: str) -> str:
    """Points p (x, .., v) of the grid of parts, whose side n is ``side`` of the number s of parts that fit a direction, and offsets o (dx, ..)."""
    index = ", ".join(f"k // pow(n, {k})::BIGINT % n AS {c}" for k, c in enumerate("xyz"[:d]))
    offsets = ", ".join(f"(SELECT unnest([-1, 0, 1])::BIGINT AS d{c})" for c in "xyz"[:d])
    return f"""WITH s AS (SELECT floor(pow(count(*), 1.0::DOUBLE / {d}) + 1e-9)::BIGINT AS s FROM part), g AS (SELECT s, {side} AS n FROM s),
q AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1), p AS (SELECT {index}, v FROM q, g WHERE k < pow(n, {d})), o AS (SELECT * FROM {offsets})"""


def _index_sql(coordinates: list[str], side: str) -> str:
    return " + ".join(f"({c}) * pow({side}, {k})::BIGINT" for k, c in enumerate(coordinates))


def _applied_stencil_sql(kind: str) -> str:
    d = generators.STENCILS[kind]
    weight = {"9pt": "CASE m WHEN 0 THEN 8 WHEN 1 THEN -2 ELSE -1 END", "27pt": "CASE m WHEN 0 THEN 26 WHEN 1 THEN -4 ELSE -1 END"}.get(kind, f"CASE m WHEN 0 THEN {2 * d} WHEN 1 THEN -1 END")
    inside = " AND ".join(f"{c} - d{c} BETWEEN 0 AND n - 1" for c in "xyz"[:d])
    return f"""{_grid_sql(d, "s")} SELECT {_index_sql([f"{c} - d{c}" for c in "xyz"[:d]], "n")} AS i, sum(({weight}) * v) AS v
FROM (SELECT *, {_moved_sql(d)} AS m FROM p, o, g) WHERE ({weight}) IS NOT NULL AND {inside} GROUP BY 1"""


def _applied_restriction_sql(d: int) -> str:
    """Fine points f = 2 c + o, on a grid of 2 n - 1 points a direction."""
    even = " AND ".join(f"({c} - d{c}) % 2 = 0 AND {c} - d{c} BETWEEN 0 AND n - 1" for c in "xyz"[:d])
    return f"""{_grid_sql(d, "2 * ((s + 1) // 2) - 1")} SELECT {_index_sql([f"({c} - d{c}) // 2" for c in "xyz"[:d]], "((n + 1) // 2)")} AS i, sum(pow(0.5, {_moved_sql(d)} + {d}) * v) AS v
FROM p, o, g WHERE {even} GROUP BY 1"""


def _applied_prolongation_sql(d: int) -> str:
    inside = " AND ".join(f"2 * {c} + d{c} BETWEEN 0 AND 2 * n - 2" for c in "xyz"[:d])
    return f"""{_grid_sql(d, "s")} SELECT {_index_sql([f"2 * {c} + d{c}" for c in "xyz"[:d]], "(2 * n - 1)")} AS i, sum(pow(0.5, {_moved_sql(d)}) * v) AS v FROM p, o, g WHERE {inside} GROUP BY 1"""


def _applied(make):
    """The product of a generated matrix with the column of quantities."""

    def run(spark, sf):
        a = make(spark, sf)
        return multiply.spgemm(a, part_quantities(spark, sf, a.ncols)).df.select("i", "v")

    return run


for _kind, _d in generators.STENCILS.items():
    query(f"laplacian_{_d}d_{_kind}", _applied_stencil_sql(_kind))(_applied(lambda spark, sf, k=_kind, d=_d: generators.stencil(spark, k, *[_side(spark, sf, d)] * d)))
for _d in (1, 2, 3):
    query(f"restricted_{_d}d", _applied_restriction_sql(_d))(_applied(lambda spark, sf, d=_d: generators.restriction(spark, *[(_side(spark, sf, d) + 1) // 2] * d)))
    query(f"prolonged_{_d}d", _applied_prolongation_sql(_d))(_applied(lambda spark, sf, d=_d: generators.prolongation(spark, *[_side(spark, sf, d)] * d)))

COARSE = f"{G}, h AS (SELECT ({N} + 1) // 2 AS n), o AS (SELECT unnest([-1, 0, 1])::BIGINT AS d, unnest([0.5, 1.0, 0.5])::DOUBLE AS w)"


@query("galerkin_parts", by_row_sql(COARSE, """SELECT (g.i - a.d) // 2 AS i, (g.j - b.d) // 2 AS j, sum(a.w / 2 * g.v * b.w) AS v FROM g, h, o a, o b
WHERE g.i < 2 * n - 1 AND g.j < 2 * n - 1 AND (g.i - a.d) % 2 = 0 AND (g.j - b.d) % 2 = 0 AND g.i - a.d BETWEEN 0 AND 2 * n - 2 AND g.j - b.d BETWEEN 0 AND 2 * n - 2 GROUP BY 1, 2"""))
def galerkin_parts(spark, sf):
    """R G P on the line of parts, of which the coarse grid takes every other one."""
    g = square(spark, sf)
    n = (g.nrows + 1) // 2
    fine = SparseMatrix(g.df.where((F.col("i") < 2 * n - 1) & (F.col("j") < 2 * n - 1)), 2 * n - 1, 2 * n - 1)
    return by_row(multiply.triple_product(generators.restriction(spark, n), fine, generators.prolongation(spark, n)))


@query("restrict_t_times_parts", by_row_sql(COARSE, f"SELECT 2 * g.i + d AS i, g.j, sum(w / 2 * g.v) AS v FROM g, o WHERE 2 * g.i + d BETWEEN 0 AND 2 * {N} - 2 GROUP BY 1, 2"))
def restrict_t_times_parts(spark, sf):
    """R' G: a restriction's transpose as the left operand."""
    g = square(spark, sf)
    return by_row(multiply.spgemm(generators.restriction(spark, g.nrows).T, g))


@query("band_times_suppliers", """WITH n AS (SELECT count(*) AS n FROM supplier), q AS (SELECT l_suppkey AS x, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey % 3 = 2 GROUP BY 1)
SELECT i, sum(v) AS v FROM (SELECT unnest(range(x, least(x + CASE WHEN x < n / 2 THEN x + 1 ELSE n - x END, n))) AS i, v FROM q, n) GROUP BY 1""")
def band_times_suppliers(spark, sf):
    """A band whose columns are empty but for every third, times the suppliers' quantities."""
    n = load(spark, sf, "supplier").count()
    df = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v")).withColumn("j", F.lit(0))
    x = SparseMatrix.of(df, n, 1, "l_suppkey", "j")
    return multiply.spgemm(generators.banded(spark, n, 3, 2, "j"), x, "broadcast").df.select("i", "v")  # the band's entries stay where they are made


@query("catalog_runs", f"WITH {METRICS}, c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MATRICES) + ") AS t(set, matrix)) SELECT c.set, c.matrix, count(m.ms) AS n_runs, round(avg(m.ms), 6) AS ms FROM c LEFT JOIN m ON m.matrix = c.matrix GROUP BY 1, 2")
def catalog_runs(spark, sf):
    """The catalogue's matrices with the runs that there are of each."""
    runs = metrics(spark, sf).groupBy("matrix").agg(F.count("*").alias("n"), F.avg("ms").alias("ms"))
    return matrices(spark).join(runs, "matrix", "left").select("set", "matrix", F.coalesce("n", F.lit(0)).alias("n_runs"), F.round("ms", 6).alias("ms"))


@query("generated_names", """WITH s AS (SELECT count(*) AS n, floor(sqrt(count(*)) + 1e-9)::BIGINT AS m FROM part)
SELECT concat('stencil_3pt_1D_', n, '_', n, 'x', n, '_nnz', 3 * n - 2, '.mtx') AS name FROM s UNION ALL SELECT concat('stencil_5pt_2D_', m, 'x', m, '_', m * m, 'x', m * m, '_nnz', 5 * m * m - 4 * m, '_T.mtx') FROM s""")
def generated_names(spark, sf):
    """The file names of stencils as large as the parts allow."""
    rows = []
    for kind, d, transposed in (("3pt", 1, False), ("5pt", 2, True)):
        sizes = (_side(spark, sf, d),) * d
        a = generators.stencil(spark, kind, *sizes)
        rows.append((generators.file_name(f"stencil_{kind}", sizes, a.nrows, a.ncols, a.nnz(), transposed),))
    return spark.createDataFrame(rows, "name string")  # two rows


@query("file_stems", f"WITH {METRICS}, {FILES} SELECT concat('hns_strong_', ngpus, '_', grid, '_', matrix, '_kokkos_nospcomm_', impl, '_nopermute') AS stem, count(*) AS n FROM f GROUP BY 1")
def file_stems(spark, sf):
    """Runs by the stem of their log's name, whatever its folder and endings."""
    path = F.concat(F.lit("results/run.1/"), F.expr(FILE_NAME), F.when(F.col("event_id") % 2 == 0, ".gz").otherwise(""))
    return metrics(spark, sf).select(stem(path).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query("parquet_roundtrip", f"WITH {G} SELECT i, j, v FROM g")
def parquet_roundtrip(spark, sf):
    path = temporary_path(spark, "matrix")
    write_parquet(square(spark, sf), path)
    return read_parquet(spark, path).df


@query("log_union", f"WITH {METRICS} SELECT 'trilinos' AS program, matrix, arg_min(ms, event_id) AS ms FROM m WHERE ngpus = 16 GROUP BY 2 UNION ALL SELECT 'hns', matrix, max(ms) FROM m WHERE ngpus = 64 GROUP BY 2")
def log_union(spark, sf):
    """Results of two kinds of runs in one frame, by the names of their columns."""
    m = metrics(spark, sf)
    first = m.where("ngpus = 16").groupBy("matrix").agg(F.min_by("ms", "event_id").alias("ms")).withColumn("program", F.lit("trilinos"))
    most = m.where("ngpus = 64").groupBy("matrix").agg(F.max("ms").alias("ms")).select(F.lit("hns").alias("program"), "ms", "matrix")
    return first.unionByName(most).select("program", "matrix", "ms")
