"""Near-duplicate vectors from a neighbour graph made by NN-descent.

Two vectors of one label are linked if their cosine is at least THRESHOLD, that
is if their angle is at most THETA.  Equal vectors form a class first.  Then
tight groups are drawn together: a ball is a centre and vectors within THETA / 2
of it, so all of its members are linked with each other, which needs no pair of
them.  Vectors travel as bytes (a direction of 8-bit numbers); how far a vector
lies from its bytes is measured and counts as its radius, so a lone vector is a
small ball as well, and the triangle inequality decides most pairs of balls for
all of their members: linked at an angle of at most THETA - r - s, not linked
beyond THETA + r + s.  Only what lies between is compared vector by vector, in
double precision, in blocks, of which counts come out and not pairs.

Balls that may be linked are found by NN-descent.  Each ball keeps a list of its
nearest K; the first lists come from blocks of a few random sort orders (signs of
random projections).  Each round joins neighbours of neighbours: whatever lists
a ball, or is listed by it, meets there, and pairs of which one is new improve
each other's lists, until few change.  A list whose last entry may still be
linked is saturated: its length is doubled and the rounds go on, so no cap on
partners remains.  The graph is then audited: QUERIES balls are compared with all
balls; if less than RECALL of the pairs that may be linked are in the lists, all
lists are enlarged and refined further, TRIES times at most, and the recall that
was reached is returned.  So a link between different balls can be missed (the
audit says how often), but none is made up and none within a ball is lost.

Blocks are cut from sorted ranges, so a large label, or very many alike vectors,
lie in many blocks; lists meet at a very common neighbour in parts, dealt anew
each round.

Cases: a vector that is null, empty or zero or holds a null or a non-finite
number, or whose label or vec_id is null, is linked with nothing; vectors of
different lengths aren't compared; rows with equal vec_id are judged by their
own vectors; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkmat.llm.common import drop_tables, table, write_table
from sparkmat.llm.neardup import components

THRESHOLD = 0.93
THETA = float(np.arccos(THRESHOLD))
#: More than rounding can move an angle near THETA.
SLACK = 1e-9
#: Entries of a list at first; vectors of a block; sort orders of the first lists; members that meet in one part.
K, LEAF, ORDERS, PART = 10, 128, 4, 512
#: Rounds end when fewer than this share of all list entries is new.
CHANGE = 0.002
QUERIES, RECALL, TRIES, ROUNDS = 1024, 0.99, 4, 12
SPACE = ["label", "dim"]


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, h, raw): the bytes of each vector and their digest, null where it can't be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, dims, hs, raws = batch.column("embedding"), [], [], []
            usable = np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("label").is_valid())
            kind = "<f4" if pa.types.is_float32(column.type.value_type) else "<f8"
            for k in range(batch.num_rows):
                own = column[k].values if usable[k] else None
                raw = None
                if own is not None and len(own) and not own.null_count:
                    x = own.to_numpy().astype(kind) + 0.0  # one zero only
                    if np.isfinite(x).all() and x.any():
                        raw = x.astype(kind).tobytes()
                dims.append(None if raw is None else len(own))
                raws.append(raw)
                hs.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(hs, pa.binary()), pa.array(raws, pa.binary())],
                names=["vec_id", "label", "dim", "h", "raw"],
            )

    # nulls inside a vector stay nulls; whole numbers would lose nothing as doubles
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    wanted = "embedding" if kind in ("float", "double") else F.col("embedding").cast("array<double>").alias("embedding")
    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), wanted).mapInArrow(run, "vec_id long, label long, dim int, h binary, raw binary")


def units(raws: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from vectors of one length."""
    x = np.frombuffer(b"".join(raws), "<f4" if len(raws[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # squares stay finite
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def directions(codes: list[bytes]) -> np.ndarray:
    """Unit vectors from bytes."""
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between all rows of a and all of b."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows of the same place, also exact where they are small."""
    return 2 * np.arcsin(np.clip(np.sqrt(((a - b) ** 2).sum(axis=1)) / 2, 0, 1))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that point in nearly the direction of each unit vector, and the angle between the two."""
    code = np.rint(x * (127 / np.abs(x).max(axis=1))[:, None]).astype(np.int8)
    return code, between(x, directions([code.tobytes()]) if len(x) == 1 else directions([c.tobytes() for c in code])) + SLACK


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows that are sorted by whole numbers ``names``."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _with(rows: DataFrame, name: str) -> StructType:
    return StructType([*rows.schema.fields, StructField(name, LongType())])


def blocks(balls: DataFrame, order: int) -> DataFrame:
    """``balls`` (sid, label, dim, code, ..) sorted by label, length and the signs of random projections, in ranges that split large runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            codes = batch.column("code").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                planes = np.random.Generator(np.random.PCG64([order, int(dim)])).standard_normal((int(dim), 40))
                keys[at] = (directions([codes[k] for k in at]) @ planes > 0) @ (1 << np.arange(40, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"])

    schema = _with(balls, "key")
    by = [*SPACE, "key", "sid"]
    return balls.mapInArrow(run, schema).repartitionByRange(*by).sortWithinPartitions(*by)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of at most LEAF rows of one label and length."""
    for _, rows in grouped(batches, SPACE):
        for k in range(0, rows.num_rows, LEAF):
            yield rows.slice(k, LEAF)


def drawn_together(rows: pa.Table) -> tuple[np.ndarray, dict[int, tuple[bytes, float]]]:
    """For the balls of a block: the place of the ball that each goes into, and code and radius of those that took others in."""
    x, radius = directions(rows.column("code").to_pylist()), rows.column("radius").to_numpy()
    into, made, free = np.arange(len(x)), {}, np.ones(len(x), bool)
    apart = angles(x, x) + radius[None, :]
    near = apart <= THETA / 2
    np.fill_diagonal(near, True)
    for pivot in np.argsort(-near.sum(axis=1), kind="stable"):
        own = np.flatnonzero(near[pivot] & free)
        if not free[pivot] or len(own) < 2:
            continue
        middle = x[own].mean(axis=0)
        code, _ = coded((middle / np.sqrt(middle @ middle))[None])
        reach = angles(directions([code.tobytes()]), x)[0] + radius + SLACK
        own = np.flatnonzero(free & (reach <= THETA / 2 - SLACK))
        if len(own) < 2:
            continue
        into[own], free[own] = own[0], False
        made[int(own[0])] = code.tobytes(), float(reach[own].max())
    return into, made


def contracted(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Balls (sid, label, dim, code, radius, mass, size) and members (node, sid) from nodes (node, label, dim, code, radius, mass)."""
    balls = nodes.select(F.col("node").alias("sid"), *SPACE, "code", "radius", "mass", F.lit(1).cast("long").alias("size"))
    members = nodes.select("node", F.col("node").alias("sid"))
    names = [*balls.columns, "into"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cut(batches):
            into, made = drawn_together(rows)
            codes, radius = rows.column("code").to_pylist(), rows.column("radius").to_numpy().copy()
            for k, (code, reach) in made.items():
                codes[k], radius[k] = code, reach
            sums = [np.bincount(into, rows.column(c).to_numpy(), len(into)).astype(np.int64) for c in ("mass", "size")]
            sid = rows.column("sid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid), *(rows.column(c).combine_chunks() for c in SPACE), pa.array(codes, pa.binary()), pa.array(radius), *map(pa.array, sums), pa.array(sid[into])],
                names=names,
            )

    schema = _with(balls, "into")
    count, order = balls.count(), 1000
    while count:
        drawn = write_table(blocks(balls, order).drop("key").mapInArrow(run, schema), "drawn")
        members = write_table(members.join(drawn.where("into <> sid").select("sid", "into"), "sid", "left").select("node", F.coalesce("into", "sid").alias("sid")), "members")
        balls = drawn.where("into = sid").drop("into")
        before, count = count, balls.count()
        order += 1
        if (before - count) * 100 < before:  # nothing more to win by another order
            break
    return balls, members


def _listed(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nearest ``k`` of each u from edges (u, v, angle, new); an entry that was there before isn't new."""
    dealt = edges.repartition("u").groupBy("u", "v").agg(F.min("angle").alias("angle"), F.min("new").alias("new"))
    placed = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy("angle", "v")))
    return placed.join(sizes, "u").where("_r <= k").select("u", "v", "angle", "new")


def first_lists(balls: DataFrame, start: int, orders: int) -> DataFrame:
    """Edges (u, v, angle, new) to the nearest K within each block of ``orders`` random sort orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cut(batches):
            x, sid = directions(rows.column("code").to_pylist()), rows.column("sid").to_numpy()
            n, k = len(sid), min(K, len(sid) - 1)
            if not k:
                continue
            apart = angles(x, x)
            np.fill_diagonal(apart, np.inf)
            best = np.argpartition(apart, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sid, k)), pa.array(sid[best].ravel()), pa.array(np.take_along_axis(apart, best, axis=1).ravel()), pa.array(np.ones(n * k, bool))], names=["u", "v", "angle", "new"])

    out = None
    for order in range(start, start + orders):
        edges = blocks(balls.select("sid", *SPACE, "code"), order).drop("key").mapInArrow(run, "u long, v long, angle double, new boolean")
        out = edges if out is None else out.unionByName(edges)
    return out


def heads(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, k, worst): the last angle of each list, pi where it isn't full."""
    last = lists.groupBy("u").agg(F.count("*").alias("_n"), F.max("angle").alias("_worst"))
    return sizes.join(last, "u", "left").select("u", "k", F.when(F.col("_n") >= F.col("k"), F.col("_worst")).otherwise(F.lit(float(np.pi))).alias("worst"))


def joined(lists: DataFrame, balls: DataFrame, last: DataFrame, turn: int) -> DataFrame:
    """Edges (u, v, angle, new) between neighbours of a common neighbour that would enter u's list."""
    meet = lists.select(F.col("u").alias("owner"), F.col("v").alias("member"), "new").unionByName(lists.select(F.col("v").alias("owner"), F.col("u").alias("member"), "new"))
    meet = meet.groupBy("owner", "member").agg(F.max("new").alias("new"))
    counts = meet.groupBy("owner").agg(F.count("*").alias("_n"), F.max("new").alias("_any")).where("_any")
    part = F.pmod(F.xxhash64("member", F.lit(turn)), F.expr(f"1 + _n div {PART}")).alias("part")
    met = meet.join(counts, "owner").select("owner", "member", "new", part)
    about = balls.select("sid", "code").join(last, F.col("sid") == F.col("u")).select(F.col("sid").alias("member"), "code", "worst")
    names = ["owner", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, names):
            x, sid = directions(rows.column("code").to_pylist()), rows.column("member").to_numpy()
            new, worst = rows.column("new").to_numpy(), rows.column("worst").to_numpy()
            apart = angles(x, x)
            np.fill_diagonal(apart, np.inf)
            u, v = np.nonzero((new[:, None] | new[None, :]) & (apart < worst[:, None]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(sid[u]), pa.array(sid[v]), pa.array(apart[u, v]), pa.array(np.ones(len(u), bool))], names=["u", "v", "angle", "new"])

    dealt = met.join(about, "member").repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "u long, v long, angle double, new boolean")


def descended(lists: DataFrame, balls: DataFrame, sizes: DataFrame, widest: float) -> tuple[DataFrame, DataFrame]:
    """Lists and their lengths after rounds of joins, until few entries change and no list is saturated."""
    entries = max(1, lists.count())
    for turn in range(ROUNDS):
        last = heads(lists, sizes)
        edges = lists.withColumn("new", F.lit(False)).unionByName(joined(lists, balls, last, turn))
        before, lists = lists, write_table(_listed(edges, sizes), "lists")
        drop_tables(before)
        changed = lists.where("new").count()
        if changed > CHANGE * entries:
            continue
        full = heads(lists, sizes).join(balls.select(F.col("sid").alias("u"), "radius"), "u").where(F.col("worst") <= THETA + widest + F.col("radius")).select("u")
        full = write_table(full, "saturated")
        if full.isEmpty():
            break
        grown = sizes.join(full.withColumn("_full", F.lit(True)), "u", "left")
        before, sizes = sizes, write_table(grown.select("u", F.expr("if(_full, 2 * k, k)").alias("k")), "sizes")
        lists = write_table(lists.join(full.withColumn("_full", F.lit(True)), "u", "left").select("u", "v", "angle", F.expr("new OR coalesce(_full, false)").alias("new")), "lists")
        drop_tables(before, full)
    return lists, sizes


def audited(lists: DataFrame, balls: DataFrame) -> float:
    """The share of pairs that may be linked that the lists hold, for QUERIES balls against all (1 if there are none)."""
    picked = balls.select("sid", *SPACE, "code", "radius").orderBy(F.xxhash64("sid"), "sid").limit(QUERIES).collect()  # at most QUERIES rows
    spaces: dict[tuple, list] = {}
    for r in picked:
        spaces.setdefault((r["label"], r["dim"]), []).append(r)
    asked = {s: (np.array([r["sid"] for r in rs]), directions([bytes(r["code"]) for r in rs]), np.array([r["radius"] for r in rs])) for s, rs in spaces.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            sid, radius, codes = batch.column("sid").to_numpy(), batch.column("radius").to_numpy(), batch.column("code").to_pylist()
            for (own_label, own_dim), (ids, x, r) in asked.items():
                at = np.flatnonzero((label == own_label) & (dim == own_dim))
                if not len(at):
                    continue
                apart = angles(x, directions([codes[k] for k in at])) - r[:, None] - radius[at][None, :]
                q, w = np.nonzero((apart <= THETA) & (ids[:, None] != sid[at][None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(sid[at][w])], names=["u", "v"])

    true = write_table(balls.select("sid", *SPACE, "code", "radius").mapInArrow(run, "u long, v long"), "true")
    held = lists.select("u", "v").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v")))
    n, found = true.count(), true.join(held, ["u", "v"], "left_semi").count()
    drop_tables(true)
    return found / n if n else 1.0


def neighbour_lists(balls: DataFrame) -> tuple[DataFrame, float]:
    """Lists (u, v, angle) of near balls, and their audited recall."""
    widest = balls.agg(F.max("radius")).first()[0] or 0.0
    sizes = balls.select(F.col("sid").alias("u"), F.lit(K).cast("long").alias("k"))
    lists = write_table(_listed(first_lists(balls, 0, ORDERS), sizes), "lists")
    for again in range(TRIES):
        lists, sizes = descended(lists, balls, sizes, widest)
        recall = audited(lists, balls)
        if recall >= RECALL or again == TRIES - 1:
            return lists, recall
        sizes = write_table(sizes.select("u", (2 * F.col("k")).alias("k")), "sizes")
        more = first_lists(balls, (again + 1) * ORDERS, ORDERS)
        lists = write_table(_listed(lists.withColumn("new", F.lit(True)).unionByName(more), sizes), "lists")
    raise AssertionError("unreachable")


def compared(mixed: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y, node, n) for pairs of balls (x, y): the mass of the other ball's members that a member is linked with, if any.

    ``members`` are (node, sid, dim, raw, weight).  Members meet in blocks of
    about PART from each side; counts come out of a block, not pairs.
    """
    parts = members.groupBy("sid").agg(F.expr(f"1 + count(*) div {PART}").alias("parts"))
    both = mixed.join(parts.select(F.col("sid").alias("x"), F.col("parts").alias("px")), "x").join(parts.select(F.col("sid").alias("y"), F.col("parts").alias("py")), "y")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    columns = ["x", "y", "bx", "by", "side", "node", "dim", "raw", "weight"]
    left = both.join(members.withColumnRenamed("sid", "x"), "x").withColumn("bx", block("px")).withColumn("by", every("py")).withColumn("side", F.lit(0))
    right = both.join(members.withColumnRenamed("sid", "y"), "y").withColumn("by", block("py")).withColumn("bx", every("px")).withColumn("side", F.lit(1))
    names = ["x", "y", "bx", "by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x, y, _, _), rows in grouped(batches, names):
            side, node, weight = (rows.column(c).to_numpy() for c in ("side", "node", "weight"))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            unit = units(rows.column("raw").to_pylist(), int(rows.column("dim")[0].as_py()))
            linked = (unit[a] @ unit[b].T >= THRESHOLD).astype(np.int64)
            n = np.concatenate([linked @ weight[b], linked.T @ weight[a]])
            at = np.concatenate([a, b])[n > 0]
            n = n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x)), pa.array(np.full(len(n), y)), pa.array(node[at]), pa.array(n)], names=["x", "y", "node", "n"])

    dealt = left.select(*columns).unionByName(right.select(*columns)).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "x long, y long, node long, n long")


def near_duplicates(vectors: DataFrame) -> tuple[DataFrame, float]:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label), and the audited recall of the graph."""
    cleaned = write_table(clean(vectors), "vectors")
    rows = cleaned.select("vec_id", *SPACE, "h")
    classes = cleaned.where("h IS NOT NULL").groupBy(*SPACE, "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # the numbers hold from here on

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws, codes, radius = batch.column("dim").to_numpy(), batch.column("raw").to_pylist(), [b""] * batch.num_rows, np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own, radius[at] = coded(units([raws[k] for k in at], int(dim)) if len({len(raws[k]) for k in at}) == 1 else np.zeros((0, int(dim))))
                for k, c in zip(at, own, strict=True):
                    codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", *SPACE)), pa.array(codes, pa.binary()), pa.array(radius), batch.column("weight")], names=["node", *SPACE, "code", "radius", "mass"])

    nodes = write_table(classes.select("node", *SPACE, "raw", "weight").mapInArrow(code, "node long, label long, dim int, code binary, radius double, mass long"), "nodes")
    balls, members = contracted(nodes)
    balls = write_table(balls, "balls")
    lists, recall = neighbour_lists(balls)

    side = lambda x: balls.select(F.col("sid").alias(x), F.col("radius").alias(f"r{x}"), F.col("mass").alias(f"m{x}"))
    pairs = lists.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "angle").groupBy("x", "y").agg(F.min("angle").alias("angle"))
    reach = F.col("rx") + F.col("ry")
    pairs = pairs.where(F.col("angle") <= 2 * THETA + SLACK).join(side("x"), "x").join(side("y"), "y").where(F.col("angle") <= THETA + reach + SLACK)
    pairs = write_table(pairs.select("x", "y", "mx", "my", (F.col("angle") + reach <= THETA - SLACK).alias("sure")), "pairs")
    sure, mixed = pairs.where("sure"), pairs.where("NOT sure").select("x", "y")
    whole = members.join(classes.select("node", "dim", "raw", "weight"), "node")
    touched = mixed.select(F.col("x").alias("sid")).unionByName(mixed.select(F.col("y").alias("sid"))).distinct()
    found = write_table(compared(mixed, whole.join(touched, "sid", "left_semi")), "found")

    edges = sure.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(found.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()
    labels = components(edges).select(F.col("id").alias("sid"), "component")
    of_sure = sure.select(F.col("x").alias("sid"), F.col("my").alias("n")).unionByName(sure.select(F.col("y").alias("sid"), F.col("mx").alias("n"))).groupBy("sid").agg(F.sum("n").alias("_sure"))
    of_ball = balls.select("sid", "mass").join(of_sure, "sid", "left").join(labels, "sid", "left").select("sid", (F.col("mass") - 1 + F.coalesce("_sure", F.lit(0))).alias("n"), F.coalesce("component", "sid").alias("_component"))
    of_node = found.groupBy("node").agg(F.sum("n").alias("_mixed"))
    known = members.join(of_ball, "sid").join(of_node, "node", "left").join(classes.select("node", "rep", *SPACE, "h"), "node")
    known = write_table(known.select(*SPACE, "h", "rep", "_component", (F.col("n") + F.coalesce("_mixed", F.lit(0))).alias("n_links")), "known")
    least = known.groupBy("_component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "_component").select(*SPACE, "h", "n_links", "component_id")
    linked = rows.where("h IS NOT NULL").join(known, [*SPACE, "h"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall


def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))[0]


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, coalesce(e.vec_id = l.component_id, true) AS kept
FROM embeddings e LEFT JOIN least l ON l.id = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""
