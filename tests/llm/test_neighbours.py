"""op12 against brute force: tight and loose groups, pairs near the threshold, nulls, empty and odd vectors, repeated ids."""

import math

import numpy as np
import pytest

from sparkmat.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long, sid long, h string, raw string, angle double"


def brute(rows):
    usable = [(k, np.array(x, np.float64)) for k, (i, x, label) in enumerate(rows) if i is not None and label is not None and x and all(e is not None and math.isfinite(e) for e in x) and any(x)]
    units = {k: (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()) for k, x in usable}
    links = {k: [] for k in range(len(rows))}
    for a in units:
        for b in units:
            if a != b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93:
                links[a].append(b)
    out, least = [], {}
    for k in range(len(rows)):
        if k not in least:
            found, todo = {k}, [k]
            while todo:
                for b in links[todo.pop()]:
                    if b not in found:
                        found.add(b)
                        todo.append(b)
            least.update(dict.fromkeys(found, min((rows[b][0] for b in found if rows[b][0] is not None), default=None)))
        i = rows[k][0]
        out.append((i, len(links[k]), least[k], i is None or i == least[k]))
    return sorted(out, key=str)


def near(rng, centre, cosine, n):
    """Vectors at about a cosine from a centre."""
    noise = rng.standard_normal((n, len(centre)))
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return (cosine * centre + math.sqrt(1 - cosine**2) * noise).astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.standard_normal(24))
    vectors = [*rng.standard_normal((250, 24)).astype(np.float32)]
    vectors += [*near(rng, unit(), 0.995, 60)]  # a tight group
    vectors += [*near(rng, unit(), 0.968, 60)]  # pairs around 0.937: some linked, some not
    vectors += [*near(rng, unit(), 0.95, 40)]  # pairs around 0.90: chains
    c = unit()
    vectors += [*near(rng, c, 0.999, 30), *near(rng, c, 0.955, 30)]  # a ball and a halo
    vectors += [vectors[3]] * 40 + [vectors[3] * 2, -vectors[3]]  # copies, a multiple, the opposite
    out = [(k, [float(e) for e in x], k % 2 if k < 250 else 1) for k, x in enumerate(vectors)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [3e38] * 24, [1e-38] * 24, [1.0] * 3, [2.0] * 3]
    out += [(1000 + k, x, 1) for k, x in enumerate(odd)]
    out += [(2000, out[0][1], None), (None, out[1][1], 1), (5, out[1][1], 1), (5, out[260][1], 1)]
    return out


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "h", "raw", 0.5) for r in rows], SCHEMA)


def test_links_and_components(spark, rows):
    got, recall = neighbours.near_duplicates(given(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert recall >= 0.99


def test_saturated_lists_grow(spark, monkeypatch, rows):
    """Without balls every link must come from the lists, which begin with K entries."""
    monkeypatch.setattr(neighbours, "contracted", lambda nodes: (nodes.selectExpr("node AS sid", "label", "dim", "code", "radius", "mass", "1L AS size"), nodes.selectExpr("node", "node AS sid")))
    got, recall = neighbours.near_duplicates(given(spark, rows[:400]))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows[:400]) and recall == 1.0


def test_no_rows(spark):
    got, recall = neighbours.near_duplicates(given(spark, []))
    assert got.collect() == [] and recall == 1.0
    got, _ = neighbours.near_duplicates(given(spark, [(7, None, 1), (8, [1.0, 2.0], 1)]))
    assert sorted(map(tuple, got.collect())) == [(7, 0, 7, True), (8, 0, 8, True)]
