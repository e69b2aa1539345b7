from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeweave.llm.embeddings import _partners, _tiles, link_vectors
from tapeweave.llm.graph import components


def brute(rows, least=0.95):
    ids = [r[0] for r in rows]
    usable = [
        np.array(v, float) if v and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) else None
        for _, v in rows
    ]
    links, label = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(usable):
        for j in range(i):
            b = usable[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[i] += 1
                links[j] += 1
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least_id = {k: min(i for i, x in zip(ids, label) if x == k) for k in set(label)}
    return sorted((i, n, least_id[x]) for i, n, x in zip(ids, links, label))


@pytest.mark.parametrize("rows_per_tile, inner", [(8192, 1024), (16, 7)])
def test_links_against_brute_force(spark, rows_per_tile, inner):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for size in (1, 1, 2, 3, 30, 60):
        centre = rng.normal(size=24)
        for _ in range(size):
            rows.append((at, (centre + rng.normal(size=24) * 0.17).tolist()))
            at += 1
    hot = rng.normal(size=24)
    rows += [(at + i, hot.tolist()) for i in range(40)] + [(at + 40, (hot * 3).tolist()), (at + 41, (-hot).tolist())]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] + [1.0] * 23), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int").withColumn("label", F.lit(None).cast("int"))
    got = link_vectors(frame, rows=rows_per_tile, inner=inner, step=8).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_partners_are_all_bins_within_the_gap():
    rng = np.random.default_rng(4)
    edges = np.sort(rng.normal(size=400))
    low, high = edges[::2], edges[1::2]
    for gap in (0.0, 0.01, 0.3, 10.0):
        first, last = _partners(low, high, gap)
        want = [[k for k in range(200) if max(low[k] - high[t], low[t] - high[k]) <= gap] for t in range(200)]
        assert [list(range(a, b + 1)) for a, b in zip(first, last)] == want
    assert [len(x) for x in _partners(low[:0], high[:0], 0.3)] == [0, 0]


def test_tiles_of_crowded_bins(spark):
    rows = [(0, 0.0)] * 100 + [(1, 0.1 + i / 1000) for i in range(9)] + [(3, 5.0)]
    table = _tiles(spark, spark.createDataFrame(rows, "bin long, z double"), 10, 0.3).collect()
    assert sorted((r["_bin"], r["start"], r["parts"], r["first"], r["last"]) for r in table) == [(0, 0, 5, 0, 5), (1, 5, 1, 0, 5), (3, 6, 1, 6, 6)]


def test_links_do_not_depend_on_the_tiles(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    coarse, fine = (link_vectors(frame, rows=r, inner=16, step=2) for r in (30, 2))
    assert sorted(map(tuple, coarse.collect())) == sorted(map(tuple, fine.collect()))


def test_no_vectors(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert [r["n_links"] for r in link_vectors(only).collect()] == [0, 0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(139, 300), (7, 7), (500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in [*range(100, 140), 300]} == {100} and got[500] == 500
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
