"""Operators on hand-made rows: ties, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import graph as G
from weft.operators import joins as J
from weft.operators import measures as M
from weft.operators import series as Y
from weft.operators import stats as S
from weft.sources import readers as R


def test_weighted_quantile_counts_ties_as_one_step(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 1), ("a", 9, 1), ("b", 5, 7)], "g string, x long, w long")
    got = {r["g"]: r["quantile"] for r in S.weighted_quantile(df, ["g"], "x", "w", 1, 2).collect()}
    assert got == {"a": 2, "b": 5}
    assert S.weighted_quantile(df.limit(0), ["g"], "x", "w", 1, 2).count() == 0


def test_zero_weight_is_null(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, w long")
    assert df.agg(S.weighted_mean("x", "w").alias("m"), S.masked_mean("x", "w", F.lit(False)).alias("k")).first() == (None, None)


def test_frozen_ecdf(spark):
    ref = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4)], "g string, x long")
    df = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("a", 9)], "g string, x long")
    assert sorted(r["y"] for r in S.frozen_ecdf(df, ref, ["g"], "x").collect()) == [0.125, 0.625, 0.875, 1.125]


def test_unknown_remedy(spark):
    with pytest.raises(ValueError):
        S.remedy(spark.range(1), "other", [], "id")


def test_interpolation_limit_from_either_side(spark):
    x = [1.0, None, None, None, None, None, 7.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "g string, i long, x double")
    got = [r["x"] for r in Y.interpolate(df, ["g"], "i", "x", 2).orderBy("i").collect()]
    assert got == [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, None]


def test_largest_remainder(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("g", "c", 1)], "g string, k string, n long")
    assert [r["seats"] for r in Y.largest_remainder(df, ["g"], "k", "n", 5).orderBy("k").collect()] == [2, 2, 1]


def test_bracket_outside_the_grid_is_null(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0)], "k long, x double, y double")
    df = spark.createDataFrame([(1, -1.0), (1, 4.0), (1, 10.0), (1, 11.0)], "k long, at double")
    assert [r["value"] for r in J.bracket(df, grid, ["k"], "at", "x", "y").orderBy("at").collect()] == [None, 2.0, 5.0, None]


def test_adjusted_rand_of_equal_labellings(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) + 7) for i in range(30)], "b long, a long")
    assert M.adjusted_rand(M.contingency(df, "b", "a")).first()["ari"] == pytest.approx(1.0)


def test_graph_steps(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (8, 9)], "a long, b long")
    assert {tuple(r) for r in G.prune_stubs(edges).collect()} == {(1, 2), (2, 3), (3, 1), (8, 9)}
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9, 10)], "id long")
    assert {r["id"]: r["comp"] for r in G.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 10}
    assert {r["id"]: r["hops"] for r in G.hops(edges, nodes.where("id = 5")).collect()} == {5: 0, 4: 1, 3: 2, 1: 3, 2: 3}
    zones = G.voronoi(edges, spark.createDataFrame([(1, 0), (5, 1)], "id long, zone long"))
    assert {r["id"]: r["zone"] for r in zones.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    rank = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, v long")
    assert {tuple(r) for r in G.contract(edges, edges.limit(1), rank).collect()} == {(2, 3), (3, 4), (4, 5), (8, 9)}


def test_merge_small_groups_one_by_one(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 9), (3, 4, 1)], "a long, b long, J long")
    sizes = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, 9)], "id long, n long")
    assert {r["id"]: r["head"] for r in G.merge_small(edges, sizes, 3, "J").collect()} == {1: 3, 2: 3, 3: 3, 4: 4}


def test_spectrum_counts_components(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 3, 4, 1.0), (0, 4, 5, 1.0)], "g long, a long, b long, w double")
    values = [r["value"] for r in G.spectrum(edges, "g", "w").orderBy("k").collect()]
    assert values[:2] == pytest.approx([0, 0], abs=1e-9) and values[2] > 0.1
    r = {(x["a"], x["b"]): x["r"] for x in G.resistance(edges.where("a >= 3"), "g", "w").collect()}
    assert r == pytest.approx({(3, 4): 1.0, (4, 5): 1.0, (3, 5): 2.0})


def test_parameters():
    base = {"a": {"b": 1, "c": 2.0}, "d": "x"}
    assert R.merge_parameters(base, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}, "d": "x"}
    with pytest.raises(TypeError):
        R.merge_parameters(base, {"d": 1})


def test_nearest_against_all_pairs(spark):
    rng = random.Random(4)
    left = [(i, i % 3, rng.random() * 100, rng.random() * 100) for i in range(120)]
    right = [(i, i % 2, rng.choice([rng.random() * 100, 5.0]), rng.choice([rng.random() * 100, 5.0])) for i in range(90)]
    a, b = spark.createDataFrame(left, "id long, g long, x double, y double"), spark.createDataFrame(right, "rid long, g long, u double, v double")
    got = {r["id"]: (r["nearest"], round(r["d2"], 9)) for r in J.nearest(a, b, ["g"], "id", "rid", "x", "y", "u", "v").collect()}
    want = {}
    for i, g, x, y in left:
        near = [((x - u) ** 2 + (y - v) ** 2, j) for j, h, u, v in right if h == g]
        if near:
            d, j = min(near)
            want[i] = (j, round(d, 9))
    assert got == want and J.nearest(a, b.limit(0), ["g"], "id", "rid", "x", "y", "u", "v").count() == 0


def test_global_ranks(spark):
    rows = [(i, (i * 37) % 50) for i in range(500)]
    got = S.global_mid_rank(spark.createDataFrame(rows, "i long, x long").repartition(7), "x", "r").collect()
    order = sorted(x for _, x in rows)
    for r in got:
        places = [k + 1 for k, x in enumerate(order) if x == r["x"]]
        assert r["r"] == sum(places) / len(places)


def test_frozen_files(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") * 3).alias("x")).repartition(3)
    R.freeze(df, str(tmp_path / "a"))
    assert sorted(tuple(r) for r in R.frozen(spark, str(tmp_path / "a"), "id long, x long").collect()) == [(i, 3 * i) for i in range(20)]
    part = sorted((tmp_path / "a" / "data").glob("part-*"))[0]
    part.with_name("." + part.name + ".crc").unlink(missing_ok=True)
    part.write_text(part.read_text().replace("3", "4", 1))
    with pytest.raises(ValueError, match=part.name):
        R.frozen(spark, str(tmp_path / "a"), "id long, x long")


def test_geometries(spark, tmp_path):
    (tmp_path / "g.json").write_text("""{"features": [
      {"properties": {"id": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1]], [[0.1, 0.1], [0.2, 0.1], [0.1, 0.2]]]}},
      {"properties": {"id": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1]]], [[[5, 5], [6, 5], [5, 6]]]]}},
      {"properties": {"id": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"id": "other"}, "geometry": null}]}""")
    rows = {r["name"]: r["parts"] for r in R.polygons(spark, str(tmp_path / "g.json"), {"p": "P", "m": "M", "x": "X"}).collect()}
    assert [len(part) for part in rows["P"]] == [2] and [len(part) for part in rows["M"]] == [1, 1] and rows["X"] == []
    assert (rows["P"][0][1][1]["x"], rows["M"][1][0][2]["y"]) == (0.2, 6.0)
