"""Graph operators on edge tables (a, b, ...): iterative ones are loops of DataFrame steps that write each step to the shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.shared import materialize


def both_directions(edges: DataFrame, keep: list[str] = ()) -> DataFrame:
    return edges.select("a", "b", *keep).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *keep))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, comp): comp is the smallest id that can be reached; nodes(id) without edges are their own. Minimum labels with pointer
    jumping, so that steps grow with the logarithm of the longest path."""
    both = materialize(both_directions(edges.where("a <> b")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("top"))
        step = materialize(step.join(up, step["comp"] == up["up"], "left").select("id", "old", F.least("comp", "top").alias("comp")), "labels")
        labels = step.select("id", "comp")
        if step.where("old <> comp").isEmpty():
            break
    if nodes is None:
        return labels
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def zone_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(zone, parts, isolated) of labels(id, zone): components inside each zone, and nodes without an edge in it."""
    inside = edges.join(labels.select(F.col("id").alias("a"), F.col("zone").alias("za")), "a").join(labels.select(F.col("id").alias("b"), F.col("zone").alias("zb")), "b").where("za = zb").select("a", "b")
    comps = components(inside, labels).join(labels, "id")
    linked = both_directions(inside).select(F.col("a").alias("id")).distinct().withColumn("linked", F.lit(1))
    return comps.join(linked, "id", "left").groupBy("zone").agg(F.count_distinct("comp").alias("parts"), F.count_if(F.col("linked").isNull()).alias("isolated"))


def anchors(labels: DataFrame, edges: DataFrame, capacity: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row a zone of labels(id, country, zone): ``anchor`` (from 0 within the country, in order of zones that have nodes of their own), ``capacity`` of its
    nodes and of nodes attached to them, ``n`` own nodes, ``attached`` ones, ``wrong_host`` (attached nodes whose label is not their host's), ``parts``
    (components of its own nodes along edges inside it) and ``contiguous``. hosts(id, host): isolated nodes and the node that each is attached to; a
    zone that lives on attached nodes only has no anchor."""
    own = labels.join(hosts.select("id"), "id", "left_anti")
    of_host = labels.select(F.col("id").alias("host"), F.col("zone").alias("host_zone"))
    tied = labels.join(hosts, "id").join(of_host, "host", "left")
    caps = labels.join(capacity, "id", "left").select("id", "country", "zone", F.coalesce("cap", F.lit(0)).alias("cap"))
    at = caps.join(hosts, "id", "left").join(of_host, "host", "left").groupBy("country", F.coalesce("host_zone", "zone").alias("zone")).agg(F.sum("cap").alias("capacity"))
    zones = own.groupBy("country", "zone").agg(F.count("*").alias("n"))
    zones = zones.withColumn("anchor", (F.row_number().over(Window.partitionBy("country").orderBy("zone")) - 1).cast("long"))  # a row a zone
    parts = zone_components(edges.select("a", "b"), own.select("id", "zone")).select("zone", "parts")
    wrong = tied.groupBy("country", "zone").agg(F.count("*").alias("attached"), F.count_if(~F.col("zone").eqNullSafe(F.col("host_zone"))).alias("wrong_host"))
    rows = labels.select("country", "zone").distinct().join(zones, ["country", "zone"], "left").join(at, ["country", "zone"], "left").join(parts, "zone", "left").join(wrong, ["country", "zone"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("country", "zone", "anchor", count("capacity"), count("n"), count("attached"), count("wrong_host"), count("parts"), (F.coalesce("parts", F.lit(0)) == 1).alias("contiguous"))


def prune_stubs(edges: DataFrame) -> DataFrame:
    """Drops edges to nodes with a single neighbour until none is left; of two nodes that have only each other the edge stays."""
    while True:
        degree = both_directions(edges).groupBy("a").agg(F.count_distinct("b").alias("k"))
        ends = edges.join(degree.select("a", F.col("k").alias("ka")), "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
        marked = materialize(ends.withColumn("stub", ((F.col("ka") == 1) | (F.col("kb") == 1)) & ~((F.col("ka") == 1) & (F.col("kb") == 1))), "stubs")
        if marked.where("stub").isEmpty():
            return edges
        edges = marked.where("not stub").select(*edges.columns)


def drop_islands(edges: DataFrame, nodes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) without the components of fewer than ``least`` nodes."""
    comps = components(edges.select("a", "b"), nodes)
    kept = comps.groupBy("comp").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("comp")
    left = materialize(nodes.join(comps.join(kept, "comp", "left_semi"), "id", "left_semi"), "mainland")
    return edges.join(left.select(F.col("id").alias("a")), "a", "left_semi").select(*edges.columns), left


def absorb_stubs(edges: DataFrame, nodes: DataFrame, group: str, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) without nodes that have a single neighbour, of the same group, and are none of fixed(id); again and again, as others become such. Of two
    nodes that have only each other the larger id stays."""
    edges = materialize(edges, "lines")
    while True:
        ends = both_directions(edges.where("a <> b").select("a", "b")).groupBy("a").agg(F.count_distinct("b").alias("k"), F.min("b").alias("b")).where("k = 1")
        kind = nodes.select("id", group)
        ends = ends.join(kind.select(F.col("id").alias("a"), F.col(group).alias("_x")), "a").join(kind.select(F.col("id").alias("b"), F.col(group).alias("_y")), "b").where("_x = _y")
        if fixed is not None:
            ends = ends.join(fixed.select(F.col("id").alias("a")), "a", "left_anti")
        other = ends.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("_both"))
        gone = materialize(ends.join(other, ["a", "b"], "left").where("_both is null or a < b").select(F.col("a").alias("id")), "stubs")
        if gone.isEmpty():
            return edges, nodes
        nodes = materialize(nodes.join(gone, "id", "left_anti"), "nodes-left")
        for end in ("a", "b"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
        edges = materialize(edges, "lines")


def contract(edges: DataFrame, joins: DataFrame, rank: DataFrame) -> DataFrame:
    """Nodes joined by ``joins`` become their member of highest rank(id, v) (ties: the largest id); self-loops are dropped, parallel edges kept."""
    comps = components(joins).join(rank, "id", "left")
    head = comps.groupBy("comp").agg(F.max_by("id", F.struct("v", "id")).alias("head"))
    to = comps.join(head, "comp").select("id", "head")
    out = edges.join(to.select(F.col("id").alias("a"), F.col("head").alias("ha")), "a", "left").join(to.select(F.col("id").alias("b"), F.col("head").alias("hb")), "b", "left")
    x, y = F.coalesce("ha", "a"), F.coalesce("hb", "b")
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return out.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), *rest).where("a <> b")


def merge_small(edges: DataFrame, sizes: DataFrame, least: int, w: str) -> DataFrame:
    """(id, head): groups of fewer than ``least`` nodes join the neighbour with the largest weight, the smallest group first, one after
    another. sizes(id, n) holds one row per group (a country): the loop runs over groups, each step is a query."""
    labels = sizes.select("id", F.col("id").alias("head"), "n")
    while True:
        labels = materialize(labels, "groups")
        totals = labels.groupBy("head").agg(F.sum("n").alias("n"))
        tied = edges.join(labels.select(F.col("id").alias("a"), F.col("head").alias("ha")), "a").join(labels.select(F.col("id").alias("b"), F.col("head").alias("hb")), "b").where("ha <> hb")
        around = tied.select(F.col("ha").alias("head"), F.col("hb").alias("to"), w).unionByName(tied.select(F.col("hb").alias("head"), F.col("ha").alias("to"), w))
        best = around.groupBy("head", "to").agg(F.sum(w).alias("w")).groupBy("head").agg(F.max_by("to", F.struct("w", -F.col("to"))).alias("to"))
        step = totals.where(F.col("n") < least).join(best, "head").orderBy("n", "head").limit(1).collect()
        if not step:
            return labels.select("id", "head")
        labels = labels.withColumn("head", F.when(F.col("head") == step[0]["head"], step[0]["to"]).otherwise(F.col("head")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_directions(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.count_distinct("b").alias("neighbours"))


def hops(edges: DataFrame, sources: DataFrame, most: int = 1000) -> DataFrame:
    """(source, id, hops) by breadth-first waves from each of sources(id)."""
    both = materialize(both_directions(edges).distinct(), "edges")
    wave = sources.select(F.col("id").alias("source"), F.col("id"), F.lit(0).cast("long").alias("hops"))
    seen = wave = materialize(wave, "wave")
    for k in range(1, most + 1):
        new = wave.join(both, wave["id"] == both["a"]).select("source", F.col("b").alias("id")).distinct().join(seen.select("source", "id"), ["source", "id"], "left_anti")
        wave = materialize(new.withColumn("hops", F.lit(k).cast("long")), "wave")
        if wave.isEmpty():
            return seen
        seen = seen.unionByName(wave)
    return seen


def voronoi(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, zone): nearest of seeds(id, zone) by hops, ties to the smallest zone: a contiguous partition. Deterministic waves."""
    both = materialize(both_directions(edges).distinct(), "edges")
    done = wave = materialize(seeds.select("id", "zone"), "zones")
    while True:
        new = wave.join(both, wave["id"] == both["a"]).select(F.col("b").alias("id"), "zone").join(done.select("id"), "id", "left_anti").groupBy("id").agg(F.min("zone").alias("zone"))
        wave = materialize(new, "wave")
        if wave.isEmpty():
            return done
        done = done.unionByName(wave)


def _matrix(pdf: pd.DataFrame, w: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
    i, j = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
    m = np.zeros((len(ids), len(ids)))
    np.add.at(m, (i, j), pdf[w])
    np.add.at(m, (j, i), pdf[w])
    return ids, m


def normalised_laplacian(m: np.ndarray) -> np.ndarray:
    d = m.sum(axis=1)
    s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0)
    return np.eye(len(m)) - s[:, None] * m * s[None, :]


def spectrum(edges: DataFrame, group: str, w: str) -> DataFrame:
    """(group, k, value): ascending eigenvalues of the normalised Laplacian of each group's graph (a country, a grid)."""

    def run(key, pdf):
        values = np.linalg.eigvalsh(normalised_laplacian(_matrix(pdf, w)[1]))
        return pd.DataFrame({group: key[0], "k": np.arange(len(values)), "value": values})

    kind = dict(edges.dtypes)[group]
    return edges.select(group, "a", "b", w).groupBy(group).applyInPandas(run, f"{group} {kind}, k long, value double")


def resistance(edges: DataFrame, group: str, w: str) -> DataFrame:
    """(group, a, b, r): effective resistance of all pairs of a group's graph, by the pseudoinverse."""

    def run(key, pdf):
        ids, m = _matrix(pdf, w)
        p = np.linalg.pinv(np.diag(m.sum(axis=1)) - m)
        r = np.diag(p)[:, None] + np.diag(p)[None, :] - 2 * p
        i, j = np.triu_indices(len(ids), 1)
        return pd.DataFrame({group: key[0], "a": ids[i], "b": ids[j], "r": r[i, j]})

    kind = dict(edges.dtypes)[group]
    return edges.select(group, "a", "b", w).groupBy(group).applyInPandas(run, f"{group} {kind}, a long, b long, r double")


def kmeans(x: np.ndarray, k: int, restarts: int, seed: int, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several runs, renamed by first appearance."""
    rng, best, out = np.random.default_rng(seed), np.inf, None
    for _ in range(restarts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            label = d.argmin(axis=1)
            new = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(axis=1).sum()
        if cost < best - 1e-12:
            best, out = cost, label
    _, first = np.unique(out, return_index=True)
    rank = {out[i]: n for n, i in enumerate(sorted(first))}
    return np.array([rank[v] for v in out])


def spectral_clusters(edges: DataFrame, group: str, w: str, k: int, restarts: int = 8, seed: int = 0) -> DataFrame:
    """(group, id, cluster): k-means on the first k eigenvectors, rows scaled to length 1."""

    def run(key, pdf):
        ids, m = _matrix(pdf, w)
        _, v = np.linalg.eigh(normalised_laplacian(m))
        x = v[:, : min(k, len(ids))]
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({group: key[0], "id": ids, "cluster": kmeans(x, min(k, len(ids)), restarts, seed)})

    kind = dict(edges.dtypes)[group]
    return edges.select(group, "a", "b", w).groupBy(group).applyInPandas(run, f"{group} {kind}, id long, cluster long")


def zones_by_component(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, zone) of all nodes(id): contiguous zones around seeds(id, zone), as ``voronoi``; a component without a seed is one zone, named by its smallest id."""
    comps = materialize(components(edges.select("a", "b"), nodes), "components")
    bare = comps.join(comps.join(seeds, "id", "left_semi").select("comp").distinct(), "comp", "left_anti")
    return voronoi(edges, seeds).unionByName(bare.select("id", F.col("comp").cast(dict(seeds.dtypes)["zone"]).alias("zone")))


def conductance(edges: DataFrame, labels: DataFrame, w: str) -> DataFrame:
    """(cluster, cut, volume, conductance) for labels(id, cluster)."""
    rows = both_directions(edges, [w]).join(labels.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    g = rows.groupBy(F.col("ca").alias("cluster")).agg(F.sum(F.when(F.col("ca") != F.col("cb"), F.col(w)).otherwise(0)).alias("cut"), F.sum(w).alias("volume"))
    rest = F.sum("volume").over(Window.partitionBy()) - F.col("volume")  # one row per cluster
    return g.withColumn("conductance", F.col("cut") / F.nullif(F.least("volume", rest), F.lit(0)))


def representatives(df: DataFrame, key: str, vector: str, n: int, seed: int = 0) -> DataFrame:
    """(key, weight): the nearest row to each of n k-means centres, with its cluster's size. Components are scaled to mean 0 and deviation 1 first, so that
    each counts alike; those that do not vary do not count."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    raw = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw).transform(raw)
    model = KMeans(k=n, seed=seed).fit(x)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    rows = model.transform(x).withColumn("_v", vector_to_array("features")).withColumn("_c", F.get(centres, "prediction"))
    d = F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy("prediction").agg(F.min_by(key, F.struct(d, key)).alias(key), F.count("*").alias("weight")).drop("prediction")
