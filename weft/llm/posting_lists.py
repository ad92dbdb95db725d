"""Approximate nearest neighbours by inner product: balanced posting lists.

* Equal vectors are one entry with its smallest ids (no more than a result has rows can matter), so that a vector that a third of
  all rows hold is one entry as well.
* Inner products become distances: a further component lifts every entry to the largest norm.
* Centroids come from a bounded sample, halved again and again by the nearer of two centres until the parts are small: all lists
  expect the same number of entries. Their number grows with the table up to ``most_centroids``.
* A graph over the centroids (nearest ones, a ring, some long edges), kept in memory by every task, is searched best first for whole
  batches at once.
* An entry goes to its nearest list, and to others that are nearly as near: boundary entries stand in several.
* A query takes the lists whose centroids are within a ratio of its nearest one's distance, and more until they hold enough entries.
* Lists are cut into chunks of bounded size; chunks meet the queries of their list, packed too, in one equi-join.

Scores are inner products of the vectors as given, in doubles, ranked by score, then id.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part (nor do those whose squared norm is no
double, and rows without id); rows are known by
id, so that a repeated row counts once, an id with several vectors by its best, and a query never finds its own id (with several vectors it
is asked once for each); vectors of different lengths are filled up with zeros; an
empty table and a table without queries have empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import materialize, read_table

ENTRY = "key binary, id long, vec binary, norm2 double"


def entries(df: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """ENTRY rows: a digest of the vector, the row's id, the vector as doubles, its squared norm."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, vectors, norms, seen = [], [], [], [], set()
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.zeros(width)
                x[: len(v)] = v
                norm = float(x @ x)
                if not np.isfinite(norm) or not x.any():
                    continue
                raw = (x + 0.0).tobytes()  # no negative zero
                key = hashlib.blake2b(raw, digest_size=16).digest()
                if (i, key) not in seen:
                    seen.add((i, key))
                    keys.append(key), ids.append(i), vectors.append(raw), norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], ["key", "id", "vec", "norm2"])

    return df.select(F.col(id_col).cast("long"), F.col(vector)).mapInArrow(read, ENTRY)


class Index:
    """Centroids of balanced lists with their graph."""

    def __init__(self, sample: np.ndarray, top: float, lists: int, degree: int = 24, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.top = top
        lifted = self.lift(sample)
        parts, most = [np.arange(len(lifted))], max(1, -(-len(lifted) // max(lists, 1)))
        centroids = []
        while parts:
            rows = parts.pop()
            x = lifted[rows]
            if len(rows) <= most:
                centroids.append(x.mean(axis=0))
                continue
            two = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(6):
                nearer = np.argsort(((x - two[0]) ** 2).sum(axis=1) - ((x - two[1]) ** 2).sum(axis=1), kind="stable")
                half = len(x) // 2
                two = np.stack([x[nearer[:half]].mean(axis=0), x[nearer[half:]].mean(axis=0)])
            parts += [rows[nearer[:half]], rows[nearer[half:]]]
        self.centroids = c = np.stack(centroids)
        k, squares = len(c), (c * c).sum(axis=1)
        near = np.zeros((k, min(degree, k - 1)), np.int64)
        for a in range(0, k, 512):
            d = squares[None] - 2 * c[a : a + 512] @ c.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 512] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        ring = (np.arange(k)[:, None] + np.array([1, k - 1])) % k
        self.graph = np.concatenate([near, ring, rng.integers(k, size=(k, 4))], axis=1)
        self.starts = np.unique(np.linspace(0, k - 1, min(k, 48)).astype(int))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """A further component brings each vector to the largest norm."""
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def aim(self, q: np.ndarray) -> np.ndarray:
        """A query at the largest norm: its distances order entries by inner product."""
        return np.concatenate([q * np.sqrt(self.top / np.maximum(1e-300, (q * q).sum(axis=1, keepdims=True))), np.zeros((len(q), 1))], axis=1)

    def search(self, x: np.ndarray, beam: int, step: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the ``beam`` nearest found for each row, nearest first: best-first search of the graph for all rows at once."""
        c, k, n = self.centroids, len(self.centroids), len(x)
        squares, own = (c * c).sum(axis=1), (x * x).sum(axis=1, keepdims=True)
        beam = min(beam, k)
        width = max(beam, len(self.starts))
        at = np.full((n, width), -1)
        dist = np.full((n, width), np.inf)
        at[:, : len(self.starts)] = self.starts
        dist[:, : len(self.starts)] = squares[self.starts] - 2 * x @ c[self.starts].T
        seen, done = np.zeros((n, k + 1), bool), np.zeros((n, width), bool)
        seen[:, self.starts] = True
        order = np.argsort(dist, axis=1)
        at, dist = np.take_along_axis(at, order, 1)[:, :beam], np.take_along_axis(dist, order, 1)[:, :beam]
        done = at < 0
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], np.inf, dist[live])
            pick = np.argsort(open_, axis=1)[:, :step]
            ok = np.isfinite(np.take_along_axis(open_, pick, 1))
            more = ok.any(axis=1)
            live, pick, ok = live[more], pick[more], ok[more]
            if not len(live):
                break
            nodes = np.where(ok, np.take_along_axis(at[live], pick, 1), -1)
            mark = done[live]
            np.put_along_axis(mark, pick, True, 1)
            done[live] = mark
            to = np.where(nodes[:, :, None] >= 0, self.graph[nodes], k).reshape(len(live), -1)
            to.sort(axis=1)
            to[:, 1:][to[:, 1:] == to[:, :-1]] = k
            to[seen[live[:, None], to]] = k
            seen[live[:, None], to] = True
            seen[:, k] = False
            new = np.where(to < k, squares[np.minimum(to, k - 1)] - 2 * np.einsum("ij,ikj->ik", x[live], c[np.minimum(to, k - 1)]), np.inf)
            all_at, all_dist = np.concatenate([at[live], np.where(to < k, to, -1)], axis=1), np.concatenate([dist[live], new], axis=1)
            all_done = np.concatenate([done[live], to >= k], axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            at[live], dist[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_at, all_dist, all_done))
        return at, np.sqrt(np.maximum(0.0, dist + own))


def _batched(n: int, size: int = 128) -> Iterator[slice]:
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


def _listed(rows: DataFrame, index, width: int, choose, extra: list[str], schema: str) -> DataFrame:
    """rows, once for each list that ``choose(index, matrix)`` names: (row, list) index pairs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for part in _batched(len(raw)):
                at, lists = choose(index.value, np.frombuffer(b"".join(raw[part]), float).reshape(-1, width))
                take = pa.array(at + part.start)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *[c.take(take) for c in batch.columns]], ["list", "vec", *extra])

    return rows.select("vec", *extra).mapInArrow(deal, schema)


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, then id; an id counts once."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return scores[keep], ids[keep]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, width)


def _scan(x: np.ndarray, ids: np.ndarray, ends: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (scores, ids) of the k best rows of a chunk: vectors x, of which number n has the ids ends[n] to ends[n + 1]."""
    first, most = ids[ends[:-1]], min(k, len(x))
    alone = len(ids) == len(x)
    for part in _batched(len(q), 256):
        near = q[part] @ x.T
        at = np.argpartition(-near, most - 1, axis=1)[:, :most]
        cut = np.take_along_axis(near, at, 1).min(axis=1, keepdims=True)
        close = near >= cut - 1e-12 * (1 + np.abs(cut))  # equal ones as well, whatever their rounding
        exact = (x[at] * q[part][:, None, :]).sum(axis=2)
        order = np.lexsort((first[at], -exact), axis=1)
        scores, names = np.take_along_axis(exact, order, 1), first[np.take_along_axis(at, order, 1)]
        plain = (close.sum(axis=1) == most) & alone & (len(np.unique(first)) == len(first))
        for row in range(len(near)):
            if plain[row]:
                yield scores[row], names[row]
                continue
            some = np.flatnonzero(close[row])
            sure = (x[some] * q[part.start + row]).sum(axis=1)
            some, sure = (v[np.lexsort((first[some], -sure))[:k]] for v in (some, sure))
            yield _merge(np.repeat(sure, ends[some + 1] - ends[some]), np.concatenate([ids[ends[n] : ends[n + 1]] for n in some]), k)


def search(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = 32_768, per_list: int = 128, most_centroids: int = 4096,
    replicas: int = 3, boundary: float = 1.06, ratio: float = 1.12, beam: int = 256, chunk: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` the k nearest rows of df found, its own id left out.

    ``sample``: distinct vectors that the centroids are fitted on, at most. ``boundary``, ``replicas``: an entry stands in the lists whose centroids
    are within that ratio of its nearest, so many at most. ``ratio``, ``beam``: a query takes lists within that ratio, so many at most
    (more only until they hold k entries); recall is theirs to set."""
    spark, schema = df.sparkSession, "query_id long, rank int, id long, score double"
    width = max(df.agg(F.max(F.size(vector))).first()[0] or 0, queries.agg(F.max(F.size(vector))).first()[0] or 0)
    none = spark.createDataFrame([], schema)
    if width < 1:
        return none
    keep = k + 1  # the query's own row may be one of them
    low = F.dense_rank().over(Window.partitionBy("key").orderBy("id"))
    all_rows = entries(df, id_col, vector, width).withColumn("_k", low).where(F.col("_k") <= keep)
    distinct = materialize(all_rows.groupBy("key").agg(F.first("vec").alias("vec"), F.first("norm2").alias("norm2"), F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    n, top = distinct.agg(F.count("*"), F.max("norm2")).first()
    asked = materialize(entries(queries, id_col, vector, width), "queries")
    if not n or asked.isEmpty():
        return none
    part = min(1.0, 1.1 * sample / n)
    fit = distinct.where(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") < int(part * 2**32)).orderBy("key").limit(sample).select("vec")  # keys are digests: a random sample
    fit_on = np.frombuffer(b"".join(r["vec"] for r in fit.collect()), float).reshape(-1, width)
    if not len(fit_on):
        fit_on = np.frombuffer(distinct.orderBy("key").first()["vec"], float).reshape(1, width)
    index = spark.sparkContext.broadcast(Index(fit_on, top, min(most_centroids, max(1, n // per_list), max(1, len(fit_on) // 4))))
    lists, chunks = len(index.value.centroids), max(1, -(-n * replicas // (len(index.value.centroids) * chunk)))

    def homes(ix: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, d = ix.search(ix.lift(x), 16)
        rows, cols = np.nonzero((d <= boundary * d[:, :1] + 1e-9)[:, :replicas])
        return rows, at[rows, cols]

    posted = _listed(distinct, index, width, homes, ["ids", "key"], "list long, vec binary, ids array<bigint>, key binary")
    at = F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")
    packed = materialize(posted.groupBy("list", at).agg(F.count("*").alias("n"), F.collect_list(F.struct("vec", "ids")).alias("entries")), "posting-lists")
    size = np.zeros(lists, np.int64)
    for r in packed.groupBy("list").agg(F.sum("n").alias("n")).collect():  # a number a list
        size[r["list"]] = r["n"]
    sizes = spark.sparkContext.broadcast(size)

    def chosen(ix: Index, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, d = ix.search(ix.aim(q), beam)
        held = np.cumsum(np.where(at >= 0, sizes.value[at], 0), axis=1)
        wanted = (d <= ratio * d[:, :1] + 1e-9) | (held - np.where(at >= 0, sizes.value[at], 0) < replicas * keep)
        rows, cols = np.nonzero(wanted & (at >= 0))
        return rows, at[rows, cols]

    asking = asked.groupBy("key").agg(F.first("vec").alias("vec"))
    aimed = _listed(asking, index, width, chosen, ["key"], "list long, vec binary, key binary")
    groups = max(1, -(-n // (lists * chunk)))
    salt = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("salt")
    packs = aimed.groupBy("list", salt).agg(F.collect_list(F.struct("vec", "key")).alias("queries")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long"))
    met = packed.select("list", F.col("chunk").cast("long").alias("chunk"), "entries").join(packs, ["list", "chunk"]).select("entries", "queries")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held, wanted = batch.column(0)[row].values, batch.column(1)[row].values
                lists = held.field("ids").to_pylist()
                ends = np.cumsum([0, *map(len, lists)])
                found = list(_scan(_vectors(held.field("vec"), width), np.concatenate(lists), ends, _vectors(wanted.field("vec"), width), keep))
                at = pa.array(np.cumsum([0, *(len(s) for s, _ in found)]), pa.int32())
                scores, ids = (pa.ListArray.from_arrays(at, pa.array(np.concatenate(c))) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([wanted.field("key"), scores, ids], ["key", "scores", "ids"])

    def best(table: pa.Table) -> pa.Table:
        s, i = _merge(table["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False), table["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False), keep)
        return pa.table([table["key"].slice(0, 1).combine_chunks(), pa.array([s.tolist()]), pa.array([i.tolist()])], ["key", "scores", "ids"])

    scanned = met.mapInArrow(scan, "key binary, scores array<double>, ids array<bigint>")
    answers = scanned.groupBy("key").applyInArrow(best, "key binary, scores array<double>, ids array<bigint>")
    hits = F.slice(F.filter(F.arrays_zip("scores", "ids"), lambda h: h["ids"] != F.col("id")), 1, k)
    out = asked.select("key", "id").distinct().join(answers, "key").select("id", F.posexplode(hits).alias("at", "h"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("h.ids").alias("id"), F.col("h.scores").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")
