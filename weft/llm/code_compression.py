"""Vector code compression: product codes whose codebooks are learnt by Lloyd's rounds with heaps.

Vectors become whole numbers and lie in blocks of some thousands, cut into parts. Within a block, each part position has one heap for
each entry of its codebook with the parts that the entry holds, keyed by slack: the lower bound of the distance to any other
entry minus the upper bound of that to its own, plus the entry's cumulative drift so far. A round moves the entries; an
entry's drift grows by its own move and the largest move of another. Only parts whose key is no longer above the drift can have changed
hands: they are popped and measured against all entries exactly, the others are not looked at. A block reports by how much each
entry's sum and count changed, so that the driver gets 8 x 16 sums a round, whatever the size of the table.

Blocks and their heaps are a table in the shared folder; a round reads the last one and writes the next, and the last but one goes.
All sums and comparisons are whole numbers; bounds are doubles, compared with a margin far above their rounding.

Defined cases: a vector that is null or holds null or non-finite components is dropped; a null id is last in order; repeated rows count
each; vectors shorter than the longest, or lengths that 8 does not divide, are filled up with zeros (one zero a part if all are empty);
components are held within +-2^26 after scaling, so that distances stay whole 64-bit numbers; fewer than 16 rows make fewer entries; an
empty table has an empty result; further columns are ignored. A label's error beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import broadcast_if_small, discard, materialize, read_table

#: More than the rounding of any bound below 2^32, less than any gap that matters.
MARGIN = 1e-3
STATE = "ids array<bigint>, labels array<bigint>, parts binary, keys binary, members binary, sizes binary, delta array<bigint>"
FIELDS = ["ids", "labels", "parts", "keys", "members", "sizes", "delta"]


class Block:
    """Parts of some vectors (position x row x component) with one heap for each position and entry."""

    def __init__(self, parts: np.ndarray, heaps: list[list[list[tuple[float, int]]]]) -> None:
        self.parts, self.heaps = parts, heaps

    @classmethod
    def fresh(cls, parts: np.ndarray, entries: int) -> Block:
        """No part is held yet: all of them are due, in a heap beside the entries' own."""
        due = [(-np.inf, k) for k in range(parts.shape[1])]
        return cls(parts, [[*([] for _ in range(entries)), list(due)] for _ in parts])

    def reassign(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Parts whose bounds may be violated go to their nearest entry; returns the change of (components' sums, count) by position and entry."""
        positions, entries, width = books.shape
        delta = np.zeros((positions, entries, width + 1), np.int64)
        for p in range(positions):
            due, held = [], []
            for e, heap in enumerate(self.heaps[p]):
                limit = np.inf if e == entries else drift[p, e] + MARGIN
                while heap and heap[0][0] <= limit:
                    due.append(heapq.heappop(heap)[1])
                    held.append(e)
            del self.heaps[p][entries:]
            step = max(1, (1 << 20) // (entries * width))
            for at in range(0, len(due), step):
                rows, old = np.array(due[at : at + step]), np.array(held[at : at + step])
                x = self.parts[p, rows].astype(np.int64)
                d2 = ((x[:, None, :] - books[p][None]) ** 2).sum(axis=2)
                best = d2.argmin(axis=1)  # the first of equal ones
                low = np.sort(d2, axis=1)[:, 1] if entries > 1 else np.full(len(rows), np.inf)
                key = np.sqrt(low.astype(float)) - np.sqrt(d2[np.arange(len(rows)), best].astype(float)) + drift[p, best]
                for e, k, row in zip(best.tolist(), key.tolist(), rows.tolist(), strict=True):
                    heapq.heappush(self.heaps[p][e], (k, row))
                moved = old != best
                one = np.concatenate([x, np.ones((len(rows), 1), np.int64)], axis=1)[moved]
                np.add.at(delta[p], best[moved], one)
                was = old[moved] < entries
                np.subtract.at(delta[p], old[moved][was], one[was])
        return delta

    def codes(self) -> np.ndarray:
        out = np.zeros(self.parts.shape[:2], np.int64)
        for p, heaps in enumerate(self.heaps):
            for e, heap in enumerate(heaps):
                out[p, [row for _, row in heap]] = e
        return out

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        flat = [item for heaps in self.heaps for heap in heaps for item in heap]
        sizes = np.array([len(heap) for heaps in self.heaps for heap in heaps], np.int32)
        return self.parts.tobytes(), np.array([k for k, _ in flat]).tobytes(), np.array([r for _, r in flat], np.int32).tobytes(), sizes.tobytes()

    @classmethod
    def unpacked(cls, rows: int, positions: int, parts: bytes, keys: bytes, members: bytes, sizes: bytes) -> Block:
        items = list(zip(np.frombuffer(keys).tolist(), np.frombuffer(members, np.int32).tolist(), strict=True))
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        heaps = [items[a:b] for a, b in zip([0, *ends], ends, strict=False)]  # arrays in heap order are heaps
        entries = len(heaps) // positions
        return cls(np.frombuffer(parts, np.int32).reshape(positions, rows, -1), [heaps[p * entries : (p + 1) * entries] for p in range(positions)])


def _cut(lists: list, scale: int, positions: int, width: int) -> np.ndarray:
    """Whole numbers of vectors, position x row x component, filled up with zeros."""
    out = np.zeros((len(lists), positions * width), np.int32)
    for k, v in enumerate(lists):
        out[k, : len(v)] = np.clip(np.floor(np.asarray(v, float) * scale), -(2.0**26), 2.0**26)
    return np.ascontiguousarray(out.reshape(len(lists), positions, width).transpose(1, 0, 2))


def _blocks(kept: DataFrame, books: np.ndarray, scale: int, size: int) -> DataFrame:
    """Blocks of ``size`` rows with their first assignment; a block takes rows of one partition, over its batches."""
    positions, entries, width = books.shape
    still = np.zeros((positions, entries))

    def block(rows: list[tuple]) -> tuple:
        ids, labels, vectors = zip(*rows, strict=True)
        b = Block.fresh(_cut(vectors, scale, positions, width), entries)
        delta = b.reassign(books, still)
        return list(ids), list(labels), *b.packed(), delta.ravel().tolist()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(rows) >= size:
                yield _batch([block(rows[:size])])
                del rows[:size]
        if rows:
            yield _batch([block(rows)])

    return kept.mapInArrow(build, STATE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FIELDS)


def _each(state: DataFrame, books: np.ndarray, drift: np.ndarray, give, schema: str) -> DataFrame:
    """give(ids, labels, block, delta) of every block after it has met the new codebooks."""
    positions = len(books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, *packed = (c[k].as_py() for c in batch.columns[:6])
                b = Block.unpacked(len(ids), positions, *packed)
                yield give(ids, labels, b, b.reassign(books, drift))

    return state.mapInArrow(step, schema)


def _totals(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the blocks' changes: one number for each position, entry and component."""
    rows = state.select(F.posexplode("delta").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows:
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def _moved(books: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codebooks (floors of means; unused entries stay) and by how much each entry's drift grows: its move and the largest other one."""
    count = sums[:, :, -1:]
    new = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
    step = np.sqrt(((new - books) ** 2).sum(axis=2).astype(float))
    order = np.sort(step, axis=1)
    others = np.where(step == order[:, -1:], order[:, -2:-1] if step.shape[1] > 1 else 0.0, order[:, -1:])
    twice = (step == order[:, -1:]).sum(axis=1, keepdims=True) > 1
    return new, step + np.where(twice, order[:, -1:], others)


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096, positions: int = 8, entries: int = 16, rounds: int = 6, block: int = 4096) -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, code, error) of every kept row, and the codebooks (position x entry x component; None without rows)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    kept = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    schema = "id long, label long, code string, error long"
    if not first:
        return df.sparkSession.createDataFrame([], schema), None
    width = max(1, -(-kept.agg(F.max(F.size("v"))).first()[0] // positions))
    books = _cut([r["v"] for r in first], scale, positions, width).astype(np.int64)
    drift = np.zeros(books.shape[:2])
    state = materialize(_blocks(kept, books, scale, block), "code-blocks")
    sums = np.zeros((*books.shape[:2], width + 1), np.int64)
    for k in range(rounds):
        sums += _totals(state, sums.shape)
        books, grown = _moved(books, sums)
        drift = drift + grown
        if k + 1 < rounds:
            old, state = state, materialize(_each(state, books, drift, lambda ids, labels, b, delta: _batch([(ids, labels, *b.packed(), delta.ravel().tolist())]), STATE), "code-blocks")
            discard(old)

    def codes(ids: list, labels: list, b: Block, _: np.ndarray) -> pa.RecordBatch:
        code = b.codes()
        error = sum(((b.parts[p].astype(np.int64) - books[p][code[p]]) ** 2).sum(axis=1) for p in range(positions))
        text = ["".join(f"{c:02x}" for c in row) for row in code.T.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(text), pa.array(error)], ["id", "label", "code", "error"])

    out = materialize(_each(state, books, drift, codes, schema), "codes")
    discard(state)
    return out, books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
    by_label = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    rows = codes.join(broadcast_if_small(by_label, 100_000), F.col("label").eqNullSafe(F.col("_l")))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(rounds: int = 6) -> str:
    """The same codes by plain Lloyd rounds: every part against every entry."""
    steps, floor = [], "((s % c) + c) % c"
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.i, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d
  FROM x JOIN b{k} b ON b.p = x.p AND b.j = x.j GROUP BY ALL) GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, j, ((s - {floor}) // c)::BIGINT AS v FROM
  (SELECT x.p, a.e, x.j, sum(x.v)::BIGINT AS s, count(*) AS c FROM a{k} a JOIN x ON x.i = a.i AND x.p = a.p GROUP BY ALL)) n ON n.p = b.p AND n.e = b.e AND n.j = b.j)""")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, embedding AS v, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT i, (j - 1) // w AS p, (j - 1) % w AS j, floor(4096 * v[j]::DOUBLE)::BIGINT AS v FROM (SELECT i, v, w, unnest(range(1, len(v) + 1)) AS j FROM k)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, j, v FROM x WHERE i <= 16),
{", ".join(steps)},
f AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f USING (i), h"""
