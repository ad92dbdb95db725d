"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

A window is ``window`` consecutive words of an item (a shorter item is one window). Its set is its ``shingle``-word
shingles. Containment has to be whole, so the necessary prefix of a window, in order of rarity over all documents, is its
one rarest shingle: a document that holds the window holds that shingle. Each occurrence of a prefix shingle is joined with
the windows that have it as prefix; the positional bound fixes where the window would begin, the length bound drops what
would run over either end, and the words in between are compared one by one.

Items are handled in blocks of about ``block_words`` words (a longer item is a block), some 100 MB of index, whatever the benchmark's size;
with several blocks each reads all documents and their hits are merged by row. An item is never cut.

Defined cases: null and empty texts have no words and are not contaminated; items without words, or with a null item_id,
are left out; repeated items count once; repeated documents are judged one by one; an empty benchmark marks nothing; columns
of docs stay as they are, whatever their names: the result is one more column, a struct named by ``into`` (with underscores behind
it, where docs has that name already).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import WORD_TABLE, free_name, materialize, read_table

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])
HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.LongType())),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class Items:
    """The windows of one block of items, with their words as numbers."""

    def __init__(self, items: list[tuple[int, bytes]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows[tuple(ids[i : i + window])].add(item)
        self.shingle = shingle
        self.prefixes: dict[int, dict[tuple[int, ...], list[tuple[tuple[int, ...], int]]]] = {}

    def width(self, window: tuple[int, ...]) -> int:
        return min(self.shingle, len(window))

    def shingles(self) -> dict[int, np.ndarray]:
        """Sorted keys of all shingles, by width."""
        found = defaultdict(set)
        for w in self.windows:
            k = self.width(w)
            found[k].update(self.key(w[i : i + k]) for i in range(len(w) - k + 1))
        return {k: np.array(sorted(v), dtype=np.uint64) for k, v in found.items()}

    def key(self, ids: tuple[int, ...]) -> int:
        out = 0
        for x in ids:
            out = (out * 0x9E3779B97F4A7C15 + x + 1) & 0xFFFFFFFFFFFFFFFF
        return out

    def keys(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Keys of all k-word shingles of a text; equal keys of other shingles are told apart by the word comparison."""
        out = np.zeros(max(0, len(ids) - k + 1), dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[j : len(ids) - k + 1 + j] + 1).astype(np.uint64)
        return out

    def number(self, text: bytes | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)

    def order(self, rarity: dict[tuple[int, int], int]) -> None:
        """Chooses each window's prefix: its rarest shingle, the first of equals by key."""
        posts = defaultdict(lambda: defaultdict(list))
        for w in self.windows:
            k = self.width(w)
            _, key, at = min((rarity.get((k, key := self.key(w[i : i + k])), 0), key, i) for i in range(len(w) - k + 1))
            posts[k][key].append((w, at))
        self.posts = {k: dict(v) for k, v in posts.items()}
        self.prefixes = {k: np.array(sorted(v), dtype=np.uint64) for k, v in posts.items()}

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words, hit spans, items) of a text."""
        ids, spans, items = self.number(text), [], set()
        n = len(ids)
        for k, prefixes in self.prefixes.items():
            keys = self.keys(ids, k)
            if not len(keys):
                continue
            slot = np.minimum(np.searchsorted(prefixes, keys), len(prefixes) - 1)
            for p in np.flatnonzero((prefixes[slot] == keys) & (ids[: len(keys)] >= 0)).tolist():
                for w, at in self.posts[k][int(keys[p])]:
                    start = p - at
                    if start >= 0 and start + len(w) <= n and tuple(ids[start : start + len(w)].tolist()) == w:
                        spans.append((start, start + len(w)))
                        items |= self.windows[w]
        return n, spans, items


def _hit_words(spans: list[tuple[int, int]]) -> int:
    total, upto = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def _verdict(n: int, spans: list[tuple[int, int]], items: set[int]) -> dict:
    hit = _hit_words(spans)
    names = ",".join(sorted(map(str, items)))
    return {"n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(names.encode()).hexdigest(), "contaminated": hit > 0 and 20 * hit >= n}


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _rarity(docs: DataFrame, index) -> dict[tuple[int, int], int]:
    """In how many documents each shingle of the block occurs: (width, key) -> count, for all documents."""

    def count(batches):
        block, totals = index.value, defaultdict(int)
        known = block.shingles()
        for batch in batches:
            for text in _texts(batch):
                ids = block.number(text)
                for k, keys in known.items():
                    found = block.keys(ids, k)
                    slot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    for x in np.unique(found[keys[slot] == found]).tolist():
                        totals[k, x] += 1
        rows = list(totals.items())
        yield pa.RecordBatch.from_pydict({"k": pa.array([k for (k, _), _ in rows], pa.int32()), "key": pa.array(np.array([x for (_, x), _ in rows], dtype=np.uint64).view(np.int64)), "n": pa.array([n for _, n in rows], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    return {(r["k"], r["key"] & 0xFFFFFFFFFFFFFFFF): r["n"] for r in rows.collect()}  # at most one row per shingle of the block


def annotate(docs: DataFrame, benchmark: DataFrame, into: str = "_decon", window: int = 13, shingle: int = 3, block_words: int = 200_000) -> DataFrame:
    """docs with a struct column ``into``: n_words, n_hit, n_items, items_sha256, contaminated."""
    spark, into, number = docs.sparkSession, free_name(docs, into), free_name(docs, "_weft_row")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // (block_words * 4)))  # a word with its blank has over four characters in running text

    def block(b: int):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        index = Items([(r["item_id"], r["text"].encode()) for r in own.collect()], window, shingle)
        index.order(_rarity(docs, spark.sparkContext.broadcast(index)))
        return spark.sparkContext.broadcast(index)

    def judged(index):
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

        def run(batches):
            for batch in batches:
                own = pa.array([_verdict(*index.value.find(t)) for t in _texts(batch)], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, into])

        return run

    def hits(index):
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])

        def run(batches):
            for batch in batches:
                found = [index.value.find(t) for t in _texts(batch)]
                own = pa.array([{"n_words": n, "spans": [x for s in sorted(set(spans)) for x in s], "items": sorted(its)} for n, spans, its in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), own], names=[number, "hits"])

        return run

    if n_blocks == 1:
        return docs.mapInArrow(judged(block(0)), T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "decon-rows")
    schema = T.StructType([T.StructField(number, T.LongType()), T.StructField("hits", HITS)])
    every = [rows.select(number, "text").mapInArrow(hits(block(b)), schema) for b in range(n_blocks)]
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)

    def merged(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                spans = [x for p in parts for x in zip(p["spans"][::2], p["spans"][1::2], strict=True)]
                out.append(_verdict(parts[0]["n_words"], spans, {i for p in parts for i in p["items"]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]))], names=[number, into])

    whole = found.groupBy(number).agg(F.collect_list("hits").alias("parts")).mapInArrow(merged, T.StructType([T.StructField(number, T.LongType()), T.StructField(into, RESULT)]))
    return rows.join(whole, number).drop(number)


#: Brute force: every 13-word window of every document against every window of every item.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(13, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "_decon.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's filter: contaminated documents go."""
    into = free_name(docs, "_weft_decon")
    out = annotate(docs, read_table(spark, sf_dir, "benchmark"), into=into)
    return out.where(~F.col(into)["contaminated"]).select(*[f"`{c}`" for c in docs.columns])
