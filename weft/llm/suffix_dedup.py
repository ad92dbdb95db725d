"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

1. Blocks. A window is ``length`` bytes of one text. Its anchor is its smallest ``gram``-byte hash, the first of equals: equal
   windows have equal anchors at equal places, so that windows with different anchors need no comparison. The consecutive
   windows of one anchor make a stretch of the text; stretches of equal content are one, with a count.
2. A stretch that occurs twice is removed whole. One that is unique, but whose anchor also has other stretches, goes to the
   block of its anchor with those.
3. Each block gets a suffix array by linear grouping (suffix_sort.py); equal windows are neighbours in it.
4. A block of over ``block`` stretches (a passage with as many different surroundings) is first split: its windows by where
   their anchor lies, in ``ways`` ranges, and each range by the bytes that all its windows must have in common around the anchor. Equal
   windows stay together, pieces that became equal are one, and what is still too large is split again; a range of one place has
   equal windows only. The blocks that come out are suffix-sorted like the others.
Counts of anchors and stretches are exchanged as packed keys; two stretches are equal if two independent hashes of 63 bits say so, and
windows are compared as bytes.

Defined cases: a null text is empty (and stays null in remove); texts under ``length`` bytes lose nothing by themselves;
repeated rows are documents of their own, so each loses what it shares; an empty table gives no rows; ids and other
columns are free. Cut texts are decoded with whole characters only: a byte of a character of which other bytes were
removed goes too (kept_sha256 is over the remaining bytes as they are).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bundles as B
from weft.llm.common import free_name, materialize, read_table
from weft.llm.suffix_sort import repeated

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
STRETCH = "anchor long, id long, left int, data binary, owner long"
#: A piece of a block: its windows have the anchor at offsets low to high - 1; shift: its first window in the stretch ``id`` of ``owner``.
PIECE = "sub long, low int, high int, content long, left int, data binary, owner long, id long, shift int"
#: A bundle's open stretches, and one row without anchor: its spans that are removed whole, ids and first windows of the others.
OPEN = STRETCH + ", whole binary, ids binary, firsts binary"
ANSWER = "owner long, id long, runs array<int>"
_CHUNK = 1 << 17


def stretches(data: bytes, ends: np.ndarray, length: int, gram: int):
    """(first window, last window, anchor position, anchor hash) of each stretch; ends: where the texts in data end."""
    out = []
    at, n = 0, len(data)
    text = np.frombuffer(data, np.uint8)
    ends = ends[ends > 0]
    while at + length <= n:
        part = text[at : at + _CHUNK + length - 1].astype(np.uint64)
        windows = len(part) - length + 1
        h, k = (part + np.uint64(1)) * _ODD, 1
        while k < gram:
            h = (h[:-k] * _ODD + h[k:]) ^ (h[:-k] >> np.uint64(29))
            k *= 2
        h = B.mix(h)
        x = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, k = length - gram + 1, 1
        while 2 * k <= width:
            x = np.minimum(x[:-k], x[k:])
            k *= 2
        if k < width:
            x = np.minimum(x[: windows], x[width - k : width - k + windows])
        p = (x[:windows] & _LOW).astype(np.int64)
        first = np.arange(at, at + windows)
        i = np.flatnonzero(first + length <= ends[np.searchsorted(ends, first, side="right")])
        if len(i):
            q = p[i]
            cut = np.flatnonzero((np.diff(q) != 0) | (np.diff(i) != 1))
            a, b = i[np.concatenate([[0], cut + 1])], i[np.concatenate([cut, [len(i) - 1]])]
            out.append(np.stack([a + at, b + at, p[a] + at, h[p[a]].view(np.int64)]))
        at += windows
    if not out:
        return np.zeros((4, 0), np.int64)
    found = np.concatenate(out, axis=1)
    if len(out) > 1:  # a stretch may have been cut between two chunks
        joint = np.flatnonzero((found[2, 1:] == found[2, :-1]) & (found[0, 1:] == found[1, :-1] + 1))
        for j in joint[::-1].tolist():
            found[1, j] = found[1, j + 1]
        found = np.delete(found, joint + 1, axis=1)
    return found


def _read(row: dict, length: int, gram: int):
    """(data, text ends, stretches, anchor keys with lowest bit 1, two keys of each stretch with lowest bit 0) of a bundle."""
    data = B.unsqueeze(row["payload"])
    ends = np.cumsum(np.maximum(np.array(row["lengths"], dtype=np.int64), 0))
    found = stretches(data, ends, length, gram)
    view = memoryview(data)
    digest = xxhash.xxh3_128_intdigest
    both = [digest(view[a : b + length], p - a) for a, b, p in zip(*found[:3].tolist(), strict=True)]
    whole = np.fromiter((x & 0xFFFFFFFFFFFFFFFE for x in both), np.uint64, len(both))
    other = np.fromiter((x >> 64 & 0xFFFFFFFFFFFFFFFE for x in both), np.uint64, len(both))
    return data, ends, found, found[3].view(np.uint64) | np.uint64(1), whole, other


def _positions(keys: np.ndarray, totals: np.ndarray, *wanted: np.ndarray):
    """The totals of each wanted key; keys: all keys of the bundle, totals: by sorted distinct key."""
    every = np.unique(keys)
    return [totals[np.searchsorted(every, w)] for w in wanted]


def _runs(starts: list[int]) -> list[int]:
    """[first, last, first, last, ...] of sorted numbers."""
    x = np.array(starts, dtype=np.int64)
    cut = np.flatnonzero(np.diff(x) != 1)
    return np.stack([x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]], axis=1).reshape(-1).tolist()


def _answers(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    rows = [r for r in rows if r[2]]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([_runs(r[2]) for r in rows], pa.list_(pa.int32()))], names=["owner", "id", "runs"])


def _sorted_blocks(blocks: DataFrame, length: int) -> DataFrame:
    """ANSWER rows of blocks(PIECE) that are small enough to be gathered."""

    def run(batches):
        now, rows = None, []

        def solved():
            if len(rows) < 2 or not any(r["owner"] is not None for r in rows):
                return []
            low, high = rows[0]["low"], rows[0]["high"]
            data = [r["data"] for r in rows]
            hits = repeated(data, [len(d) - length for d in data], length, [r["left"] - low for r in rows], low + length - high + 1)
            return [(r["owner"], r["id"], [r["shift"] + x for x in h]) for r, h in zip(rows, hits, strict=True) if r["owner"] is not None]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["sub"], row["low"]) != now:
                    out += solved()
                    now, rows = (row["sub"], row["low"]), []
                rows.append(row)
            yield _answers(out)
        yield _answers(solved())

    return blocks.repartition("sub").sortWithinPartitions("sub", "low", "content").mapInArrow(run, ANSWER)


def _split(blocks: DataFrame, length: int, ways: int) -> DataFrame:
    """The pieces of blocks(PIECE) by narrower ranges of the anchor's offset and by the bytes that windows of such a range have in common."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                last = len(r["data"]) - length
                edges = sorted({r["low"] + (r["high"] - r["low"]) * k // ways for k in range(ways + 1)})
                for low, high in zip(edges, edges[1:], strict=False):
                    a, b = max(0, r["left"] - high + 1), min(last, r["left"] - low)
                    if a > b:
                        continue
                    data, left = r["data"][a : b + length], r["left"] - a
                    core = data[left - low : left + length - high + 1]
                    sub = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=f"{low} {high}".encode()).digest(), "little", signed=True)
                    content = int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=str(left).encode()).digest(), "little", signed=True)
                    out.append({**r, "sub": sub, "low": low, "high": high, "content": content, "left": left, "data": data, "shift": r["shift"] + a})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema) if out else batch.slice(0, 0)

    return blocks.mapInArrow(run, PIECE)


def _repeats(pieces: DataFrame, length: int, block: int, ways: int = 4) -> DataFrame:
    """ANSWER rows of pieces(PIECE), distinct within each sub. Pieces without owner stand for those that are decided already."""
    names, hits = pieces.columns, None
    while True:
        sizes = pieces.groupBy("sub").agg(F.count("*").alias("n"), F.count("owner").alias("open"))
        sizes = materialize(sizes.where("n > 1 and open > 0").select("sub", "n"), "block-sizes")
        found = _sorted_blocks(pieces.join(sizes.where(F.col("n") <= block).select("sub"), "sub").select(*names), length)
        hits = found if hits is None else hits.union(found)
        if sizes.where(F.col("n") > block).isEmpty():
            return hits
        new = materialize(_split(pieces.join(sizes.where(F.col("n") > block).select("sub"), "sub").select(*names), length, ways), "pieces")
        first = [F.first(c).alias(c) for c in ("low", "high", "left", "data", "id", "shift")]
        same = new.groupBy("sub", "content").agg(F.count("*").alias("n"), F.max("owner").alias("owner"), *first)
        same = materialize(same.withColumn("owner", F.when(F.col("n") == 1, F.col("owner"))), "distinct-pieces")
        equal = new.where("owner is not null").join(same.where("n > 1").select("sub", "content"), ["sub", "content"])
        hits = hits.union(equal.select("owner", "id", F.array("shift", (F.col("shift") + F.length("data") - length).cast("int")).alias("runs")))
        pieces = same.select(*names)


def find(docs: DataFrame, length: int = 200, gram: int = 32, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(the bundles of docs(doc_id, text), per bundle the packed removed spans: bundle, spans): spans are pairs of
    first and end byte offsets in the bundle's texts laid end to end."""
    packed = B.bundle(docs)

    def keys_of(row: dict):
        _, _, _, *keys = _read(row, length, gram)
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        return keys, counts

    totals = B.total_counts(packed, keys_of, B.part_bits(packed, 0.033))

    def candidates(row: dict, total: np.ndarray) -> pa.Table:
        data, _, found, anchors, whole, other = _read(row, length, gram)
        of_anchor, of_whole, of_other = _positions(np.concatenate([anchors, whole, other]), total, anchors, whole, other)
        of_whole = np.minimum(of_whole, of_other)
        open_ = np.flatnonzero(of_anchor > of_whole)
        _, once = np.unique(whole[open_], return_index=True)
        i = open_[once]
        a, b, p = found[0][i].tolist(), found[1][i].tolist(), found[2][i].tolist()
        unique = (of_whole[i] == 1).tolist()
        kept = of_whole > 1
        left = np.flatnonzero(~kept)
        none = [None] * len(i)
        return pa.table({
            "anchor": pa.array([*anchors[i].view(np.int64).tolist(), None], pa.int64()), "id": pa.array([*whole[i].view(np.int64).tolist(), None], pa.int64()),
            "left": pa.array([*[y - x for x, y in zip(a, p, strict=True)], None], pa.int32()), "data": pa.array([*[data[x : y + length] for x, y in zip(a, b, strict=True)], None], pa.binary()),
            "owner": pa.array([*[row["bundle"] if u else None for u in unique], row["bundle"]], pa.int64()),
            "whole": pa.array([*none, B.pack_numbers(found[:2, kept].T.copy().reshape(-1))], pa.binary()),
            "ids": pa.array([*none, B.pack_numbers(whole[left])], pa.binary()), "firsts": pa.array([*none, B.pack_numbers(found[0, left])], pa.binary()),
        })

    every = materialize(B.with_totals(packed, totals, candidates, OPEN), "open")
    rows = every.where("anchor is not null").groupBy("anchor", "id").agg(F.first("left").alias("left"), F.first("data").alias("data"), F.max("owner").alias("owner"))
    pieces = rows.select(F.col("anchor").alias("sub"), F.lit(0).alias("low"), F.lit(length - gram + 1).alias("high"), F.col("id").alias("content"), "left", "data", "owner", "id", F.lit(0).alias("shift"))
    hits = materialize(_repeats(materialize(pieces, "stretches"), length, block), "repeats").groupBy("owner").agg(F.collect_list(F.struct("id", "runs")).alias("hits"))

    base = every.where("anchor is null").select(F.col("owner").alias("bundle"), "whole", "ids", "firsts")
    both = base.join(hits.withColumnRenamed("owner", "bundle"), "bundle", "left").select("bundle", "whole", "ids", "firsts", "hits")

    def merge(batches):
        for batch in batches:
            packed_spans = []
            for row in B.rows_of(batch):
                first_last = B.unpack_numbers(row["whole"], np.int64).reshape(-1, 2)
                starts = dict(zip(B.unpack_numbers(row["ids"], np.int64).tolist(), B.unpack_numbers(row["firsts"], np.int64).tolist(), strict=True)) if row["hits"] else {}
                more = [(starts[h["id"]] + a, starts[h["id"]] + b) for h in row["hits"] or [] for a, b in zip(h["runs"][::2], h["runs"][1::2], strict=True)]
                every = np.concatenate([first_last, np.array(more, dtype=np.int64).reshape(-1, 2)])
                every = every[np.argsort(every[:, 0], kind="stable")]
                every[:, 1] += length
                if len(every):
                    reach = np.maximum.accumulate(every[:, 1])
                    new = np.concatenate([[True], every[1:, 0] > reach[:-1]])
                    every = np.stack([every[new, 0], np.concatenate([reach[:-1][new[1:]], reach[-1:]])], axis=1)
                packed_spans.append(B.pack_numbers(every.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed_spans, pa.binary())], names=["bundle", "spans"])

    return packed, materialize(both.mapInArrow(merge, "bundle long, spans binary"), "spans")


def _documents(packed: DataFrame, spans: DataFrame, make, schema: str) -> DataFrame:
    """make(ids, lengths, texts, spans by text) -> table, for every bundle."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = next(B.rows_of(left.combine_chunks()))
        every = B.unpack_numbers(right.column("spans")[0].as_py(), np.int64).reshape(-1, 2)
        texts, at, out = B.texts_of(row["payload"], row["lengths"]), 0, []
        k = 0
        for text in texts:
            own, end = [], at + len(text)
            while k < len(every) and every[k, 0] < end:  # a span may run on from one text's end to the next one's start
                if text:  # an empty one inside a span has none of its bytes
                    own.append((int(max(every[k, 0], at)) - at, int(min(every[k, 1], end)) - at))
                if every[k, 1] > end:
                    break
                k += 1
            out.append(own)
            at = end
        return make(row, texts, out)

    return packed.groupBy("bundle").cogroup(spans.groupBy("bundle")).applyInArrow(run, schema)


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def report(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    packed, spans = find(docs, **parameters)

    def make(row, texts, own):
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in s) for s in own], pa.int64()), "n_spans": pa.array([len(s) for s in own], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(_rest(t, s)).hexdigest() for t, s in zip(texts, own, strict=True)], pa.string()),
        })

    return _documents(packed, spans, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the repeated bytes cut from ``text``, other columns as they are."""
    row, rest = free_name(docs, "_weft_row"), free_name(docs, "_weft_cut")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "suffix-rows")
    packed, spans = find(rows.select(F.col(row).alias("doc_id"), "text"), **parameters)

    def make(bundle, texts, own):
        cut = [(i, _rest(t, s).decode("utf-8", "ignore")) for i, t, s in zip(bundle["ids"], texts, own, strict=True) if s]
        return pa.table({row: pa.array([i for i, _ in cut], pa.int64()), rest: pa.array([t for _, t in cut], pa.string())})

    cut = _documents(packed, spans, make, f"`{row}` long, `{rest}` string")
    out = rows.join(cut, row, "left").withColumn(rest, F.coalesce(rest, "text"))
    return out.select(*[F.col(rest if c == "text" else f"`{c}`").alias(c) for c in docs.columns])


#: Brute force: every 200-byte window of every text.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c0 AS (SELECT doc_id, n, k, h[2000 * k + 1:2000 * k + 2400] AS h FROM (SELECT doc_id, n, h, unnest(range(0, n // 1000 + 1)) AS k FROM d WHERE n >= 200)),
w AS (SELECT doc_id, 1000 * k + j AS i, md5_number(h[2 * j + 1:2 * j + 400]) AS g FROM (SELECT doc_id, h, k, unnest(range(0, least(1000, n - 199 - 1000 * k))) AS j FROM c0)),
c AS (SELECT g FROM w GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS gap FROM w JOIN c USING (g)),
k AS (SELECT doc_id, i, sum(coalesce(gap, true)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY 1, 2),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY b) AS b FROM s GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda j: h[CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END:CASE WHEN j = n_spans THEN len(h) ELSE 2 * a[j + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's cutter: repeated bytes go, every document stays; n_chars follows the text."""
    out = remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
