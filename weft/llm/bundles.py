"""Bundles: documents packed into compressed rows, and counts of 64-bit keys over all bundles.

A bundle holds some megabytes of texts, so that per-document work in Python is vectorised and rows stay few. Bundles are
written to the shared folder once; whatever refers to them later is stable, also after executors are lost.

``total_counts`` answers, for every bundle, how often each of its keys occurs in all bundles. Keys go out as one packed
array for each bundle and key range, each key once per bundle with its own count. A range adds up at most about ``fan`` such
arrays. Where there are more bundles, crowds of ``fan`` of them are added up first, each crowd's sums go on as one array for each
finer range, as if it were a bundle, and the totals come back the same way. So a key that stands in every bundle is in no task more
than about ``fan`` times, and arrays stay long, whatever the number of bundles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialize

BUNDLE = "bundle long, raw_bytes long, n_docs int, ids array<long>, lengths array<int>, payload binary"
REQUEST = "bundle long, part long, keys binary, own binary"
ANSWER = "bundle long, part long, totals binary, n_types long, n_tokens long"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(x: np.ndarray) -> bytes:
    """Fixed-width numbers with equal bytes of all numbers side by side, then compressed."""
    return squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()) if len(x) else b""


def unpack_numbers(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(unsqueeze(data), np.uint8).reshape(width, -1).T.copy().reshape(-1).view(dtype) if data else np.zeros(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bundle(docs: DataFrame, raw_bytes: int = 4 << 20) -> DataFrame:
    """Packs docs(doc_id, text), each row once; a null text has length -1. A longer text is a bundle of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, lengths, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

        def out():
            row = [number, size, len(ids), ids, lengths, squeeze(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["bundle", "raw_bytes", "n_docs", "ids", "lengths", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if ids and size + len(text or b"") > raw_bytes:
                    yield out()
                    number, ids, lengths, texts, size = number + 1, [], [], [], 0
                ids.append(doc)
                lengths.append(-1 if text is None else len(text))
                texts.append(text or b"")
                size += len(text or b"")
        if ids:
            yield out()

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, BUNDLE), "bundles")


def texts_of(payload: bytes, lengths: list[int]) -> list[bytes]:
    data, at, out = unsqueeze(payload), 0, []
    for n in lengths:
        out.append(data[at : at + max(0, n)])
        at += max(0, n)
    return out


def rows_of(batch) -> Iterator[dict]:
    """The rows of a table or batch of bundles, one at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def part_bits(bundles: DataFrame, keys_per_byte: float, keys_per_part: int = 2_000_000, fan: int = 8192) -> int:
    """Bits of a key that name its range: as many as let a range of ``fan`` bundles (all, if fewer) hold keys_per_part keys."""
    raw, n = bundles.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)), F.count("*")).first()
    return max(3, int(np.ceil(np.log2(max(1.0, raw * keys_per_byte / keys_per_part * min(1.0, fan / max(n, 1)))))))


def _cut(owner: int, keys: np.ndarray, own: np.ndarray, bits: int) -> pa.RecordBatch:
    """REQUEST rows of one owner's sorted keys, by their first ``bits`` bits."""
    parts, starts = np.unique((keys >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    ends = [*starts[1:].tolist(), len(keys)]
    cut = list(zip(parts.tolist(), starts.tolist(), ends, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([owner] * len(cut), pa.int64()), pa.array([p for p, _, _ in cut], pa.int64()), pa.array([pack_sorted(keys[a:b]) for _, a, b in cut], pa.binary()), pa.array([pack_numbers(own[a:b]) for _, a, b in cut], pa.binary())],
        names=["bundle", "part", "keys", "own"],
    )


def _sum(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(keys of each row, all distinct keys, their sums, places of the rows' keys in them) of REQUEST rows."""
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    own = np.concatenate([unpack_numbers(k, np.uint64) for k in table.column("own").to_pylist()])
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(every), np.uint64)
    np.add.at(totals, inverse, own)
    return keys, every, totals, inverse


def deal(df: DataFrame, groups: int, per_task: int, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as so many groups need, where the session's number of tasks is too small for them."""
    tasks = -(-groups // per_task)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _add_up(requests: DataFrame, owners: int, bits: int, fan: int, ignore: int | None) -> DataFrame:
    """ANSWER rows for REQUEST rows of so many owners, whose parts are the first ``bits`` bits of the keys."""

    def answer(table: pa.Table) -> pa.Table:
        keys, every, totals, inverse = _sum(table)
        marked = ((every & np.uint64(1)) == 1) & (totals > 0)
        if ignore is not None:
            marked &= every != np.uint64(ignore)
        at, first = np.cumsum([0, *map(len, keys)]), [1] + [0] * (len(keys) - 1)
        packed = [pack_numbers(totals[inverse[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"bundle": table.column("bundle"), "part": table.column("part"), "totals": pa.array(packed, pa.binary()), "n_types": pa.array([int(marked.sum()) * f for f in first], pa.int64()), "n_tokens": pa.array([int(totals[marked].sum()) * f for f in first], pa.int64())})

    if owners <= fan:
        return deal(requests, 1 << bits, 8, "part").groupBy("part").applyInArrow(answer, ANSWER)
    crowds = -(-owners // fan)
    finer = bits + min(crowds, fan).bit_length()  # a finer range of all crowds holds no more than a range of one crowd
    dealt = materialize(requests.withColumn("crowd", F.pmod(F.xxhash64("bundle"), F.lit(crowds))), "requests")

    def merge(table: pa.Table) -> pa.Table:
        _, every, totals, _ = _sum(table)
        return pa.Table.from_batches([_cut(table.column("crowd")[0].as_py(), every, totals, finer)])

    dealt = deal(dealt, crowds << bits, 8, "crowd", "part")
    above = _add_up(dealt.groupBy("crowd", "part").applyInArrow(merge, REQUEST), crowds, finer, fan, ignore)
    above = above.select(F.col("bundle").alias("crowd"), F.shiftright("part", finer - bits).alias("part"), F.col("part").alias("finer"), "totals", "n_types", "n_tokens")

    def spread(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, _, _, inverse = _sum(asked)
        order = np.argsort(known.column("finer").to_numpy())
        blobs = known.column("totals").to_pylist()
        totals = np.concatenate([unpack_numbers(blobs[i], np.uint64) for i in order])
        at, rest = np.cumsum([0, *map(len, keys)]), [0] * (len(keys) - 1)
        packed = [pack_numbers(totals[inverse[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        whole = {c: pa.array([sum(known.column(c).to_pylist()), *rest], pa.int64()) for c in ("n_types", "n_tokens")}
        return pa.table({"bundle": asked.column("bundle"), "part": asked.column("part"), "totals": pa.array(packed, pa.binary()), **whole})

    return dealt.groupBy("crowd", "part").cogroup(above.groupBy("crowd", "part")).applyInArrow(spread, ANSWER)


def total_counts(bundles: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], bits: int, ignore: int | None = None, fan: int = 8192) -> DataFrame:
    """ANSWER rows: for each bundle and part, the total count of each of its sorted keys. keys_of(bundle row) gives sorted
    distinct keys and their counts in the bundle. The sums of n_types and n_tokens over all rows count the distinct keys (and
    occurrences) whose lowest bit is 1, but for the key ``ignore``."""

    def ask(batches):
        for batch in batches:
            for row in rows_of(batch):
                keys, own = keys_of(row)
                yield _cut(row["bundle"], keys, own.astype(np.uint64), bits)

    return materialize(_add_up(bundles.mapInArrow(ask, REQUEST), bundles.count(), bits, fan, ignore), "totals")


def with_totals(bundles: DataFrame, answers: DataFrame, each: Callable[[dict, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """each(bundle row, total counts aligned with its sorted keys), for every bundle."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("part").to_numpy())
        blobs = right.column("totals").to_pylist()
        totals = np.concatenate([np.zeros(0, np.uint64), *[unpack_numbers(blobs[i], np.uint64) for i in order]])
        return each(next(rows_of(left.combine_chunks())), totals)

    n = bundles.count()
    return deal(bundles, n, 32, "bundle").groupBy("bundle").cogroup(deal(answers.select("bundle", "part", "totals"), n, 32, "bundle").groupBy("bundle")).applyInArrow(meet, schema)
