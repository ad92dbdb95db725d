"""LM scoring by deleted interpolation of uniform, unigram and bigram maximum-likelihood estimates.

Counts come from the training documents: those whose crc32 of the doc_id's decimal text is not ``held_fold`` modulo
``folds`` (a null doc_id counts as the text ``null``). A text's tokens are its words, A-Z lowered, then one end; bigrams
start with a begin mark that is only a context.
p(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1), with b the bucket floor(log2(c(v) + 1)) of the context's
frequency. The weights of each bucket are learned by expectation-maximisation on held-out counts by deletion: for
every training token the estimates are those of the training corpus without the token's document. For EM only, the pair of estimates is
rounded to eighths of an octave, so that its table has a fixed bound; scores use exact counts, and both the score and the base score all of
them. ``left_out_score`` is that of the training corpus without the document (V stays), so that training and held-out documents compare, and a
text that stands elsewhere as well is told from one that does not.

Counts are gathered over all documents and grow with them; they meet the documents by bundle (see bundles.py) and never at
the driver, which sees the EM table and a few totals only.

Defined cases: null and empty texts are one end token; repeated rows are documents of their own; without training
documents N = V = 0 and every probability is 1 / (V + 1); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bundles as B
from weft.llm.common import materialize, read_table

END, BEGIN = 0x8E51D94F6A0B7C23, 0x3B97F1C25D8E4A61
_ODD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: uni and bi: training counts of each token's unigram and bigram; own: those of the document itself, one after the other.
COUNTED = "doc_id long, held_out boolean, n_tokens long, uni binary, bi binary, own binary, begins long"


def is_held_out(doc_id: int | None, folds: int, held_fold: int) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds == held_fold


def _uni(h: np.ndarray) -> np.ndarray:
    return B.mix(h) | np.uint64(1)


def _bi(prev: np.ndarray, h: np.ndarray) -> np.ndarray:
    return B.mix(prev * _ODD + B.mix(h ^ _PAIR)) & ~np.uint64(1)


BEGIN_KEY = int(_uni(np.array([BEGIN], np.uint64))[0])


def tokens(row: dict, folds: int, held_fold: int):
    """(token hashes, previous hashes, tokens per document, training flags per document) of a bundle."""
    vocab: dict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    vocab[b" "]  # the end, which no word equals
    flat: list[int] = []
    sizes = []
    for text in B.texts_of(row["payload"], row["lengths"]):
        words = text.lower().split()
        flat += [vocab[w] for w in words]
        flat.append(0)
        sizes.append(len(words) + 1)
    hashes = np.array([END, *[xxhash.xxh3_64_intdigest(w) for w in list(vocab)[1:]]], dtype=np.uint64)
    h = hashes[np.array(flat, dtype=np.int64)]
    prev = np.concatenate([np.array([BEGIN], np.uint64), h[:-1]])
    starts = np.cumsum([0, *sizes[:-1]])
    prev[starts] = BEGIN
    return h, prev, np.array(sizes), np.array([not is_held_out(d, folds, held_fold) for d in row["ids"]])


def _keys(row: dict, folds: int, held_fold: int):
    h, prev, sizes, train = tokens(row, folds, held_fold)
    every = np.concatenate([_uni(h), _bi(prev, h), np.full(len(sizes), BEGIN_KEY, np.uint64)])
    return every, np.concatenate([np.repeat(train, sizes)] * 2 + [train]), sizes, train


def count(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> tuple[DataFrame, int, int]:
    """(COUNTED rows: for every document and token its unigram's and bigram's training count; N; V)."""
    packed = B.bundle(docs)

    def keys_of(row: dict):
        every, train, _, _ = _keys(row, folds, held_fold)
        keys, inverse = np.unique(every, return_inverse=True)
        return keys, np.bincount(inverse, weights=train, minlength=len(keys))

    answers = B.total_counts(packed, keys_of, B.part_bits(packed, 0.12), ignore=BEGIN_KEY)
    total = answers.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()

    def each(row: dict, totals: np.ndarray) -> pa.Table:
        every, _, sizes, train = _keys(row, folds, held_fold)
        _, inverse = np.unique(every, return_inverse=True)
        of = totals[inverse]
        n, docs_ = int(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)
        _, place, times = np.unique(np.concatenate([docs_, docs_]) * len(totals) + inverse[: 2 * n], return_inverse=True, return_counts=True)
        own = (times[place] * np.repeat(np.tile(train, 2), np.tile(sizes, 2))).astype(np.uint32)
        ends = np.cumsum(sizes)
        cut = [slice(b - s, b) for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        begins = int(of[-1])
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(~train), "n_tokens": pa.array(sizes, pa.int64()),
            "uni": pa.array([B.pack_numbers(of[c]) for c in cut], pa.binary()), "bi": pa.array([B.pack_numbers(of[n:][c]) for c in cut], pa.binary()),
            "own": pa.array([B.pack_numbers(np.concatenate([own[c], own[n:][c]])) for c in cut], pa.binary()), "begins": pa.array([begins] * len(sizes), pa.int64()),
        })

    return materialize(B.with_totals(packed, answers, each, COUNTED), "lm-counts"), int(total[0]), int(total[1])


def _counts(batch: pa.RecordBatch, n: int):
    """For each COUNTED row: (all training counts of its unigrams and bigrams; without its own: bigrams, contexts, unigrams, tokens)."""
    at = {name: i for i, name in enumerate(batch.schema.names)}
    for u, b, o, begins, held in zip(*[batch.column(at[c]).to_pylist() for c in ("uni", "bi", "own", "begins", "held_out")], strict=True):
        uni, bi = B.unpack_numbers(u, np.uint64).astype(np.float64), B.unpack_numbers(b, np.uint64).astype(np.float64)
        own = B.unpack_numbers(o, np.uint32).astype(np.float64)
        rest = uni - own[: len(uni)]
        context = np.concatenate([[begins - (not held)], rest[:-1]])
        yield (uni, bi, np.concatenate([[begins], uni[:-1]])), bi - own[len(uni) :], context, rest, n if held else n - len(uni)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(context + 1.0)).astype(np.int64)


def em_table(counted: DataFrame, n: int) -> np.ndarray:
    """Rows (bucket, eighths of log2 of the bigram estimate, of the unigram estimate, tokens); estimates without the token's document."""

    def run(batches):
        sums: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            parts = []
            for _, bi, context, rest, left in _counts(batch, n):
                with np.errstate(divide="ignore", invalid="ignore"):
                    x2 = np.where((context > 0) & (bi > 0), np.rint(8 * np.log2(bi / context)), -9999)
                    x1 = np.where(rest > 0, np.rint(8 * np.log2(rest / max(left, 1))), -9999)
                parts.append(np.stack([_bucket(context), x2.astype(np.int64), x1.astype(np.int64)]))
            if parts:
                cells, counts = _cells(np.concatenate(parts, axis=1))
                for b, x2, x1, c in zip(*cells.tolist(), counts.tolist(), strict=True):
                    sums[b, x2, x1] += c
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"b": pa.array([k[0] for k in keys], pa.int64()), "x2": pa.array([k[1] for k in keys], pa.int64()), "x1": pa.array([k[2] for k in keys], pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    cells = counted.where("not held_out").select("uni", "bi", "own", "begins", "held_out").mapInArrow(run, "b long, x2 long, x1 long, n long")
    rows = cells.groupBy("b", "x2", "x1").agg(F.sum("n").alias("n")).collect()  # at most 40 buckets x 400 x 400 cells
    return np.array([tuple(r) for r in rows], dtype=np.int64).reshape(-1, 4)


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of (bucket, x2, x1) and their counts."""
    code = (x[0] << 40) | ((x[1] + 10000) << 20) | (x[2] + 10000)
    codes, counts = np.unique(code, return_counts=True)
    return np.stack([codes >> 40, ((codes >> 20) & 0xFFFFF) - 10000, (codes & 0xFFFFF) - 10000]), counts


def learn(table: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (64 buckets x [bigram, unigram, uniform]) by EM; a bucket without tokens takes those of the bucket below."""
    weights = np.tile([0.0, 0.9, 0.1], (64, 1))
    for b in range(64):
        own = table[table[:, 0] == b]
        if not len(own):
            weights[b] = weights[b - 1] if b else weights[b]
            continue
        estimate = lambda x: np.where(x == -9999, 0.0, np.exp2(x / 8.0))
        p = np.stack([estimate(own[:, 1]), estimate(own[:, 2]), np.full(len(own), 1.0 / (v + 1))])
        n, w = own[:, 3].astype(np.float64), np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * n).sum(axis=1) / n.sum()
        w = np.maximum(w, [0.0, 1e-9, 1e-9])  # no token may get probability 0
        weights[b] = w / w.sum()
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def score(counted: DataFrame, n: int, v: int, weights: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            out = {"n_known": [], "base_score": [], "score": [], "left_out_score": []}
            mixed = lambda bi, context, uni, total: float(np.log10((w := weights[_bucket(context)])[:, 0] * np.where(context > 0, bi / np.maximum(context, 1), 0) + w[:, 1] * (uni / max(total, 1)) + w[:, 2] / (v + 1)).sum())
            for (uni, bi, before), own_bi, own_context, rest, left in _counts(batch, n):
                out["n_known"].append(int((uni > 0).sum()))
                out["base_score"].append(float(np.log10((uni + 1) / (n + v + 1)).sum()))
                out["score"].append(mixed(bi, before, uni, n))
                out["left_out_score"].append(mixed(own_bi, own_context, rest, left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at["doc_id"]), batch.column(at["held_out"]), batch.column(at["n_tokens"]), pa.array(out["n_known"], pa.int64()), pa.array([n] * batch.num_rows, pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64()), pa.array(out["left_out_score"], pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "left_out_score"],
            )

    return counted.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, left_out_score double")


def score_documents(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    counted, n, v = count(docs, folds, held_fold)
    return score(counted, n, v, learn(em_table(counted, n), v))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
