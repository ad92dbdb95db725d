"""Vector codes and nearest neighbours against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from weft.llm import code_compression, posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, width=16, seed=1):
    """Rows in clumps, with copies, a hot vector, ties, odd and missing values."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, width))
    rows = [(i, [float(np.float32(v)) for v in middle[i % 7] + rng.normal(size=width) * 0.4], i % 5 if i % 11 else None) for i in range(n)]
    rows += [(n + 1000 + i, rows[3][1], 1) for i in range(120)]  # a hot vector
    rows += [(n + 2000 + i, [0.0] * width, None) for i in range(3)]
    bad = [None, [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0] * (width - 1) + [float("-inf")]]
    rows += [(n + 3000 + i, v, 2) for i, v in enumerate(bad)]
    random.Random(seed).shuffle(rows)
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, rounds=6, positions=8, entries=16):
    """Codes by plain Lloyd rounds in Python numbers."""
    kept = sorted(((i, v, l) for i, v, l in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=1) // positions))
    x = [[[math.floor(4096 * v[p * width + j]) if p * width + j < len(v) else 0 for j in range(width)] for p in range(positions)] for _, v, _ in kept]
    books = [[list(r[p]) for r in x[:entries]] for p in range(positions)]
    d2 = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (d2(r[p], books[p][e]), e)) for p in range(positions)] for r in x]
    for _ in range(rounds):
        codes = assign()
        for p in range(positions):
            for e in range(len(books[p])):
                mine = [r[p] for r, c in zip(x, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = assign()
    out = [(i, "".join(f"{c:02x}" for c in code), sum(d2(r[p], books[p][code[p]]) for p in range(positions)), l) for (i, _, l), r, code in zip(kept, x, codes, strict=True)]
    total = {}
    for _, _, e, l in out:
        total[l] = total.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((i is None, i, code, e, total[l], digest) for i, code, e, l in out)


def codes(spark, rows, tmp_path, schema=SCHEMA, parts=3):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(path)
    got = code_compression.query(spark, str(tmp_path)).collect()
    return sorted((r["vec_id"] is None, r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


def test_codes_by_heaps_are_those_of_plain_rounds(spark, tmp_path):
    rows = vectors()
    want = lloyd(rows)
    assert codes(spark, rows, tmp_path) == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        sql = con.execute(code_compression.oracle()).df()
    assert sorted((False, int(r.vec_id), r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in sql.itertuples()) == want


@pytest.mark.parametrize("case", ["few", "ragged", "copies", "empty vectors", "ids"])
def test_codes_of_odd_tables(spark, tmp_path, case):
    rng = random.Random(2)
    rows = {
        "few": vectors()[:9],
        "ragged": [(i, [rng.uniform(-2, 2) for _ in range(rng.randint(0, 13))], 1) for i in range(60)],
        "copies": [(5, [0.25] * 8, None)] * 40 + [(6, [-0.25] * 8, None)],
        "empty vectors": [(i, [], 3) for i in range(20)],
        "ids": [(None, [0.5] * 8, 1), (None, [1.5] * 8, 1), (-4, [2.5] * 8, 2)] * 7,
    }[case]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert codes(spark, rows, tmp_path) == lloyd(rows)


def test_codes_of_no_rows(spark, tmp_path):
    assert codes(spark, [], tmp_path) == [] and codes(spark, [(1, None, 1)], tmp_path) == []


def test_heaps_leave_most_parts_alone():
    rng = np.random.default_rng(0)
    parts = (rng.normal(size=(1, 2000, 4)) * 300 + rng.integers(4, size=(1, 2000, 1)) * 9000).astype(np.int32)
    books = parts[:, :4].astype(np.int64) * 0 + np.arange(4)[None, :, None] * 9000
    block = code_compression.Block.fresh(parts, 4)
    block.reassign(books, np.zeros((1, 4)))
    before = [list(h) for h in block.heaps[0]]
    block.reassign(books + 10, np.full((1, 4), 40.0))
    assert [list(h) for h in block.heaps[0]] == before  # no bound is violated: nothing is popped
    again = code_compression.Block.unpacked(2000, 1, *block.packed())
    assert again.heaps == block.heaps and (again.codes() == block.codes()).all()


def nearest(rows, k=20):
    """query id -> (score, id) of the k nearest, by all pairs."""
    kept = {(i, tuple(v)) for i, v, _ in rows if i is not None and usable(v) and any(v)}
    width = max((len(v) for _, v in kept), default=0)
    ids = np.array([i for i, _ in kept])
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in kept])
    out = {}
    for a in np.flatnonzero(ids % 20 == 0):
        s = x @ x[a]
        best = sorted((-round(float(s[b]), 9), int(ids[b])) for b in range(len(ids)) if ids[b] != ids[a])[:k]
        out[int(ids[a])] = best
    return out


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = {}
    for r in posting_lists.search(df, df.where("vec_id % 20 = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_all_lists_are_the_nearest(spark):
    rows = vectors()
    assert found(spark, rows, per_list=20, ratio=9.0, chunk=16) == nearest(rows)


def test_recall(spark):
    rows = [r for r in vectors(3000, 32, 4)]
    want, got = nearest(rows), found(spark, rows, per_list=40, sample=900)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: {i: s for s, i in nearest(rows, 10**9)[q]} for q in list(want)[:1]}
    assert all(scores[q][i] == s for q in scores for s, i in got[q])


@pytest.mark.parametrize("case", ["few", "ragged", "repeated", "negative", "no query", "none"])
def test_neighbours_of_odd_tables(spark, case):
    rng = random.Random(3)
    rows = {
        "few": vectors()[:15] + [(20, [1.0] * 16, 1)],
        "ragged": [(i, [rng.uniform(-2, 2) for _ in range(rng.randint(0, 9))], 1) for i in range(70)],
        "repeated": [(i % 30, [float(i % 30), 1.0], 1) for i in range(300)] + [(None, [1.0, 1.0], 1)],
        "negative": [(i, [-1.0, -0.5 * i], 1) for i in range(-40, 40)],
        "no query": [(i * 20 + 1, [1.0, 2.0], 1) for i in range(9)],
        "none": [],
    }[case]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert found(spark, rows, ratio=99.0) == nearest(rows)


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    index = posting_lists.Index(rng.normal(size=(4000, 24)), 60.0, 500)
    q = index.aim(rng.normal(size=(200, 24)))
    at, d = index.search(q, 32)
    true = np.sqrt(((q[:, None] - index.centroids[None]) ** 2).sum(axis=2))
    want = np.argsort(true, axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(at, want, strict=True)]) >= 9
    assert np.allclose(d, np.take_along_axis(true, at, 1)) and (np.diff(d, axis=1) >= 0).all()
