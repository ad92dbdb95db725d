"""Near-dedup, suffix-array dedup, language model, toxicity, pipeline: against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, frame, lower, words
from weft.llm import bundles, language_model, near_dup, suffix_dedup, suffix_sort, toxicity
from weft.llm.common import materialize
from weft.operators import graph


def components(rows):
    """doc_id -> (set size, smallest reachable id), by all pairs."""
    sets = {}
    for i, text, *_ in rows:
        w = lower(text).encode().split()
        if i is not None:
            sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    top[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("rounds, block, dense", [(2, 512, 16), (0, 8, 16), (0, 8, 0)])
def test_near_duplicates(spark, rounds, block, dense):
    rows = corpus()
    out = near_dup.near_duplicates(frame(spark, rows), rounds=rounds, block=block, salt=4, dense=dense).collect()
    assert len(out) == len(rows)
    want = components(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_of_one_large_group(spark):
    """Many near copies, half of them too far from the original: links between them must be found all the same."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rng.shuffle(rows)
    want = components(rows)
    for dense in (16, 0):
        out = near_dup.near_duplicates(frame(spark, rows), block=64, salt=16, dense=dense).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert 5 < len({c for _, c in want.values()}) < 200


def test_deduplicate_keeps_columns_and_one_of_repeated_rows(spark):
    rows = corpus()
    out = near_dup.deduplicate(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {i for i, (_, c) in components(rows).items() if i == c}
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in near_dup.deduplicate(frame(spark, rows), max_broadcast_rows=1).collect())


def test_rows_of_one_id_with_different_texts(spark):
    """They are documents of their own; the result does not depend on the order of rows."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1), "en", "s", 1), (1, text(2), "en", "s", 1), (2, text(1) + " more", "en", "s", 1), (3, text(2) + " more", "en", "s", 1), (3, "", "en", "s", 1), (4, text(4), "b", "s", 1), (4, text(4), "a", "s", 1), (0, text(4), "en", "s", 1), (5, text(5), "b", "s", 1), (5, text(5), "a", "s", 1)]
    for table in (rows, rows[::-1]):
        out = near_dup.near_duplicates(frame(spark, table)).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 0, False), (4, 0, False), (5, 5, True), (5, 5, True)]
        left = near_dup.deduplicate(frame(spark, table).repartition(3)).collect()
        assert sorted((r["doc_id"], r["text"][:4]) for r in left) == [(0, "w4x0"), (1, "w1x0"), (1, "w2x0"), (3, ""), (5, "w5x0")]


def test_a_group_at_half_similarity_meets_by_sketches(spark):
    """Sets that share half their shingles share entries, but no meeting has to compare their texts."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[:150] + [f"y{rng.randrange(10**9)}" for _ in range(70)]), "en", "s", 1) for i in range(400)]
    sketches = [near_dup.sketch(near_dup.shingles(t.encode(), 5, near_dup.Hashes())) for _, t, *_ in rows]
    open_pairs = sum(near_dup.may_be_similar(x, np.stack(sketches), 75).sum() - 1 for x in sketches)
    assert open_pairs < 0.01 * len(rows) ** 2
    out = near_dup.near_duplicates(frame(spark, rows), block=128).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)


def test_sketches_leave_similar_sets_open():
    rng = np.random.default_rng(5)
    for n in (1, 3, 7, 20, 100, 1000, 5000):
        for _ in range(60):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            k = int(n * 3 / 4 * 1.0000001) if n > 1 else 1
            rest = n - k  # 100 * k >= 75 * (k + rest)
            x, y = np.unique(both[: k + rest // 2]), np.unique(np.concatenate([both[:k], both[k + rest // 2 :]]))
            if near_dup.similar(x, y, 75):
                assert near_dup.may_be_similar(near_dup.sketch(x), near_dup.sketch(y)[None, :], 75)[0]


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    one = near_dup.near_duplicates(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in one)


def test_multi_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 64)
        b = a.copy()
        b[rng.choice(64, 31, replace=False)] += 1
        assert ((a != b).reshape(16, 4).sum(axis=1) <= 1).any()


def test_components(spark):
    edges = [(k, k + 1) for k in range(20, 40)] + [(3, 1), (1, 7), (7, 3), (50, 51), (9, 9)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 20 for k in range(20, 41)}, 1: 1, 3: 1, 7: 1, 50: 50, 51: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 60))]
        assert suffix_sort.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_sort.suffix_array(b"abracadabra" * 20) == sorted(range(220), key=lambda i: (b"abracadabra" * 20)[i:])


def spans(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        own = []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                if own and i <= own[-1][1]:
                    own[-1][1] = i + length
                else:
                    own.append([i, i + length])
        out.append(own)
    return out


@pytest.mark.parametrize("length, gram, block", [(200, 32, 256), (200, 32, 1), (40, 8, 4)])
def test_suffix_dedup(spark, length, gram, block):
    rows = corpus()
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for (i, *_), t, own in zip(rows, texts, spans(texts, length), strict=True):
        rest, at = b"", 0
        for a, b in own:
            rest, at = rest + t[at:a], b
        want[i, len(t), sum(b - a for a, b in own), len(own), hashlib.sha256(rest + t[at:]).hexdigest()] += 1
    out = suffix_dedup.report(frame(spark, rows).repartition(3), length=length, gram=gram, block=block).collect()
    assert Counter(map(tuple, out)) == want
    assert any(k[2] for k in want) and any(0 < k[2] < k[1] for k in want)


def test_suffix_stretches_across_chunks(monkeypatch):
    data = b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(400))
    ends = np.array([3000, 3000, 9000, len(data)])
    whole = suffix_dedup.stretches(data, ends, 200, 32)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    assert (suffix_dedup.stretches(data, ends, 200, 32) == whole).all()
    windows = sum(max(0, n - 199) for n in (3000, 6000, len(data) - 9000))
    assert (whole[1] - whole[0] + 1).sum() == windows


def test_suffix_remove_keeps_rows_and_columns(spark):
    rows = corpus()
    out = suffix_dedup.remove(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == len(rows)
    assert out.where("text is null").count() == sum(r[1] is None for r in rows)
    assert suffix_dedup.remove(frame(spark, [])).count() == 0 and suffix_dedup.report(frame(spark, [])).count() == 0


def test_suffix_spans_of_empty_texts_between_copies(spark):
    copy = " ".join(str(k * k) for k in range(90))
    docs = frame(spark, [(1, copy, "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, copy, "en", "s", 1)]).coalesce(1)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.report(docs.select("doc_id", "text")).collect()}
    assert got == {1: (len(copy), 1), 2: (0, 0), 3: (0, 0), 4: (len(copy), 1)}
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.remove(docs).collect()} == {1: "", 2: None, 3: "", 4: ""}


def test_packed_numbers():
    x = np.array([0, 5, 5, 2**63, 2**64 - 1], dtype=np.uint64)
    assert (bundles.unpack_sorted(bundles.pack_sorted(x)) == x).all()
    assert len(bundles.unpack_numbers(bundles.pack_numbers(x[:0]), np.uint64)) == 0


def test_language_model(spark):
    rows = corpus()
    tokens = [(r[0], [*lower(r[1]).encode().split(), None]) for r in rows]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    train = [w for i, w in tokens if not held(i)]
    uni, bi = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([0, *w[:-1]], w, strict=True))
    context = Counter(p for w in train for p in [0, *w[:-1]])
    n, v = sum(uni.values()), len(uni)
    docs = frame(spark, rows)
    counted, n_, v_ = language_model.count(docs)
    assert (n_, v_) == (n, v)
    weights = language_model.learn(language_model.em_table(counted, n), v)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 1:] > 0).all()
    out = language_model.score(counted, n, v, weights).collect()
    want, cells = [], Counter()
    for i, w in tokens:
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        own = 0 if held(i) else 1
        own_uni, own_bi, own_context = Counter(w), Counter(zip([0, *w[:-1]], w, strict=True)), Counter([0, *w[:-1]])
        score = whole = 0.0
        for p, x in zip([0, *w[:-1]], w, strict=True):
            c = context[p] - own * own_context[p]
            b = weights[int(math.floor(math.log2(c + 1)))]
            p2 = (bi[p, x] - own * own_bi[p, x]) / c if c else 0
            p1 = (uni[x] - own * own_uni[x]) / (n - own * len(w))
            score += math.log10(b[0] * p2 + b[1] * p1 + b[2] / (v + 1))
            b = weights[int(math.floor(math.log2(context[p] + 1)))]
            whole += math.log10(b[0] * (bi[p, x] / context[p] if context[p] else 0) + b[1] * uni[x] / n + b[2] / (v + 1))
            if own:
                cells[int(math.floor(math.log2(c + 1)))] += 1
        want.append((str(i), held(i), len(w), sum(uni[x] > 0 for x in w), n, round(base, 6), round(whole, 6), round(score, 6)))
    got = [(str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6), round(r[7], 6)) for r in out]
    assert sorted(got) == sorted(want)
    table = language_model.em_table(counted, n)
    assert {int(b): int(table[table[:, 0] == b][:, 3].sum()) for b in np.unique(table[:, 0])} == cells


def test_language_model_tells_texts_that_stand_twice(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz") * rng.randint(1, 9) for _ in range(60))
    rows = [(i, text(), "en", "s", 1) for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s", 1) for i in range(20) if not language_model.is_held_out(i, 7, 2) and not language_model.is_held_out(200 + i, 7, 2)]
    out = {r["doc_id"]: r["left_out_score"] / r["n_tokens"] for r in language_model.score_documents(frame(spark, rows)).collect() if not r["held_out"]}
    twice = [i % 200 for i in out if i >= 200]
    assert min(out[i] for i in twice) > max(s for i, s in out.items() if i < 200 and i not in twice)


@pytest.mark.parametrize("n, fan", [(300, 1000), (300, 40), (300, 4)])
def test_total_counts_over_crowds(spark, n, fan):
    """One key stands in every bundle, others in some; no task may see the common one more than about fan times."""
    packed = spark.range(n).select(F.col("id").alias("bundle")).repartition(3)

    def keys_of(row):
        b = row["bundle"]
        keys = np.unique(bundles.mix(np.array([7, 8 + b % 5, 100 + b // 3, 1000 + b], dtype=np.uint64)))
        return keys, np.full(len(keys), 1 + b % 2)

    answers = bundles.total_counts(packed, keys_of, 3, fan=fan)
    want = Counter()
    for b in range(n):
        for k in keys_of({"bundle": b})[0].tolist():
            want[k] += 1 + b % 2
    totals = answers.agg(F.sum("n_types"), F.sum("n_tokens")).first()
    odd = {k: c for k, c in want.items() if k & 1}
    assert tuple(totals) == (len(odd), sum(odd.values()))

    def each(row, found):
        keys, _ = keys_of(row)
        return pa.table({"key": pa.array(keys.view(np.int64)), "n": pa.array(found.astype(np.int64))})

    got = {(r["key"] & (2**64 - 1), r["n"]) for r in bundles.with_totals(packed, answers, each, "key long, n long").collect()}
    assert got == set(want.items())


def test_a_key_of_100000_bundles_stays_small(spark, monkeypatch):
    """Crowds: the arrays that any one range adds up."""
    seen = []
    old = bundles._add_up

    def spy(requests, owners, bits, fan, ignore):
        by = F.pmod(F.xxhash64("bundle"), F.lit(-(-owners // fan)))
        seen.append((owners, requests.groupBy(by.alias("crowd"), "part").count().agg(F.max("count")).first()[0]))
        return old(requests, owners, bits, fan, ignore)

    monkeypatch.setattr(bundles, "_add_up", spy)
    packed = spark.range(100_000).select(F.col("id").alias("bundle"))
    answers = bundles.total_counts(packed, lambda row: (np.array([5], np.uint64), np.array([2])), 3, fan=500)
    assert answers.agg(F.sum("n_tokens"), F.count("*")).first()[:] == (200_000, 100_000)
    assert [n for n, _ in seen] == [100_000, 200] and all(m <= 1.25 * 500 for _, m in seen)


def test_language_model_learns_and_survives_empty_tables(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(w for _ in range(30) for w in rng.choice(["red fish", "blue sky", "old man"]).split()), "en", "s", 1) for i in range(80)]
    out = [r for r in language_model.score_documents(frame(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.75 * sum(r["base_score"] for r in out)  # log10: less negative
    assert language_model.score_documents(frame(spark, [])).count() == 0
    only_held = [(i, "a b", "en", "s", 1) for i in range(200) if language_model.is_held_out(i, 7, 2)][:3]
    assert all(r["score"] == pytest.approx(3 * math.log10(1.0)) or r["score"] <= 0 for r in language_model.score_documents(frame(spark, only_held)).collect())


def test_em_climbs():
    table = np.array([[3, -8, -80, 50], [3, -9999, -64, 50], [5, -4, -90, 100]])
    w = language_model.learn(table, 1000, rounds=200)
    p = lambda w: (50 * np.log(w[0] * 2**-1 + w[1] * 2**-10 + w[2] / 1001) + 50 * np.log(w[1] * 2**-8 + w[2] / 1001))
    for other in np.random.default_rng(0).dirichlet([1, 1, 1], 200):
        assert p(w[3]) >= p(other) - 1e-6


def toxic_rows(n=400, seed=1):
    rng = random.Random(seed)
    clean = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["nasty", "vile", "foulness", "foulest"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad) if rng.random() > 0.03 else int(not bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.assess(docs, table).collect()
    truth = {i: any(x in t for x in ("nasty", "vile", "foul")) for i, t, *_ in rows}
    held = [r for r in out if r["held_out"]]
    assert 60 < len(held) < 140
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    flipped = [(i, q, 1 - t) if toxicity.is_held_out(i) else (i, q, t) for i, q, t in labels]
    again = toxicity.assess(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in out}  # labels of the held-out fold are never read


def test_toxicity_of_themes_without_labels_of_their_words(spark):
    """No labelled row has the words of a theme: voters vote on unlabelled rows all the same, in any script and length."""
    rows, labels = toxic_rows()
    rows += [(1000 + i, "you are a pathetic idiot and a worthless moron, you stupid clown " + "日本 " * i, "en", "s", 1) for i in range(40)]
    rows += [(2000, "word1 " * 200_000, "en", "s", 1), (2001, "word1 " * 200_000 + "idiot pathetic", "en", "s", 1)]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.assess(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(out[1000 + i] for i in range(40)) >= 38 and not out[2000]


def test_toxicity_against_brute_force(spark):
    """Mined terms, votes, posteriors and scores by plain loops over the rows."""
    rows, labels = toxic_rows(n=300, seed=3)
    rows += [(5000 + i, f"{rows[i][1]} you idiot!!!", "en", "s", 1) for i in range(20)]
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = {i: t for i, _, t in labels if not toxicity.is_held_out(i)}
    mined = toxicity.mine(docs, table.where(F.col("doc_id").isin(list(known))).select(F.col("doc_id").alias("id"), "toxic"), places=1)
    counts = {y: Counter() for y in (0, 1)}
    for i, t, *_ in rows:
        if i in known:
            counts[known[i]].update({x for w in set(toxicity.words_of(t.encode())) for x in toxicity.terms_of(w)})
    n = Counter(known.values())
    want = set()
    for t, b in counts[1].items():
        g = counts[0][t]
        e = (b + g) * n[1] / (n[0] + n[1])
        if b - e >= 8 * math.sqrt(e) and (b + 0.5) / (n[1] + 1) / ((g + 0.5) / (n[0] + 1)) >= 16:
            want.add(t)
    assert {t for t, _ in mined} == want

    model, table = toxicity.fit(docs, table)
    found = {r["doc_id"]: (np.frombuffer(bytes(r["words"]), np.uint16), np.unpackbits(np.frombuffer(bytes(r["votes"]), np.uint8), count=model.voters.size)) for r in table.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    for i, text, *_ in rows:
        words = toxicity.words_of(text.encode())
        votes = model.voters.votes(text.encode(), words, {w: k for w in words if (k := model.voters.lexicons_of(w))})
        assert (votes == found[i][1]).all()
        z = sum(model.weights[toxicity.xxhash.xxh3_64_intdigest(w) % toxicity.BUCKETS] * 0.3 / math.sqrt(len(found[i][0])) for w in {toxicity.xxhash.xxh3_64_intdigest(w) % toxicity.BUCKETS: w for w in words}.values())
        z += sum(model.weights[toxicity.BUCKETS + k] for k in range(len(votes)) if votes[k]) + model.weights[-1]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)
    label = model.labelling
    for i, y in [(1, -1), (2, 0), (3, 1)]:
        odds = math.log(label.prior / (1 - label.prior))
        for k, v in enumerate(found[i][1]):
            odds += label.weight[k] * math.log(label.p1[k] / label.p0[k] if v else (1 - label.p1[k]) / (1 - label.p0[k]))
        odds += {-1: 0, 0: math.log((1 - label.label1) / (1 - label.label0)), 1: math.log(label.label1 / label.label0)}[y]
        assert label.posterior(found[i][1][None, :], np.array([y]))[0] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, None), (None, 1, 1), (1, 1, 0), (4, 1, 7)], "doc_id long, quality int, toxic int")
    docs = frame(spark, corpus())
    out = toxicity.assess(docs, labels).collect()
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.assess(frame(spark, []), labels.limit(0)).count() == 0
    both = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.assess(docs, both).where("score between 0 and 1").count() == len(corpus())


def test_label_model_recovers_rates_and_discounts_copies():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.3
    vote = lambda hit, noise: ((y & (rng.random(n) < hit)) | (~y & (rng.random(n) < noise))).astype(np.uint8)
    good, bad = [vote(h, e) for h, e in ((0.8, 0.03), (0.7, 0.05), (0.5, 0.02), (0.6, 0.1))], vote(0.5, 0.3)
    votes, labels = np.stack([*good, bad, bad, bad], axis=1), np.where(rng.random(n) < 0.1, np.where(rng.random(n) < 0.05, ~y, y), -1)
    model = toxicity.LabelModel(np.ones(7), 0.3)
    for _ in range(40):
        model.update(model.expect(votes, labels, np.ones(n)))
    assert np.abs(model.p1[:4] - [0.8, 0.7, 0.5, 0.6]).max() < 0.06 and np.abs(model.p0[:4] - [0.03, 0.05, 0.02, 0.1]).max() < 0.06
    assert model.weight[4:].max() < model.weight[:4].min()
    assert ((model.posterior(votes, np.full(n, -1)) > 0.5) == y).mean() > 0.93


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None and r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = (before, docs.count())
    assert seen["suffix-array dedup"][0] == seen["suffix-array dedup"][1]
    assert seen["benchmark decontamination"][1] == seen["benchmark decontamination"][0] - 1
    ids = {r["doc_id"] for r in docs.collect()}
    assert 3 not in ids and len(ids - {0}) > 30
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == ids
    groups = defaultdict(int)
    for r in out:
        groups[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for r in out:
        assert abs(groups[r["source"]] - r["target"]) <= 1
    for r in docs.where("text is not null").collect():
        assert r["n_chars"] == len(r["text"]) and words(r["text"]) is not None


def test_repeated_windows_with_an_anchor_symbol():
    rng = random.Random(6)
    gram = bytes(range(200, 232))
    pieces, lefts = [], []
    for _ in range(12):
        left = rng.randint(5, 40)
        tail = bytes(rng.choice(b"ab") for _ in range(60))
        pieces.append((b"abab" * 20)[-left:] + gram + (b"c" * 60 if rng.random() < 0.5 else tail))
        lefts.append(left)
    lasts = [min(left, len(p) - 60) for p, left in zip(pieces, lefts, strict=True)]
    pieces = [p[: last + 60] for p, last in zip(pieces, lasts, strict=True)]
    windows = Counter(p[d : d + 60] for p, last in zip(pieces, lasts, strict=True) for d in range(last + 1))
    want = [[d for d in range(last + 1) if windows[p[d : d + 60]] > 1] for p, last in zip(pieces, lasts, strict=True)]
    usable = [all(left + 32 <= d + 60 for d in range(last + 1)) for left, last in zip(lefts, lasts, strict=True)]
    assert suffix_sort.repeated(pieces, lasts, 60) == want and any(want)
    pick = [i for i, u in enumerate(usable) if u]
    sub = [pieces[i] for i in pick], [lasts[i] for i in pick]
    assert suffix_sort.repeated(*sub, 60, [lefts[i] for i in pick], 32) == suffix_sort.repeated(*sub, 60)
