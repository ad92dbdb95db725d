"""Spelling variant grouping against brute force."""

import random
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import corpus, frame, lower
from weft.llm import spelling


def brute(words, ratio=5):
    """word -> (form, root, n_near, form_n), by all pairs."""
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), len(near[w]), words[form[w]] if form[w] else None) for w in words}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def vocabulary(seed, n, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))): rng.choice([5, 5, 6, 25, 30, 150, 800]) for _ in range(n)}
    words |= {"a" * k: 5 ** (k - 5) for k in range(6, 13)}  # a long chain of forms, ties of letters
    words |= {"prefixed" + "".join(rng.choice(letters) for _ in range(6)): rng.choice([5, 40]) for _ in range(n // 2)}
    return words | {"x" * 3000: 5, "x" * 2999 + "y": 25, "÷×àáâã": 9}


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"shard": 50, "few": 0}, {"shard": 50, "few": 1000}, {"shard": 40, "hot": 12}, {"hot": 0}])
def test_groups(spark, options):
    words = vocabulary(3, 400)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got, want = result(spelling.spelling_groups(df, **options)), brute(words)
    assert got == want
    assert max(Counter(r for _, r, _, _ in want.values()).values()) > 2 and any(f and r != f for f, r, _, _ in want.values())


def test_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_groups(none).count() == 0
    docs = frame(spark, [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "ab c1d", "en", "s", 6)])
    assert spelling.word_counts(docs).count() == 0


def test_word_counts_with_damage(spark):
    rows = corpus() + [(5000, "Überläufer straßeÿ " * 40 + "ABCDEFGHIJ" * 200_000 + " naïvely×÷", "de", "s", 9)]
    want = Counter()
    for i, text, *_ in rows:
        for run in spelling.RUNS.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 7 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                want[word] += 1
    docs = frame(spark, rows).withColumnRenamed("n_chars", "word")  # a clashing name
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, damage=7).collect()} == want


def test_query_on_a_table(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, text, *_ in rows:
        for run in spelling.RUNS.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            word = word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word
            want[word] += len(word) >= 6
    assert result(spelling.query(spark, str(tmp_path))) == brute({w: n for w, n in want.items() if n >= 5})
