"""A small corpus with every odd case, and brute-force versions of the contracts."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def corpus(seed=5, n=60):
    """Rows (doc_id, text, lang, source, n_chars): prose, exact and near copies, shared passages, odd and missing texts, ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)] + ["naïve", "straße", "日本語"]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [prose(rng.randint(20, 150)) for _ in range(n)]
    passage = prose(60)
    base = prose(90).split(" ")
    for k in range(25):  # near copies of one text, each with its own edits
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0]] * 4 + [texts[1].upper()]
    texts += [prose(30) + "\n" + passage + "\n" + prose(20) for _ in range(6)]
    texts += [None, "", "   \t\n", "one two", "one two", "a" * 700, "ab" * 400, "é" * 350, prose(3000), "word " * 60, "A\x00B\x1c C"]
    sources = ["s1", "s1", "s1", "s0", None, "Ω", "s2"]
    rows = [(i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "a row without an id " * 3, None, None, 1)]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
