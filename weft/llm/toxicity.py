"""Toxicity by weak supervision.

1. Voters, each of which votes for one class or abstains. Lexicon voters: the fixed lists of THEMES, one voter a theme; words and word
   beginnings (4 to 7 letters) that labelled training rows show to be one-sided and that no theme has, the ``single`` strongest one voter each, the others in ``shared``
   voters by their odds. Pattern voters for toxic: a second-person word near a lexicon word, three or more lexicon words, a short text with
   one, shouting, runs of exclamation marks, words masked by symbols; for clean: no lexicon word; no lexicon word in a long text.
2. Label model. Votes of all rows, labelled or not, are a mixture of two classes; the label of a training row is one more voter, which
   may err and abstains on all other rows. Each voter's rate in either class is estimated by expectation-maximisation, started from the
   voters' sides; toxic rows are as frequent as among the labelled. What two voters share within the classes is correlation: a voter's
   log-odds are divided by one plus what it shares with the others, so that voters that repeat one another do not count twice.
   The posterior is the soft label of a row.
3. A logistic regression on hashed words and votes is trained on the posteriors of at most ``sample_rows`` labelled training rows (those
   with the smallest hash of doc_id) by full-batch AdaGrad, deterministic, and scores every whole text.

Words are mined from all labelled training rows by an aggregate; a round of the label model is an aggregate over the distinct vote patterns of
all rows that gives voters^2 numbers; a row's features (word buckets, votes) are written once, of bounded size each. The sample holds features, no texts. Rows of the
held-out fold are voted on, their labels are never read.

Defined cases: null and empty texts have no features and get the model's base rate; labels of unknown rows and null labels
are ignored; of several labels of a row the highest counts; repeated rows are scored one by one; without toxic (or without clean) training
rows every score is the smoothed base rate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import broadcast_if_small, materialize, read_table

#: Words of everyday insults, contempt and threats, by theme.
THEMES = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile dimwit halfwit brainless",
    "worth": "loser losers worthless pathetic useless failure nobody reject",
    "dirt": "scum scumbag trash trashy garbage filth filthy vermin",
    "disgust": "disgusting repulsive revolting nasty sickening",
    "ridicule": "clown clowns laughable buffoon freak weirdo",
    "malice": "hateful despise loathe liar coward traitor",
    "threat": "murder strangle slaughter kys",
    "abuse": "damn crap bastard jerk bitch shit fuck fucking asshole",
}
#: Words that address a reader.
SECOND_PERSON = frozenset(b"you your yours yourself u ur youre".split())
TOXIC_PATTERNS = ("second person", "many words", "short text", "shouting", "exclamation", "masked")
CLEAN_PATTERNS = ("no word", "no word in a long text")
BUCKETS = 1 << 14

_TABLE = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_NO_UPPER, _NO_LETTER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A), bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_SHOUT, _MASKED = re.compile(rb"[!?]{3,}"), re.compile(rb"[A-Za-z][*@#$]{2,}|[A-Za-z][*@$][A-Za-z]")


def is_held_out(doc_id: int | None, folds: int = 4, held_fold: int = 2) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds == held_fold


def words_of(text: bytes | None) -> list[bytes]:
    """Lowered runs of ASCII letters and non-ASCII bytes."""
    return (text or b"").translate(_TABLE).split()


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, those marked by ``^``."""
    letters = word.decode("utf-8", "replace")
    return [word, *(b"^" + letters[:k].encode() for k in range(4, min(8, len(letters))))]


class Voters:
    def __init__(self, mined: list[tuple[bytes, float]], single: int = 16, shared: int = 8):
        themes = [frozenset(v.encode().split()) for v in THEMES.values()]
        self.of: dict[bytes, int] = {w: k for k, theme in enumerate(themes) for w in theme}
        for i, (w, _) in enumerate(mined[:single]):
            self.of.setdefault(w, len(themes) + i)
        others = sorted(mined[single:], key=lambda m: (-m[1], m[0]))
        for i, (w, _) in enumerate(others):
            self.of.setdefault(w, len(themes) + single + i * shared // len(others))
        self.lexicons = len(themes) + single + shared
        self.size = self.lexicons + len(TOXIC_PATTERNS) + len(CLEAN_PATTERNS)
        #: 1 for a vote for toxic, -1 for clean.
        self.side = np.array([1] * (self.size - len(CLEAN_PATTERNS)) + [-1] * len(CLEAN_PATTERNS))

    def lexicons_of(self, word: bytes) -> tuple[int, ...]:
        return tuple({self.of[t] for t in terms_of(word) if t in self.of})

    def votes(self, text: bytes | None, words: list[bytes], found: dict[bytes, tuple[int, ...]]) -> np.ndarray:
        """Whether each voter votes; found: the text's lexicon words, with their lexicons."""
        out, text = np.zeros(self.size, bool), text or b""
        out[[k for own in found.values() for k in own]] = True
        hits = [i for i, w in enumerate(words) if w in found] if found else []
        near = any(w in SECOND_PERSON for i in hits for w in words[max(0, i - 3) : i + 4])
        upper, letters = len(text.translate(None, _NO_UPPER)), len(text.translate(None, _NO_LETTER))
        toxic = (near, len(hits) >= 3, bool(hits) and len(words) <= 12, letters >= 20 and upper > 0.6 * letters, bool(_SHOUT.search(text)), bool(_MASKED.search(text)))
        out[self.lexicons :] = (*toxic, not hits, not hits and len(text) > 400)
        return out


def mine(docs: DataFrame, known: DataFrame, odds: float = 16.0, z: float = 8.0, places: int = 10, most: int = 5000) -> list[tuple[bytes, float]]:
    """Terms (and their log-odds) whose smoothed odds of being in toxic rows are high, and beyond ``z`` deviations of chance, the strongest first. known(id, toxic)
    names all labelled training rows; every one of their terms is counted. Copies of one toxic text make its words look one-sided: a
    term has to stand in toxic rows of ``places`` of 64 minhash classes (by two minima), and near copies mostly share theirs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(known, "id").select("text", "toxic")

    def count(batches):
        sums: dict[bytes, list[int]] = {}
        known_terms: dict[bytes, list[bytes]] = {}

        def out():
            keys, values = list(sums), list(sums.values())
            sums.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.binary()), "bad": pa.array([v[1] for v in values], pa.int64()), "good": pa.array([v[0] for v in values], pa.int64()), "places": pa.array(np.array([v[2] for v in values], np.uint64).view(np.int64))})

        for batch in batches:
            for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[bytes] = set()
                for w in set(words_of(text)):
                    if w not in known_terms:
                        known_terms[w] = terms_of(w)
                    found.update(known_terms[w])
                least = heapq.nsmallest(2, map(xxhash.xxh3_64_intdigest, set((text or b"").split()))) if toxic else []
                place = 1 << xxhash.xxh3_64_intdigest(repr(least)) % 64
                for t in found:
                    own = sums.setdefault(t, [0, 0, 0])
                    own[toxic] += 1
                    if toxic:
                        own[2] |= place
                if len(known_terms) > 100_000:
                    known_terms.clear()
                if len(sums) > 300_000:
                    yield out()
        yield out()

    total = rows.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return []
    terms = rows.mapInArrow(count, "word binary, bad long, good long, places long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_count(F.bit_or("places")).alias("places"))
    expected = (F.col("bad") + F.col("good")) * (total["bad"] / (total["bad"] + total["good"]))
    ratio = ((F.col("bad") + 0.5) / (total["bad"] + 1)) / ((F.col("good") + 0.5) / (total["good"] + 1))
    best = terms.where((F.col("bad") - expected >= z * F.sqrt(expected)) & (ratio >= odds) & (F.col("places") >= places))
    best = best.select("word", F.log(ratio).alias("odds"), (F.log(ratio) * F.sqrt("bad")).alias("strength"))
    return [(bytes(r["word"]), r["odds"]) for r in best.orderBy(F.col("strength").desc(), "word").limit(most).collect()]


def features(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, empty, words, votes) of each row: its word buckets, packed and sorted, and its votes, packed bits."""

    def run(batches):
        known: dict[bytes, tuple[int, tuple[int, ...]]] = {}  # word: bucket, lexicons
        for batch in batches:
            buckets, votes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                distinct = set(words)
                if len(known) > 300_000:
                    known.clear()
                for w in [w for w in distinct if w not in known]:
                    known[w] = xxhash.xxh3_64_intdigest(w) % BUCKETS, voters.lexicons_of(w)
                buckets.append(np.unique(np.array([known[w][0] for w in distinct], np.uint16)).tobytes())
                votes.append(np.packbits(voters.votes(text, words, {w: k for w in distinct if (k := known[w][1])})).tobytes())
            empty = [not t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(empty, pa.bool_()), pa.array(buckets, pa.binary()), pa.array(votes, pa.binary())], names=["doc_id", "empty", "words", "votes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, empty boolean, words binary, votes binary")
    return materialize(rows, "toxicity")


def _bits(votes: list[bytes], size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(votes), np.uint8).reshape(len(votes), -1), axis=1, count=size)


class LabelModel:
    """Rates p1, p0 of each voter among toxic and clean rows, and its weight."""

    def __init__(self, side: np.ndarray, prior: float):
        self.prior, self.weight = prior, np.ones(len(side))
        self.p1, self.p0 = np.where(side > 0, 0.05, 0.3), np.where(side > 0, 0.01, 0.8)  # low rates: at first an abstention says little
        self.label1, self.label0 = 0.9, 0.02  # share of label 1 among toxic and clean labelled rows

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The probability of toxic for rows of votes and labels (-1: none)."""
        on, off = np.log(self.p1 / self.p0), np.log((1 - self.p1) / (1 - self.p0))
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes, on, off) @ self.weight
        odds += np.where(labels < 0, 0, np.where(labels == 1, np.log(self.label1 / self.label0), np.log((1 - self.label1) / (1 - self.label0))))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def expect(self, votes: np.ndarray, labels: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By class, how many rows each two voters both vote on; behind the voters: label 1, any label, any row. Rows occur n times each."""
        x = np.column_stack([votes, labels == 1, labels >= 0, np.ones(len(votes))]).astype(np.float64)
        q = self.posterior(votes, labels)
        return np.stack([(x.T * ((1 - q) * n)) @ x, (x.T * (q * n)) @ x])

    def update(self, both: np.ndarray) -> float:
        """New rates, correlations and weights from the sums of expect; the largest change of a rate."""
        rates, labels, rest = [], [], 0
        for k in both:
            rows, of = k[-1, -1], k[-1, :-3]
            rates.append((of + 0.5) / (rows + 1))
            labels.append((k[-1, -3] + 0.5) / (k[-1, -2] + 1))
            rest = rest + k[:-3, :-3] - np.outer(of, of) / max(rows, 1e-9)
        sd = np.sqrt(np.maximum(np.diag(rest), 1.0))  # a voter of less than one vote has no correlation
        self.correlations = rest / np.outer(sd, sd)
        np.fill_diagonal(self.correlations, 0)
        moved = max(np.abs(rates[0] - self.p0).max(), np.abs(rates[1] - self.p1).max(), abs(labels[1] - self.label1))
        (self.p0, self.p1), (self.label0, self.label1) = rates, labels
        self.discount(0.9)
        return float(moved)

    def discount(self, least: float = 0.02) -> None:
        """Weights from the correlations above least: what two voters share in the direction of their votes. While rates are still
        moving, only copies of one another are discounted."""
        gap = self.p1 - self.p0
        agree = np.sign(np.outer(gap, gap)) * self.correlations
        self.weight = 1 / (1 + np.where(agree > least, agree, 0).sum(axis=1))


def label_model(rows: DataFrame, voters: Voters, prior: float, rounds: int = 12, tol: float = 2e-3) -> LabelModel:
    """The label model of the votes and labels of all rows(empty, votes, toxic) with a text."""
    model, size = LabelModel(voters.side, prior), voters.size + 3
    patterns = materialize(rows.where("not empty").groupBy("votes", "toxic").agg(F.count("*").alias("n")), "vote-patterns")
    patterns = patterns.coalesce(-(-patterns.count() // 100_000) or 1)
    for _ in range(rounds):

        def run(batches, model=model):
            both = np.zeros((2, size, size))
            for batch in batches:
                if batch.num_rows:
                    both += model.expect(_bits(batch.column(0).to_pylist(), size - 3), batch.column(1).to_numpy(), batch.column(2).to_numpy())
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(both.reshape(-1)[at], pa.float64())})

        sums = np.zeros(2 * size**2)
        for r in patterns.mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # voters^2 rows
            sums[r["at"]] = r["n"]
        if model.update(sums.reshape(2, size, size)) < tol:
            break
    model.discount()
    return model


def inputs(words: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a row's inputs: word buckets, votes, one constant."""
    on = np.flatnonzero(votes)
    places = np.concatenate([words.astype(np.int64), BUCKETS + on, [BUCKETS + len(votes)]])
    return places, np.concatenate([np.full(len(words), 0.3 / np.sqrt(max(1, len(words)))), np.ones(len(on) + 1)])


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, size: int, l2: float = 1e-4, rounds: int = 400, rate: float = 0.2) -> np.ndarray:
    """Logistic regression on soft labels by full-batch AdaGrad."""
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, weights=value * w[index], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft
        g = np.bincount(index, weights=value * error[owner], minlength=size) / len(rows) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


class Model:
    """Voters, label model and classifier; without weights every score is the base rate."""

    def __init__(self, base: float, voters: Voters, labelling: LabelModel | None = None, weights: np.ndarray | None = None):
        self.base, self.voters, self.labelling, self.weights = base, voters, labelling, weights

    def score(self, words: np.ndarray, votes: np.ndarray) -> float:
        places, values = inputs(words, votes)
        return float(1 / (1 + np.exp(-np.clip((self.weights[places] * values).sum(), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, folds: int = 4, held_fold: int = 2, max_broadcast_rows: int = 2_000_000) -> tuple[Model, DataFrame]:
    """(the model, the features of docs)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != held_fold).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_semi"), "toxic-labels")
    n_bad, n_all = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    base = (n_bad + 0.5) / (n_all + 1)
    voters = Voters(mine(docs, broadcast_if_small(known, max_broadcast_rows)))
    rows = features(docs, voters)
    if not 0 < n_bad < n_all:
        return Model(base, voters), rows
    known = broadcast_if_small(known, max_broadcast_rows)
    labelled = rows.join(known, F.col("doc_id") == F.col("id"), "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
    labelling = label_model(labelled.select("empty", "votes", "toxic"), voters, base)
    picked = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows))  # bounded by sample_rows
    sample = rows.where("not empty").join(picked, F.col("doc_id") == F.col("id")).orderBy(F.xxhash64("id"), "id", "words", "votes").limit(sample_rows).select("words", "votes", "toxic").collect()
    if not sample:
        return Model(base, voters), rows
    votes = _bits([bytes(r["votes"]) for r in sample], voters.size)
    own = [inputs(np.frombuffer(bytes(r["words"]), np.uint16), v) for r, v in zip(sample, votes, strict=True)]
    return Model(base, voters, labelling, fit_linear(own, labelling.posterior(votes, np.array([r["toxic"] for r in sample])), BUCKETS + voters.size + 1)), rows


def score(rows: DataFrame, model: Model, folds: int = 4, held_fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of features(...)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            model, n = shared.value, batch.num_rows
            if model.weights is None or not n:
                found = np.full(n, model.base)
            else:
                words, votes = batch.column(2).to_pylist(), _bits(batch.column(3).to_pylist(), model.voters.size)
                own = [inputs(np.frombuffer(w, np.uint16), v) for w, v in zip(words, votes, strict=True)]
                owner = np.repeat(np.arange(n), [len(i) for i, _ in own])
                places, values = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
                z = np.bincount(owner, weights=values * model.weights[places], minlength=n)
                found = np.where(batch.column(1).to_numpy(zero_copy_only=False), model.base, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            found = [round(float(s), 6) for s in found]
            held = [is_held_out(i, folds, held_fold) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "empty", "words", "votes").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text), from labels(doc_id, toxic)."""
    model, rows = fit(docs, labels, **parameters)
    return score(rows, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
