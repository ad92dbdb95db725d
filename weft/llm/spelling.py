"""Spelling variant grouping by Aho-Corasick halves.

Two words are near if one inserted, deleted or replaced code point makes one the other. Then one half of the shorter word (of
either, at equal length) stands in the other word untouched: the first half at its beginning or the second at its end. The halves of
all words are dealt to shards by hash; a shard's automaton holds its halves, and every word is scanned by the shards that
may hold a half of it. A hit says which words to look at; offset and length are checked, then the distance.

Work is in proportion to the words, not to the square of a crowd: the words behind a half are compared one by one only where they are
few, else found by their remainders with one code point left out. A half that very many words share (``hot``) has no shard: its
words are joined by those remainders, dealt out by remainder.

Defined cases: a null text has no words; a row without id counts like one with an empty id; repeated rows count each; an empty table
has no words; further columns are ignored. A text is taken whole, whatever its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import discard, materialize, read_table

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Marks either end of a word, so that a half matches at its one possible offset only.
END = "\x00"
FOUND = "word string, n_near long, best string, best_n long"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, damage: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least ``least`` code points, A-Z lowered, and how often they occur. With ``damage``, a run whose
    crc32 (behind its row's id and a colon) is a multiple of it loses the code point at crc32 modulo its length first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()
        for batch in batches:
            for at, text in zip(batch.column(0), batch.column(1), strict=True):
                text, at = text.as_py(), at.as_py()
                if not text:
                    continue
                runs = Counter(RUNS.findall(text)) if len(text) < 1 << 20 else Counter(m.group() for m in RUNS.finditer(text))
                start = zlib.crc32(f"{'' if at is None else at}:".encode())
                for run, n in runs.items():
                    if len(run) < least:
                        continue
                    word = run.lower() if run.isascii() else run.translate(LOWER)
                    if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    totals[word] += n
                if len(totals) >= 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])
                    totals = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])

    return docs.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def is_near(u: str, v: str) -> bool:
    """One code point inserted into u, or one replaced, makes it v (u no longer than v)."""
    k = 0
    while k < len(u) and u[k] == v[k]:
        k += 1
    return (len(u) == len(v) and k < len(u) and u[k + 1 :] == v[k + 1 :]) or (len(u) + 1 == len(v) and u[k:] == v[k + 1 :])


class _Crowd:
    """The words of one length behind a half: compared one by one, or found by what is left of them without one code point."""

    def __init__(self, first: bool, half: int, few: int) -> None:
        self.first, self.half, self.few, self.words, self.gaps = first, half, few, [], None

    def rest(self, word: str) -> str:
        return word[self.half :] if self.first else word[: len(word) - self.half]

    def near(self, v: str) -> list[str]:
        if len(self.words) <= self.few:
            return [u for u in self.words if is_near(u, v)]
        longer, r = len(v) - len(self.words[0]), self.rest(v)
        if self.gaps is None:
            self.gaps = defaultdict(list)
            for u in self.words:
                s = self.rest(u)
                self.gaps[(-1, s)].append(u)
                for k in range(len(s)):
                    self.gaps[(k, s[:k] + s[k + 1 :])].append(u)
        if longer:
            return [u for s in {r[:k] + r[k + 1 :] for k in range(len(r))} for u in self.gaps.get((-1, s), ())]
        return [u for k in range(len(r)) for u in self.gaps.get((k, r[:k] + r[k + 1 :]), ()) if u != v]


def _add(found: dict[str, list], word: str, other: str, n: int) -> None:
    have = found.setdefault(word, [0, other, n])
    have[0] += 1
    if (-n, other) < (-have[2], have[1]):
        have[1:] = other, n


def scan_shard(first: list[tuple[str, int]], second: list[tuple[str, int]], scans: list[tuple[str, int]], few: int = 8) -> dict[str, list]:
    """word -> [near words found here, the commonest of them, its count], for a shard's first halves, second halves and scanned words."""
    crowds: dict[str, dict[int, _Crowd]] = {}
    count = dict(first) | dict(second)
    for words, is_first in ((first, True), (second, False)):
        for u, _ in words:
            h = len(u) // 2 if is_first else len(u) - len(u) // 2
            key = END + u[:h] if is_first else u[len(u) - h :] + END
            crowds.setdefault(key, {}).setdefault(len(u), _Crowd(is_first, h, few)).words.append(u)
    automaton = ahocorasick.Automaton()
    for key, by_length in crowds.items():
        automaton.add_word(key, by_length)
    found: dict[str, list] = {}
    if not crowds:
        return found
    automaton.make_automaton()
    for v, n in scans:
        for _, by_length in automaton.iter(END + v + END):
            for length in (len(v) - 1, len(v)):
                if (crowd := by_length.get(length)) is None:
                    continue
                for u in crowd.near(v):
                    if length == len(v) and u > v or not crowd.first and v.startswith(u[: length // 2]):
                        continue  # met the other way round, or by the first half as well
                    _add(found, v, u, count[u])
                    _add(found, u, v, n)
    return found


def _half(word: Column, first: bool, length: Column) -> Column:
    return F.concat(F.lit("<"), F.substring(word, F.lit(1), length)) if first else F.concat(F.substring(word, F.length(word) - length + 1, length), F.lit(">"))


def _halves(words: DataFrame) -> DataFrame:
    """(half, word, n, role): a word's own halves (role 0 and 1)."""
    size = F.length("word")
    own = F.array(*[F.struct(F.lit(k).alias("role"), _half(F.col("word"), not k, F.floor((size + k) / 2).cast("int")).alias("half")) for k in (0, 1)])
    return words.select("word", "n", F.inline(own))


def _probes(words: DataFrame) -> DataFrame:
    """(half, word, n): every half that a near word, no longer than this one, may have here."""
    w, size = F.col("word"), F.length("word")
    floor = lambda x: F.floor(x / 2).cast("int")
    may = F.array_distinct(F.array(_half(w, True, floor(size - 1)), _half(w, True, floor(size)), _half(w, False, floor(size)), _half(w, False, floor(size + 1))))
    return words.select("word", "n", F.explode(may).alias("half"))


def _hot_pairs(halves: DataFrame, probes: DataFrame, hot: DataFrame) -> DataFrame:
    """Near words behind hot halves, by what is left of the remainder without one code point: FOUND rows."""
    first = F.col("half").startswith("<")
    rest = F.when(first, F.substring("word", F.length("half"), F.length("word"))).otherwise(F.substring("word", F.lit(1), F.length("word") - F.length("half") + 1))
    rows = lambda df: df.join(hot, "half", "left_semi").withColumn("rest", rest).withColumn("size", F.length("word"))
    without = lambda k: F.concat(F.substring("rest", F.lit(1), k), F.substring("rest", k + 2, F.length("rest")))
    places = F.when(F.length("rest") > 0, F.sequence(F.lit(0), F.length("rest") - 1)).otherwise(F.array().cast("array<int>"))
    gaps = F.transform(places, lambda k: F.struct(k.alias("at"), without(k).alias("left")))
    shorter = F.transform(F.array_distinct(F.transform(places, without)), lambda s: F.struct(F.lit(-1).alias("at"), s.alias("left")))
    a = rows(halves).select("half", "size", F.col("word").alias("u"), F.col("n").alias("n_u"), F.inline(F.concat(gaps, F.array(F.struct(F.lit(-1).alias("at"), F.col("rest").alias("left"))))))
    b = rows(probes).select("half", F.col("word").alias("v"), F.col("n").alias("n_v"), F.inline(F.concat(F.transform(gaps, lambda g: F.struct(F.col("size").alias("size"), g["at"].alias("at"), g["left"].alias("left"))), F.transform(shorter, lambda g: F.struct((F.col("size") - 1).alias("size"), g["at"].alias("at"), g["left"].alias("left"))))))
    twice = F.col("half").endswith(">") & F.expr("startswith(v, substring(u, 1, length(u) div 2))")
    pairs = a.join(b, ["half", "size", "at", "left"]).where("length(u) < length(v) or u < v").where(~twice)
    both = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("best"), F.col("n_v").alias("best_n")), F.struct(F.col("v").alias("word"), F.col("u").alias("best"), F.col("n_u").alias("best_n")))))
    return both.select("word", F.lit(1).cast("long").alias("n_near"), "best", "best_n")


def near_words(words: DataFrame, shard: int = 8192, few: int = 8, hot: int = 32768) -> DataFrame:
    """(word, n_near, best, best_n) of the words(word, n) that have near words: how many, and the commonest (ties: the first in code-point
    order). A shard holds some ``shard`` words' halves; halves of more than ``hot`` words are joined by remainders."""
    shards = max(1, -(-words.count() // shard))
    halves, probes = _halves(words), _probes(words)
    crowded = materialize(halves.groupBy("half").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("half"), "hot-halves")
    any_hot = not crowded.isEmpty()
    cool = lambda df: df.join(crowded, "half", "left_anti") if any_hot else df
    at = F.pmod(F.xxhash64("half"), F.lit(shards)).alias("shard")
    dealt = cool(halves).select(at, "word", "n", "role").unionByName(cool(probes).select(at, "word", "n", F.lit(2).alias("role")).distinct())

    def scan(table: pa.Table) -> pa.Table:
        by_role: tuple[list, list, list] = ([], [], [])
        for word, n, role in zip(table["word"].to_pylist(), table["n"].to_pylist(), table["role"].to_pylist(), strict=True):
            by_role[role].append((word, n))
        found = scan_shard(*by_role, few)
        columns = list(zip(*found.values(), strict=True)) if found else [(), (), ()]
        kinds = (pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array(list(found), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["word", "n_near", "best", "best_n"])

    found = dealt.groupBy("shard").applyInArrow(scan, FOUND)
    if any_hot:
        found = found.unionByName(_hot_pairs(halves, probes, crowded))
    best = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))
    top = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    return top.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.n")).alias("best_n"))


def spelling_groups(words: DataFrame, ratio: int = 5, **options) -> DataFrame:
    """(word, n, form, root, n_near, form_n): the near word of largest n, if that is at least ``ratio`` times the word's, and where the forms
    lead to. Counts grow along forms, so that they end; roots are found by doubling the steps, a few rounds."""
    near = near_words(words, **options)
    good = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.when(good, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    steps = rows.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        further = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = materialize(steps.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        still = not step.where("moved").isEmpty()
        if "moved" in steps.columns:
            discard(steps)
        steps = step
        if not still:
            break
    return rows.join(steps.select("word", F.col("to").alias("_root")), "word", "left").select("word", "n", "form", F.coalesce("_root", "word").alias("root"), "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(read_table(spark, sf_dir, "documents"), damage=199).where("n >= 5")
    return spelling_groups(materialize(words, "words"))
