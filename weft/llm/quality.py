"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Only DataFrame functions: no Python runs on the executors.
Units are runs of letters and digits, and runs of other visible characters; unigrams and bigrams of units are hashed into
``buckets`` counters. The score of a text is the mean over its n-grams of log(p_target / p_raw), the
target's count and the count expected of it from the raw corpus with one added to each; every text is kept or rejected by the same fixed threshold, so reruns agree.

Counts cover all rows. The model is one array of ``buckets`` doubles whatever the input's size; the driver puts it into the
plan as a constant, so that scoring moves no row.

Defined cases: null and empty texts have no words: all counts 0, score 0, base_failed true (fewer than 10 words), kept
false; repeated rows are scored alike, and each counts; labels of unknown rows are ignored; a trusted row that is repeated
in labels counts once; without trusted rows every score is 0; an empty table gives no rows; columns of
docs stay as they are, whatever their names: the result is one more column, a struct named by ``into``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import NON_SPACE, SPACE, broadcast_if_small, empty_text, free_name, let, materialize, read_table

UNITS = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]+"
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text. Windows are compared by 64-bit hash within one text."""
    starts = F.size(words) - WINDOW + 1
    hashes = F.transform(F.sequence(F.lit(0), starts - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            hit = F.filter(F.transform(p, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(F.array_sort(hit), start, step)["n"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, marked))

    return F.when(starts < 1, 0).otherwise(let(hashes, covered))


def text_stats(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = empty_text(text)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NON_SPACE))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, buckets: int) -> Column:
    """array<int>: the buckets of all unigrams and bigrams of units."""
    units = F.regexp_extract_all(empty_text(text), F.lit(UNITS), F.lit(0))
    ids = F.transform(units, lambda u: F.xxhash64(u))
    both = lambda h: F.concat(h, F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))  # noqa: E731  the last pairs with null: the text's end
    return F.transform(let(ids, both), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def fit(docs: DataFrame, trusted_ids: DataFrame, buckets: int = 1 << 14, max_broadcast_rows: int = 4_000_000) -> DataFrame:
    """One row with ``ratios``: array of log(p_target / p_raw) by bucket. trusted_ids(doc_id) names the target's rows."""
    trusted = trusted_ids.where("doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    rows = docs.select("doc_id", "text").join(broadcast_if_small(trusted, max_broadcast_rows), F.col("doc_id") == F.col("_trusted"), "left")
    grams = rows.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = materialize(counts, "quality-counts")
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0)
    one = every.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    ratio = lambda x: F.log((x["target"] + 1.0) / (x["raw"] * F.col("n_target") / F.col("n_raw") + 1.0))
    return one.select(F.when(F.col("n_target") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(F.transform("c", ratio)).alias("ratios"))


def assess(docs: DataFrame, model: DataFrame, buckets: int = 1 << 14, threshold: float = -0.3, into: str = "_quality") -> DataFrame:
    """docs with a struct column ``into``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    ratios = F.split(F.lit(",".join(map(repr, model.first()["ratios"]))), ",").cast("array<double>")  # folded to a constant
    mean = lambda b: F.when(F.size(b) == 0, 0.0).otherwise(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(ratios, x)) / F.size(b))
    score = F.round(let(ngram_buckets(F.col("text"), buckets), mean), 9)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdict(x):
        s, value = x["stats"], x["score"]
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        return F.struct(*[s[n].alias(n) for n in names], failed.alias("base_failed"), value.alias("score"), (~failed & (value >= threshold)).alias("kept"))

    both = F.struct(text_stats(F.col("text")).alias("stats"), score.alias("score"))
    return docs.select("*", let(both, verdict).alias(into))


def trusted_from_labels(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = assess(docs, fit(docs, trusted_from_labels(read_table(spark, sf_dir, "labels"))))
    return out.select("doc_id", "_quality.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's filter: rejected documents go, the others keep the columns of documents."""
    into = free_name(docs, "_weft_quality")
    out = assess(docs, fit(docs, trusted_from_labels(read_table(spark, sf_dir, "labels"))), into=into)
    return out.where(F.col(into)["kept"]).select(*[f"`{c}`" for c in docs.columns])
