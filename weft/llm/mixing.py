"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words; a target stops
at ``most`` times its source's size and the excess is shared again by weight until none is above.
Schedule: slot i of the mix sits at the van der Corput point of i, its bits reversed behind the binary point. With 2^k slots,
the first power of two that holds all, these points are the multiples of 2^-k, each once. Cumulative weights, in slots of one
block, cut them: a source of q blocks has exactly q points, however small it is, and every stretch of the mix has its
share of them. Points behind the last source hold no block. A source's slots are ranked in the mix's order.
Blocks: each source's documents are shuffled by hash, anew for every pass, laid end to end, and cut into blocks of ``block``
words; slot rank r takes block r, the last block ends at the target. What a document gives is its words inside the blocks taken.

No source is one task: places in a source come from prefix sums over hash buckets, slots from chunks of a source's points,
ranks from a closed form (points in an interval among the first i) without a window. Sources are a table; the driver sees totals only.

Defined cases: null and empty texts have size 0 and give nothing; a null source is a source of its own, the last; repeated
rows (also of doc_id) are documents of their own, next to each other in every pass; all sizes 0 or an empty table: targets 0; where
``share`` is above ``most`` every target is its bound; columns other than doc_id, text and source are ignored by mix, and kept by mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import NON_SPACE, before, empty_text, free_name, materialize, numbered, read_table

WEIGHTS = (5, 2, 1)
CHUNK = 1 << 16


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(n, weight) with ``target``. Each round shares what the full sources leave; one aggregate a round, and a level that
    only rises, so that it ends when no further source is full."""
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cap, weight = most * F.col("n"), F.col("weight")
    left, free, full = share * total, None, -1
    while True:
        over = F.lit(False) if free is None else F.lit(left) * weight / F.lit(free) > cap if free else F.lit(True)
        held, rest, n = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0)), F.count_if(over)).first()
        if n == full:
            return sources.withColumn("target", F.when(over, cap).otherwise(F.lit(left) * weight / F.lit(free or 1)))
        left, free, full = share * total - held, rest, n


def schedule(quotas: DataFrame) -> tuple[DataFrame, int]:
    """((slot, src, rank), bits) of quotas(src, quota): 2^bits slots, of which each source has exactly its quota."""
    quotas = materialize(before(quotas, [], "src", "quota", "low"), "quotas")
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    bits = max(0, int(total) - 1).bit_length()
    chunks = quotas.where("quota > 0").select("src", "low", "quota", F.explode(F.sequence(F.lit(0), F.expr(f"(quota - 1) div {CHUNK}"))).alias("chunk"))
    chunks = chunks.repartition("src", "chunk")
    first = F.col("low") + F.col("chunk") * CHUNK
    last = F.least(F.col("low") + F.col("quota"), first + CHUNK) - 1
    points = chunks.select("src", "low", (F.col("low") + F.col("quota")).alias("high"), F.explode(F.sequence(first, last)).alias("point"))
    slots = points.withColumn("slot", F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long"))
    return slots.select("slot", "src", _rank(bits).cast("long").alias("rank")), bits


def _rank(bits: int) -> Column:
    """How many slots before ``slot`` have points in [low, high). The slots before it fall apart into one run per set bit b; a
    run's points are every 2^(bits - b)-th one, from the point's own lowest bits on."""
    out = F.lit(0).cast("long")
    if not bits:
        return out

    def run(total: Column, b: Column) -> Column:
        at, gap = F.lit(bits) - b, F.lit(1).cast("long")
        step = F.call_function("shiftleft", gap, at)
        start = F.pmod(F.col("point"), F.call_function("shiftleft", gap, at - 1))
        upto = lambda edge: F.call_function("shiftright", F.col(edge) - start + step - 1, at)
        return total + F.when(F.call_function("shiftright", F.col("slot"), b).bitwiseAND(F.lit(1)) == 1, upto("high") - upto("low")).otherwise(F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), out, run)


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, counted as the blanks that end one, without keeping the words."""
    marked = F.regexp_replace(empty_text(text), NON_SPACE, "w")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 1024, bucket_rows: int = 1_000, weights=WEIGHTS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, size, source, source_size, target, taken, first_slot (-1: none); the mix: slot, source, doc_id, first, words). ``row``
    names a column that numbers the rows, and is then a column of both tables too."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    digest = F.md5(F.encode(empty_text(F.col("text")), "UTF-8"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), digest.alias("digest"), number.alias("_row"))
    rows = materialize(rows, "mix-rows")
    found = numbered(rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")), [F.col("source").asc_nulls_last()], "src")
    goal = targets(found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))), share, most)
    sources = goal.select("src", "source", F.col("n").alias("source_size"), "target", F.floor(F.col("target") + 0.5).alias("goal"), "docs")
    sources = materialize(sources.withColumn("quota", F.expr(f"(goal + {block - 1}) div {block}")), "mix-sources")
    docs_all, n_sources, name_chars = sources.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    named = F.broadcast(sources) if n_sources <= 100_000 and name_chars <= 4_000_000 else sources
    named = named.select(F.col("source").alias("_source"), "src", "source_size", "target", "goal")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = rows.select("_row", "doc_id", "src", "size", "source_size", "goal", "digest", F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))).alias("pass")).where("size > 0")
    epochs = epochs.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "pass", "digest").cast("binary"))).drop("digest")
    first32 = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    buckets = max(1, -(-docs_all // bucket_rows))
    epochs = epochs.withColumn("bucket", F.shiftright(first32 * buckets, 32))  # ascending with the key: buckets in a row are in the key's order
    sums = before(epochs.groupBy("src", "pass", "bucket").agg(F.sum("size").alias("n")), ["src", "pass"], "bucket", "n", "before")
    inside = Window.partitionBy("src", "pass", "bucket").orderBy("key", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    laid = epochs.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums.drop("n"), ["src", "pass", "bucket"])
    laid = laid.withColumn("a", F.col("source_size") * F.col("pass") + F.col("before") + F.col("own"))
    laid = laid.select("_row", "doc_id", "src", "a", F.least(F.col("a") + F.col("size"), "goal").alias("b")).where("b > a")
    pieces = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    slots, _ = schedule(sources.select("src", "quota"))
    first = F.greatest(F.col("a"), F.col("rank") * block)
    # Slots come out of few rows by explode and would look small enough to broadcast.
    mixed = pieces.join(slots.hint("merge"), ["src", "rank"]).select("slot", "src", "_row", "doc_id", (first - F.col("a")).alias("first"), (F.least(F.col("b"), (F.col("rank") + 1) * block) - first).alias("words"))
    mixed = materialize(mixed, "mix-slots")
    taken = mixed.groupBy("_row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    extra = [F.col("_row").alias(row)] if row else []
    per_doc = rows.join(taken, "_row", "left").select(*extra, "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))
    by_src = F.broadcast(sources.select("src", "source")) if n_sources <= 100_000 and name_chars <= 4_000_000 else sources.select("src", "source")
    return per_doc, mixed.join(by_src, "src").select(*extra, "slot", "source", "doc_id", "first", "words")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """docs, each row whole and once, with size, source_size, target, taken, first_slot and ``slots``: the places in the mix that its
    words fill (slot, first word, words), in order. A name that docs has already gets an underscore behind it."""
    row = free_name(docs, "_weft_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    per_doc, mixed = mix(rows, row=row, **parameters)
    places = mixed.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("slot", "first", "words"))).alias("slots"))
    names = ("size", "source_size", "target", "taken", "first_slot")
    own = per_doc.join(places, row, "left").select(F.col(row).alias("_weft_n"), *[F.col(c).alias(f"_weft_{c}") for c in names], F.coalesce("slots", F.expr("array()").cast("array<struct<slot:bigint,first:bigint,words:bigint>>")).alias("_weft_slots"))
    out = rows.join(own.toDF(*[f"{c}{row}" for c in own.columns]), F.col(row) == F.col(f"_weft_n{row}"))
    return out.select(*[rows[c] for c in docs.columns], *[F.col(f"_weft_{c}{row}").alias(free_name(docs, c)) for c in (*names, "slots")])


#: Points, ranks and blocks by plain counting.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY 1),
w AS (SELECT source, n, 2.0::DOUBLE * n AS cap, [5, 2, 1][(k - 1) % 3 + 1] AS w, k FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS r FROM w),
f AS (SELECT a.r, 1.5::DOUBLE * (SELECT sum(n) FROM s) - coalesce(sum(b.cap), 0) AS rest, (SELECT sum(w) FROM w) - coalesce(sum(b.w), 0) AS share FROM o a LEFT JOIN o b ON b.r < a.r GROUP BY 1),
l AS (SELECT arg_min(rest, r) AS rest, arg_min(share, r) AS share, min(r) AS r FROM f JOIN o USING (r) WHERE rest * w / share <= cap),
g AS (SELECT source, k, n, CASE WHEN o.r < coalesce(l.r, 1e9) THEN cap ELSE l.rest * w / l.share END AS target FROM o, l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS goal, (floor(target + 0.5)::BIGINT + 1023) // 1024 AS quota FROM g),
c AS (SELECT *, sum(quota) OVER (ORDER BY k) - quota AS low FROM q),
b AS (SELECT min(b) AS bits FROM range(0, 60) t(b) WHERE (1::BIGINT << b) >= (SELECT sum(quota) FROM q)),
v AS (SELECT slot, coalesce(list_sum(list_transform(range(0, bits), lambda x: ((slot >> x) & 1) << (bits - 1 - x))), 0) AS point FROM (SELECT bits, unnest(range(0, 1::BIGINT << bits)) AS slot FROM b)),
t AS (SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM v JOIN c ON point >= low AND point < low + quota),
e AS (SELECT d.r, k, size, goal, n * pass + coalesce(sum(size) OVER (PARTITION BY k, pass ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':' || pass::VARCHAR || ':' || digest), size, doc_id, d.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, (SELECT unnest([0, 1]) AS pass)),
p AS (SELECT r, k, a::BIGINT AS a, least(a + size, goal)::BIGINT AS b FROM e WHERE least(a + size, goal) > a),
x AS (SELECT r, k, a, b, unnest(range(a // 1024, (b - 1) // 1024 + 1)) AS rank FROM p),
m AS (SELECT r, sum(least(b, (rank + 1) * 1024) - greatest(a, rank * 1024))::BIGINT AS taken, min(slot)::BIGINT AS first_slot FROM x JOIN t USING (k, rank) GROUP BY 1)
SELECT doc_id, size, n::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN m USING (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the mix as documents with their places in it."""
    return mixed_documents(docs)
