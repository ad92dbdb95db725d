"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct ``width``-word shingles (fewer words: the whole sequence). Its signature is ``symbols`` b-bit
(16-bit) minhash values. Two signatures within distance ``2 * chunks - 1`` have, by the pigeonhole principle, a chunk with at most
one differing symbol; each signature is entered under every chunk with each symbol left out in turn, so that every pair
within that distance shares an entry. With 64 symbols in 16 chunks the distance is 31; a pair of similarity 0.75 differs in
16 on average and in 32 or more with probability 1e-5. Links are confirmed on the full sets.

Entries with one member are done. Within the others no pairs are enumerated: in ``rounds`` rounds each set is compared
with one hub, the one it shares most entries with, and links merge components. What then still shares an entry
across two components meets in blocks: candidate groups (sets connected by open entries) are ordered by component and cut into
blocks of ``block`` sets; two blocks meet in one task unless both lie in the same component. A meeting holds signatures and
sketches only (256 bins, the least hash of each): pairs within the signature distance whose sketches leave a similarity
of ``percent`` open, at 4.5 deviations, are confirmed on the full sets. A meeting with more of them than ``dense`` for each set is held
again with the texts: there a pair is confirmed in the task, unless both sets have been connected already. Only
links leave it. No link between components is lost either way. Equal sets are one set throughout.

Hot entries: their members are rows, counted and joined by Spark; a hub's comparisons are dealt in salted groups
of about ``salt`` members; a task holds one hub's set, or two blocks, at a time. Blocks are bounded by sets and by bytes.

Defined cases: null and empty texts have an empty set and are linked with nothing; rows of a null doc_id are linked with
nothing and have a null component; repeated rows share the component (deduplicate keeps one of them); rows of one doc_id with
different texts are documents of their own; an empty table gives no rows; other columns are ignored, or kept by deduplicate.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import bundles as B
from weft.llm.common import broadcast_if_small, free_name, materialize, read_table
from weft.operators.graph import components

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Hashes(defaultdict):
    """Hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes | None, width: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = B.mix(out * _MULT + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def _permutations(symbols: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"minhash {i}".encode()) | 1 for i in range(symbols)], dtype=np.uint64)


def signature(found: np.ndarray, mults: np.ndarray) -> np.ndarray:
    low = np.full(len(mults), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for a in range(0, len(found), 2048):
        part = found[a : a + 2048]
        for i, m in enumerate(mults):
            low[i] = min(low[i], (part * m).min())
    return (B.mix(low) >> np.uint64(48)).astype(np.uint16)


def digest(text) -> Column:
    """Names a text: 128 bits, computed alike wherever the table is read."""
    return F.md5(F.encode(text, "UTF-8"))


def features(docs: DataFrame, width: int = 5, symbols: int = 64) -> DataFrame:
    """(doc_id, text_id, n_shingles, set_id, sig) of each row; set_id is null for an empty set."""
    mults = _permutations(symbols)

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            n, ids, sigs = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text, width, hashes)
                n.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found, mults).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_id", "n_shingles", "set_id", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_id"), "text")
    return materialize(rows.mapInArrow(run, "doc_id long, text_id string, n_shingles long, set_id binary, sig binary"), "minhash")


def sketch(found: np.ndarray) -> np.ndarray:
    """256 bins: the least of the sorted hashes with these first 8 bits, as 1..65535; 0 for none."""
    out = np.zeros(256, np.uint16)
    bins, first = np.unique(found >> np.uint64(56), return_index=True)
    out[bins.astype(np.int64)] = B.mix(found[first]) % np.uint64(65535) + np.uint64(1)
    return out


def may_be_similar(one: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches leave a similarity of percent open: not more than 4.5 deviations below it."""
    used = ((others != 0) | (one != 0)).sum(axis=1)
    goal = percent / 100
    return ((others == one) & (one != 0)).sum(axis=1) >= goal * used - 4.5 * np.sqrt(goal * (1 - goal) * used) - 1e-9


def _entries(reps: DataFrame, symbols: int, chunk: int) -> DataFrame:
    """(key, rep): a signature under each chunk with each symbol left out."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, symbols // chunk, chunk).astype(np.uint64)
            for c in range(symbols // chunk):
                for out in range(chunk):
                    key = np.full(len(sig), c * chunk + out, np.uint64)
                    for j in range(chunk):
                        if j != out:
                            key = (key << np.uint64(16)) | sig[:, c, j]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, salt: int) -> DataFrame:
    """Those of pairs(a, b) with 100 * intersection >= percent * union, by the full sets of texts(rep, z)."""
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / salt).alias("groups")), "a")
    sized = sized.select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("g"))
    hubs = sized.select("a", "g").distinct().select("a", "g", F.col("a").alias("id"), F.lit(0).alias("kind"))
    rows = hubs.union(sized.select("a", "g", "b", F.lit(1)))
    rows = rows.join(texts.withColumnRenamed("rep", "id"), "id").repartition("a", "g").sortWithinPartitions("a", "g", "kind")

    def run(batches):
        hashes, hub, own = Hashes(), None, None
        for batch in batches:
            links = []
            for a, g, b, kind, z in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = shingles(B.unsqueeze(z), width, hashes)
                if kind == 0:
                    hub, own = (a, g), found
                elif hub == (a, g):
                    if similar(own, found, percent):
                        links.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return rows.select("a", "g", "id", "kind", "z").mapInArrow(run, "a long, b long")


def _one_task(rows: list[tuple], width: int, percent: int, most: int, hashes: Hashes) -> list[tuple[int, int]]:
    """Links between the components of rows (side, rep, comp, sig, z) of one or two blocks; of two, only across them."""
    sides = np.array([r[0] for r in rows])
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1)
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    sets: dict[int, np.ndarray] = {}
    get = lambda i: sets[i] if i in sets else sets.setdefault(i, shingles(B.unsqueeze(rows[i][4]), width, hashes))
    two, links = len(set(sides.tolist())) == 2, []
    for i in range(len(rows)):
        if two and sides[i]:
            continue
        others = np.flatnonzero(sides == 1) if two else np.arange(i + 1, len(rows))
        d = (sigs[others] != sigs[i]).sum(axis=1)
        for j in others[d <= most][np.argsort(d[d <= most], kind="stable")].tolist():
            a, b = root(rows[i][2]), root(rows[j][2])
            if a != b and similar(get(i), get(j), percent):
                top[max(a, b)] = min(a, b)
                links.append((rows[i][1], rows[j][1]))
    return links


def _dealt(open_entries: DataFrame, texts: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(grp, rep, comp, block, mixed): sets that share open entries, in blocks of their group."""
    hubs = open_entries.groupBy("key").agg(F.min("rep").alias("hub")).join(open_entries.select("key", "rep"), "key")
    # A set's hubs (one per entry at most) are tied to the smallest of them: few edges, as many sets have the same hubs.
    hubs = materialize(hubs.groupBy("rep").agg(F.min("hub").alias("first"), F.collect_set("hub").alias("hubs")), "open-hubs")
    edges = hubs.select(F.col("rep").alias("a"), F.col("first").alias("b")).union(hubs.select(F.explode("hubs"), "first")).where("a <> b")
    groups = components(edges.distinct()).select(F.col("id").alias("rep"), F.col("comp").alias("grp"))
    rows = groups.join(open_entries.select("rep", "comp").distinct(), "rep").join(texts.select("rep", F.length("z").alias("bytes")), "rep")
    rows = materialize(rows, "open-sets")
    # Blocks: by hash within (group, component), so that large components have blocks of their own; small ones share.
    sizes = rows.groupBy("grp", "comp").agg(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes).alias("n"))
    shares = sizes.groupBy("grp").agg(F.ceil(F.sum(F.when(F.col("n") < 0.25, F.col("n")))).alias("shared"))
    cut = sizes.join(shares, "grp")
    own = F.when(F.col("n") < 0.25, F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.col("shared")))).otherwise(F.concat(F.lit("c"), F.col("comp"), F.lit("/"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("n")))))
    return materialize(rows.join(cut, ["grp", "comp"]).select("grp", "rep", "comp", own.alias("block"), (F.col("n") < 0.25).alias("mixed")), "blocks")


def _meeting(meet: DataFrame, sets: DataFrame, names: list[str]) -> DataFrame:
    """The sets(grp, block, *names) of each meeting, together and in order."""
    sides = meet.select("grp", F.col("block_x").alias("block"), "block_x", "block_y", F.lit(0).alias("side"))
    sides = sides.union(meet.where("block_x <> block_y").select("grp", F.col("block_y"), "block_x", "block_y", F.lit(1)))
    work = sides.join(sets, ["grp", "block"]).select("grp", "block_x", "block_y", "side", *names)
    return work.repartition("grp", "block_x", "block_y").sortWithinPartitions("grp", "block_x", "block_y", "side", "rep")


def _meetings(batches):
    """((grp, block_x, block_y), rows) of each meeting."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:3] != now:
                if rows:
                    yield now, rows
                now, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield now, rows


def _candidates(rows: list[tuple], percent: int, most: int, dense: int) -> list[tuple[int, int]] | None:
    """Pairs of rows (side, rep, comp, sig, sketch) that may be links between components; None: more than dense a row."""
    sides, comps, reps = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), [r[1] for r in rows]
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1)
    sketches = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), -1)
    two, out = len(set(sides.tolist())) == 2, []
    for i in range(len(rows)):
        if two and sides[i]:
            continue
        j = np.flatnonzero(sides == 1) if two else np.arange(i + 1, len(rows))
        j = j[comps[j] != comps[i]]
        j = j[(sigs[j] != sigs[i]).sum(axis=1) <= most]
        out += [(reps[i], reps[k]) for k in j[may_be_similar(sketches[i], sketches[j], percent)].tolist()]
        if len(out) > dense * len(rows):
            return None
    return out


def _in_blocks(open_entries: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, percent: int, most: int, block: int, block_bytes: int, dense: int, salt: int) -> DataFrame:
    """Links (a, b) between components among sets that share open entries (key, rep, comp)."""
    dealt = _dealt(open_entries, texts, block, block_bytes)
    blocks = dealt.groupBy("grp", "block", "mixed").agg(F.min("comp").alias("comp"))
    x, y = blocks.select("grp", *[F.col(c).alias(f"{c}_x") for c in ("block", "mixed", "comp")]), blocks.select("grp", *[F.col(c).alias(f"{c}_y") for c in ("block", "mixed", "comp")])
    meet = materialize(x.join(y, "grp").where("block_x <= block_y and (mixed_x or mixed_y or comp_x <> comp_y)").select("grp", "block_x", "block_y"), "meetings")
    full = dealt.select("grp", "block", "rep", "comp").join(sigs, "rep").join(texts, "rep")

    def drawn(batches):
        hashes = Hashes()
        for batch in batches:
            own = [sketch(shingles(B.unsqueeze(z), width, hashes)).tobytes() for z in batch.column(batch.schema.get_field_index("z")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("grp", "block", "rep", "comp", "sig")], pa.array(own, pa.binary())], names=["grp", "block", "rep", "comp", "sig", "sketch"])

    light = materialize(full.mapInArrow(drawn, "grp long, block string, rep long, comp long, sig binary, sketch binary"), "sketches")

    def look(batches):
        for (grp, bx, by), rows in _meetings(batches):
            found = _candidates(rows, percent, most, dense)
            out = [(grp, bx, by, None, None)] if found is None else [(grp, bx, by, a, b) for a, b in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["grp", "block_x", "block_y", "a", "b"])

    seen = _meeting(meet, light, ["rep", "comp", "sig", "sketch"]).mapInArrow(look, "grp long, block_x string, block_y string, a long, b long")
    seen = materialize(seen, "candidates")
    links = confirm(seen.where("a is not null").select("a", "b"), texts, width, percent, salt)
    again = seen.where("a is null").select("grp", "block_x", "block_y")
    if again.isEmpty():
        return links

    def settle(batches):
        hashes = Hashes()
        for _, rows in _meetings(batches):
            found = _one_task(rows, width, percent, most, hashes)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links.union(_meeting(again, full, ["rep", "comp", "sig", "z"]).mapInArrow(settle, "a long, b long"))


def _compressed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([B.squeeze(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["rep", "z"])

    return docs.mapInArrow(run, "rep long, z binary")


def _related(docs: DataFrame, width: int, percent: int, symbols: int, chunk: int, rounds: int, salt: int, block: int, block_bytes: int, dense: int, max_broadcast_rows: int) -> DataFrame:
    """(doc_id, text_id, n_shingles, comp, component_id) of each row; comp tells components apart, null for empty sets."""
    most = 2 * (symbols // chunk) - 1
    found = features(docs, width, symbols)
    real = found.where("set_id is not null and doc_id is not null")
    sets = real.groupBy("set_id").agg(F.min("doc_id").alias("low"), F.min("text_id").alias("text_id"), F.first("sig").alias("sig"))
    sets = materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")  # numbered once, in the table
    entries = _entries(sets, symbols, chunk)
    live = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialize(entries.join(live, "key"), "entries")
    sigs = materialize(sets.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "sig", "text_id"), "live-sets")
    wanted = broadcast_if_small(sigs.select("rep", "text_id"), max_broadcast_rows)
    texts = docs.where("text is not null").select(digest(F.col("text")).alias("text_id"), "text").join(wanted, "text_id").select("rep", "text")
    texts = materialize(_compressed(texts).groupBy("rep").agg(F.first("z").alias("z")), "live-texts")  # equal texts: any will do
    sigs = sigs.select("rep", "sig")
    links, labels = None, None
    for r in range(rounds + 1):
        now = members.withColumn("comp", F.col("rep"))
        if labels is not None:
            now = members.join(labels, members["rep"] == labels["id"], "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
        hub = F.min_by(F.struct("rep", "comp"), F.struct(F.xxhash64("rep", F.lit(r)) if r else F.col("rep"), F.col("rep")))
        open_ = now.groupBy("key").agg(hub.alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        if r < rounds:
            pairs = now.join(open_.select("key", "hub"), "key").where("hub.comp <> comp").groupBy(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("n"))
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
            pairs = materialize(pairs, "pairs")
            if pairs.isEmpty():
                break
            new = confirm(pairs, texts, width, percent, salt)
        else:
            own = materialize(now.join(open_.select("key"), "key", "left_semi"), "open-entries")
            if own.isEmpty():
                break
            new = _in_blocks(own, sigs, texts, width, percent, most, block, block_bytes, dense, salt)
        new = materialize(new, "links")
        links = new if links is None else links.union(new)
        labels = components(links)
    comps = sets.select("set_id", "low", F.col("rep").alias("comp"))
    if labels is not None:
        named = sets.join(labels, sets["rep"] == labels["id"], "left").select("set_id", "low", F.coalesce("comp", "rep").alias("comp"))
        first = named.groupBy("comp").agg(F.min("low").alias("least"))
        comps = named.join(first, "comp").select("set_id", F.col("least").alias("low"), "comp")
    out = found.join(comps, "set_id", "left")
    return out.select("doc_id", "text_id", "n_shingles", "comp", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))


PARAMETERS = dict(width=5, percent=75, symbols=64, chunk=4, rounds=2, salt=256, block=512, block_bytes=16 << 20, dense=16, max_broadcast_rows=250_000)


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; parameters: those of PARAMETERS."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _related(docs, **(PARAMETERS | parameters)).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, max_broadcast_rows: int = 4_000_000, **parameters) -> DataFrame:
    """The rows of docs that stay, with their columns: one of each component, that of the smallest doc_id, then of the smallest
    digest of its text, then of its other columns. Rows of a null doc_id stay."""
    out = _related(docs, **(PARAMETERS | parameters)).where("doc_id is not null").withColumn("text_id", F.coalesce("text_id", F.lit("")))
    out = materialize(out, "near-dup")
    id_, text_, gone, kept, number = (free_name(docs, c) for c in ("_weft_id", "_weft_text", "_weft_gone", "_weft_kept", "_weft_n"))
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(text_, F.coalesce(digest(F.col("text")), F.lit("")))

    def matched(left, right, how):
        right = broadcast_if_small(right.toDF(*[gone, kept][: len(right.columns)]), max_broadcast_rows)
        on = [F.col(id_) == F.col(gone), F.col(text_) == F.col(kept)][: len(right.columns)]
        return left.join(right, on, how)

    left = matched(rows, out.where("doc_id <> component_id").select("doc_id", "text_id").distinct(), "left_anti")
    firsts = out.where("doc_id = component_id")
    twice = materialize(firsts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if not twice.isEmpty():
        keep = firsts.join(twice, "doc_id").groupBy("doc_id", "comp").agg(F.min("text_id").alias("text_id")).select("doc_id", "text_id")
        of_pair = Window.partitionBy(id_, text_).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns]))
        one = matched(left, keep, "left_semi").withColumn(number, F.row_number().over(of_pair)).where(F.col(number) == 1).drop(number)
        left = matched(left, twice, "left_anti").unionByName(one)
    return left.select(*[f"`{c}`" for c in docs.columns])


#: Brute force: every pair of documents that share a shingle, then the closure of the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS m FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(m) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, (d.doc_id = m) AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)
