"""Decontamination, quality rules, licenses, URL filter, chat formatting, mixing."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, corpus, frame, lower, words
from weft.llm import chat, common, decontaminate, licenses, mixing, quality, url_filter

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def contaminated(rows, items, window=13):
    found = {}
    sets = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        if item is not None and w:
            sets.setdefault(item, set()).update(tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1)))
    for row in rows:
        w, hit, its = WORD.findall(lower(row[1])), set(), set()
        for item, windows in sets.items():
            for size in {len(x) for x in windows}:
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) in windows:
                        hit.update(range(i, i + size))
                        its.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, its))).encode()).hexdigest()
        found.setdefault(row[0], (len(w), len(hit), len(its), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return found


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontamination(spark, block_words):
    rows = corpus()
    items = [(1, rows[0][1][:200]), (2, rows[5][1]), (10, "one two"), (11, "One, TWO!"), (3, None), (4, "..."), (None, rows[7][1]), (2, rows[5][1]), (5, "日本語 straße")]
    out = decontaminate.annotate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    want = contaminated(rows, items)
    got = out.select("doc_id", "_decon.*").collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(frame(spark, []), none).count() == 0
    out = decontaminate.annotate(frame(spark, corpus()), none)
    assert out.where("_decon.contaminated or _decon.n_items > 0").count() == 0


def test_decontamination_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "x y z", 7, "keep")], "doc_id long, text string, n_words int, contaminated string")
    out = decontaminate.annotate(rows, spark.createDataFrame([(1, "q")], "item_id long, text string")).first()
    assert (out["n_words"], out["contaminated"], out["_decon"]["n_words"]) == (7, "keep", 3)


def stats(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rows = [*corpus(), (900, "a b c d e f a b c d e x\nline\nline\n\n###|<>$%&*\x0b w", "en", "s", 1), (901, "x " * 10, "en", "s", 1)]
    docs = frame(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (3,)], "doc_id long")
    out = quality.assess(docs, quality.fit(docs, trusted, buckets=1024), buckets=1024).select("doc_id", "text", "_quality.*").collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in out}
    for i, text, *_ in rows:
        r = by[i, text]
        n = stats(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, text
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rejects_what_is_unlike_the_target(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(40)), "en", "s", 1) for i in range(40)]
    bad = [(100 + i, " ".join(f"w{(i * 3 + k) % 30}$$$ ###" for k in range(30)), "en", "s", 1) for i in range(10)]
    docs = frame(spark, good + bad)
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    out = {r["doc_id"]: r for r in quality.assess(docs, quality.fit(docs, trusted)).select("doc_id", "_quality.*").collect()}
    assert all(out[i]["kept"] for i in range(40)) and not any(out[100 + i]["kept"] for i in range(10))
    shuffled = quality.assess(docs, quality.fit(docs, trusted, max_broadcast_rows=1))  # the other way of joining
    assert {r["doc_id"]: r["_quality"]["score"] for r in shuffled.collect()} == {i: r["score"] for i, r in out.items()}


def test_quality_of_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long")
    assert quality.assess(none, quality.fit(none, labels)).count() == 0
    docs = frame(spark, corpus())
    assert {r["_quality"]["score"] for r in quality.assess(docs, quality.fit(docs, labels)).collect()} == {0.0}


def test_quality_stage_keeps_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)), "mine", False), (2, "x", "mine", True)], "doc_id long, text string, score string, kept boolean")
    out = quality.stage(spark, docs, str(tmp_path)).collect()
    assert [(r["doc_id"], r["score"], r["kept"]) for r in out] == [(1, "mine", False)]


def test_licenses(spark):
    mit = "\n".join([licenses.SENTENCES["mit-grant"].replace("to deal", "to\n deal"), licenses.SENTENCES["mit-notice"], "", licenses.SENTENCES["mit-warranty"]])
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nmore"), (2, "licensed under the APACHE license, version 2.0!"), (3, f"/* Copyright 2020 X */\n{mit}"),
        (4, licenses.SENTENCES["bsd-redistribution"]), (5, None), (6, ""), (7, "the license is not one"), (8, "x " * 50000 + "\nLicensed under CC BY 4.0."),
        (9, "Licensed under CC BY 4.0.\nReleased under the MIT License.\nReleased under the MIT License."), (9, "Licensed under CC BY 4.0."),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], r["_license"]["licenses"]) for r in out.collect()]
    assert sorted(got) == sorted([(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (4, ""), (5, ""), (6, ""), (7, ""), (8, "CC-BY-4.0"), (9, "CC-BY-4.0,MIT"), (9, "CC-BY-4.0")])
    third = next(r["_license"] for r in out.collect() if r["doc_id"] == 3)
    assert third["sentence_ids"].split(",") == ["mit-grant", "mit-notice", "mit-warranty"] and third["n_matches"] == 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_notices_and_long_runs_of_known_sentences():
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES, 2)
    gnu = "This {what} is free software{colon} you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation{semi} either version {v} of the License, or\n(at your option) any later version."
    notices = {
        "GPL-3.0-or-later": gnu.format(what="program", colon=":", kind="", semi=",", v="3"), "GPL-2.0-or-later": gnu.format(what="program", colon=";", kind="", semi=";", v="2"),
        "LGPL-2.1-or-later": gnu.format(what="library", colon=";", kind="Lesser ", semi=";", v="2.1"), "AGPL-3.0-or-later": gnu.format(what="program", colon=":", kind="Affero ", semi=",", v="3"),
        "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Unlicense": "This is free and unencumbered software released into the public domain.", "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    }
    for name, text in notices.items():
        assert scanner.scan(f"Some words before.\n\n{text}\n\nAnd after.")["licenses"] == name
    began = time.time()
    out = scanner.scan("Released under the MIT License.\nLicensed under CC BY 4.0.\n" * 10_000)
    assert out["n_matches"] == 20_000 and time.time() - began < 20


def test_decontamination_stage_keeps_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "x y z", "a", 1), (2, "q", "b", 2)], "doc_id long, text string, _weft_decon string, _weft_row int")
    assert [tuple(r) for r in decontaminate.stage(spark, docs, str(tmp_path)).collect()] == [(2, "q", "b", 2)]
    out = decontaminate.annotate(docs, spark.createDataFrame([(1, "x y z"), (2, "p q")], "item_id long, text string"), into="_weft_decon", block_words=1)
    assert out.columns == ["doc_id", "text", "_weft_decon", "_weft_row", "_weft_decon_"] and out.where("_weft_decon_.contaminated").count() == 1


def test_license_rules_against_brute_force():
    """Every subsequence of known sentences, by hand: a rule matches where its identifiers follow one another within the gap."""
    scanner = licenses.Scanner({"a": "alpha one.", "b": "beta two.", "c": "gamma three."}, (("AB", ("a", "b")), ("ABC", ("a", "b", "c")), ("C", ("c",))), gap=1)
    say = {"a": "Alpha one.", "b": "Beta two.", "c": "Gamma three.", "x": "Nothing here."}
    import itertools

    for order in itertools.product("abcx", repeat=4):
        text = "\n".join(say[o] for o in order)
        ids = [(k, o) for k, o in enumerate(order) if o != "x"]
        spans = []
        for name, rule in (("AB", "ab"), ("ABC", "abc"), ("C", "c")):
            for k, o in ids:
                at, ok = k, o == rule[0]
                for want in rule[1:]:
                    after = [j for j, p in ids if j > at and j - at <= 2 and p == want]
                    ok, at = ok and bool(after), after[0] if after else at
                if ok:
                    spans.append((-len(rule), k, name, at))
        taken = []
        for _, a, name, b in sorted(spans):
            if all(b < x or a > y for x, y, _ in taken):
                taken.append((a, b, name))
        assert scanner.scan(text)["licenses"] == ",".join(sorted({n for _, _, n in taken})), order


def test_url_rules_and_parts(spark):
    rows = [
        (1, "http://A.Example.ORG/es/9?x=1", "a.example.org", "/es/9", "example.org/es/", "block"), (2, "https://x.org", "x.org", "", None, None),
        (3, "https://x.org/", "x.org", "/", "org/", "allow"), (4, "https://example.org/en/17#t", "example.org", "/en/17", "example.org/en/1", "block"),
        (5, "https://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"), (6, "https://b.com/de/a", "b.com", "/de/a", "com/de/", "block"),
        (7, "b.com/de/a", "", "", None, None), (8, None, "", "", None, None), (9, "ftp://notcom/de/x", "notcom", "/de/x", None, None), (9, "https://q.net/?u=http://x.org/", "q.net", "/", None, None),
    ]
    out = url_filter.judge(spark.createDataFrame([(i, u) for i, u, *_ in rows], "page_id long, url string")).collect()
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in out if r["page_id"] < 9)
    assert got == sorted((i, h, p, rule) for i, _, h, p, rule, _ in rows if i < 9)
    verdicts = {r["page_id"]: r["verdict"] for r in out}
    assert all(verdicts[i] == v for i, *_, v in rows if v)
    assert set(verdicts.values()) <= {"allow", "block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates_generalise(spark):
    """On one host every labelled page under /ads is blocked and under /news allowed: pages without a rule follow their template."""
    rules = (("block", "h.net/ads/x/"), ("allow", "h.net/news/x/"))
    urls = [f"http://h.net/{k}/x/{i}" for i in range(40) for k in ("ads", "news")] + [f"http://h.net/{k}/y/{i}" for i in range(5) for k in ("ads", "news")]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules)
    for r in out.collect():
        assert r["verdict"] == ("block" if r["path"].startswith("/ads/") else "allow"), r


def tree(urls, rules, many, share, z, weight=4.0):
    """(template, purity) per url by plain recursion over the whole tree; urls: (host, path)."""

    def label(host, path):
        fits = [(len(r), what == "block") for what, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fits)[1] if fits else None

    rows = [(h, ["*" if re.search("[0-9]", s) or len(s) >= 24 else s for s in p.split("/") if s], label(h, p)) for h, p in urls]
    seen = [x for *_, x in rows if x is not None]
    prior, out = (sum(seen) + weight / 2) / (len(seen) + weight), [None] * len(rows)
    test = lambda gap, p, n, m: abs(gap) > z * (p * (1 - p) * (1 / n + 1 / max(m, 1))) ** 0.5

    def count(ids):
        found = [rows[i][2] for i in ids if rows[i][2] is not None]
        return len(found), sum(found)

    def descend(ids, d, node, p, n, bad, template):
        for i in ids:
            out[i] = (template, p)
        if not 0 < bad < n:
            return
        kids = {}
        for i in ids:
            if len(rows[i][1]) > d:
                kids.setdefault(rows[i][1][d], []).append(i)
        thin = {k for k, v in kids.items() if len(v) < share * sum(map(len, kids.values()))}
        if len(thin) > many:
            kids = {k: v for k, v in kids.items() if k not in thin} | {"*": sorted(i for k in thin | ({"*"} & kids.keys()) for i in kids[k])}
        counts = {k: count(v) for k, v in kids.items()}
        own = sorted((b / m, k) for k, (m, b) in counts.items() if m and test(b / m - p, p, m, n))
        runs = []
        for r, k in own:
            if runs:
                (m, b), (m0, b0) = counts[k], counts[runs[-1][-1]]
                if not test(r - b0 / m0, (b + b0) / (m + m0), m, m0):
                    runs[-1].append(k)
                    continue
            runs.append([k])
        for run in runs:
            m, b = sum(counts[k][0] for k in run), sum(counts[k][1] for k in run)
            name = node + "/" + "|".join(sorted(run))
            descend([i for k in run for i in kids[k]], d + 1, name, (b + weight * p) / (m + weight), m, b, name)
        for k in kids.keys() - {k for _, k in own}:
            descend(kids[k], d + 1, node + "/" + k, p, *counts[k], template)

    for host in {r[0] for r in rows}:
        ids = [i for i, r in enumerate(rows) if r[0] == host]
        n, bad = count(ids)
        own = n and test(bad / n - prior, prior, n, len(seen))
        descend(ids, 0, host, (bad + weight * prior) / (n + weight) if own else prior, n, bad, host if own else "")
    return [(t, round(p, 6)) for t, p in out]


@pytest.mark.parametrize("seed", range(3))
def test_url_tree_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rules = (("block", "h.net/a/b/c/d/bad/"), ("allow", "h.net/a/b/c/d/good/"), ("block", "h.net/a/b/x/"), ("allow", "h.net/a/q/"), ("block", "g.net/r1/"), ("allow", "g.net/r2/"), ("block", "k.net/a/"), ("block", "k.net/b/"), ("allow", "k.net/"))
    names = ["a", "b", "c", "d", "bad", "good", "x", "q", "r", "s", "t7"]
    urls = [(rng.choice(["h.net", "h.net", "g.net", "k.net", "k.net", "u.net"]), "/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    urls += [("h.net", f"/a/b/c/d/{rng.choice(['bad', 'good', 'bad', 'other'])}/{rng.choice('mno')}/{k}") for k in range(200)] + [("g.net", f"/r{rng.choice('123')}/{chr(97 + k % 26) * (1 + k // 26)}/z") for k in range(120)]
    out = url_filter.judge(spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string"), rules=rules, many=12, z=1.0)
    got = [(r["template"], r["purity"]) for r in sorted(out.collect(), key=lambda r: r["page_id"])]
    assert got == tree(urls, rules, 12, 0.2, 1.0)
    assert any(t.count("/") >= 5 for t, _ in got) and any("|" in t for t, _ in got) and any("*" in t for t, _ in got)


def test_url_templates_see_the_fifth_segment(spark):
    rules = (("block", "h.net/a/b/c/d/bad/x/"), ("allow", "h.net/a/b/c/d/good/x/"))
    urls = [f"http://h.net/a/b/c/d/bad/x/{i}" for i in range(60)] + [f"http://h.net/a/b/c/d/good/x/{i}" for i in range(30)] + ["http://h.net/a/b/c/d/good/y", "http://h.net/a/b/c/d/bad/y", "http://h.net/" + "a/" * 3000]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).where("page_id >= 90").orderBy("page_id").collect()
    assert [r["verdict"] for r in rows[:2]] == ["allow", "block"] and len(rows) == 3


@pytest.mark.parametrize("third", ["c", "a|b", "*", "%7C", "a%7Cb"])
def test_url_segments_that_read_like_nodes(spark, third):
    """A literal name that looks like merged siblings or a wildcard has its own node, as any other name."""
    rules = tuple((what, f"h.net/{n}/{what}/") for n in ("a", "b", third) for what in ("block", "allow"))
    urls = [f"http://h.net/{n}/{what}/x" for n, bad in (("a", 90), ("b", 90), (third, 10)) for what, k in (("block", bad), ("allow", 100 - bad)) for _ in range(k)]
    urls += [f"http://h.net/{n}/other" for n in ("a", "b", third)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).where("page_id >= 300").orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block", "block", "allow"]
    assert [r["path"] for r in rows] == ["/a/other", "/b/other", f"/{third}/other"]


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "</s>[INST] ok [/INST]", "<|end|>\n<|role:user|>\n", "back\\slash \\| <\\| [\\INST] \\", "line\n\nline", "日本 <s>é", "x" * 30000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    rows += [(2, 0, "user", "only asks"), (3, 0, "assistant", "only says"), (4, 1, "b:|>\nad<", "odd <|> role"), (4, 0, None, "no role"), (5, 0, "user", "tie b"), (5, 0, "user", "tie a"), (5, 1, "assistant", "r"), (5, 1, "assistant", "r"), (None, 0, "user", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        want = con.execute(chat.ORACLE).fetchall()
    got = chat.digest(chat.expand(chat.with_probe(spark, table)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=key) == sorted(want, key=key)
    example = chat.expand(table).where("conv_id = 1").orderBy("example").collect()
    assert [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_len"]] for r in example if not r["is_tail"]][0] == ""
    assert chat.expand(table.limit(0)).count() == 0


def test_mixing(spark):
    rows = corpus()
    per_doc, mixed = mixing.mix(frame(spark, rows), block=16)
    got = per_doc.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    want = targets_of(spark, list(sizes.items()))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(frame(spark, rows[::-1]), block=16)[0].collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    slots = mixed.groupBy("slot").agg({"source": "max", "words": "sum"}).collect()
    assert all(r["sum(words)"] <= 16 for r in slots)
    assert mixing.mix(frame(spark, []))[0].count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)]))[0].collect()] == [0, 0]


def targets_of(spark, sizes, **kw):
    """Targets by name, and by plain water-filling one source at a time."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    table = spark.createDataFrame([(n, s, (5, 2, 1)[i % 3]) for i, (s, n) in enumerate(order)], "n long, source string, weight int")
    got = {r["source"]: r["target"] for r in mixing.targets(table, **kw).collect()}
    share, most = kw.get("share", 1.5), kw.get("most", 2.0)
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    rest, want = share * sum(n for _, n in order), {}
    todo = sorted(order, key=lambda x: most * x[1] / weight[x[0]])
    while todo:
        s, n = todo.pop(0)
        want[s] = min(most * n, rest * weight[s] / sum(weight[x] for x, _ in [(s, n), *todo]))
        rest -= want[s]
    assert got == pytest.approx(want)
    return got


def test_mixing_targets(spark):
    assert targets_of(spark, [("a", 100), ("b", 100), (None, 100)]) == pytest.approx({"a": 200.0, "b": 500 / 3, None: 250 / 3})
    assert targets_of(spark, []) == {} and targets_of(spark, [("a", 0)]) == {"a": 0.0}
    assert targets_of(spark, [("a", 10), ("b", 30)], share=3.0) == {"a": 20.0, "b": 60.0}  # all at their bound
    targets_of(spark, [(f"s{i:02d}", (i * 37) % 11 * 10 ** (i % 5)) for i in range(40)])


def radical_inverse(i, bits):
    return int(format(i, f"0{bits}b")[::-1], 2) if bits else 0


def ranks(spark, quota):
    """The schedule by plain counting: slots in order, each given to the source whose interval holds its point."""
    slots, bits = mixing.schedule(spark.createDataFrame(list(enumerate(quota)), "src long, quota long"))
    got = {(r["slot"], r["src"], r["rank"]) for r in slots.collect()}
    edges, at = [], 0
    for s, n in enumerate(quota):
        edges.append((at, at + n, s))
        at += n
    want, seen = set(), Counter()
    owner = [s for low, high, s in edges for _ in range(low, high)]
    for i in range(1 << bits):
        point = radical_inverse(i, bits)
        if point < len(owner):
            want.add((i, owner[point], seen[owner[point]]))
            seen[owner[point]] += 1
    assert got == want and len(got) == sum(quota)
    return sorted(got)


def test_mixing_keeps_low_discrepancy(spark):
    rows = ranks(spark, [500, 300, 200])
    for k in range(50, 1000, 50):
        for s, share in ((0, 0.5), (1, 0.3), (2, 0.2)):
            assert abs(sum(r[1] == s for r in rows[:k]) - k * share) <= 6


@pytest.mark.parametrize("quota", [[8043, 1, 16956], [0, 3, 0, 1], [1], [], [0, 0], [100_000, 3, 1, 29, 70_000, 1, 2, 140_000, 5, 8, 13, 1, 1, 1, 65_536]])
def test_mixing_gives_every_source_its_quota(spark, quota):
    rows = ranks(spark, quota)
    assert Counter(s for _, s, _ in rows) == {s: n for s, n in enumerate(quota) if n}


def test_mixing_takes_small_sources_whole(spark):
    sizes = {"a": 6090, "b": 1, "c": 38643}
    docs = [(i, "w " * n, "en", s, 2 * n) for i, (s, n) in enumerate(sizes.items())]
    per_doc, mixed = mixing.mix(frame(spark, docs), block=2)
    want = targets_of(spark, list(sizes.items()))
    assert {r["source"]: r["taken"] for r in per_doc.collect()} == {s: round(t) for s, t in want.items()}
    assert mixed.where("source = 'b'").select("slot").distinct().count() == 1


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7, "t"), (2, None, "x", 8, None), (None, "d e", None, 9, "u"), (None, "d e", None, 9, "u")], "doc_id long, text string, source string, size int, _weft_row string")
    out = mixing.mixed_documents(docs, block=2)
    assert out.columns == ["doc_id", "text", "source", "size", "_weft_row", "size_", "source_size", "target", "taken", "first_slot", "slots"]
    rows = out.collect()
    assert sorted((str(r["doc_id"]), r["size"], r["size_"]) for r in rows) == [("1", 7, 3), ("2", 8, 0), ("None", 9, 2), ("None", 9, 2)]
    for r in rows:
        assert sum(p["words"] for p in r["slots"]) == r["taken"] and r["first_slot"] == min((p["slot"] for p in r["slots"]), default=-1)
    assert mixing.mixed_documents(frame(spark, [])).count() == 0


def test_whole_numbers_in_order(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    table = spark.createDataFrame(rows, "x long, k long").repartition(5)
    assert sorted((r["x"], r["n"]) for r in common.numbered(table, [F.col("x")], "n").collect()) == [(i, i) for i in range(1000)]
    for r in common.before(table, ["k"], "x", "x", "sum", width=64).collect():
        assert r["sum"] == sum(x for x, k in rows if k == r["k"] and x < r["x"])


def test_schema(spark):
    assert frame(spark, []).schema.simpleString() == "struct<" + DOCS.replace("long", "bigint").replace(" ", ":").replace(",:", ",") + ">"


def test_short_lines_are_not_normalised_again_and_again(monkeypatch):
    """A long text of short lines: what is normalised stays within a few times its length."""
    scanner, seen, plain = licenses.Scanner(licenses.SENTENCES, licenses.RULES, 2), [], licenses.normalise
    monkeypatch.setattr(licenses, "normalise", lambda s: seen.append(len(s)) or plain(s))
    text = "noninfringement\n" + ("abc\n" * 500 + "x.\n") * 40 + licenses.SENTENCES["mit-name"] + "\n"
    assert scanner.scan(text)["licenses"] == "MIT" and sum(seen) < 4 * len(text)
