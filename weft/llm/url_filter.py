"""URL filter by a path-template tree per host, with DataFrame functions only.

Urls that a rule fits are the labelled examples (allow or block); every other url gets the verdict of its template.
1. Each path becomes segments, all of them; a segment with a digit, of 24 or more characters, or of hex only is variable: ``*``.
2. From the host down, level by level: children with less than ``share`` of their parent's rows are thin; if there are more
   than ``many`` thin ones, they are one child ``*``. So no parent keeps more than many + 1 / share + 1 children.
3. A child whose labelled purity does not differ from its parent's estimate by a two-proportion test is merged with the
   parent: it takes the parent's estimate. Those that differ are laid side by side by purity; neighbours that do not differ from
   each other are merged into one node (``a|b``), their counts and their branches below together.
4. Purity is smoothed towards the parent (root: all labelled urls); a url is blocked if its deepest node's is at least ``reject``.
A branch without labels, or whose labels all agree, is not split further, so that there are as many levels as labels that differ
need, at any depth.

Hosts of any size: counts are aggregated before every shuffle, nothing is collected, no group is gathered by one task; each level
is written to the shared folder and holds the shapes still open only.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged as such; ties between rules of
the same length go to block; empty tables give no rows; other columns are ignored; repeated rows are judged alike, one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import ascii_lower, materialize, read_table

#: The contract's rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none. The rule list is a parameter of the query: a few entries."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """The path's segments, variable ones as ``*``; in others ``%``, ``|`` and ``*`` are escaped, so that no segment reads like a wildcard or a merged node."""
    literal = lambda s: F.replace(F.replace(F.replace(s, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("*"), F.lit("%2A"))
    fixed = lambda s: F.when(s.rlike(r"[0-9]") | (F.length(s) >= 24) | s.rlike(r"^[0-9a-fA-F]{8,}$"), "*").otherwise(literal(s))
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), fixed)


def _differ(rate: Column, p: Column, n: Column, m: Column, z: float) -> Column:
    return F.abs(rate) > z * F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), n) + 1 / F.greatest(m, F.lit(1))))


def _level(open_: DataFrame, d: int, many: int, share: float, z: float, weight: float) -> DataFrame:
    """open_ shapes (node, purity, seen, blocked of their node; rows, n, bad of their own) one level down, at their d-th segment."""
    rows = open_.withColumn("child", F.element_at("seg", d))
    kids = rows.groupBy("node", "child").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("purity").alias("up"), F.first("seen").alias("n_up"))
    sizes = kids.groupBy("node").agg(F.sum("rows").alias("all"))
    kids = kids.join(sizes, "node").withColumn("thin", F.col("rows") < share * F.col("all"))
    wide = kids.groupBy("node").agg((F.count_if("thin") > many).alias("wide"))
    kids = materialize(kids.join(wide, "node").withColumn("name", F.when(F.col("thin") & F.col("wide"), "*").otherwise(F.col("child"))), "url-children")
    named = kids.groupBy("node", "name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("up").alias("up"), F.first("n_up").alias("n_up"))
    n, bad, up = F.col("n"), F.col("bad"), F.col("up")
    named = named.withColumn("own", (n > 0) & F.coalesce(_differ(F.try_divide(bad, n) - up, up, n, F.col("n_up"), z), F.lit(False)))
    # Siblings: a parent has a bounded number of named children.
    side = Window.partitionBy("node", "own").orderBy(F.try_divide(bad, n), "name")
    n0, bad0 = F.lag("n").over(side), F.lag("bad").over(side)
    pool = F.try_divide(bad + bad0, n + n0)
    apart = F.col("own") & F.coalesce(_differ(F.try_divide(bad, n) - F.try_divide(bad0, n0), pool, n, n0, z), F.lit(True))
    named = named.withColumn("run", F.when(F.col("own"), F.sum(apart.cast("int")).over(side)))
    merged = named.where("own").groupBy("node", "run").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("label"), F.sum("n").alias("seen"), F.sum("bad").alias("blocked"))
    named = named.join(merged, ["node", "run"], "left")
    named = named.select("node", "name", "own", "up", F.concat("node", F.lit("/"), F.coalesce("label", "name")).alias("next"), F.coalesce("seen", "n").alias("seen"), F.coalesce("blocked", "bad").alias("blocked"))
    smooth = F.when(F.col("own"), (F.col("blocked") + weight * up) / (F.col("seen") + weight)).otherwise(up)
    found = kids.select("node", "child", "name").join(named.withColumn("purity", smooth), ["node", "name"]).drop("name", "up")
    out = rows.drop("purity", "seen", "blocked").join(found, ["node", "child"])
    template = F.when(F.col("own"), F.col("next")).otherwise(F.col("template"))
    return out.select("host", "shape", "seg", "rows", "n", "bad", F.col("next").alias("node"), "purity", "seen", "blocked", template.alias("template"))


def _purity(shapes: DataFrame, many: int, share: float, z: float, weight: float) -> DataFrame:
    """(host, shape, purity, template) of shapes(host, shape, seg, rows, n, bad)."""
    total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    prior = (total["bad"] + 0.5 * weight) / (total["n"] + weight)
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("seen"), F.sum("bad").alias("blocked"))
    own = (F.col("seen") > 0) & F.coalesce(_differ(F.try_divide("blocked", "seen") - prior, F.lit(prior), F.col("seen"), F.lit(total["n"]), z), F.lit(False))
    smooth = F.when(own, (F.col("blocked") + weight * prior) / (F.col("seen") + weight)).otherwise(F.lit(prior))
    hosts = hosts.select("host", "seen", "blocked", smooth.alias("purity"), F.when(own, F.col("host")).otherwise("").alias("template"))
    state = shapes.join(hosts, "host").withColumn("node", F.col("host"))
    done, d = [], 0
    while True:
        state, d = materialize(state, "url-level"), d + 1
        splits = (F.col("blocked") > 0) & (F.col("blocked") < F.col("seen")) & (F.size("seg") >= d)
        done.append(state.where(~splits).select("host", "shape", "purity", "template"))
        state = state.where(splits)
        if state.isEmpty():
            break
        state = _level(state, d, many, share, z, weight)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def judge(pages: DataFrame, rules=RULES, many: int = 20, share: float = 0.2, z: float = 1.96, weight: float = 4.0, reject: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of pages(page_id, url). The tree is built over
    counts of distinct (host, shape) pairs, never over rows."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), F.array_join(_segments(F.col("path")), "/").alias("shape"))
    labelled = lambda what: F.sum(F.when(what, 1).otherwise(0))
    shapes = urls.groupBy("host", "shape").agg(
        F.count("*").alias("rows"), labelled(F.col("ruled").isNotNull()).alias("n"), labelled(F.col("ruled") == "block").alias("bad"))
    shapes = materialize(shapes.withColumn("seg", F.filter(F.split("shape", "/"), lambda s: s != "")), "url-shapes")
    out = urls.join(_purity(shapes, many, share, z, weight), ["host", "shape"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle(rules=RULES, many: int = 20, share: float = 0.2, z: float = 1.96, weight: float = 4.0, reject: float = 0.5, levels: int = 8) -> str:
    """The same judgement as SQL over the table pages. SQL has no loop for its levels: it ends with an error where ``levels`` are too few."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block"))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))", what, rule) for what, rule in ranked for h, _, p in [rule.partition("/")]]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    differ = lambda rate, p, n, m: f"abs({rate}) > {z} * sqrt({p} * (1 - {p}) * (1 / {n} + 1 / greatest({m}, 1)))"
    fixed = "CASE WHEN regexp_matches(s, '[0-9]') OR length(s) >= 24 OR regexp_matches(s, '^[0-9a-fA-F]{8,}$') THEN '*' ELSE replace(replace(replace(s, '%', '%25'), '|', '%7C'), '*', '%2A') END"
    steps = [f"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {case(2)} AS rule, {case(1)} AS ruled, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {fixed}), '/') AS shape FROM u),
s AS (SELECT host, shape, count(*) AS rows, count(ruled)::DOUBLE AS n, (count(*) FILTER (ruled = 'block'))::DOUBLE AS bad, list_filter(string_split(shape, '/'), lambda s: s <> '') AS seg FROM r GROUP BY host, shape),
pri AS (SELECT (coalesce(sum(bad), 0) + {0.5 * weight}) / (coalesce(sum(n), 0) + {weight}) AS prior, coalesce(sum(n), 0) AS n_all FROM s),
h AS (SELECT host, sum(n) AS seen, sum(bad) AS blocked FROM s GROUP BY 1),
ho AS (SELECT *, seen > 0 AND {differ("blocked / seen - prior", "prior", "seen", "n_all")} AS own FROM h, pri),
s0 AS (SELECT s.*, host AS node, seen, blocked, CASE WHEN own THEN (blocked + {weight} * prior) / (seen + {weight}) ELSE prior END AS purity, CASE WHEN own THEN host ELSE '' END AS template FROM s JOIN ho USING (host))"""]
    opened = lambda d: f"blocked > 0 AND blocked < seen AND len(seg) >= {d}"
    for d in range(1, levels + 1):
        steps.append(f"""k{d} AS (SELECT node, seg[{d}] AS child, sum(rows) AS rows, sum(n) AS n, sum(bad) AS bad, min(purity) AS up, min(seen) AS n_up FROM s{d - 1} WHERE {opened(d)} GROUP BY 1, 2),
t{d} AS (SELECT *, rows < {share} * sum(rows) OVER (PARTITION BY node) AS thin FROM k{d}),
w{d} AS (SELECT *, CASE WHEN thin AND count(*) FILTER (thin) OVER (PARTITION BY node) > {many} THEN '*' ELSE child END AS name FROM t{d}),
n{d} AS (SELECT node, name, sum(n) AS n, sum(bad) AS bad, min(up) AS up, min(n_up) AS n_up FROM w{d} GROUP BY 1, 2),
o{d} AS (SELECT *, n > 0 AND {differ("bad / n - up", "up", "n", "n_up")} AS own FROM n{d}),
l{d} AS (SELECT *, lag(n) OVER x AS n0, lag(bad) OVER x AS bad0 FROM o{d} WINDOW x AS (PARTITION BY node, own ORDER BY bad / n, name)),
a{d} AS (SELECT *, own AND coalesce({differ("bad / n - bad0 / n0", "((bad + bad0) / (n + n0))", "n", "n0")}, true) AS apart FROM l{d}),
g{d} AS (SELECT *, CASE WHEN own THEN sum(apart::INT) OVER (PARTITION BY node, own ORDER BY bad / n, name) END AS run FROM a{d}),
m{d} AS (SELECT node, run, string_agg(name, '|' ORDER BY name) AS label, sum(n) AS seen, sum(bad) AS blocked FROM g{d} WHERE own GROUP BY 1, 2),
j{d} AS (SELECT g{d}.node, name, own, up, g{d}.node || '/' || coalesce(label, name) AS next, coalesce(m{d}.seen, n) AS seen, coalesce(m{d}.blocked, bad) AS blocked FROM g{d} LEFT JOIN m{d} ON m{d}.node = g{d}.node AND m{d}.run = g{d}.run),
f{d} AS (SELECT w{d}.node, child, own, next, seen, blocked, CASE WHEN own THEN (blocked + {weight} * j{d}.up) / (seen + {weight}) ELSE j{d}.up END AS purity FROM w{d} JOIN j{d} USING (node, name)),
s{d} AS (SELECT host, shape, seg, rows, n, bad, node, seen, blocked, purity, template FROM s{d - 1} WHERE NOT ({opened(d)})
  UNION ALL SELECT host, shape, seg, rows, n, bad, next, f{d}.seen, f{d}.blocked, f{d}.purity, CASE WHEN own THEN next ELSE template END FROM s{d - 1} x JOIN f{d} ON f{d}.node = x.node AND child = seg[{d}] WHERE x.blocked > 0 AND x.blocked < x.seen AND len(seg) >= {d})""")
    over = opened(levels + 1)
    return "WITH " + ",\n".join(steps) + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN {over} THEN error('deeper than the SQL goes') ELSE template END AS template, round(purity, 6) AS purity FROM r JOIN s{levels} USING (host, shape)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
