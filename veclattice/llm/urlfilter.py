"""URL filter by a path-template tree.

Per host, paths form a tree of their segments, as deep as they are.  A segment
is generalised by its form (numbers, hexadecimal names, dates), and where a
node has more than MAX_KIDS children, each child with under 1 / SHARE of the
node's urls becomes a wildcard; what follows wildcards is one subtree.  The
end of a path is a child too, never a wildcard.

Siblings with LEAST_LABELLED labelled urls or more are put in order of their
share of blocked ones, and neighbours whose shares do not differ by more than
SIGMAS standard errors are merged: they become one node and share statistics
and subtrees.  A node's purity is its share of blocked urls among labelled
ones, smoothed towards its parent's purity, and at the first level towards a
fixed prior; below the first level a node that holds all urls of its parent
adds nothing and keeps the parent's purity.  Urls that no rule fits are
blocked where the purity of their path's node reaches REJECT.  Labels are the
verdicts of the rules: under a first-level branch without labelled urls all
is allowed.

The tree grows in rounds over counts by distinct generalised path, each round a
few joins and sums.  A stretch on which the paths of a node do not part changes
no purity and is passed within the round that leads to it: its length is what
the least and the greatest rest of the node's paths have in common.  Paths with
one rest between them are finished.  So rounds follow the branchings on a path,
not its length.  A node has at most SHARE + MAX_KIDS + 2 children after
wildcards, which bounds the windows that merge.  Urls meet their path's verdict by a join that adaptive execution can
split.

Defined results: a null url or one without `://` has an empty host and path,
no rule, and is allowed unless its empty template was rejected; repeated rows
each get their row; columns other than page_id and url are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
MAX_KIDS, SHARE = 12, 50
LEAST_LABELLED, SIGMAS = 5, 2.0
WEIGHT, PRIOR, REJECT = 4.0, 0.2, 0.5

#: (form, replacement) of variable segments.
FORMS = (
    ("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    ("^[0-9]+$", "{number}"),
    (r"^[0-9]+\.[A-Za-z]+$", "{number}.{type}"),
    ("^[0-9a-f]{8,}(-[0-9a-f]{4,})*$", "{hex}"),
    ("^[^/]*[-_][^/]*[0-9]+$", "{slug}"),
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule(rules: tuple[Rule, ...], what: int) -> str:
    """The longest rule that fits wins."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    cases = " ".join(f"WHEN (host = {_quote(r.host)} OR right(host, {len(r.host) + 1}) = {_quote('.' + r.host)}) AND left(path, {len(r.path)}) = {_quote(r.path)} THEN {_quote((r.host + r.path, r.verdict)[what])}" for r in ordered)
    return f"CASE {cases} END" if ordered else "CAST(NULL AS VARCHAR(1))"


def _shape(segment: str, matches: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches}({segment}, {_quote(form)}) THEN {_quote(to)}" for form, to in FORMS) + f" ELSE {segment} END"


def paths(pages: str, rules: tuple[Rule, ...] = RULES, matches: str = "regexp_like", lambda_: str = "s ->", shaped: str = "array_join(transform(split(path, '/'), {}), '/')") -> str:
    """page_id, host, path, rule, ruling and shape (the generalised path) of every url; the later arguments: the dialect."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM rests),
paths AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM hosts)
SELECT page_id, host, path, {_rule(rules, 0)} AS rule, {_rule(rules, 1)} AS ruling, {shaped.format(lambda_ + " " + _shape("s", matches))} AS shape FROM paths"""


#: The end of a path as a segment; no path holds a question mark.
END = "?"


def _apart(bad: Column, n: Column, bad0: Column, n0: Column) -> Column:
    """Whether two shares differ significantly."""
    pooled = (bad + bad0) / (n + n0)
    return F.abs(bad / n - bad0 / n0) > F.lit(SIGMAS) * F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n + F.lit(1.0) / n0))


def _children(active: DataFrame, first: bool) -> DataFrame:
    """For each node and next segment: its name, the node it becomes, that node's purity, how many further segments all its paths share, and whether they share them all."""
    node, named = ["host", "node"], ["host", "node", "name"]
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    kids = active.groupBy(*node, "seg").agg(*sums, F.min("rest").alias("low"), F.max("rest").alias("high"), F.first("purity").alias("purity"))
    nodes = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("total"))
    keeps = (F.col("kids") <= MAX_KIDS) | (F.lit(SHARE) * F.col("n") >= F.col("total")) | (F.col("seg") == END)
    kids = kids.join(nodes, node).withColumn("name", F.when(keeps, F.col("seg")).otherwise("*"))
    names = kids.groupBy(*named).agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.first("total").alias("total"), F.first("purity").alias("purity"))
    # merge neighbours in order of their shares; the windows hold a node's few names
    n = (F.col("good") + F.col("bad")).cast("double")
    known = n >= LEAST_LABELLED
    ordered = Window.partitionBy(*node, "known").orderBy("share", "name")
    names = names.withColumn("known", known).withColumn("share", F.when(known, F.col("bad") / n))
    before = (F.lag("bad").over(ordered), F.lag(F.col("good") + F.col("bad")).over(ordered))
    names = names.withColumn("parts", F.when(F.col("known") & ~_apart(F.col("bad").cast("double"), n, before[0].cast("double"), before[1].cast("double")), 0).otherwise(1))
    names = names.withColumn("class", F.sum("parts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    classes = Window.partitionBy(*node, "known", "class")
    merged = {c: F.sum(c).over(classes) for c in ("n", "good", "bad")} | {"low": F.min("low").over(classes), "high": F.max("high").over(classes)}
    names = names.select(*named, "total", "purity", F.min("name").over(classes).alias("least"), *[v.alias(c) for c, v in merged.items()])
    fresh = (F.col("bad") + F.lit(WEIGHT) * F.col("purity")) / (F.col("good") + F.col("bad") + F.lit(WEIGHT))
    purity = fresh if first else F.when(F.col("n") == F.col("total"), F.col("purity")).otherwise(fresh)
    # all rests lie between the two in order, so they begin with what these two begin with; where the two are equal, no place differs
    parted = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    names = names.select(*named, F.concat("node", F.lit("/"), "least").alias("child"), purity.alias("child_purity"), F.greatest(parted - 1, F.lit(0)).alias("shared"), (parted == 0).alias("alike"))
    return kids.select(*named, "seg").join(names, named)


def templates(leaves: DataFrame) -> DataFrame:
    """host, shape, template and purity of leaves(host, shape, n, good, bad), one row for each distinct generalised path."""
    # a path's segments follow its first slash; what stands before it is empty
    segs = F.concat(F.slice(F.split("shape", "/"), F.lit(2), F.greatest(F.size(F.split("shape", "/")) - 1, F.lit(0))), F.array(F.lit(END)))
    active = leaves.select("host", "shape", "n", "good", "bad", segs.alias("segs"), F.lit("").alias("node"), F.lit("").alias("template"), F.lit(PRIOR).alias("purity"))
    done, first = [], True
    while first or not active.isEmpty():
        seg = F.get("segs", F.lit(0))
        # an ended path has no rest and no say in what the others share
        here = active.select("*", seg.alias("seg"), F.when(seg != END, F.slice("segs", F.lit(2), F.size("segs") - 1)).alias("rest"))
        kids = _children(here, first).select("host", "node", "seg", "name", "child", "child_purity", "shared", "alike")
        grown = here.join(kids, ["host", "node", "seg"])
        ended = F.col("rest").isNull() | F.col("alike")
        passed = F.when(ended, F.size("rest") - 1).otherwise(F.col("shared"))
        stretch = F.when(passed > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), passed), "/"))).otherwise("")
        step = F.when(F.col("rest").isNull(), "").otherwise(F.concat(F.lit("/"), "name", stretch))
        left = F.slice("rest", passed + 1, F.size("rest") - passed)
        grown = cut(grown.select("host", "shape", "n", "good", "bad", left.alias("segs"), F.col("child").alias("node"), F.concat("template", step).alias("template"), F.col("child_purity").alias("purity"), ended.alias("ended")))
        first = False
        done.append(grown.where("ended").select("host", "shape", "template", "purity"))
        active = grown.where("not ended").drop("ended")
    return reduce(DataFrame.unionAll, done)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and its purity of every row."""
    text = paths("{pages}", rules)
    # braces are names of tables only where they are meant so
    text = text.replace("{", "{{").replace("}", "}}").replace("{{pages}}", "{pages}")
    urls = pages.sparkSession.sql(text, pages=pages.select("page_id", "url"))
    count = lambda ruling: F.sum((F.coalesce("ruling", F.lit("")) == ruling).cast("long"))
    leaves = cut(urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("good"), count("block").alias("bad")))
    verdict = F.coalesce("ruling", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return urls.join(templates(leaves), ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


#: The same results by another way: the tree grows by recursion over paths, with windows in place of grouped joins.
ORACLE = f"""WITH RECURSIVE urls AS ({paths("pages", RULES, "regexp_matches", "lambda s:", "array_to_string(list_transform(string_split(path, '/'), {}), '/')")}),
tree AS (
SELECT host, shape, list_append(string_split(shape, '/')[2:], '{END}') AS segs, count(*) AS n, count(*) FILTER (WHERE ruling = 'allow') AS good, count(*) FILTER (WHERE ruling = 'block') AS bad,
  0 AS level, '' AS node, '' AS template, {PRIOR}::DOUBLE AS purity FROM urls GROUP BY host, shape
UNION ALL
SELECT host, shape, segs, n, good, bad, level + 1, node || '/' || min(name) OVER class, CASE WHEN seg = '{END}' THEN template ELSE template || '/' || name END,
  CASE WHEN level > 0 AND sum(n) OVER class = total THEN purity ELSE (sum(bad) OVER class + {WEIGHT}::DOUBLE * purity) / (sum(good + bad) OVER class + {WEIGHT}::DOUBLE) END
FROM (SELECT *, sum(parts) OVER (PARTITION BY host, node, known ORDER BY share, name, shape ROWS UNBOUNDED PRECEDING) AS part FROM (
  SELECT *, CASE WHEN lag(name) OVER o = name THEN 0
    WHEN known AND abs(b / m - lag(b) OVER o / lag(m) OVER o) <= {SIGMAS}::DOUBLE * sqrt((b + lag(b) OVER o) / (m + lag(m) OVER o) * (1::DOUBLE - (b + lag(b) OVER o) / (m + lag(m) OVER o)) * (1::DOUBLE / m + 1::DOUBLE / lag(m) OVER o)) THEN 0 ELSE 1 END AS parts
  FROM (SELECT *, m >= {LEAST_LABELLED} AS known, CASE WHEN m >= {LEAST_LABELLED} THEN b / m END AS share FROM (
    SELECT *, (sum(bad) OVER nm)::DOUBLE AS b, (sum(good + bad) OVER nm)::DOUBLE AS m FROM (
      SELECT *, CASE WHEN kids <= {MAX_KIDS} OR {SHARE} * kn >= total OR seg = '{END}' THEN seg ELSE '*' END AS name FROM (
        SELECT *, count(DISTINCT seg) OVER (PARTITION BY host, node) AS kids, sum(n) OVER (PARTITION BY host, node, seg) AS kn, sum(n) OVER (PARTITION BY host, node) AS total
        FROM (SELECT *, segs[level + 1] AS seg FROM tree WHERE level < len(segs))))
    WINDOW nm AS (PARTITION BY host, node, name)))
  WINDOW o AS (PARTITION BY host, node, known ORDER BY share, name, shape)))
WINDOW class AS (PARTITION BY host, node, known, part))
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.ruling, CASE WHEN t.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(t.purity, 6) AS purity
FROM urls u LEFT JOIN tree t ON u.host = t.host AND u.shape = t.shape AND t.level = len(t.segs)"""
