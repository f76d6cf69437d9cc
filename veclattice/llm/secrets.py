"""Secret scan through a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression: every
string that the rule matches has all trigrams of one of the query's
alternatives.  The index is a bitmap index: for each trigram that queries ask
for, the posting is one bit of every row (texts folded to lower case), kept
beside the row, so that postings of a query are intersected and united bit by
bit where the text lies and nothing is shuffled.  The rows that satisfy a
rule's query are its candidates, and only those are verified with the
expression itself.  Rules without mandatory trigrams scan every row.  All of
it runs in built-in SQL functions; spans are put together in blocks, in time
proportional to their number.

Defined results: null and empty texts have no spans; repeated rows each get
their row; a match shorter than its rule's least length is dropped, the text
it took is not searched again by that rule; columns other than doc_id and
text are not read by the scan.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str  # understood alike by Java, RE2 and Python
    group: int = 0  # the group whose length counts
    least: int = 1


#: The base rules, then those the method adds.  Runs that are too
#: short can't be cut longer, so a least length may stand in the expression.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("live", r"sk_live_[0-9a-zA-Z]{16,}"),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----"),
)
RULES = BASE + ADDED

_MOST_STRINGS = 32
#: A query: alternatives, each a set of trigrams that must all be there; None: no constraint.
Query = frozenset[frozenset[str]] | None


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MOST_STRINGS else min(a, b, key=len)


def _of(strings: set[str]) -> Query:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in sets else frozenset(sets)


def _product(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _MOST_STRINGS else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that items match, if few, and else a query that they satisfy."""
    strings: set[str] = {""}
    query: Query = None
    exact = True

    def flush() -> None:
        nonlocal strings, query, exact
        query, strings, exact = _and(query, _of(strings)), {""}, False

    for op, value in items:
        if op is kinds.LITERAL:
            found, inner = {chr(value).lower()}, None
        elif op is kinds.IN and all(k is kinds.LITERAL for k, _ in value) and len(value) <= 8:
            found, inner = {chr(v).lower() for _, v in value}, None
        elif op is kinds.SUBPATTERN:
            found, inner = _walk(value[3])
        elif op is kinds.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in parts):
                found, inner = set().union(*(s for s, _ in parts)), None
            else:
                found, queries = None, [_of(s) if s is not None else q for s, q in parts]
                inner = None if None in queries else frozenset().union(*queries)
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, sub = value
            once, inner = _walk(sub)
            found = {"", *once} if (low, high) == (0, 1) and once is not None else None
            if low == 0:
                inner = None
            elif found is None and once is not None:
                inner = _of(once)
            if low > 1 and high == low and once is not None and len(once) == 1:
                found, inner = {next(iter(once)) * low}, None
        elif op is kinds.AT:
            continue
        else:
            found, inner = None, None
        joined = _product(strings, found) if found is not None else None
        if joined is not None:
            strings = joined
        else:
            flush()
            if found is not None:
                strings = found
            query = _and(query, inner)
    if exact:
        return strings, None
    return None, _and(query, _of(strings))


def trigram_query(pattern: str) -> Query:
    strings, query = _walk(parser.parse(pattern))
    query = _of(strings) if strings is not None else query
    # an alternative that asks for more than another adds nothing
    return query and frozenset(a for a in query if not any(b < a for b in query))


_BITS = 60
#: Values of a block when running sums are made.
_BLOCK = 256


def _postings(trigrams: list[str]) -> dict[str, Column]:
    """The bits of a row: word w holds those of trigrams w * _BITS and on."""
    words: dict[str, Column] = {}
    for i, t in enumerate(trigrams):
        bit = F.when(F.contains("folded", F.lit(t)), F.lit(1 << i % _BITS)).otherwise(F.lit(0)).cast("long")
        name = f"m{i // _BITS}"
        words[name] = words[name].bitwiseOR(bit) if name in words else bit
    return words


def _holds(query: Query, trigrams: list[str]) -> Column:
    """Whether a row is in the postings of all trigrams of one of the query's alternatives."""
    out = F.lit(False)
    for alternative in sorted(map(sorted, query)):
        all_of = F.lit(True)
        for w in range(-(-len(trigrams) // _BITS)):
            mask = sum(1 << i % _BITS for i, t in enumerate(trigrams) if t in alternative and i // _BITS == w)
            if mask:
                all_of = all_of & (F.col(f"m{w}").bitwiseAND(mask) == mask)
        out = out | all_of
    return F.coalesce(out, F.lit(False))


def _running(values: str, step: str) -> str:
    """Running results of step({0}, {1}), an associative expression with 0 as its neutral element, over an array of bigint."""
    blocks = f"sequence(0, (size(values) - 1) div {_BLOCK})"
    part = f"slice(values, b * {_BLOCK} + 1, {_BLOCK})"
    sums = f"transform({blocks}, b -> aggregate({part}, 0L, (a, x) -> {step.format('a', 'x')}))"
    start = f"aggregate(slice(sums, 1, b), 0L, (a, x) -> {step.format('a', 'x')})"
    after = step.format("acc.at", "x")
    inside = f"aggregate({part}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), (acc, x) -> named_struct('at', {after}, 'out', concat(acc.out, array({after}))), acc -> acc.out)"
    return f"transform(array({values}), values -> transform(array({sums}), sums -> flatten(transform({blocks}, b -> {inside})))[0])[0]"


def _spans(rule: Rule, order: int) -> Column:
    """Spans of one rule from the matches, the measured groups and the pieces between matches."""
    k = rule.kind
    ends = _running(f"transform(m_{k}, (x, i) -> cast(length(p_{k}[i]) + length(x) as bigint))", "{0} + {1}")
    span = f"if(length(g_{k}[i]) >= {rule.least}, named_struct('start', e - length(m_{k}[i]), 'rank', {order}, 'end', e, 'kind', '{k}'), null)"
    none = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"
    return F.expr(f"if(size(m_{k}) > 0, filter(transform({ends}, (e, i) -> {span}), x -> x is not null), {none})")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc (the other columns of docs, whatever they are called), text and found of every row."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for alternative in q for t in alternative})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text")
    indexed = rows.withColumn("folded", F.lower("text")).select("doc", "text", *[x.alias(n) for n, x in _postings(trigrams).items()])
    joined = indexed.select("doc", "text", *[_holds(q, trigrams).alias(f"is_{k}") for k, q in queries.items()])
    columns = []
    for r in rules:
        pattern = F.lit(r.pattern)
        on = F.col("text").isNotNull() if r.kind not in queries else F.coalesce(F.col(f"is_{r.kind}"), F.lit(False))
        on = on & F.col("text").rlike(r.pattern)
        columns.append(F.when(on, F.regexp_extract_all("text", pattern, F.lit(0))).alias(f"m_{r.kind}"))
        columns.append(F.when(on, F.regexp_extract_all("text", pattern, F.lit(r.group))).alias(f"g_{r.kind}"))
        columns.append(F.when(on, F.split("text", r.pattern, -1)).alias(f"p_{r.kind}"))
    found = F.array_sort(F.concat(*[_spans(r, i) for i, r in enumerate(rules)]))
    return joined.select("doc", "text", *columns).select("doc", "text", found.alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `found` (theirs of that name is replaced): spans as (start, rank, end, kind), in order; code points, end exclusive."""
    columns = ["text" if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "found"]
    return _scanned(docs, rules).select(*columns, "found")


def _text(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def digest(scanned: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    base = _text(f"filter(found, x -> x.rank < {len(BASE)})")
    return scanned.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _text("found").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span, overlapping ones merged, replaced in text, and n_chars, if there, as of the new text."""
    upto = _running("transform(found, x -> x.end)", "greatest({0}, {1})")
    piece = "if(x.start >= before[i], concat(array_join(slice(chars, cast(before[i] + 1 as int), cast(x.start - before[i] as int)), ''), '[secret]'), '')"
    whole = f"concat(array_join(transform(found, (x, i) -> {piece}), ''), array_join(slice(chars, cast(upto[size(upto) - 1] + 1 as int), size(chars)), ''))"
    new = F.expr(f"if(size(found) = 0, text, transform(array(regexp_extract_all(text, '(?s).', 0)), chars -> transform(array({upto}), upto -> transform(array(concat(array(0L), upto)), before -> {whole})[0])[0])[0])")
    rows = _scanned(docs, rules).select("doc", new.alias("new"))
    columns = {c: F.col("new") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), columns["n_chars"])
    return rows.select(*[v.alias(c) for c, v in columns.items()])


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest in DuckDB's SQL, each rule scanning every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ctes, all_spans = [], []
    for i, r in enumerate(rules):
        p = quote(r.pattern)
        ctes.append(f"regexp_extract_all(t, {p}, 0) AS m_{i}, regexp_extract_all(t, {p}, {r.group}) AS g_{i}, string_split_regex(t, {p}) AS p_{i}")
        at = f"coalesce(list_sum(list_transform(p_{i}[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{i}[1:j - 1], lambda x: length(x))), 0)"
        spans = f"list_transform(list_filter(range(1, len(m_{i}) + 1), lambda j: length(g_{i}[j]) >= {r.least}), lambda j: {{'s': ({at})::BIGINT, 'r': {i}, 'e': ({at} + length(m_{i}[j]))::BIGINT, 'k': '{r.kind}'}})"
        all_spans.append(spans)
    joined = "[]"
    for s in all_spans:
        joined = s if joined == "[]" else f"list_concat({joined}, {s})"
    text = "coalesce(array_to_string(list_transform({}, lambda x: concat(x.k, ':', x.s, ':', x.e)), ','), '')".format
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)
    base = text(f"list_filter(f, lambda x: x.r < {len(BASE)})")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {", ".join(ctes)} FROM d),
s AS (SELECT doc_id, list_sort({joined}) AS f FROM m)
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {text("f")} AS spans FROM s"""
