"""Benchmark decontamination by spaced-seed hashing.

Each mask names the positions of a seed that count; the others are ignored.
Every position of every document is hashed under every mask and joined with
the seeds of the benchmark items.  Around each hit the two texts are compared
position by position: a document overlaps an item if some window of `WINDOW`
aligned tokens (the whole item, where shorter) differs in at most
TOLERATED of 13 of its tokens.  The masks are such that every window with so
many tokens substituted, wherever they stand, contains an intact seed: three
masks at every position of items of 13 tokens and more, and for shorter items
interleaved seeds that share no token, one more than substitutions are
tolerated.  So no overlap is missed.

Tokens are runs of letters and digits, lower-cased.  All of it is built-in
functions: positions are exploded, hashed and probed inside one generated
stage, and neither texts nor their tokens are shuffled unless the benchmark
outgrows BROADCAST_SEEDS.  Then the codes of the seeds alone are broadcast, and
the positions that have one, with the tokens around them, meet the seeds in a
shuffled join; more codes than MARKED take further passes over the documents.
No document's whole array is ever copied, and no position is shuffled that
hits nothing.

Defined results: null and empty texts and items overlap nothing; items of 3
to 5 tokens overlap only as they stand, shorter ones never; repeated rows give
one result row for each doc_id and item_id; columns other than doc_id, text
and item_id, text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 4, 5))
WINDOW, TOLERATED = 13, 3
#: Items of so many tokens are seeds as a whole; of those up to the next numbers, a mask and the places at which it stands.
SHORT = (3, 4, 5)
MIDDLE = {8: ((0, 2, 4), (0, 1)), 12: ((0, 3, 6), (0, 1, 2))}
#: Seeds that are broadcast, each with 25 codes: at most 30 MB.
BROADCAST_SEEDS = 100_000
#: Codes of seeds that are broadcast in a pass over the documents when there are more seeds: at most about 60 MB.
MARKED = 1_000_000

TOKEN = r"[\p{L}\p{N}]+"


def _codes(text: str) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _seed(codes: str, at: str, mask: tuple[int, ...]) -> str:
    return f"xxhash64({', '.join([str(hash_of(mask)), *(f'get({codes}, {at} + {o})' for o in mask)])})"


def hash_of(mask: tuple[int, ...]) -> int:
    """A small number that tells masks apart."""
    return sum(1 << o for o in mask)


def seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """seed, item, j (its place in the item), the token codes around it and the tokens of a window, of items(item, g): their token codes."""
    parts = []
    at = items.where(f"size(g) > {max(MIDDLE)}")
    for mask in masks:
        parts.append(at.select("item", "g", F.expr(f"explode(sequence(0, size(g) - {mask[-1] + 1}))").alias("j")).select(F.expr(_seed("g", "j", mask)).alias("seed"), "item", "j", "g"))
    least = max(SHORT)
    for most, (mask, places) in MIDDLE.items():
        at = items.where(f"size(g) > {least} and size(g) <= {most}").select("item", "g", F.explode(F.array(*map(F.lit, places))).alias("j"))
        parts.append(at.select(F.expr(_seed("g", "j", mask)).alias("seed"), "item", "j", "g"))
        least = most
    for n in SHORT:
        parts.append(items.where(f"size(g) = {n}").select(F.expr(_seed("g", "0", tuple(range(n)))).alias("seed"), "item", F.lit(0).alias("j"), "g"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    around = F.expr(f"transform(sequence({1 - WINDOW}, {WINDOW - 1}), d -> get(g, j + d))")
    return out.select("seed", "item", "j", around.alias("around"), F.least(F.lit(WINDOW), F.size("g")).alias("w"))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """doc_id, item_id, matched (equal tokens of the best window), window (its tokens) and first_token (where the item would begin, at its first place)."""
    # items of the same tokens are one until their ids are wanted
    named = items.where("text is not null").select("item_id", _codes("text").alias("g")).where(f"size(g) >= {min(SHORT)}").withColumn("item", F.xxhash64("g"))
    wanted = seeds(named.groupBy("item").agg(F.any_value("g").alias("g")), masks)
    # small benchmarks are broadcast, by count; of others the codes alone
    n, short, long_ = wanted.agg(F.count(F.lit(1)), F.min("w"), F.max("w")).first()
    kinds = _kinds(short or 0, long_ or 0, masks)
    r = WINDOW - 1
    at = docs.select("doc_id", _codes("text").alias("h"))
    at = at.select("doc_id", "h", F.explode(F.expr("case when size(h) > 0 then sequence(0, size(h) - 1) end")).alias("i"))
    at = at.select("doc_id", "h", "i", F.explode(F.array(*[F.expr(_seed("h", "i", m)) for m in kinds])).alias("seed"))
    # Only the tokens around a hit leave the generated stage, never a document's whole array.  That `near`
    # is read twice keeps the two projections apart, of which the second is not generated code.
    near = F.expr(f"slice(h, greatest(i - {r}, 0) + 1, {2 * r + 1})")
    hits = at.join(F.broadcast(wanted), "seed").withColumn("near", near) if n <= BROADCAST_SEEDS else _marked_hits(at, wanted, n, near)
    hits = hits.select("doc_id", "item", "w", "around", (F.col("i") - F.col("j")).alias("first"), F.least("i", F.lit(r)).alias("lead"), "near")
    same = f"if(size(near) > 0, transform(around, (g, k) -> if(coalesce(get(near, k - {r} + lead) = g, false), 1, 0)), null)"
    best = f"array_max(transform(sequence(1, {2 * r + 2} - w), s -> aggregate(slice(same, s, w), 0, (a, x) -> a + x)))"
    hits = hits.select("doc_id", "item", "w", "first", F.expr(same).alias("same")).select("doc_id", "item", "w", "first", F.expr(best).alias("best"))
    enough = F.expr(f"best >= w - floor({TOLERATED} * w / {WINDOW}) and (w > {max(SHORT)} or best = w)")
    # filtered after the sums: a filter before them would move into the join and out of generated code
    sums = [F.max(F.when(enough, F.col("best"))).cast("long").alias("matched"), F.max("w").cast("long").alias("window"), F.min(F.when(enough, F.col("first"))).cast("long").alias("first_token")]
    found = hits.groupBy("doc_id", "item").agg(*sums).join(named.select("item_id", "item").distinct(), "item")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"), F.min("first_token").alias("first_token")).where("matched is not null")


def _kinds(shortest: int, longest: int, masks: tuple[tuple[int, ...], ...]) -> list[tuple[int, ...]]:
    """The masks that items of such lengths need."""
    kinds = [*masks] if longest >= WINDOW else []
    kinds += [mask for most, (mask, _) in MIDDLE.items() if shortest <= most]
    return kinds + [tuple(range(k)) for k in SHORT if shortest <= k] or [*masks]


def _marked_hits(at: DataFrame, wanted: DataFrame, n: int, near: Column) -> DataFrame:
    """The hits of n seeds with the tokens around them: positions of a seed's code are found by broadcast codes, MARKED a pass, and alone meet the seeds."""
    codes, passes, found = wanted.select("seed").distinct(), max(1, -(-n // MARKED)), None
    for k in range(passes):
        own = codes if passes == 1 else codes.where(F.pmod(F.xxhash64("seed"), F.lit(passes)) == k)
        part = at.join(F.broadcast(own), "seed", "left_semi").select("doc_id", "seed", "i", near.alias("near"))
        found = part if found is None else found.unionByName(part)
    return found.join(wanted, "seed")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id overlaps an item; rows without a doc_id are held by their text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    bad = overlaps(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("bad")).distinct()
    # the columns travel together, so that none of them clashes
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key")).join(bad, F.col("key") == F.col("bad"), "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def oracle() -> str:
    """The overlaps in DuckDB's SQL, without seeds: all alignments on which enough tokens are equal."""
    return f"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS g FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS h FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, i, h[i + 1] AS t FROM d, unnest(range(0, len(h))) u(i)),
y AS (SELECT item_id, j, g[j + 1] AS t, least({WINDOW}, len(g)) AS w, len(g) AS n FROM b, unnest(range(0, len(g))) u(j) WHERE len(g) >= {min(SHORT)}),
l AS (SELECT doc_id, item_id, i - j AS first, any_value(w) AS w, any_value(n) AS n, list(DISTINCT j) AS js FROM x JOIN y ON x.t = y.t
  GROUP BY doc_id, item_id, i - j HAVING count(DISTINCT j) >= any_value(w) - floor({TOLERATED} * any_value(w) / {WINDOW})),
bests AS (SELECT doc_id, item_id, first, w, list_max(list_transform(range(0, n - w + 1), lambda s: len(list_filter(js, lambda j: j >= s AND j < s + w)))) AS best FROM l)
SELECT doc_id, item_id, max(best)::BIGINT AS matched, max(w)::BIGINT AS "window", min(first)::BIGINT AS first_token
FROM bests WHERE best >= w - floor({TOLERATED} * w / {WINDOW}) AND (w > {max(SHORT)} OR best = w) GROUP BY doc_id, item_id"""
