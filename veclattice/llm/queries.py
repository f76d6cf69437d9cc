"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, langid, lexical, mixing, ngram_join, quality, secrets, substring_dedup, tokencount, toxicity, urlfilter, whitening
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links themselves, between the documents of least doc_id of each set."""
    members, links = ngram_join.jaccard_links(table(spark, sf_dir, "documents"), n=3, percent=90)
    first = members.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("doc_id"))
    out = links.join(first.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x")), "a").join(first.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("linked_id"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return quality.judge(table(spark, sf_dir, "documents")).select(*columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secret_scan, op3_source_mix, op4_toxicity, op5_language_id, op6_substring_dedup, op7_ngram_jaccard_join, op8_html_extraction, op9_quality_rules, op10_url_filter, op11_embedding_whitening, op12_ranked_search, op13_token_counts)}
#: Further queries of operators that have one above.
FURTHER = {f.__name__: f for f in (ngram_jaccard_links,)}
_SPLIT = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_DEDUP = f"""WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) t(i)),
r AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p SEMI JOIN r USING (k)),
x AS (SELECT doc_id, j, w[j] AS t FROM d, unnest(range(1, len(w) + 1)) u(j)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS text, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_LINKS = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y, o = a.n AND o = b.n AS same FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l)"""

_JACCARD = f"""{_LINKS},
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.r = e.x),
m AS (SELECT x, sum(same::INT) AS n_equal, sum((NOT same)::INT) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.r) AS component_id, coalesce(any_value(n_equal), 0)::BIGINT AS n_equal, coalesce(any_value(n_links), 0)::BIGINT AS n_links
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id GROUP BY d.doc_id"""

_PAIRS = f"""{_LINKS},
f AS (SELECT x, min(y) AS least FROM e WHERE same GROUP BY x),
u AS (SELECT doc_id FROM d LEFT JOIN f ON f.x = doc_id WHERE least IS NULL OR least > doc_id)
SELECT x AS doc_id, y AS linked_id FROM l WHERE NOT same AND x IN (SELECT doc_id FROM u) AND y IN (SELECT doc_id FROM u)"""

#: Mixing (3) is a search for a subset, 4, 5, 8 and 9 are trained or read HTML, 11 needs eigenvectors and 13 a tokenizer: they have no SQL and are tested by brute force.
SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.oracle(),
    "op2_secret_scan": secrets.oracle(),
    "op6_substring_dedup": _DEDUP,
    "op7_ngram_jaccard_join": _JACCARD,
    "ngram_jaccard_links": _PAIRS,
    "op10_url_filter": urlfilter.ORACLE,
    "op12_ranked_search": lexical.ORACLE,
}
