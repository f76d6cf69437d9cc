"""Registered queries of the search engine over the driver's tables, and their SQL.

`embeddings` stands for token vectors, eight a document; the queries of a
search are the documents (or benchmark items) whose id is divisible by 100.
`documents` stands for chunks: the source is the document's name.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import subword
from ..functions import text as X
from ..functions import vectors as V
from ..functions.subword import MARK
from ..operators import catalog, chunk, codec, encode, evaluate, metadata, mutate, pooling, score, search
from ..operators.predicate import where
from ..operators.index import VectorIndex
from ..operators.segments import SegmentIndex
from ..schema import IndexConfig, SearchParameters
from ..session import checkpointed, shared_folder
from ..sources import ingest
from ..streaming.ingest import index_batch, stream_files
from ..streaming.ingest import ingest as ingest_stream
from . import params

K = 5
EVERY, NBITS, PROBE, CAP = 16, 2, 4, 12

QUERIES: dict = {}
SQL: dict[str, str] = {}


class _DigitEncoder:
    """One number a token: the first hexadecimal digit of its md5."""

    dim = 1

    def encode(self, tokens: list[str]) -> np.ndarray:
        return np.array([[int(hashlib.md5(t.encode()).hexdigest()[0], 16)] for t in tokens], dtype=np.float64).reshape(-1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- vectors


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = V.normalize(V.doubles("embedding"))
    return e.select(F.expr("vec_id div 8").alias("doc_id"), (F.col("vec_id") % 8).alias("token_pos"), F.col("vec_id").alias("seq"), v.alias("v"))


def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("token_pos").alias("qtok"), "v")


UNIT = """e AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
n AS (SELECT vec_id, CASE WHEN l <= 1e-12 THEN x ELSE list_transform(x, lambda a: a / l) END AS v FROM e),
d AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS token_pos, v AS dv FROM n),
q AS (SELECT vec_id // 8 AS query_id, vec_id % 8 AS qtok, v AS qv FROM n WHERE (vec_id // 8) % 100 = 0)"""
SCORES = UNIT + """,
m AS (SELECT query_id, doc_id, qtok, max(list_inner_product(qv, dv)) AS best FROM q CROSS JOIN d GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(best), 6) AS score FROM m GROUP BY ALL)"""
TOP = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 5"


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(V.doubles("embedding")), 6).alias("norm"))


@query(f"WITH {UNIT} SELECT vec_id, i - 1 AS pos, round(v[i], 6) AS x FROM n, unnest(range(1, len(v) + 1)) t(i)")
def vec_normalize(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.normalize(V.doubles("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _pairs(spark, sf, unit: bool) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = V.normalize(V.doubles("embedding")) if unit else V.doubles("embedding")
    rows = e.select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("token_pos"), v.alias("v"))
    queries = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.lit(0).alias("qtok"), "v")
    return score.interaction_matrix(rows, queries).select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), "dot")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def vec_pairwise_dot(spark, sf):
    return _pairs(spark, sf, False)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def vec_cosine(spark, sf):
    return _pairs(spark, sf, True).withColumnRenamed("dot", "cosine")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:5], lambda x: printf('%.9f', x::DOUBLE)), ', ') || ', ..., ' || array_to_string(list_transform(embedding[len(embedding) - 4:], lambda x: printf('%.9f', x::DOUBLE)), ', ') || ']' AS text FROM embeddings")
def format_vector(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.format_vector(V.doubles("embedding")).alias("text"))


# -- exact scores


@query(f"WITH {UNIT} SELECT query_id, qtok, doc_id, token_pos, round(list_inner_product(qv, dv), 6) AS dot FROM q CROSS JOIN d")
def interaction_matrix(spark, sf):
    return score.interaction_matrix(tokens(spark, sf), query_tokens(spark, sf))


@query(f"WITH {SCORES} SELECT query_id, doc_id, score FROM s")
def maxsim_scores(spark, sf):
    return score.maxsim(tokens(spark, sf), query_tokens(spark, sf))


@query(f"WITH {SCORES} {TOP}")
def maxsim_topk(spark, sf):
    return score.search_exact(tokens(spark, sf), query_tokens(spark, sf), K)


@query(f"WITH {SCORES} {TOP}")
def maxsim_zero_padding(spark, sf):
    q = query_tokens(spark, sf)
    zeros = q.select("query_id", (F.col("qtok") + 8).alias("qtok"), F.transform("v", lambda x: F.lit(0.0)).alias("v"))
    return score.search_exact(tokens(spark, sf), q.unionByName(zeros), K)


@query(f"WITH {SCORES}, t AS (SELECT * FROM s WHERE query_id > 0 OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) {TOP.replace('FROM s', 'FROM t')}")
def maxsim_subset(spark, sf):
    allowed = table(spark, sf, "labels").where("quality = 1").select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    return score.search_exact(tokens(spark, sf), query_tokens(spark, sf), K, allowed)


@query(f"WITH {SCORES} SELECT query_id, doc_id, round(score / 8, 6) AS normalized FROM s")
def score_normalized(spark, sf):
    return maxsim_scores(spark, sf).select("query_id", "doc_id", F.round(D.normalized(F.col("score"), F.lit(8)), 6).alias("normalized"))


@query(f"WITH {SCORES} SELECT query_id, doc_id, round(least(greatest(score / 8, 0), 1) * 100)::BIGINT AS percent FROM s")
def match_percent(spark, sf):
    return maxsim_scores(spark, sf).select("query_id", "doc_id", D.match_percent(F.col("score"), F.lit(8)).alias("percent"))


@query(f"WITH {SCORES} SELECT query_id, doc_id, CASE WHEN score / 8 >= 0.7 THEN 'green' WHEN score / 8 >= 0.4 THEN 'orange' ELSE 'gray' END AS band FROM s")
def score_band(spark, sf):
    return maxsim_scores(spark, sf).select("query_id", "doc_id", D.score_band(F.col("score") / 8).alias("band"))


@query(f"WITH {SCORES} SELECT query_id, doc_id, trunc(score * 100)::BIGINT AS percentage FROM s")
def score_percentage(spark, sf):
    return maxsim_scores(spark, sf).select("query_id", "doc_id", D.score_percentage(F.col("score")).alias("percentage"))


# -- text

WORDS = "list_filter(string_split_regex({}, '[ \\n\\t\\r]+'), lambda t: t <> '')"
HASHED = f"""b AS (SELECT item_id AS query_id, {WORDS.format("text")}[1:32] AS t FROM benchmark WHERE item_id % 100 = 0),
w AS (SELECT DISTINCT doc_id, unnest({WORDS.format("text")}) AS tok FROM documents),
u AS (SELECT query_id, i AS qtok, t[i] AS tok FROM b, unnest(range(1, len(t) + 1)) x(i)),
vocabulary AS (SELECT DISTINCT tok FROM w UNION SELECT tok FROM u),
raw AS (SELECT tok, list_transform(range(1, 33), lambda i: ('0x' || substr(md5(tok), i, 1))::BIGINT::DOUBLE - 7.5) AS r FROM vocabulary),
vec AS (SELECT tok, list_transform(r, lambda x: x / l) AS v FROM (SELECT tok, r, sqrt(list_inner_product(r, r)) AS l FROM raw)),
sim AS (SELECT u.query_id, u.qtok, x.tok, list_inner_product(y.v, x.v) AS s FROM u JOIN vec y ON u.tok = y.tok CROSS JOIN vec x),
best AS (SELECT query_id, doc_id, qtok, max(s) AS m FROM w JOIN sim ON w.tok = sim.tok GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM best GROUP BY ALL)"""


def _text_hits(spark, sf) -> DataFrame:
    items = table(spark, sf, "benchmark").where("item_id % 100 = 0").select("item_id", "text").orderBy("item_id").collect()  # a hundredth of a small table
    return score.top_k(encode.score_texts(table(spark, sf, "documents"), [(r[0], r[1]) for r in items], encode.HashEncoder()), K)


@query(f"WITH {HASHED} {TOP}")
def text_search_hash(spark, sf):
    return _text_hits(spark, sf)


@query(f"WITH {HASHED}, h AS ({TOP}) SELECT h.query_id, h.rank, h.doc_id, h.score, d.source AS document_name, CASE WHEN length(d.text) <= 200 THEN d.text ELSE d.text[1:200] || '...' END AS preview FROM h JOIN documents d USING (doc_id)")
def text_search_enriched(spark, sf):
    return metadata.enrich(_text_hits(spark, sf), _chunks(spark, sf)).select("query_id", "rank", "doc_id", "score", "document_name", "preview")


def _window_sql(size: int, overlap: int) -> str:
    size, step = X.window_sizes(size, overlap)
    return f"""WITH d AS (SELECT doc_id, {WORDS.format("text")} AS t FROM documents),
w AS (SELECT doc_id, i AS chunk_index, t[i * {step} + 1:i * {step} + {size}] AS w FROM d, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 ELSE (len(t) - 1) // {step} + 1 END)) x(i))"""


def _windows(spark, sf, size: int, overlap: int) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    rows = docs.select("doc_id", F.posexplode(X.token_windows(F.col("t"), size, overlap)).alias("chunk_index", "w"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_window_sql(180, 64) + " SELECT doc_id, chunk_index, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS text_md5 FROM w")
def token_windows(spark, sf):
    return _windows(spark, sf, 180, 64).select("doc_id", "chunk_index", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("text_md5"))


@query(_window_sql(300, 0) + " SELECT doc_id, count(*) AS n_windows, max(len(w))::BIGINT AS longest FROM w GROUP BY doc_id")
def window_cap(spark, sf):
    return _windows(spark, sf, 300, 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.size("w")).cast("long").alias("longest"))


@query(_window_sql(5, 4) + " SELECT doc_id, count(*) AS n_windows, min(len(w))::BIGINT AS shortest FROM w GROUP BY doc_id")
def window_overlap_clamp(spark, sf):
    return _windows(spark, sf, 5, 20).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min(F.size("w")).cast("long").alias("shortest"))


@query(_window_sql(180, 64) + " SELECT doc_id, chunk_index, array_to_string(list_transform(w, lambda t: ('0x' || substr(md5(t), 1, 4))::BIGINT::VARCHAR), ',') AS ids FROM w")
def window_ids(spark, sf):
    return _windows(spark, sf, 180, 64).select("doc_id", "chunk_index", F.array_join(F.transform("w", lambda t: X.hash_id(t).cast("string")), ",").alias("ids"))


@query(_window_sql(*X.chunk_budget(512)) + " SELECT doc_id, chunk_index, array_to_string(w, ' ') AS chunk_text FROM w")
def chunk_text(spark, sf):
    return chunk.chunk_rows(table(spark, sf, "documents"), *X.chunk_budget(512)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _sentences_sql(text: str) -> str:
    """The detector without looking around: what is no end is marked, in several passes."""
    lead, blank, mark = "(^|[ \n\t\r(\"''\\[])", "[ \n\t\r]+", "' || chr(2) || '"
    before_lower = (lead + f"({X.any_of(X.ENDING_ABBREVIATIONS)})\\.({blank}\\p{{Ll}})", f"\\1\\2.{mark}\\3")
    text = f"replace(replace({text}, chr(1), ''), chr(2), '')"
    # neighbours share the white space between them, so every other one is left for a second pass
    for pattern, into in ((lead + f"({X.any_of(X.ABBREVIATIONS)})\\.", f"\\1\\2.{mark}"), before_lower, before_lower, (lead + "(\\p{Lu})\\.", f"\\1\\2.{mark}"), (f"([.!?]+[\"'')\\]]*){blank}", "\\1' || chr(1) || '")):
        text = f"regexp_replace({text}, '{pattern}', '{into}', 'g')"
    return f"list_filter(list_transform(string_split(replace({text}, chr(2), ''), chr(1)), lambda s: regexp_replace(s, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda s: s <> '')"


@query(_window_sql(180, 64) + " SELECT doc_id, sum(len(w))::BIGINT AS rows, (sum(len(w)) - 1)::BIGINT AS last, md5(array_to_string(flatten(list(list_transform(w, lambda t: ('0x' || substr(md5(t), 1, 1))::BIGINT::VARCHAR) ORDER BY chunk_index)), '')) AS firsts FROM w GROUP BY doc_id")
def encode_concatenated(spark, sf):
    """Rows of each document's windows in one run, in order."""
    rows = encode.encode_long(table(spark, sf, "documents"), _DigitEncoder())
    digits = F.array_sort(F.collect_list(F.struct("token_pos", F.col("v")[0].cast("int").cast("string").alias("x"))))
    out = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("token_pos").cast("long").alias("last"), digits.alias("d"))
    return out.select("doc_id", "rows", "last", F.md5(F.array_join(F.transform("d", lambda x: x["x"]), "")).alias("firsts"))


SENTENCES = _sentences_sql("text")


def _packing_sql(name: str, size: int, overlap: int) -> str:
    """first, end and alone of the chunks of {name}(key, counts), chunk by chunk, in {name}_r."""
    gap = size + overlap + 1
    return f"""{name}_w AS (SELECT key, w, list_transform(range(0, len(w) + 1), lambda k: coalesce(list_sum(w[1:k]), 0)::BIGINT) AS s FROM (SELECT key, list_transform(counts, lambda c: CASE WHEN c > {size} THEN {gap} ELSE c END) AS w FROM {name} WHERE len(counts) > 0)),
{name}_o AS (SELECT key, 0::BIGINT AS i, 0::BIGINT AS o FROM {name}_w UNION ALL SELECT key, j, CASE WHEN w[j + 1] > {size} THEN j ELSE list_min(list_filter(range(0, j + 1), lambda a: s[j + 1] - s[a + 1] <= {overlap})) END FROM (
  SELECT key, w, s, greatest(i + 1, list_min(list_filter(range(o, len(w) + 1), lambda p: p = len(w) OR s[p + 2] - s[o + 1] > {size}))) AS j FROM {name}_o JOIN {name}_w USING (key)) WHERE j < len(w)),
{name}_r AS (SELECT key, o AS first, lead(i, 1, len(w)) OVER (PARTITION BY key ORDER BY i) AS "end", w[i + 1] > {size} AS alone FROM {name}_o JOIN {name}_w USING (key))"""


def _sentence_chunks_sql(size: int, overlap: int) -> str:
    count = f"len({WORDS.format('x')})"
    marks = ", ".join(f"list_filter(string_split(replace(t, '{m}', '{m}' || chr(1)), chr(1)), lambda c: regexp_replace(c, '[ \n\t\r]+', '', 'g') <> '')" for m in chunk.DELIMITERS)
    return f"""WITH RECURSIVE d AS (SELECT doc_id AS key, {SENTENCES} AS x FROM documents WHERE text IS NOT NULL), a AS (SELECT key, x AS items, list_transform(x, lambda x: {count}) AS counts FROM d),
{_packing_sql('a', size, overlap)},
l AS (SELECT {{'doc': key, 'pos': first}} AS key, items[first + 1] AS t FROM a JOIN a_r USING (key) WHERE alone),
m AS (SELECT key, t, list_filter([{marks}], lambda c: len(c) > 1)[1] AS items FROM l),
b AS (SELECT key, items, list_transform(items, lambda x: {count}) AS counts FROM m WHERE items IS NOT NULL),
{_packing_sql('b', size, 0)},
pieces AS (SELECT key AS doc_id, first AS pos, "end" AS nth, array_to_string(items[first + 1:"end"], ' ') AS text FROM a JOIN a_r USING (key) WHERE NOT alone
UNION ALL SELECT key.doc, key.pos, first, array_to_string(items[first + 1:"end"], '') FROM b JOIN b_r USING (key)
UNION ALL SELECT key.doc, key.pos, k, array_to_string(w[k * {size} + 1:k * {size} + {size}], ' ') FROM (SELECT key, {WORDS.format('t')} AS w FROM m WHERE items IS NULL), unnest(range(0, (len(w) - 1) // {size} + 1)) u(k)),
plain AS (SELECT doc_id, pos, nth, regexp_replace(replace(text, chr(10), ' '), '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g') AS chunk_text FROM pieces)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, nth) - 1 AS chunk_index, chunk_text FROM plain WHERE chunk_text <> ''"""


@query(f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) x(i)")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, len({SENTENCES})::BIGINT AS n FROM documents")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(_sentence_chunks_sql(180, 64))
def sentence_chunks(spark, sf):
    return chunk.sentence_chunk_rows(table(spark, sf, "documents")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_sentence_chunks_sql(15, 3))
def clause_split(spark, sf):
    return chunk.sentence_chunk_rows(table(spark, sf, "documents"), 15, 3).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_window_sql(120, 30) + " SELECT doc_id, chunk_index, array_to_string(list_transform(w, lambda t: ('0x' || substr(md5(t), 1, 4))::BIGINT::VARCHAR), ',') AS ids FROM w")
def sentence_chunk_ids(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id", F.transform(X.tokens(F.col("text")), X.hash_id).alias("ids"))
    rows = ids.select("doc_id", F.posexplode(chunk.sentence_chunk_ids(F.col("ids"), 120, 30)).alias("chunk_index", "w"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(F.col("w").cast("array<string>"), ",").alias("ids"))


_VOCABULARY = f"""m AS (SELECT DISTINCT '{MARK}' || unnest({WORDS.format('text')}) AS w FROM benchmark),
v AS (SELECT piece, row_number() OVER (ORDER BY piece) AS id FROM (SELECT DISTINCT w[i:i + n - 1] AS piece FROM m, unnest(range(1, length(w) + 1)) x(i), unnest(range(1, 5)) y(n)))"""
_SUBWORDS = f"""WITH RECURSIVE {_VOCABULARY},
q AS (SELECT DISTINCT '{MARK}' || unnest({WORDS.format('text')}) AS w FROM documents),
r AS (SELECT w, 1::BIGINT AS pos, []::BIGINT[] AS ids FROM q UNION ALL
  SELECT w, pos + coalesce(length(a.piece), length(b.piece), length(c.piece), 1), list_append(ids, coalesce(a.id, b.id, c.id, d.id, 0)) FROM r
  LEFT JOIN v a ON a.piece = w[pos:pos + 3] LEFT JOIN v b ON b.piece = w[pos:pos + 2] LEFT JOIN v c ON c.piece = w[pos:pos + 1] LEFT JOIN v d ON d.piece = w[pos:pos] WHERE pos <= length(w)),
t AS (SELECT w, ids FROM r WHERE pos > length(w)),
p AS (SELECT doc_id, i, '{MARK}' || x[i] AS w FROM (SELECT doc_id, {WORDS.format('text')} AS x FROM documents), unnest(range(1, len(x) + 1)) u(i))
SELECT doc_id, array_to_string(flatten(list(ids ORDER BY i)), ',') AS ids, sum(len(ids))::BIGINT AS n FROM p JOIN t USING (w) GROUP BY doc_id"""


def _subwords(spark, sf) -> subword.SubwordTokenizer:
    """A vocabulary file of the benchmark's pieces of up to four characters, written and loaded."""
    words = table(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word"))
    path = _new_folder(spark)
    subword.pieces_of(words, 4).orderBy("piece").coalesce(1).write.text(path)
    return subword.SubwordTokenizer.load(spark, path)


@query(_SUBWORDS)
def subword_ids(spark, sf):
    """Ids of longest matches, of documents with a token."""
    ids = table(spark, sf, "documents").select("doc_id", _subwords(spark, sf).column(F.col("text")).alias("ids")).where("size(ids) > 0")
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS text FROM documents WHERE text IS NOT NULL")
def subword_round_trip(spark, sf):
    """Tokens of each text put together again."""
    tokenizer = _subwords(spark, sf)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokenizer.detokenize(tokenizer.tokenize(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


IDS = f"SELECT doc_id, list_transform({WORDS.format('text')}, lambda t: ('0x' || substr(md5(t), 1, 4))::BIGINT) AS ids FROM documents"
SEQUENCE = "list_concat([1, 2], ids[1:254], list_transform(range(0, 254 - least(len(ids), 254)), lambda i: 0))"
MASK = "list_transform(range(1, 257), lambda i: CASE WHEN i - 1 < 256 AND seq[i] <> 0 AND NOT (i >= 3 AND list_contains(skip, seq[i])) THEN 1 ELSE 0 END)"
SKIP = "[" + ", ".join(f"('0x' || substr(md5('{c if c != chr(39) else chr(39) * 2}'), 1, 4))::BIGINT" for c in X.PUNCTUATION) + "]"


def _sequences(spark, sf) -> DataFrame:
    ids = F.transform(X.tokens(F.col("text")), X.hash_id)
    return table(spark, sf, "documents").select("doc_id", X.model_tokens(ids, 256, 2, 0).alias("seq"))


def _masks(spark, sf) -> DataFrame:
    skip = F.array(*[X.hash_id(F.lit(c)) for c in X.PUNCTUATION])
    return _sequences(spark, sf).select("doc_id", "seq", X.attention_mask(F.col("seq"), 0, skip, 256).alias("mask"))


@query(f"WITH d AS ({IDS}) SELECT doc_id, array_to_string({SEQUENCE}, ',') AS seq FROM d")
def model_tokens(spark, sf):
    return _sequences(spark, sf).select("doc_id", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"))


MASKED = f"d AS ({IDS}), s AS (SELECT doc_id, {SEQUENCE} AS seq, {SKIP} AS skip FROM d), m AS (SELECT doc_id, seq, {MASK} AS mask FROM s)"


@query(f"WITH {MASKED} SELECT doc_id, array_to_string(mask, '') AS mask FROM m")
def attention_mask(spark, sf):
    return _masks(spark, sf).select("doc_id", F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


@query(f"WITH {MASKED} SELECT doc_id, list_sum(mask)::BIGINT AS real, len(list_filter(range(1, list_sum(mask)::BIGINT + 1), lambda i: mask[i] = 1))::BIGINT AS kept_in_prefix FROM m")
def mask_prefix_compat(spark, sf):
    m = _masks(spark, sf)
    kept = X.document_rows(F.col("seq"), F.col("mask"))
    return m.select("doc_id", F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long").alias("real"), F.size(kept).cast("long").alias("kept_in_prefix"))


@query(f"WITH {MASKED} SELECT doc_id, array_to_string(list_transform(list_filter(range(1, 257), lambda i: mask[i] = 1), lambda i: seq[i]), ',') AS kept FROM m")
def doc_postprocess(spark, sf):
    kept = X.document_rows(F.col("seq"), F.col("mask"), prefix_mask_compat=False)
    return _masks(spark, sf).select("doc_id", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query(f"WITH {MASKED}, k AS (SELECT doc_id, list_transform(list_filter(range(1, 257), lambda i: mask[i] = 1), lambda i: seq[i]) AS kept FROM m) SELECT doc_id, array_to_string(list_concat(kept[1:32], list_transform(range(0, 32 - least(len(kept), 32)), lambda i: 0)), ',') AS rows FROM k")
def query_pad(spark, sf):
    kept = X.document_rows(F.col("seq"), F.col("mask"), prefix_mask_compat=False)
    rows = X.query_rows(kept, 32, F.lit(0).cast("long"))
    return _masks(spark, sf).select("doc_id", F.array_join(rows.cast("array<string>"), ",").alias("rows"))


# -- index tables with deterministic centroids

CENTROIDS = UNIT + f""",
c AS (SELECT vec_id // {EVERY} AS centroid_id, v AS cv FROM n WHERE vec_id % {EVERY} = 0),
a AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS token_pos, v, centroid_id, cv FROM (
  SELECT n.vec_id, n.v, c.centroid_id, c.cv, row_number() OVER (PARTITION BY n.vec_id ORDER BY round(list_inner_product(n.v, c.cv), 9) DESC, c.centroid_id) AS rn FROM n CROSS JOIN c) WHERE rn = 1)"""


def _moved_sql(assigned: str, before: str, after: str) -> str:
    """Centroids after one Lloyd step."""
    return f"""{after}_m AS (SELECT centroid_id, list(x ORDER BY i) AS x FROM (SELECT centroid_id, i, round(avg(v[i]), 9) AS x FROM {assigned}, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL) GROUP BY centroid_id),
{after} AS (SELECT {before}.* EXCLUDE (cv), coalesce(list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))), cv) AS cv FROM {before} LEFT JOIN {after}_m USING (centroid_id))"""


def _nearest_sql(tokens: str, centroids: str, on: str = "true") -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT {tokens}.*, y.centroid_id, row_number() OVER (PARTITION BY {tokens}.vec_id ORDER BY round(list_inner_product({tokens}.v, y.cv), 9) DESC, y.centroid_id) AS rn FROM {tokens} JOIN {centroids} y ON {on}) WHERE rn = 1"""


LLOYD = f"{UNIT}, c0 AS (SELECT vec_id // {EVERY} AS centroid_id, v AS cv FROM n WHERE vec_id % {EVERY} = 0), a0 AS ({_nearest_sql('n', 'c0')}), {_moved_sql('a0', 'c0', 'c1')}, a1 AS ({_nearest_sql('n', 'c1')}), {_moved_sql('a1', 'c1', 'c2')}"
CELLS = f"""{UNIT}, k AS (SELECT vec_id // 128 AS centroid_id, v AS cv FROM n WHERE vec_id % 128 = 0), t AS (SELECT vec_id, v, centroid_id AS cell FROM ({_nearest_sql('n', 'k')})),
f0 AS (SELECT vec_id // {EVERY} AS centroid_id, cell, v AS cv FROM t WHERE vec_id % {EVERY} = 0), b0 AS ({_nearest_sql('t', 'f0', 't.cell = y.cell')}), {_moved_sql('b0', 'f0', 'f1')}, b1 AS ({_nearest_sql('t', 'f1', 't.cell = y.cell')})"""


@query(f"WITH {LLOYD} SELECT centroid_id, i - 1 AS pos, round(cv[i], 6) AS x FROM c2, unnest(range(1, len(cv) + 1)) t(i)")
def lloyd_centroids(spark, sf):
    """Two Lloyd steps from every sixteenth token, as sums over the tokens."""
    t = tokens(spark, sf)
    _, start = codec.centroid_block(codec.deterministic_centroids(t, EVERY))
    c = spark.createDataFrame(codec.centroid_table(codec.lloyd(t, start, 2)), "centroid_id long, v array<double>")
    return c.select("centroid_id", F.posexplode("v").alias("pos", "x")).select("centroid_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {CELLS} SELECT vec_id // 8 AS doc_id, vec_id % 8 AS token_pos, centroid_id FROM b1")
def two_level_assign(spark, sf):
    """Cells of every 128th token; inside them one Lloyd step from every sixteenth token, then assignment, joined by cell."""
    t = tokens(spark, sf)
    coarse = np.array([r[0] for r in codec.deterministic_centroids(t, 128).orderBy("centroid_id").select("v").collect()])
    cells = codec.in_cells(t, coarse)
    first = cells.where(f"(doc_id * 8 + token_pos) % {EVERY} = 0").select("cell", F.expr(f"(doc_id * 8 + token_pos) div {EVERY}").alias("centroid_id"), "v")
    fine = codec.lloyd_in_cells(cells, first, 1)
    return codec.assign_in_cells(cells, fine).select("doc_id", F.col("token_pos").cast("long").alias("token_pos"), "centroid_id")


def _codec_sql(nbits: int, s: str = "") -> str:
    n = 2**nbits
    inner, middle = [i / n for i in range(1, n)], [(i + 0.5) / n for i in range(n)]
    return f"""r{s} AS (SELECT doc_id, token_pos, centroid_id, cv, v, list_transform(range(1, len(v) + 1), lambda i: round(v[i] - cv[i], 9)) AS r FROM a),
x{s} AS (SELECT quantile_cont(x, {inner}) AS cut, quantile_cont(x, {middle}) AS w FROM (SELECT unnest(r) AS x FROM r{s})),
k{s} AS (SELECT doc_id, token_pos, centroid_id, cv, v, r, w, list_transform(r, lambda x: len(list_filter(cut, lambda y: x >= y))) AS code FROM r{s}, x{s}),
z{s} AS (SELECT doc_id, token_pos, centroid_id, v, list_transform(range(1, len(cv) + 1), lambda i: cv[i] + w[code[i] + 1]) AS u FROM k{s}),
t{s} AS (SELECT doc_id, token_pos, centroid_id, v, list_transform(u, lambda x: x / l) AS dv FROM (SELECT *, sqrt(list_inner_product(u, u)) AS l FROM z{s}))"""


CODEC = CENTROIDS + ", " + _codec_sql(NBITS)


def _centroids(spark, sf) -> DataFrame:
    return codec.deterministic_centroids(tokens(spark, sf), EVERY)


def _assigned(spark, sf) -> DataFrame:
    return codec.assign(tokens(spark, sf), _centroids(spark, sf))


def _residuals(spark, sf) -> DataFrame:
    return codec.residuals(_assigned(spark, sf), _centroids(spark, sf))


def _coded(spark, sf) -> tuple[DataFrame, list[float]]:
    rest = checkpointed(_residuals(spark, sf))
    edges, weights = codec.cutoffs(rest, NBITS)
    return codec.codes(rest, edges), weights


def _rebuilt(spark, sf) -> DataFrame:
    coded, weights = _coded(spark, sf)
    return codec.reconstruct(coded, _centroids(spark, sf), weights)


@query(f"WITH {CENTROIDS} SELECT centroid_id, i - 1 AS pos, round(cv[i], 6) AS x FROM c, unnest(range(1, len(cv) + 1)) t(i)")
def centroids_det(spark, sf):
    return _centroids(spark, sf).select("centroid_id", F.posexplode("v").alias("pos", "x")).select("centroid_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {CENTROIDS} SELECT doc_id, token_pos, centroid_id FROM a")
def centroid_assign(spark, sf):
    return _assigned(spark, sf).select("doc_id", F.col("token_pos").cast("long").alias("token_pos"), "centroid_id")


@query(f"WITH {CENTROIDS} SELECT centroid_id, count(DISTINCT doc_id) AS n, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids FROM a GROUP BY centroid_id")
def ivf_lists(spark, sf):
    return codec.inverted_lists(_assigned(spark, sf)).select("centroid_id", "n", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query("SELECT vec_id // 8 AS doc_id, count(*) AS n_tokens FROM embeddings GROUP BY ALL")
def doc_lengths(spark, sf):
    return codec.document_lengths(tokens(spark, sf))


@query(f"WITH {CODEC}, parts AS (SELECT 'cutoff' AS kind, i - 1 AS pos, round(cut[i], 6) AS x FROM x, unnest(range(1, len(cut) + 1)) t(i) UNION ALL SELECT 'weight', i - 1, round(w[i], 6) FROM x, unnest(range(1, len(w) + 1)) t(i)) SELECT * FROM parts")
def residual_codec(spark, sf):
    edges, weights = codec.cutoffs(checkpointed(_residuals(spark, sf)), NBITS)
    rows = [(kind, i, round(x, 6)) for kind, xs in (("cutoff", edges), ("weight", weights)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "kind string, pos long, x double")


@query(f"WITH {CODEC} SELECT doc_id, token_pos, centroid_id, array_to_string(code, '') AS code FROM k")
def residual_codes(spark, sf):
    coded, _ = _coded(spark, sf)
    return coded.select("doc_id", F.col("token_pos").cast("long").alias("token_pos"), "centroid_id", F.array_join(F.col("code").cast("array<string>"), "").alias("code"))


@query(f"WITH {CODEC} SELECT i - 1 AS pos, round(avg(abs(r[i])), 6) AS avg_residual FROM r, unnest(range(1, len(r) + 1)) t(i) GROUP BY ALL")
def avg_residual(spark, sf):
    return codec.average_residual(_residuals(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CODEC} SELECT doc_id, token_pos, i - 1 AS pos, round(dv[i], 6) AS x FROM t, unnest(range(1, len(dv) + 1)) y(i)")
def reconstruct(spark, sf):
    return _rebuilt(spark, sf).select("doc_id", F.col("token_pos").cast("long").alias("token_pos"), F.posexplode("v").alias("pos", "x")).select("doc_id", "token_pos", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_ERRORS = " UNION ALL ".join(f"SELECT {b} AS nbits, round(avg(list_inner_product(v, dv)), 6) AS mean_cosine FROM t{b}" for b in (1, 2, 4))


@query(f"WITH {CENTROIDS}, {', '.join(_codec_sql(b, str(b)) for b in (1, 2, 4))} {_ERRORS}")
def reconstruct_error_by_nbits(spark, sf):
    own = tokens(spark, sf).select("doc_id", "token_pos", F.col("v").alias("own"))
    rest, out = checkpointed(_residuals(spark, sf)), None
    for b in (1, 2, 4):
        edges, weights = codec.cutoffs(rest, b)
        both = codec.reconstruct(codec.codes(rest, edges), _centroids(spark, sf), weights).join(own, ["doc_id", "token_pos"])
        part = both.agg(F.round(F.avg(V.dot(F.col("v"), F.col("own"))), 6).alias("mean_cosine")).select(F.lit(b).alias("nbits"), "mean_cosine")
        out = part if out is None else out.unionByName(part)
    return out


STAGES = CODEC + f""",
cs AS (SELECT query_id, qtok, centroid_id, round(list_inner_product(cv, qv), 9) AS s FROM c CROSS JOIN q),
p AS (SELECT DISTINCT query_id, centroid_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qtok ORDER BY s DESC, centroid_id) AS rn FROM cs) WHERE rn <= {PROBE}),
cand AS (SELECT DISTINCT p.query_id, a.doc_id FROM p JOIN a ON p.centroid_id = a.centroid_id)"""


def _approximate_sql(threshold: float | None) -> str:
    keep = "" if threshold is None else f"JOIN (SELECT query_id, centroid_id FROM cs GROUP BY ALL HAVING max(s) >= {threshold}) h ON cs.query_id = h.query_id AND cs.centroid_id = h.centroid_id"
    return f"""live AS (SELECT cs.* FROM cs {keep}),
ba AS (SELECT cand.query_id, cand.doc_id, live.qtok, max(live.s) AS m FROM cand JOIN a ON cand.doc_id = a.doc_id JOIN live ON live.query_id = cand.query_id AND live.centroid_id = a.centroid_id GROUP BY ALL),
ap AS (SELECT cand.query_id, cand.doc_id, round(coalesce(sum(m), 0), 6) AS score FROM cand LEFT JOIN ba ON cand.query_id = ba.query_id AND cand.doc_id = ba.doc_id GROUP BY ALL),
kept AS (SELECT query_id, doc_id, score FROM ap QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {CAP}),
fm AS (SELECT kept.query_id, kept.doc_id, q.qtok, max(list_inner_product(q.qv, t.dv)) AS m FROM kept JOIN q ON kept.query_id = q.query_id JOIN t ON kept.doc_id = t.doc_id GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM fm GROUP BY ALL)"""


def _stage_tables(spark, sf):
    centroids = _centroids(spark, sf)
    return centroids, codec.inverted_lists(_assigned(spark, sf)), *search.scorer_of(centroids, query_tokens(spark, sf))


@query(f"WITH {STAGES} SELECT query_id, doc_id FROM cand")
def ivf_probe(spark, sf):
    centroids, lists, scorer, _ = _stage_tables(spark, sf)
    return search.pairs(search.probe(centroids, scorer, lists, PROBE), scorer)


@query(f"WITH {STAGES}, {_approximate_sql(None)} SELECT query_id, doc_id, score FROM ap")
def centroid_approx_scores(spark, sf):
    centroids, lists, scorer, ids = _stage_tables(spark, sf)
    return search.approximate(search.probe(centroids, scorer, lists, PROBE), lists, scorer, ids, None)


@query(f"WITH {STAGES}, {_approximate_sql(0.25)} SELECT query_id, doc_id, score FROM ap")
def threshold_prune(spark, sf):
    centroids, lists, scorer, ids = _stage_tables(spark, sf)
    return search.approximate(search.probe(centroids, scorer, lists, PROBE), lists, scorer, ids, 0.25)


@query(f"WITH {STAGES}, {_approximate_sql(None)} SELECT query_id, doc_id, score FROM kept")
def candidate_cap(spark, sf):
    return search.cap(centroid_approx_scores(spark, sf), CAP)


def _staged(spark, sf, threshold=None, probe=PROBE, cap=CAP) -> DataFrame:
    coded, weights = _coded(spark, sf)
    centroids = _centroids(spark, sf)
    p = SearchParameters(n_full_scores=cap, n_ivf_probe=probe, top_k=K, centroid_score_threshold=threshold)
    return search.staged(codec.reconstruct(coded, centroids, weights), coded, codec.inverted_lists(coded), centroids, query_tokens(spark, sf), p)


@query(f"WITH {STAGES}, {_approximate_sql(None)} {TOP}")
def staged_search(spark, sf):
    return _staged(spark, sf)


@query(f"WITH {STAGES}, {_approximate_sql(0.25)} {TOP}")
def staged_search_threshold(spark, sf):
    return _staged(spark, sf, 0.25)


@query(f"WITH {STAGES}, {_approximate_sql(None)}, h AS ({TOP}), em AS (SELECT query_id, doc_id, qtok, max(list_inner_product(qv, dv)) AS best FROM q CROSS JOIN d GROUP BY ALL), es AS (SELECT query_id, doc_id, round(sum(best), 6) AS score FROM em GROUP BY ALL), eh AS ({TOP.replace('FROM s', 'FROM es')}) SELECT h.query_id, count(eh.doc_id) / count(*) AS overlap FROM h LEFT JOIN eh ON h.query_id = eh.query_id AND h.doc_id = eh.doc_id GROUP BY h.query_id")
def staged_vs_exact_overlap(spark, sf):
    return evaluate.overlap_at_k(_staged(spark, sf), maxsim_topk(spark, sf), K)


_ADAPTIVE_SQL = (STAGES + ", " + _approximate_sql(None)).replace(f"rn <= {PROBE})", "rn <= (SELECT probe FROM par))").replace(f"<= {CAP})", "<= (SELECT full_scores FROM par))").replace("t.dv)) AS m FROM kept", "d.dv)) AS m FROM kept").replace("JOIN t ON kept.doc_id = t.doc_id", "JOIN d ON kept.doc_id = d.doc_id")
_ADAPTIVE_SQL = f"""WITH num AS (SELECT count(DISTINCT vec_id // 8) AS n FROM embeddings),
par AS (SELECT CASE WHEN n <= 100 THEN n WHEN n <= 500 THEN greatest({40 * K}, least(200, n)) WHEN n <= 2000 THEN greatest({60 * K}, 250) ELSE greatest({80 * K}, 300) END AS full_scores,
CASE WHEN n <= 100 THEN least(16, n) WHEN n <= 500 THEN greatest(8, least(24, n // 4)) WHEN n <= 2000 THEN least(32, greatest(24, n // 80)) ELSE least(48, greatest(32, n // 100)) END AS probe FROM num),
{_ADAPTIVE_SQL}"""


@query(f"{_ADAPTIVE_SQL} {TOP}")
def staged_search_adaptive(spark, sf):
    """Probes and cap by the number of documents; what the cap keeps is scored with the original vectors."""
    n = tokens(spark, sf).select("doc_id").distinct().count()
    p = replace(params.adaptive(n, K), centroid_score_threshold=None)
    assigned = _assigned(spark, sf)
    return search.staged(tokens(spark, sf), assigned, codec.inverted_lists(assigned), _centroids(spark, sf), query_tokens(spark, sf), p)


@query(f"{_ADAPTIVE_SQL}, h AS ({TOP}), em AS (SELECT query_id, doc_id, qtok, max(list_inner_product(qv, dv)) AS best FROM q CROSS JOIN d GROUP BY ALL), es AS (SELECT query_id, doc_id, round(sum(best), 6) AS score FROM em GROUP BY ALL), eh AS ({TOP.replace('FROM s', 'FROM es')}) SELECT h.query_id, count(eh.doc_id) / count(*) AS overlap FROM h LEFT JOIN eh ON h.query_id = eh.query_id AND h.doc_id = eh.doc_id GROUP BY h.query_id")
def staged_adaptive_recall(spark, sf):
    """Recall of the adaptive search against exact search, for each query."""
    return evaluate.overlap_at_k(staged_search_adaptive(spark, sf), maxsim_topk(spark, sf), K)


# -- the index on disk


def _searched(spark, sf, index: VectorIndex) -> DataFrame:
    p = SearchParameters(n_full_scores=CAP, n_ivf_probe=PROBE, top_k=K, centroid_score_threshold=None)
    return index.search(query_tokens(spark, sf), p)


INDEXED = IndexConfig(nbits=NBITS, centroids="deterministic", every=EVERY)


@query(SQL["staged_search"])
def index_create_search(spark, sf):
    """An index is written, opened again and searched."""
    path = _new_folder(spark)
    VectorIndex.create(spark, path, tokens(spark, sf), INDEXED)
    return _searched(spark, sf, VectorIndex.open(spark, path))


@query(SQL["staged_search"])
def index_append_search(spark, sf):
    """An index of the first 40 documents to which the others are appended, numbered from 0."""
    path, t = _new_folder(spark), tokens(spark, sf)
    VectorIndex.create(spark, path, t.where("doc_id < 40"), INDEXED)
    VectorIndex.open(spark, path).append(t.where("doc_id >= 40").withColumn("doc_id", F.col("doc_id") - 40))
    return _searched(spark, sf, VectorIndex.open(spark, path))


@query("SELECT row_number() OVER (ORDER BY o) - 1 AS doc_id, n_tokens FROM (SELECT vec_id // 8 AS o, count(*) AS n_tokens FROM embeddings WHERE (vec_id // 8) % 3 <> 1 GROUP BY o)")
def index_delete(spark, sf):
    """Documents leave an index on disk, survivors are renumbered in order."""
    path = _new_folder(spark)
    index = VectorIndex.create(spark, path, tokens(spark, sf), INDEXED)
    index.delete(spark.range(1, index.num_documents, 3).select(F.col("id").alias("doc_id")))
    return VectorIndex.open(spark, path).table("doclens").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))


# -- the segmented index

#: Small blocks and files of lists, so that small tables have many; nothing is built anew.
SEGMENTED = replace(INDEXED, rebuild_up_to=0, block=16, bucket=2)


def _segmented(spark, sf, config: IndexConfig = SEGMENTED) -> SegmentIndex:
    path = _new_folder(spark)
    SegmentIndex.create(spark, path, tokens(spark, sf), config)
    return SegmentIndex.open(spark, path)


@query(SQL["staged_search"])
def packed_search(spark, sf):
    """Packed codes on disk, scored by look-up tables."""
    return _searched(spark, sf, _segmented(spark, sf))


@query(SQL["staged_search_threshold"])
def packed_search_threshold(spark, sf):
    p = SearchParameters(n_full_scores=CAP, n_ivf_probe=PROBE, top_k=K, centroid_score_threshold=0.25)
    return _segmented(spark, sf).search(query_tokens(spark, sf), p)


@query(SQL["maxsim_topk"])
def certified_search(spark, sf):
    """Exactly the result of exact search, from bounds and the documents that could pass them."""
    return _segmented(spark, sf, replace(SEGMENTED, nbits=8)).certified(query_tokens(spark, sf), K)[0]


@query()
def certified_effort(spark, sf):
    """Of each query: all documents, those in probed lists, those that were scored, and lists probed for each token."""
    report = _segmented(spark, sf, replace(SEGMENTED, nbits=8)).certified(query_tokens(spark, sf), K)[1]
    return spark.createDataFrame([tuple(r.values()) for r in report], "query_id long, documents long, candidates long, scored long, probes long")


@query(SQL["maxsim_subset"].replace("(SELECT doc_id FROM labels WHERE quality = 1)", "(SELECT doc_id FROM labels WHERE quality = 1)"))
def certified_subset(spark, sf):
    """A query that may see some documents only: the others are neither candidates nor scored."""
    allowed = table(spark, sf, "labels").where("quality = 1").select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    return _segmented(spark, sf, replace(SEGMENTED, nbits=8)).certified(query_tokens(spark, sf), K, subset=allowed)[0]


_APPENDED = SQL["staged_search"].replace(f"FROM n WHERE vec_id % {EVERY} = 0", f"FROM n WHERE vec_id % {EVERY} = 0 AND vec_id < 320").replace("unnest(r) AS x FROM r)", "unnest(r) AS x FROM r WHERE doc_id < 40)")


@query(_APPENDED)
def index_append_incremental(spark, sf):
    """Segments: the first 40 documents give the codebook, the others come in four appends, which are merged; no vectors are kept."""
    path, t = _new_folder(spark), tokens(spark, sf)
    index = SegmentIndex.create(spark, path, t.where("doc_id < 40"), replace(SEGMENTED, keep_vectors=False, fan=2))
    last = t.agg(F.max("doc_id")).first()[0] + 1
    ends = [40 + (last - 40) * i // 4 for i in range(5)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        index, _ = index.append(t.where(f"doc_id >= {a} and doc_id < {b}").withColumn("doc_id", F.col("doc_id") - a))
    return _searched(spark, sf, SegmentIndex.open(spark, path))


@query(SQL["staged_search"].replace("JOIN a ON p.centroid_id = a.centroid_id)", "JOIN a ON p.centroid_id = a.centroid_id WHERE a.doc_id % 3 <> 1)").replace(TOP, f"SELECT query_id, rank, doc_id - (doc_id + 1) // 3 AS doc_id, score FROM ({TOP})"))
def index_delete_search(spark, sf):
    """A third of the documents leave by bitmaps; codes stay as they are, survivors are renumbered where they are read."""
    index = _segmented(spark, sf)
    index, _ = index.delete(spark.range(1, index.num_documents, 3).select(F.col("id").alias("doc_id")))
    return _searched(spark, sf, index)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, source AS document_name, doc_id AS chunk_index FROM documents WHERE doc_id IN (SELECT vec_id // 8 FROM embeddings) AND doc_id % 3 <> 1 AND doc_id % 7 <> 0")
def index_delete_metadata(spark, sf):
    """Metadata after two deletes, of which the second names the new ids."""
    path, t = _new_folder(spark), tokens(spark, sf)
    index = SegmentIndex.create(spark, path, t, SEGMENTED, _chunks(spark, sf).join(t.select("doc_id").distinct(), "doc_id", "left_semi"))
    index, _ = index.delete(spark.range(1, index.num_documents, 3).select(F.col("id").alias("doc_id")))
    index, _ = index.delete(index.chunks().where("chunk_index % 7 = 0").select("doc_id"))
    return SegmentIndex.open(spark, path).chunks().select("doc_id", "document_name", F.col("chunk_index").cast("long").alias("chunk_index"))


STREAMED = IndexConfig(nbits=2, centroids="deterministic", every=4000, rebuild_up_to=0, keep_vectors=False, fan=3)


@query(_window_sql(180, 64) + " SELECT doc_id::VARCHAR AS document_name, count(*) AS chunk_count, sum(len(w))::BIGINT AS embedding_count FROM w GROUP BY doc_id")
def index_stream(spark, sf):
    """The documents as a stream of files into an index, batch by batch; then the first and the second batch come again."""
    folder = _new_folder(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_name"), "text")
    docs.repartition(4, "document_name").write.parquet(f"{folder}/files")
    stream = stream_files(spark, f"{folder}/files", "document_name string, text string", files_per_batch=1)
    encoder = encode.HashEncoder()
    run = ingest_stream(stream, f"{folder}/index", encoder, f"{folder}/state", STREAMED)
    run.awaitTermination()
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", str(run.id))
    again = index_batch(f"{folder}/index", encoder, STREAMED)
    for batch in (1, 0):
        again(docs, batch)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    return SegmentIndex.open(spark, f"{folder}/index").documents().select("document_name", "chunk_count", "embedding_count")


@query("SELECT count(DISTINCT vec_id // 8) AS deleted, 0::BIGINT AS remaining FROM embeddings")
def index_wipe(spark, sf):
    """Deleting all documents removes the index."""
    index = _segmented(spark, sf)
    left, gone = index.delete(index.table("doclens").select("doc_id"))
    return gone.agg(F.count(F.lit(1)).alias("deleted")).select("deleted", F.lit(0 if left is None else left.num_documents).cast("long").alias("remaining"))


# -- parameters


@query(
    """WITH g AS (SELECT n, k FROM range(1, 3001, 7) a(n), range(1, 21) b(k))
SELECT n, k, CASE WHEN n <= 100 THEN n WHEN n <= 500 THEN greatest(40 * k, least(200, n)) WHEN n <= 2000 THEN greatest(60 * k, 250) ELSE greatest(80 * k, 300) END AS n_full,
CASE WHEN n <= 100 THEN least(16, n) WHEN n <= 500 THEN greatest(8, least(24, n // 4)) WHEN n <= 2000 THEN least(32, greatest(24, n // 80)) ELSE least(48, greatest(32, n // 100)) END AS n_probe FROM g"""
)
def adaptive_params(spark, sf):
    grid = spark.range(1, 3001, 7).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("k"))
    full, probe = params.adaptive_columns(F.col("n"), F.col("k"))
    return grid.select("n", "k", full.alias("n_full"), probe.alias("n_probe"))


@query("SELECT n AS documents, k, least(k, n) AS top_k, least(8, 2 ** b)::BIGINT AS n_probe, b AS nbits FROM range(1, 40) x(n), range(1, 10) y(k), (VALUES (1), (2), (4), (8)) z(b)")
def cli_params(spark, sf):
    rows = [(n, k, p.top_k, p.n_ivf_probe, b) for n in range(1, 40) for k in range(1, 10) for b in (1, 2, 4, 8) for p in [params.for_new_index(n, k, b)]]
    return spark.createDataFrame(rows, "documents long, k long, top_k long, n_probe long, nbits int")


# -- metadata


def _chunks(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_name"), F.col("text").alias("chunk_text"), F.col("doc_id").alias("chunk_index"), F.size(X.tokens(F.col("text"))).alias("embedding_count"), F.when(F.col("lang") != "en", F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("file_path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"))
    return metadata.register(rows)


COUNT = f"len({WORDS.format('text')})::BIGINT"
PATH = "CASE WHEN lang <> 'en' THEN '/' || lang || '/' || doc_id END"


@query(f"SELECT doc_id, source AS document_name, doc_id AS chunk_index, {COUNT} AS embedding_count, {PATH} AS file_path, 1700000000 + doc_id AS created FROM documents")
def register_roundtrip(spark, sf):
    return _chunks(spark, sf).select("doc_id", "document_name", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("embedding_count").cast("long").alias("embedding_count"), "file_path", F.unix_timestamp("created_at").alias("created"))


@query("SELECT row_number() OVER (ORDER BY l.doc_id DESC) - 1 AS pos, l.doc_id, d.source AS document_name FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def get_documents_ordered(spark, sf):
    wanted = [r[0] for r in table(spark, sf, "labels").select("doc_id").orderBy(F.desc("doc_id")).collect()]  # a request: its order is what is asked
    return metadata.get(_chunks(spark, sf), wanted).select("pos", "doc_id", "document_name")


@query("SELECT doc_id, source AS document_name, text AS chunk_text FROM documents WHERE source = 'src3'")
def document_chunks_named(spark, sf):
    return metadata.by_name(_chunks(spark, sf), "src3").select("doc_id", "document_name", "chunk_text")


@query(f"SELECT source AS document_name, count(*) AS chunk_count, sum({COUNT})::BIGINT AS embedding_count, arg_min({PATH}, doc_id) FILTER (WHERE lang <> 'en') AS file_path, min(1700000000 + doc_id) AS created FROM documents GROUP BY source")
def indexed_documents(spark, sf):
    return metadata.documents(_chunks(spark, sf)).select("document_name", "chunk_count", "embedding_count", "file_path", F.unix_timestamp("created_at").alias("created"))


@query("SELECT count(*) AS n FROM documents")
def document_count(spark, sf):
    return _chunks(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, source AS document_name, text AS chunk_text, {COUNT} AS embedding_count, {PATH} AS file_path FROM documents")
def payload_json_roundtrip(spark, sf):
    back = metadata.from_payload(_chunks(spark, sf).select(metadata.payload().alias("payload")))
    return back.select("doc_id", "document_name", "chunk_text", F.col("embedding_count").cast("long").alias("embedding_count"), "file_path")


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def _where(name: str, fragment: str, values: list, sql: str) -> None:
    def f(spark, sf):
        return where(_labelled(spark, sf), fragment, values).select("doc_id")

    f.__name__ = name
    query(f"SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE {sql}")(f)


_where("where_eq", "lang = ?", ["de"], "lang = 'de'")
_where("where_ne", "lang != ?", ["en"], "lang <> 'en'")
_where("where_lt", "n_chars < ?", [800], "n_chars < 800")
_where("where_le", "n_chars <= 1000", [], "n_chars <= 1000")
_where("where_gt", "n_chars > ?", [3000], "n_chars > 3000")
_where("where_ge", "n_chars >= ?", [2368], "n_chars >= 2368")
_where("where_in", "source IN (?, 'src2', ?)", ["src1", "src5"], "source IN ('src1', 'src2', 'src5')")
_where("where_not_in", "source NOT IN (?, ?)", ["src0", "src1"], "source NOT IN ('src0', 'src1')")
_where("where_between", "n_chars BETWEEN ? AND ?", [500, 1500], "n_chars BETWEEN 500 AND 1500")
_where("where_isnull", "quality IS NULL", [], "l.quality IS NULL")
_where("where_notnull", "quality IS NOT NULL", [], "l.quality IS NOT NULL")
_where("where_and_or", "(lang = ? OR lang = ?) AND NOT n_chars > ? AND quality IS NOT NULL", ["de", "fr", 2500], "(lang = 'de' OR lang = 'fr') AND NOT n_chars > 2500 AND l.quality IS NOT NULL")


# -- deletes


@query("SELECT doc_id - (SELECT count(*) FROM documents g WHERE g.lang = 'fr' AND g.doc_id < d.doc_id) AS doc_id, doc_id AS old_id FROM documents d WHERE lang <> 'fr'")
def delete_remap(spark, sf):
    docs = table(spark, sf, "documents")
    return mutate.remap(docs.select("doc_id", F.col("doc_id").alias("old_id")), docs.where("lang = 'fr'").select("doc_id"))


@query("SELECT DISTINCT doc_id FROM (SELECT vec_id - 20 AS doc_id FROM embeddings UNION ALL SELECT doc_id FROM labels) WHERE doc_id >= 0 AND doc_id < (SELECT count(*) FROM documents)")
def delete_sanitize(spark, sf):
    ids = table(spark, sf, "embeddings").select((F.col("vec_id") - 20).alias("doc_id")).unionByName(table(spark, sf, "labels").select("doc_id"))
    return mutate.sanitize(ids, table(spark, sf, "documents").count())


@query("WITH s AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM documents WHERE source <> 'src1') SELECT new_id AS doc_id, source AS document_name FROM s")
def delete_by_name(spark, sf):
    c = _chunks(spark, sf)
    return mutate.remap(c, metadata.by_name(c, "src1").select("doc_id")).select("doc_id", "document_name")


@query("SELECT count(*) AS deleted, 0::BIGINT AS remaining FROM documents")
def delete_full_wipe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    n = docs.count()
    gone = mutate.sanitize(docs, n)
    return gone.agg(F.count(F.lit(1)).alias("deleted")).select("deleted", (F.lit(n) - F.col("deleted")).alias("remaining"))


@query(f"SELECT count(*) FILTER (WHERE source = 'src1') AS deleted, greatest(sum({COUNT}) - sum({COUNT}) FILTER (WHERE source = 'src1'), 0)::BIGINT AS embeddings_left FROM documents")
def delete_accounting(spark, sf):
    c = _chunks(spark, sf)
    gone = F.when(F.col("document_name") == "src1", F.col("embedding_count"))
    return c.agg(F.count(gone).alias("deleted"), F.greatest(F.sum(F.col("embedding_count").cast("long")) - F.coalesce(F.sum(gone.cast("long")), F.lit(0)), F.lit(0)).alias("embeddings_left"))


@query("SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY page_id) - 1 AS doc_id, page_id FROM pages")
def append_ids(spark, sf):
    return mutate.append_ids(table(spark, sf, "pages").select("page_id"), table(spark, sf, "documents").count(), "page_id").select("doc_id", "page_id")


# -- display, sources, catalogue


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE text[1:200] || '...' END AS preview FROM documents")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE WHEN doc_id > 0 THEN source || ' (chunk ' || (doc_id + 1) || ')' ELSE source END AS name FROM documents")
def display_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.display_name(F.col("source"), F.col("doc_id")).alias("name"))


@query("SELECT conv_id, turn FROM conversations WHERE regexp_replace(coalesce(text, ''), '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g') <> ''")
def ingest_filter_blank(spark, sf):
    return ingest.not_blank(table(spark, sf, "conversations")).select("conv_id", "turn")


@query("SELECT TRY_CAST(trim(v) AS BIGINT) AS doc_id FROM (SELECT ' ' || vec_id || ' ' AS v FROM embeddings UNION ALL SELECT source FROM documents) WHERE regexp_full_match(trim(v), '[+-]?[0-9]+')")
def ids_file_parse(spark, sf):
    lines = table(spark, sf, "embeddings").select(F.concat(F.lit(" "), F.col("vec_id").cast("string"), F.lit(" ")).alias("value")).unionByName(table(spark, sf, "documents").select(F.col("source").alias("value")))
    return ingest.ids(lines)


@query("SELECT 0::BIGINT AS origin, item_id AS pos, regexp_replace(text, '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g') AS text FROM benchmark UNION ALL SELECT 1, doc_id, regexp_replace(text, '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g') FROM documents WHERE regexp_replace(text, '[ \\n\\t\\r]+', '', 'g') <> ''")
def files_union_inline(spark, sf):
    return ingest.inline_and_files(table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"))


CATALOG = '[{"domain": "files", "tools": [{"name": "read", "description": "Read a file", "parameters": {"properties": {"path": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["path"]}}, {"name": "list", "description": "List a folder"}, {"name": "nameless"}]}, {"tools": [{"name": "ping", "description": "Ping", "parameters": {"properties": {"host": {}}, "required": []}}]}]'


@query("SELECT * FROM (VALUES (0, 'files', 'read', 'Read a file', 'path:string,limit:integer'), (1, 'files', 'list', 'List a folder', ''), (100000, 'general', 'ping', 'Ping', 'host:any')) t(pos, domain, name, description, arguments)".replace("(0, ", "(0::BIGINT, ", 1))
def catalog_flatten(spark, sf):
    return catalog.flatten(spark.createDataFrame([(CATALOG,)], "json string"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'files', 'read,list'), (100000, 'general', 'ping')) t(position, domain, tools)")
def catalog_grouped(spark, sf):
    return catalog.grouped(catalog_flatten(spark, sf))


# -- pooling, evaluation, trained index, streams


@query("SELECT vec_id // 8 AS doc_id, CASE WHEN count(*) <= 1 OR greatest(1, (count(*) - 1) // 3) >= count(*) - 1 THEN count(*) ELSE greatest(1, (count(*) - 1) // 3) + 1 END AS n FROM embeddings GROUP BY ALL")
def pool_counts(spark, sf):
    return pooling.pool_tokens(tokens(spark, sf), 3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def pool_vectors(spark, sf):
    return pooling.pool_tokens(tokens(spark, sf), 3)


@query()
def graded_corpus_search(spark, sf):
    docs, queries = evaluate.graded_corpus()
    return score.search_exact(spark.createDataFrame(docs, "doc_id long, token_pos long, v array<double>"), spark.createDataFrame(queries, "query_id long, qtok long, v array<double>"), K)


@query()
def kmeans_search(spark, sf):
    t = tokens(spark, sf)
    k = codec.partitions_for(t.count())
    c = codec.kmeans_centroids(t, k)
    rest = checkpointed(codec.residuals(codec.assign(t, c), c))
    edges, weights = codec.cutoffs(rest, 4)
    rebuilt = codec.reconstruct(codec.codes(rest, edges), c, weights)
    p = SearchParameters(n_full_scores=4096, n_ivf_probe=k, top_k=K, centroid_score_threshold=None)
    return search.staged(rebuilt, rest, codec.inverted_lists(rest), c, query_tokens(spark, sf), p)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ingest_equivalence(spark, sf):
    """A stream of the table, appended batch by batch to a Parquet sink, is what a batch reads."""
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parquet*")
    out = _new_folder(spark)
    stream.select("event_type", "value").writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/data").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
