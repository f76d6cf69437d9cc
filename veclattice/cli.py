"""Command line: demo, update, delete, remap-test, tokenize, similarity.

python -m veclattice.cli <command> --help
"""

from __future__ import annotations

import argparse
import os
import secrets
import sys
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EmptyInput, EngineError
from .functions import text as X
from .operators import encode, metadata
from .operators.segments import SegmentIndex
from .operators.mutate import append_ids
from .plans import params
from .schema import IndexConfig, resolve_model
from .session import session
from .sources import ingest

#: Environment variable that names the folder of indexes; else .veclattice here.
FOLDER = "VECLATTICE_INDEX_DIR"


def index_path(name: str | None) -> str:
    root = os.environ.get(FOLDER) or os.path.join(os.getcwd(), ".veclattice")
    return os.path.join(root, name or f"index-{secrets.token_hex(4)}")


def _texts(spark: SparkSession, docs: list[str], files: list[str], strict: bool) -> DataFrame:
    """doc_id and chunk_text: inline texts first, then files; blank ones are left out, missing files are an error if strict."""
    inline = spark.createDataFrame(list(enumerate(docs)), "pos long, text string")
    rows = []
    for k, path in enumerate(files):
        if not os.path.isfile(path):
            if strict:
                raise EngineError(f"no file {path}")
            print(f"skipped: no file {path}", file=sys.stderr)
            continue
        with open(path, encoding="utf-8", errors="replace") as f:
            rows.append((k, f.read()))
    read = spark.createDataFrame(rows, "pos long, text string")
    both = ingest.inline_and_files(inline, read).withColumn("key", F.format_string("%d-%012d", "origin", "pos"))
    return append_ids(both, 0, "key").select("doc_id", F.col("text").alias("chunk_text"))


def _encoder(model: str) -> encode.Encoder:
    resolve_model(model)  # neural encoders plug in here; offline there is the hash encoder
    return encode.HashEncoder()


def _query(spark: SparkSession, text: str, encoder: encode.Encoder, length: int) -> DataFrame:
    m = encode.encode_query(text, encoder, length)
    return spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(m)], "query_id long, qtok int, v array<double>")


def _show(index: SegmentIndex, hits: DataFrame) -> None:
    chunks = index.chunks()
    rows = metadata.enrich(hits, chunks).orderBy("rank").collect() if chunks is not None else hits.orderBy("rank").collect()
    for r in rows:
        print(f"{r['rank']}. [{r['doc_id']}] {r['score']:.4f} " + (r["preview"].replace("\n", " ") if chunks is not None else ""))


def demo(spark: SparkSession, a) -> int:
    _, config = resolve_model(a.model)
    encoder = _encoder(a.model)
    path = index_path(a.index_name)
    if a.existing:
        index = SegmentIndex.open(spark, path, a.model)
        p = params.for_existing_index(index.num_documents, a.top_k, index.meta["num_partitions"])
    else:
        docs = _texts(spark, a.docs, a.files, True).cache()
        if docs.isEmpty():
            raise EmptyInput("no text to index")
        chunks = docs.select("doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("document_name"), "chunk_text")
        index = SegmentIndex.create(spark, path, encode.encode_documents(docs, encoder), IndexConfig(nbits=a.nbits, seed=a.seed), chunks, a.model)
        p = params.for_new_index(index.num_documents, a.top_k, a.nbits)
    print(f"{path}: {index.num_documents} documents, {index.num_embeddings} embeddings of {index.dim} dimensions")
    if a.query:
        _show(index, index.search(_query(spark, a.query, encoder, config.query_length), p))
    if not a.existing and not a.keep and a.index_name is None:
        SegmentIndex.drop(spark, path)
    return 0


def update(spark: SparkSession, a) -> int:
    index = SegmentIndex.open(spark, index_path(a.index_name), a.model)
    docs = _texts(spark, a.docs, a.files, False).cache()
    chunks = docs.select("doc_id", F.concat(F.lit("document "), (F.col("doc_id") + index.num_documents).cast("string")).alias("document_name"), "chunk_text")
    _, ids = index.append(encode.encode_documents(docs, _encoder(a.model)), chunks)
    print(f"added {ids[0]} to {ids[-1]}" if ids else "nothing to add")
    return 0


def delete(spark: SparkSession, a) -> int:
    index = SegmentIndex.open(spark, index_path(a.index_name))
    ids = spark.createDataFrame([(i,) for i in a.doc_ids], "doc_id long")
    if a.ids_file:
        ids = ids.unionByName(ingest.ids_file(spark, a.ids_file))
    _, gone = index.delete(ids.distinct())
    print("deleted " + (", ".join(str(r[0]) for r in gone.orderBy("doc_id").collect()) or "nothing"))
    return 0


def remap_test(spark: SparkSession, a) -> int:
    """One-hot documents: append, delete in the middle, delete at the end."""
    from .schema import SearchParameters

    def tokens(axes):
        return spark.createDataFrame([(i, t, np.eye(16)[x].tolist()) for i, x in enumerate(axes) for t in range(4)], "doc_id long, token_pos int, v array<double>")

    def best(axis):
        q = spark.createDataFrame([(0, 0, np.eye(16)[axis].tolist())], "query_id long, qtok int, v array<double>")
        return index.search(q, SearchParameters(n_ivf_probe=1024, centroid_score_threshold=None, top_k=1)).first()["doc_id"]

    with tempfile.TemporaryDirectory() as folder:
        index = SegmentIndex.create(spark, os.path.join(folder, "i"), tokens(range(5)), IndexConfig(nbits=4, centroids="deterministic"))
        index, ids = index.append(tokens([5, 6]))
        checks = [ids == [5, 6]]
        index, _ = index.delete([2])
        checks += [best(3) == 2, best(4) == 3, best(6) == 5]
        index, _ = index.delete([5])
        checks += [best(3) == 2, best(5) == 4]
    print("ok" if all(checks) else f"failed: {checks}")
    return 0 if all(checks) else 1


def tokenize(spark: SparkSession, a) -> int:
    _, config = resolve_model(a.model)
    row = spark.createDataFrame([(a.text,)], "text string").select(X.tokens(F.col("text")).alias("t"))
    ids = F.transform("t", X.hash_id)
    length = config.query_length if a.query else config.document_length
    out = row.select("t", ids.alias("ids"), X.model_tokens(ids, length, 1 if a.query else 2, 0).alias("sequence")).first()
    print("tokens:", " ".join(out["t"]))
    print("ids:", *out["ids"])
    print("sequence:", *out["sequence"])
    return 0


def similarity(spark: SparkSession, a) -> int:
    encoder = _encoder(a.model)
    docs = spark.createDataFrame([(0, a.document)], "doc_id long, text string")
    row = encode.score_texts(docs, [(0, a.query)], encoder).first()
    if row is None:
        raise EmptyInput("the query and the document need a token each")
    print(f"{row['score']:.4f}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veclattice")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *names):
        c = sub.add_parser(name, aliases=list(names))
        c.set_defaults(run=run)
        c.add_argument("--model", default="mxbai")
        return c

    c = add("demo", demo, "index-and-search")
    c.add_argument("--docs", nargs="*", default=[])
    c.add_argument("--files", nargs="*", default=[])
    c.add_argument("--query")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--nbits", type=int, default=2)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--index-name")
    c.add_argument("--existing", action="store_true")
    c.add_argument("--keep", action="store_true")
    c = add("update", update)
    c.add_argument("--index-name", required=True)
    c.add_argument("--docs", nargs="*", default=[])
    c.add_argument("--files", nargs="*", default=[])
    c = add("delete", delete)
    c.add_argument("--index-name", required=True)
    c.add_argument("--doc-ids", nargs="*", type=int, default=[])
    c.add_argument("--ids-file")
    add("remap-test", remap_test)
    c = add("tokenize", tokenize)
    c.add_argument("text")
    c.add_argument("--query", action="store_true")
    c = add("similarity", similarity)
    c.add_argument("query")
    c.add_argument("document")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or session("local[*]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    try:
        return a.run(spark, a)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
