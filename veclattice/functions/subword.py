"""Sub-word tokens by longest match over the trie of a vocabulary file.

A word is taken with a mark before it; at each place the longest piece of the
vocabulary is a token, and a character that begins no piece is one by itself
with the id of unknown ones.  Words are matched once for each batch, however
often they occur.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

#: What stands before a word, and the id of characters that no piece begins with.
MARK, UNKNOWN = "▁", 0
#: Characters of a vocabulary that may travel with a function.
MOST = 50_000_000


class SubwordTokenizer:
    """Tokens and ids of texts; `detokenize` gives the words back, one blank between them."""

    def __init__(self, vocabulary: dict[str, int]):
        if not vocabulary or "" in vocabulary or UNKNOWN in vocabulary.values():
            raise EngineError("a vocabulary has pieces, none of them empty and none with the id of unknown characters")
        if sum(map(len, vocabulary)) > MOST:
            raise EngineError("the vocabulary is too large to travel")
        self.vocabulary = vocabulary
        self.root: dict = {}
        for piece, i in vocabulary.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubwordTokenizer:
        """From a file or folder that Spark reads: a JSON object of pieces and ids, or a piece a line, numbered from 1."""
        lines = [r[0] for r in spark.read.text(path, wholetext=False).collect()]  # bounded by MOST when it is taken up
        if lines and lines[0].lstrip().startswith("{"):
            return cls({k: int(v) for k, v in json.loads("\n".join(lines)).items()})
        return cls({piece: i for i, piece in enumerate(lines, 1)})

    def match(self, word: str) -> list[tuple[str, int]]:
        """Pieces of a marked word with their ids, by longest match."""
        out, at = [], 0
        while at < len(word):
            node, end, found = self.root, at + 1, UNKNOWN
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    end, found = k + 1, node[""]
            out.append((word[at:end], found))
            at = end
        return out

    def _words(self, text: str) -> list[str]:
        return [MARK + w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]

    def tokenize(self, text: str) -> list[str]:
        return [piece for w in self._words(text) for piece, _ in self.match(w)]

    def ids(self, text: str) -> list[int]:
        return [i for w in self._words(text) for _, i in self.match(w)]

    def detokenize(self, tokens: list[str]) -> str:
        return "".join(tokens).replace(MARK, " ").removeprefix(" ")

    def column(self, text: Column) -> Column:
        """Ids of a text column, in Arrow batches; null texts have none."""

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                known: dict[str, list[int]] = {}
                out = []
                for t in column.to_pylist():
                    ids: list[int] = []
                    for w in self._words(t or ""):
                        if w not in known:
                            known[w] = [i for _, i in self.match(w)]
                        ids += known[w]
                    out.append(ids)
                yield pa.array(out, pa.list_(pa.int64()))

        run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<bigint>")(text)


def pieces_of(words: DataFrame, longest: int) -> DataFrame:
    """Distinct pieces of up to `longest` characters of words(word), marked: a vocabulary without a fit."""
    marked = words.select(F.concat(F.lit(MARK), "word").alias("w")).distinct()
    starts = marked.select("w", F.explode(F.expr("sequence(1, length(w))")).alias("i"))
    parts = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substring("w", F.col("i"), n))).alias("piece"))
    return parts.distinct()
