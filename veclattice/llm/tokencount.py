"""Token counts of whole texts by a public tokenizer's vocabulary file.

Texts go through an Arrow function that returns lengths only.  They are cut at
safe boundaries, which are those that no token of the tokenizer spans, so the
tokens of the pieces are those of the whole: before a blank, tab or line break
that follows anything but white space, and, in pieces of more than PIECE
characters, between an ASCII letter and digit.  Pieces of many texts are
encoded together in batches of about BATCH bytes, whatever the texts' lengths;
short pieces are remembered while there are not more than REMEMBERED, so a
word is encoded once for many places.  What cannot be cut (a run of one class
of characters, any text of a tokenizer whose boundaries are not known to be
safe) is encoded in one.

Nothing is shuffled and each row depends on its text alone, so a lost executor
costs its own batches only.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
give a row each; an empty table gives an empty one; other columns are kept,
except that columns named like the new ones are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch, characters above which a piece is cut at digits, and pieces that are remembered, with their longest length.
BATCH, PIECE, REMEMBERED, SHORT = 262_144, 65_536, 400_000, 48
#: More tokens than a context of this size are over the limit.
LIMIT = 1024

_SPACED = re.compile(r"\s ")
_BLANK = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_DIGIT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) splits words before its merges, so that no token spans a safe boundary.

    Known are byte-level splitting without a prefixed blank, and splits that drop what lies between words; added tokens
    must be plain strings without a boundary inside.
    """
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    words = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer")
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s|[0-9]", t["content"])) for t in spec.get("added_tokens", []))
    return bool((words or dropped) and plain)


def pieces(text: str) -> list[str]:
    """text in pieces that end at safe boundaries; joined they are the text."""
    if _SPACED.search(text):
        parts = _BLANK.split(text)
    else:
        first, *rest = text.split(" ")
        parts = [first, *map(" ".__add__, rest)]
    if len(text) > PIECE and max(map(len, parts)) > PIECE:
        parts = [q for p in parts for q in (_DIGIT.split(p) if len(p) > PIECE else [p])]
    return parts


def batches(texts: Iterator[str]) -> Iterator[list[str]]:
    """texts in lists of about BATCH bytes; a longer text is alone."""
    batch, n = [], 0
    for t in texts:
        size = len(t.encode())
        if batch and n + size > BATCH:
            yield batch
            batch, n = [], 0
        batch.append(t)
        n += size
    if batch:
        yield batch


def encoder(data: bytes, kind: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to their numbers of tokens, and whether texts may be cut."""
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(data)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)], cuttable(json.loads(data))


class Counter:
    """Numbers of tokens of texts, with the pieces that are remembered: those met of late, and those before them."""

    def __init__(self, data: bytes, kind: str):
        self.lengths, self.cut = encoder(data, kind)
        self.late: dict[str, int] = {}
        self.earlier: dict[str, int] = {}

    def _at_hand(self, wanted: set[str]) -> dict[str, int]:
        """The counts of all wanted pieces; what is short is remembered, and what was met long ago forgotten."""
        out = {p: self.late[p] for p in wanted & self.late.keys()}
        fresh = {p: self.earlier[p] for p in (wanted - out.keys()) & self.earlier.keys()}
        out.update(fresh)
        for batch in batches(p for p in wanted if p not in out):
            new = dict(zip(batch, self.lengths(batch), strict=True))
            out.update(new)
            fresh.update((p, n) for p, n in new.items() if len(p) <= SHORT)
        if len(self.late) + len(fresh) > REMEMBERED // 2:
            self.earlier, self.late = self.late, {}
        if len(fresh) <= REMEMBERED // 2:
            self.late.update(fresh)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return [n for batch in batches(iter(texts)) for n in self.lengths(batch)]
        parts = [pieces(t) for t in texts]
        at_hand = self._at_hand(set().union(*parts))
        return [sum(map(at_hand.__getitem__, p)) for p in parts]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`).

    The file (a few megabytes) is read once, on the driver, and travels with the function.
    """
    path = vocabulary(tokenizer)
    with open(path, "rb") as f:
        data = f.read()
    kind = os.path.splitext(path)[1]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(data, kind)
        for column in columns:
            ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())).to_numpy(zero_copy_only=False)
            out, i = [], 0
            while i < len(column):
                # rows up to the next BATCH bytes, one at least
                before = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(ends.searchsorted(before + BATCH, "right")))
                out += counter.counts([t or "" for t in column.slice(i, j - i).to_pylist()])
                i = j
            yield pa.array(out, pa.int64())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    count = F.arrow_udf(run, "long")
    body = F.coalesce(F.col(text), F.lit(""))
    new = {"n_bytes": F.octet_length(body).cast("long"), "n_tokens": count(body)}
    return docs.withColumns(new).withColumn("over_limit", F.col("n_tokens") > limit)
