"""Tokens, windows and masks as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows never hold more tokens than this, whatever is asked for.
MOST_TOKENS = 180
#: Fixed value: the punctuation that a mask may skip.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokenizer(Protocol):
    def tokenize(self, text: str) -> list[str]: ...

    def detokenize(self, tokens: list[str]) -> str: ...


class WhitespaceTokenizer:
    def tokenize(self, text: str) -> list[str]:
        return text.split()

    def detokenize(self, tokens: list[str]) -> str:
        return " ".join(tokens)


def tokens(text: Column) -> Column:
    """Runs of anything but blank, tab, newline and carriage return."""
    return F.filter(F.split(text, "[ \n\t\r]+"), lambda t: t != "")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \n\t\r"))


def count_tokens(trimmed: Column) -> Column:
    """How many tokens a trimmed text has, without making them."""
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit("[ \n\t\r]+")) + 1)


def window_sizes(size: int, overlap: int) -> tuple[int, int]:
    """Effective size and step."""
    if size < 1 or overlap < 0:
        raise ValueError("a window has at least one token, an overlap at least none")
    size = min(size, MOST_TOKENS)
    return size, max(1, size - min(overlap, size - 1))


def token_windows(ids: Column, size: int, overlap: int) -> Column:
    """All windows from 0 by step; short ones at the end stay, also those that the one before covers.

    ids is a column of its own and no expression: each window reads it.
    """
    size, step = window_sizes(size, overlap)
    n = F.size(ids)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(ids, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def chunk_budget(document_length: int) -> tuple[int, int]:
    """Window size and overlap for a model's document length."""
    content = max(document_length - 2, 1)
    return content, min(64, max(content - 1, 0))


def model_tokens(ids: Column, length: int, prefix: int, pad: int, start: int = 1) -> Column:
    """Start, prefix and content, cut and padded to exactly length."""
    room = max(length - 2, 0)
    content = F.slice(ids, 1, room) if room else F.array().cast("array<bigint>")
    filled = F.concat(F.array(F.lit(start).cast("long"), F.lit(prefix).cast("long")), content, F.array_repeat(F.lit(pad).cast("long"), length))
    return F.slice(filled, 1, length)


def attention_mask(sequence: Column, pad: int, skip: Column | None, max_length: int) -> Column:
    """1 where a token is in range and no padding; from the third position on, skipped tokens are 0."""

    def bit(t: Column, i: Column) -> Column:
        on = (i < max_length) & (t != pad)
        if skip is not None:
            on = on & ~((i >= 2) & F.array_contains(skip, t))
        return F.when(on, 1).otherwise(0)

    return F.transform(sequence, bit)


def document_rows(rows: Column, mask: Column, prefix_mask_compat: bool = True) -> Column:
    """Rows whose mask is set.  In the compatible form only as many leading rows as mask bits are set are looked at, so each skipped one also costs a row at the end."""
    if prefix_mask_compat:
        n = F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x), F.lit(1))
        rows, mask = F.slice(rows, F.lit(1), n), F.slice(mask, F.lit(1), n)
    kept = F.filter(F.zip_with(rows, mask, lambda r, m: F.when(m == 1, r)), lambda r: r.isNotNull())
    return kept


def query_rows(rows: Column, length: int, zero: Column) -> Column:
    """Cut or padded with zero rows to length."""
    return F.slice(F.concat(rows, F.array_repeat(zero, length)), 1, length)


def hash_id(token: Column) -> Column:
    """Token id: the first four hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("long")


#: Abbreviations that end no sentence, and those that end one unless a lower-case letter follows.
ABBREVIATIONS = "dr mr mrs ms prof sr jr st vs e.g i.e co corp no fig vol al approx dept est".split()
ENDING_ABBREVIATIONS = "a.m p.m etc inc ltd u.s u.k".split()
#: Marks of a sentence's end and of an end that is none; they are dropped from texts that hold them.
_END, _NONE = "\u0001", "\u0002"
_LEAD = "(?:^|[ \\n\\t\\r(\"'\\[])"


def any_of(words: list[str]) -> str:
    return "(?i:" + "|".join(w.replace(".", "\\.") for w in words) + ")"


#: A full stop that ends no sentence: it is looked at from behind, as there are few of them, and an end with its closing marks.
_NO_END = f"\\.(?:(?<={_LEAD}{any_of(ABBREVIATIONS)}\\.)|(?<={_LEAD}{any_of(ENDING_ABBREVIATIONS)}\\.)(?=[ \\n\\t\\r]+\\p{{Ll}})|(?<={_LEAD}\\p{{Lu}}\\.))"
_AN_END = "([.!?]+[\"')\\]]*)[ \\n\\t\\r]+"


def sentences(text: Column) -> Column:
    """Sentences by closing punctuation before white space, but not after abbreviations and initials; trimmed, without empty ones."""
    # sentences of a trimmed text are trimmed: white space after an end goes, and there is none before it
    text = trim(F.translate(text, _END + _NONE, ""))
    text = F.regexp_replace(text, F.lit(_NO_END), F.lit("." + _NONE))
    text = F.regexp_replace(text, F.lit(_AN_END), F.lit("$1" + _END))
    return F.array_remove(F.split(F.translate(text, _NONE, ""), _END), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def packed_ranges(counts: Column, size: int, overlap: int) -> Column:
    """Which items each chunk of greedy packing takes: structs of first, end (exclusive) and alone, in order.

    Items are taken while their counts fit in size; a chunk begins with the last items before it that fit in overlap, and
    its first new item is added whatever it makes.  An item over size is alone, without overlap on either side.

    Where the chunk ends that a new item i opens depends on i alone: an array from token places to items gives it without
    search.  From these next pointers, doubled as long as there are items, come the items that open chunks.
    """
    gap = size + overlap + 1  # what an item over size takes, so that neither a chunk nor an overlap reaches over it

    def with_places(weights: Column) -> Column:
        of = F.flatten(F.transform(weights, lambda w, i: F.array_repeat(i, w)))
        return let(F.concat(of, F.array(F.size(weights))), lambda item: with_starts(weights, item))

    def with_starts(weights: Column, item: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(item) - 1), lambda t: (t == 0) | (F.get(item, t) != F.get(item, t - 1)))
        return let(starts, lambda begin: with_pointers(weights, item, begin))

    def with_pointers(weights: Column, item: Column, begin: Column) -> Column:
        def first(i: Column) -> Column:
            at = F.greatest(F.get(begin, i) - overlap, F.lit(0))
            return F.when(F.get(weights, i) > size, i).otherwise(F.get(item, at) + F.when(F.get(begin, F.get(item, at)) == at, 0).otherwise(1))

        def end(i: Column) -> Column:
            return F.greatest(F.get(item, F.least(F.get(begin, first(i)) + size, F.size(item) - 1)), i + 1)

        n = F.size(weights)
        following = F.concat(F.transform(F.sequence(F.lit(0), n - 1), end), F.array(n))

        def chain(state: Column, _: Column) -> Column:
            met, hop = state["met"], state["hop"]
            return F.struct(F.array_distinct(F.concat(met, F.transform(met, lambda i: F.get(hop, i)))).alias("met"), F.transform(hop, lambda i: F.get(hop, i)).alias("hop"))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
        start = F.struct(F.array(F.lit(0)).alias("met"), following.alias("hop"))
        opened = F.array_sort(F.filter(F.aggregate(rounds, start, chain)["met"], lambda i: i < n))
        return F.transform(opened, lambda i: F.struct(first(i).alias("first"), end(i).alias("end"), (F.get(weights, i) > size).alias("alone")))

    weights = F.transform(counts, lambda c: F.when(c > size, gap).otherwise(c))
    return F.when(F.size(counts) > 0, let(weights, with_places)).otherwise(F.array().cast("array<struct<first:int,end:int,alone:boolean>>"))
