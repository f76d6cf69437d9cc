"""Main text of web pages by a host suffix array.

Pages are parsed into blocks of text with the place of each: inside the
article, inside a container that is never article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, comments), or elsewhere, and with
its kind, the path of elements and classes that leads to it.  The word streams
of a host's pages in a task are concatenated and sorted into a suffix array
(by prefix doubling, to the depth of the shortest run of interest: a longer
run is shared by pages just where all of its shortest runs are).  Neighbours
in the array are the runs that pages share; each task sends the code of a run
once, with its pages, and pages are counted over the whole host, so neither
tasks nor the size of a host change a text.

A run is boilerplate if most of its places lie in such containers or if enough
pages of the host share it.  Pages of equal text count once, and a page counts
only if it has DEPTH words on end that no such run covers: pages that differ
in scattered words are copies of each other, and what only copies share stays.

On pages that mark no article, blocks in such containers or wholly covered by
boilerplate runs go, all others stay.  What a page marks as its article stays,
without such containers and without blocks of a kind that is boilerplate on
the host: NEARLY all words of its blocks lie in runs that enough pages share.
A sentence of an article that other articles repeat stays, as its kind has
other words; the page's blocks outside of the article go.

Runs are told apart by 64-bit codes of host and words: a first pass finds the
codes that may repeat, a second counts those exactly over the host, and the
list goes to a pass over the pages.  A list too long to be sent to all tasks
meets the pages by host, which are then dealt over shards of bounded size by a
hash of the page, so a host may hold any share of the input.

Defined results: null and empty html give the empty string; a null url or one
without `://` has the host ""; repeated rows each get their row; a page larger
than a shard is a shard's only large page, never cut; columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .textcodes import U64, chunks, mix, tidied, windows, words

#: Names of HTML elements, and words in class, id and role that name such containers.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
OUTSIDE = frozenset("head nav footer aside form button select dialog menu object svg math canvas audio video".split())
ARTICLE = frozenset("article main".split())
_ANYWHERE = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|respond|disqus|replies|related|recommended|share|sharing|social|breadcrumbs?|menu|navbar|nav|navigation|topbar|footer|widget|pagination|pager|search|skip-link|toolbar|complementary|contentinfo"
NAMES = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE}|header|site-header|masthead)(?=$|[\s_-])", re.I)
#: Inside an article a header is the article's own.
NAMES_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE})(?=$|[\s_-])", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|page|main)[_-]?(?:content|body|text)|articlebody)(?=$|\s)", re.I)
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z", re.S)
_DIGITS = re.compile(r"\d+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Words of the shortest run (a power of two), least pages that share a run, their least share of a host's pages, and so many are always enough.
DEPTH, LEAST_PAGES, LEAST_SHARE, ENOUGH_PAGES = 8, 3, 0.01, 100
#: Share of the words of a kind of block in an article that repeated runs must cover.
NEARLY = 0.9
SHARD_BYTES = 1 << 20
BROADCAST_HOSTS = 50_000
#: Codes of boilerplate that are broadcast; a longer list meets the shards in a cogroup.
BROADCAST_CODES = 4_000_000
#: Bits of the filter of codes that may repeat, as powers of two: one for a word of the input within these (a full filter only lets more through); codes of a range when it is made.
LEAST_FILTER, MOST_FILTER, RANGE_CODES = 20, 28, 1 << 22

IN_ARTICLE, NEUTRAL, BOILERPLATE = 0, 1, 2


class Page(NamedTuple):
    """The blocks of a page, and the place and kind of each."""

    blocks: list[str]
    places: list[int]
    kinds: list[str]


def parse(html: str | None) -> Page:
    blocks: list[str] = []
    places: list[int] = []
    kinds: list[str] = []
    if not html:
        return Page(blocks, places, kinds)
    text: list[str] = []
    stack: list[tuple[str, int, str]] = []  # open elements, the place inside them and their path
    place = NEUTRAL

    def close() -> None:
        words = entities.unescape("".join(text)).split()
        text.clear()
        if words:
            blocks.append(" ".join(words))
            places.append(place)
            kinds.append(stack[-1][2] if stack else "")

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                text.append(entities.unescape(m.group()[9:-3]).replace("&", "&amp;"))
            continue
        ends = m.group(1) or m.group(4)
        if name in INLINE:
            continue
        close()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    place = stack[-1][1] if stack else NEUTRAL
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(html, at)
            at = n if end is None else end.start()
            continue
        if name == "body":
            stack, place = [], NEUTRAL
        if name in VOID or (m.group(3) or m.group(6) or "").endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            place = stack[-1][1] if stack else NEUTRAL
        inside, label = place, name
        if place != BOILERPLATE:
            more = m.group(3) or m.group(6)
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(more)} if more else {}
            named = " ".join(attributes.get(k, "") for k in ("class", "id", "role")) if attributes else ""
            if name in OUTSIDE or (name == "header" and place != IN_ARTICLE) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
                inside = BOILERPLATE
            elif name in ARTICLE or attributes.get("role") == "main" or attributes.get("itemprop", "").lower() == "articlebody":
                inside = BOILERPLATE if NAMES.search(named) and name != "main" else IN_ARTICLE
            elif named and name not in ("html", "body") and (NAMES_INSIDE if place == IN_ARTICLE else NAMES).search(named):
                inside = BOILERPLATE
            elif named and name in ("div", "section", "td") and ARTICLE_NAMES.search(named):
                inside = IN_ARTICLE
            if attributes.get("class"):
                label = f"{name}.{_DIGITS.sub('0', attributes['class'])}"
        stack.append((name, inside, f"{stack[-1][2] if stack else ''}/{label}"))
        place = inside
    close()
    return Page(blocks, places, kinds)


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` tokens (a power of two); equal ranks share them."""
    rank, k = tokens, 1
    while k < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
        k *= 2
    return rank


class Runs(NamedTuple):
    """Places of all runs of DEPTH words inside one page, by page and word."""

    code: np.ndarray
    page: np.ndarray
    word: np.ndarray  # first word, counted in its page
    place: np.ndarray  # of the first word
    words: np.ndarray  # of each page
    token: np.ndarray  # code of each word, page after page


def _salt(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest())


def runs(pages: list[Page], hosts: list[str]) -> Runs:
    texts = pa.array(["\n".join(p.blocks) for p in pages], pa.large_string())
    salt = {h: _salt(h) for h in set(hosts)}
    salts = np.array([salt[h] for h in hosts], dtype=U64)
    places = [np.repeat(np.array(p.places, dtype=np.int64), [b.count(" ") + 1 for b in p.blocks]) for p in pages]
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for i, j in chunks(texts):
        w = words(texts, i, j)
        start, code = windows(w, DEPTH)
        page = w.doc()[start]
        place = np.concatenate([*places[i:j], np.zeros(0, dtype=np.int64)])
        for x, y in zip(out, (mix(code ^ salts[i + page]), i + page, start - w.first[page], place[start], np.diff(w.first), w.code ^ salts[i + w.doc()]), strict=True):
            x.append(y)
    types = (U64, np.int64, np.int64, np.int64, np.int64, U64)
    return Runs(*[np.concatenate([*x, np.zeros(0, dtype=k)]) for x, k in zip(out, types, strict=True)])


def text_key(host: str, blocks: list[str]) -> int:
    """Equal for pages of one host and equal text."""
    return int.from_bytes(hashlib.blake2b("\n".join([host, *blocks]).encode(), digest_size=8).digest(), signed=True)


def kind_codes(host: str, page: Page) -> list[int]:
    """A code of host and kind for each block."""
    known: dict[str, int] = {}
    for k in page.kinds:
        if k not in known:
            known[k] = _salt(f"{host} {k}")
    return [known[k] for k in page.kinds]


def least_pages(n: int) -> float:
    """How many of a host's n pages make a run boilerplate."""
    return max(LEAST_PAGES, min(ENOUGH_PAGES, LEAST_SHARE * n))


def suffix_groups(r: Runs) -> np.ndarray:
    """A number for each run, the same for equal ones, from the suffix array of the pages' streams."""
    if not len(r.code):
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(r.words) - r.words
    ranks = suffix_ranks(np.unique(r.token, return_inverse=True)[1], DEPTH)
    return np.unique(ranks[first[r.page] + r.word], return_inverse=True)[1]


def covered(r: Runs, some: np.ndarray) -> np.ndarray:
    """Whether each word, page after page, lies in one of some runs."""
    first = np.cumsum(r.words) - r.words
    at = (first[r.page] + r.word)[some]
    edge = np.zeros(int(r.words.sum()) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + DEPTH, -1)
    return np.cumsum(edge[:-1]) > 0


def boilerplate(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs that are boilerplate and of the kinds that are so in articles, from all pages of one host."""
    pages = list({text_key("", p.blocks): p for p in reversed(pages)}.values())
    r = runs(pages, [""] * len(pages))
    g = suffix_groups(r)
    n, least = int(g.max(initial=-1)) + 1, least_pages(len(pages))

    def count(on: np.ndarray) -> np.ndarray:
        return np.bincount(np.unique(g[on] * (len(pages) + 1) + r.page[on]) // (len(pages) + 1), minlength=n)

    n_pages = count(np.ones(len(g), dtype=bool))
    outside = np.bincount(g, weights=r.place == BOILERPLATE, minlength=n)
    mostly = (n_pages >= 2) & (2 * outside > np.bincount(g, minlength=n))
    ends = np.cumsum(r.words)[:-1]
    free = np.split(~covered(r, (n_pages >= least)[g]), ends)
    shared = np.bincount(r.page, weights=(n_pages >= least)[g], minlength=len(pages)) > 0
    own = np.array([longest(x) >= DEPTH for x in free], dtype=bool)
    often = count(own[r.page]) >= least
    words_of: dict[int, int] = {}
    covered_of: dict[int, int] = {}
    pages_of: dict[int, int] = {}
    for p, page, on in zip(range(len(pages)), pages, np.split(covered(r, (often[g] & own[r.page])), ends), strict=True):
        if shared[p] and not own[p]:
            continue
        at, seen = 0, set()
        for text, place, kind in zip(page.blocks, page.places, kind_codes("", page), strict=True):
            size = text.count(" ") + 1
            if place == IN_ARTICLE:
                words_of[kind] = words_of.get(kind, 0) + size
                covered_of[kind] = covered_of.get(kind, 0) + int(on[at : at + size].sum())
                seen.add(kind)
            at += size
        for kind in seen:
            pages_of[kind] = pages_of.get(kind, 0) + 1
    kinds = [k for k, x in words_of.items() if pages_of[k] >= least and covered_of[k] >= NEARLY * x]
    return np.unique(r.code[(mostly | often)[g]]), np.sort(np.array(kinds, dtype=U64))


def longest(on: np.ndarray) -> int:
    """The most true values on end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def _among(codes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(codes), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, codes), len(listed) - 1)] == codes


def judge(pages: list[Page], hosts: list[str] | None = None, listed: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """Main text of each page; without the sorted codes of boilerplate runs and kinds the pages are all those of one host."""
    if listed is None or hosts is None:
        hosts, listed = [""] * len(pages), boilerplate(pages)
    out: list[str] = [""] * len(pages)
    open_ = [p for p, page in enumerate(pages) if IN_ARTICLE not in page.places]
    for p, page in enumerate(pages):
        codes = np.array(kind_codes(hosts[p], page) if len(listed[1]) else [0] * len(page.blocks), dtype=U64)
        keep = (np.array(page.places, dtype=np.int64) == IN_ARTICLE) & ~_among(codes, listed[1])
        out[p] = "\n".join(b for b, k in zip(page.blocks, keep.tolist(), strict=True) if k)
    # pages that mark no article
    r = runs([pages[p] for p in open_], [hosts[p] for p in open_])
    gone = np.split(covered(r, _among(r.code, listed[0])), np.cumsum(r.words)[:-1])
    for p, on in zip(open_, gone, strict=False):
        at, kept = 0, []
        for text, place in zip(pages[p].blocks, pages[p].places, strict=True):
            size = text.count(" ") + 1
            if place != BOILERPLATE and not on[at : at + size].all():
                kept.append(text)
            at += size
        out[p] = "\n".join(kept)
    return out


def _pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[Page]]]:
    """Hosts and parsed pages of (host, html), a bounded number at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            yield part.column(0).to_pylist(), [parse(x) for x in part.column(1).to_pylist()]


@tidied
def _ranges(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The sorted codes of pages, cut into 2**bits ranges and packed as differences.

    Only runs on LEAST_PAGES pages, or on two of which one has it in a container
    that is never article, can be boilerplate: such a place counts as pages more.
    """
    pack = zstandard.ZstdCompressor(level=1)

    def packed(codes: list[np.ndarray]) -> pa.RecordBatch:
        c = np.sort(np.concatenate(codes))
        k = LEAST_PAGES  # no more are of use
        c = c[np.concatenate([np.ones(k, dtype=bool), c[k:] != c[:-k]])] if len(c) > k else c
        name = (c >> U64(64 - bits)).astype(np.int64)
        low = ((c >> U64(32 - bits)) & U64(0xFFFFFFFF)).astype("<u4")
        names, at = np.unique(name, return_index=True)
        bodies = [pack.compress(np.diff(x, prepend=x[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for x in np.split(low, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], ["name", "body"])

    held: list[np.ndarray] = []
    size = 0
    for hosts, pages in _pages_of(batches):
        r = runs(pages, hosts)
        g = suffix_groups(r)
        # of each run its pages, and whether it is in a container
        count = np.bincount(np.unique(g * (len(pages) + 1) + r.page) // (len(pages) + 1), minlength=1)
        in_container = np.bincount(g, weights=r.place == BOILERPLATE, minlength=1) > 0
        group, first = np.unique(g, return_index=True)
        weight = np.minimum(count[group] + in_container[group] * (LEAST_PAGES - 2), LEAST_PAGES)
        held.append(np.repeat(r.code[first], weight))
        size += len(held[-1])
        if size >= RANGE_CODES:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)


@tidied
def _repeated(batches: Iterator[pa.RecordBatch], bits: int, size: int) -> Iterator[pa.RecordBatch]:
    """Each range's part of the filter: which of its codes can be boilerplate."""
    pack, opened = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            d = np.frombuffer(opened.decompress(body), dtype=np.uint8).reshape(4, -1).T
            found.setdefault(name, []).append(np.cumsum(np.ascontiguousarray(d).view("<u4").ravel(), dtype=np.uint32))
    for name in list(found):
        low = np.sort(np.concatenate(found.pop(name)))
        often = low[LEAST_PAGES - 1 :][low[LEAST_PAGES - 1 :] == low[: len(low) - LEAST_PAGES + 1]]
        on = np.zeros(1 << (size - bits), dtype=bool)
        on[often >> np.uint32(32 - size + bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([pack.compress(np.packbits(on).tobytes())], pa.binary())], ["name", "body"])


@tidied
def _candidates(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """Of each page the runs that the filter lets through: the code of each with its places, those in containers and its starts."""
    bits = wanted.value
    size = (8 * len(bits)).bit_length() - 1
    for hosts, pages in _pages_of(batches):
        r = runs(pages, hosts)
        cell = (r.code >> U64(64 - size)).astype(np.int64)
        on = np.flatnonzero(bits[cell >> 3] >> (7 - (cell & 7)) & 1)
        on = on[np.lexsort((r.word[on], r.code[on], r.page[on]))]
        page, code = r.page[on], r.code[on]
        new = np.ones(len(on), dtype=bool)
        new[1:] = (page[1:] != page[:-1]) | (code[1:] != code[:-1])
        first = np.append(np.flatnonzero(new), len(on))
        outside = np.add.reduceat(r.place[on] == BOILERPLATE, first[:-1], dtype=np.int32) if len(on) else np.zeros(0, dtype=np.int32)
        edge = pa.array(np.searchsorted(page[new], np.arange(len(pages) + 1)), pa.int32())
        starts = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(r.word[on].astype(np.int32)))
        fields = [pa.array(code[new].view(np.int64)), pa.array(np.diff(first).astype(np.int32)), pa.array(outside), starts]
        found = pa.ListArray.from_arrays(edge, pa.StructArray.from_arrays(fields, ["code", "places", "outside", "at"]))
        keys = pa.array([text_key(h, p.blocks) for h, p in zip(hosts, pages, strict=True)], pa.int64())
        parts = [_parts(h, p) for h, p in zip(hosts, pages, strict=True)]
        three = [pa.array([x[k] for x in parts], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), keys, pa.array(r.words, pa.int64()), found, *three], ["host", "text", "words", "found", "first", "size", "kind"])


def _parts(host: str, page: Page) -> tuple[list[int], list[int], list[int]]:
    """First word, words and kind of each stretch of one kind in the article."""
    first, size, kind = [], [], []
    at = 0
    for text, place, k in zip(page.blocks, page.places, np.array(kind_codes(host, page), dtype=U64).view(np.int64).tolist(), strict=True):
        n = text.count(" ") + 1
        if place == IN_ARTICLE:
            if kind and kind[-1] == k and first[-1] + size[-1] == at:
                size[-1] += n
            else:
                first.append(at), size.append(n), kind.append(k)
        at += n
    return first, size, kind


@tidied
def _coverage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hid, least, kind, words, covered and pages of pages with the starts of their boilerplate runs."""
    for batch in batches:
        sums: dict[tuple[int, float, int], list[int]] = {}
        for hid, least, words_, at, *parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            edge = np.zeros(words_ + DEPTH + 1, dtype=np.int64)
            at = np.unique(np.array(at or [], dtype=np.int64))
            edge[at] += 1
            edge[at + DEPTH] -= 1
            on = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
            seen = set()
            for first, size, kind in zip(*parts, strict=True):
                x = sums.setdefault((hid, least, kind), [0, 0, 0])
                x[0] += size
                x[1] += int(on[first + size] - on[first])
                x[2] += kind not in seen
                seen.add(kind)
        yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in sums], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], *[pa.array([x[i] for x in sums.values()], pa.int64()) for i in range(3)]], ["hid", "least", "kind", "words", "covered", "pages"])


def _listed(pages: DataFrame) -> DataFrame:
    """hid (a hash of the host), code, neutral and inside: the runs that are boilerplate (neutral) and the kinds that are so in articles (inside), from (host, html)."""
    spark = pages.sparkSession
    (total,) = pages.agg(F.sum(F.octet_length("html"))).first()
    bits = int(np.clip(np.ceil(np.log2((total or 0) / 6 / RANGE_CODES + 1)), 6, 14))
    packed = pages.mapInArrow(lambda b: _ranges(b, bits), "name long, body binary").repartition("name")
    size = int(np.clip(np.ceil(np.log2((total or 0) / 6 + 1)), LEAST_FILTER, MOST_FILTER))
    on = np.zeros((1 << bits, 1 << (size - 3 - bits)), dtype=np.uint8)
    for name, body in packed.mapInArrow(lambda b: _repeated(b, bits, size), "name long, body binary").collect():  # bounded: 2**MOST_FILTER bits
        on[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(body)), dtype=np.uint8)
    del packed
    wanted = spark.sparkContext.broadcast(on.ravel())
    texts = pages.mapInArrow(lambda b: _candidates(b, wanted), "host string, text long, words long, found array<struct<code:bigint,places:int,outside:int,at:array<int>>>, first array<int>, size array<int>, kind array<long>")
    # pages of equal text count once
    texts = texts.groupBy("host", "text").agg(F.any_value(F.struct("words", "found", "first", "size", "kind")).alias("p")).select("host", "text", "p.*")
    texts = written(texts)  # rows of nested lists: as Parquet a fraction of a checkpoint's size
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).select("host", F.expr(f"cast(greatest({LEAST_PAGES}, least({ENOUGH_PAGES}, {LEAST_SHARE}D * n)) as double)").alias("least"))
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    texts = texts.join(hosts, "host").withColumn("hid", F.xxhash64("host")).drop("host")
    found = texts.select("hid", "text", "least", F.explode("found").alias("r")).select("hid", "text", "least", "r.*")
    counts = found.groupBy("code").agg(F.max("hid").alias("hid"), F.max("least").alias("least"), F.count(F.lit(1)).alias("pages"), F.sum("places").alias("places"), F.sum("outside").alias("outside"))
    mostly, often = F.expr("pages >= 2 and 2 * outside > places"), F.expr("pages >= least")
    counts = cut(counts.select("hid", "code", mostly.alias("mostly"), often.alias("often")).where("mostly or often"))
    few = lambda d: F.broadcast(d) if d.count() <= BROADCAST_CODES // 8 else d
    shared = few(counts.where("often").select("code"))

    def starts(codes: DataFrame, of: DataFrame) -> DataFrame:
        return of.join(codes, "code").groupBy("text").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))

    # the most words on end of a page that no shared run covers
    rest = F.expr(f"aggregate(at, struct(0L as upto, 0L as most), (a, w) -> struct(cast(w + {DEPTH} as long) as upto, greatest(a.most, w - a.upto) as most), a -> greatest(a.most, words - a.upto))")
    whole = starts(shared, found).join(texts.select("text", "words"), "text")
    copies = few(cut(whole.where(rest < DEPTH).select("text")))
    own = found.join(copies, "text", "left_anti")
    known = cut(own.join(shared, "code").groupBy("code").agg(F.max("least").alias("least"), F.count(F.lit(1)).alias("pages")).where("pages >= least").select("code"))
    out = counts.join(known.withColumn("known", F.lit(True)), "code", "left").where("mostly or known").select("hid", "code", F.lit(True).alias("neutral"), F.lit(False).alias("inside"))
    # kinds of blocks in articles; copies do not count
    marked = texts.where("size(kind) > 0").join(copies, "text", "left_anti").select("text", "hid", "least", "words", "first", "size", "kind")
    marked = marked.join(starts(few(known), own), "text", "left").select("hid", "least", "words", "at", "first", "size", "kind")
    kinds = marked.mapInArrow(_coverage, "hid long, least double, kind long, words long, covered long, pages long").groupBy("hid", "least", "kind").agg(*[F.sum(c).alias(c) for c in ("words", "covered", "pages")])
    kinds = kinds.where(f"pages >= least and covered >= {NEARLY}D * words").select("hid", F.col("kind").alias("code"), F.lit(False).alias("neutral"), F.lit(True).alias("inside"))
    return cut(out.unionByName(kinds))


def _codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code = rows["code"].to_numpy().view(U64)
    return tuple(np.sort(code[rows[k].to_numpy().astype(bool)]) for k in ("neutral", "inside"))


@tidied
def _texts(batches: Iterator[pa.RecordBatch], codes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            pages = [parse(x) for x in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(judge(pages, part.column(2).to_pylist(), codes.value), pa.string())], ["page_id", "url", "text"])


def _judged(table: pa.Table, listed: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    pages = [parse(x) for x in table["html"].to_pylist()]
    return pa.table([table["page_id"], table["url"], pa.array(judge(pages, table["host"].to_pylist(), listed), pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url and text of every row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    after = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    pages = pages.select("page_id", "url", F.coalesce(F.lower(F.regexp_extract(after, "^[^/?#]*", 0)), F.lit("")).alias("host"), "html")
    listed = _listed(pages.select("host", "html"))
    schema = f"page_id {kind}, url string, text string"
    if listed.count() <= BROADCAST_CODES:
        codes = pages.sparkSession.sparkContext.broadcast(_codes(listed.select("code", "neutral", "inside").toArrow()))
        return pages.mapInArrow(lambda b: _texts(b, codes), schema)
    pages = pages.withColumn("hid", F.xxhash64("host"))
    large = cut(pages.groupBy("hid").agg(F.ceil(F.sum(F.octet_length("html")) / shard_bytes).alias("shards")).where("shards > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    deal = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("shards", F.lit(1))).alias("shard")
    dealt = pages.join(large, "hid", "left").select("page_id", "url", "host", "hid", deal, "html")
    spread = listed.join(large, "hid", "left").select("hid", F.explode(F.expr("sequence(0L, coalesce(shards, 1L) - 1)")).alias("shard"), "code", "neutral", "inside")
    return dealt.groupBy("hid", "shard").cogroup(spread.groupBy("hid", "shard")).applyInArrow(lambda t, c: _judged(t, _codes(c)), schema)
