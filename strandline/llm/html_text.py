"""Main text of web pages: markup zones, and a host suffix array for what markup leaves open.

A page is read as blocks. Zones that markup names (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts, styles) are chrome
and go. Of the others, those inside an explicit container (article, main,
role=main) are candidates for the main text, or all where a page has no
container. Inside a container a class or id names a zone only when all its parts
do (``ad-box``, but not ``section-header``), and hidden elements stay.

The host's suffix array judges the candidates: the token streams of the host's
pages are joined, inside containers and outside apart, and a run of tokens that
occurs in many different texts is boilerplate. The array is sparse and dealt out:

* a stream's suffixes are sampled, at each block's beginning, ``RUN`` tokens
  before its end, and where a suffix is the least (by a hash of its first ``RUN``
  tokens) of ``RUN`` in a row. So two texts that share 2 * RUN - 1 tokens, or a
  block, sample the same suffixes of it, and cover it but for its outermost tokens;
* suffixes with equal first ``RUN`` tokens are an interval of the array; only the
  number of its texts is needed, so intervals are counted by (host, first RUN
  tokens) with sums that start in each task. No host is ever gathered.

An interval is boilerplate with two texts outside containers (marked chrome is
evidence there), and inside them with ``LEAST`` and a ``SHARE`` of the host's
texts: an article may quote what another one says, but what a template puts into
each does not belong to it. Blocks mostly covered by such runs go. Copies of a
page are not boilerplate: containers with equal tokens are one text, a container
that would lose over half of its tokens stays whole, and so does a page without a
container of which nothing would be left.

References are decoded, white space inside a block becomes one space, blocks are
joined by one \\n.

Defined results: null or empty html gives an empty text; a page without a host
in its url belongs to the host ''; rows equal in url and html get equal
texts; html that ends inside a tag loses that tag only.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import Words, int64, mix64, prefix_sums, session_of, span_hash, stored

#: Tokens that a repeated run has at least.
RUN = 6
#: Part of a block's tokens that repeated runs must cover for it to go.
COVERED = 0.8
#: Texts of a host, and the share of all its texts, that a run inside containers occurs in before it is boilerplate.
LEAST, SHARE = 3, 0.25
#: Parts of an interval's hash: side, side and host tag, and the mark of totals.
_SIDE, _TAGS, _TOTAL = np.uint64(1), np.uint64(0x1FFFF), np.uint64(1 << 63)
#: Suffixes that a task holds before it sums them up.
HELD = 2_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# --- fixed values: element names and the words of class, id and role that name a zone ---
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object canvas".split())
CHROME = set("nav header footer aside form button select dialog menu head".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
NEVER_CHROME = set("html body h1 h2 h3 h4 h5 h6".split())
ZONE_WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disclaimer disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted recommend recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split())
AFFIXES = set("area bar block box container inner list outer panel wrap wrapper".split())
ZONE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
# --- end of fixed values ---


_COMMENT = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}


def _zone(name: str, attributes: str, inside: bool) -> str:
    """'chrome', 'comment', 'main' or '' for a start tag; ``inside``: it stands in a container."""
    words: set[str] = set()
    main = name in ("article", "main")
    chrome = name in CHROME
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                for one in value.split():
                    parts = [w for w in re.split(r"[^a-z]+", one) if w]
                    if not inside or all(w in ZONE_WORDS or w in AFFIXES for w in parts):
                        words.update(parts)
            elif key == "role":
                main |= value == "main"
                chrome |= value in ZONE_ROLES
            elif key == "itemprop":
                main |= value == "articlebody"
                words.update(["comment"] if value == "comment" else [])
            elif key == "hidden" or value == "true":
                chrome |= not inside
    if words & _COMMENT:
        return "comment"
    if main:
        return "main"
    if chrome or (words & ZONE_WORDS and name not in NEVER_CHROME):
        return "chrome"
    return ""


def read_page(page: str) -> tuple[bool, list[tuple[str, str]]]:
    """(has a container, blocks as (zone, text)); zone is 'main', 'chrome' or '' (open)."""
    blocks: list[tuple[str, str]] = []
    zones: list[list] = []  # [zone, tag name, open tags of that name]
    piece: list[str] = []
    found_main, at = False, 0

    def zone_now() -> str:
        for z in reversed(zones):
            if z[0] != "main":
                return "chrome"
        return "main" if zones else ""

    def flush() -> None:
        if piece:
            text = " ".join(_html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                blocks.append((zone_now(), text))

    size = len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            piece.append(page[at:])
            break
        if start > at:
            piece.append(page[at:start])
        m = _TAG.match(page, start)
        if m is None:
            piece.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK or (name in RAW and not closing):
            flush()
        elif name == "br":
            piece.append(" ")
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID or (attributes.endswith("/") and not closing and name not in BLOCK):
            continue
        if closing:
            for i in range(len(zones) - 1, -1, -1):
                if zones[i][1] == name:
                    flush()
                    zones[i][2] -= 1
                    if not zones[i][2]:
                        del zones[i:]
                    break
            continue
        kind = _zone(name, attributes, bool(zones) and zone_now() == "main")
        if kind == "main" and any(z[0] == "chrome" for z in zones):  # an unclosed menu does not swallow the article
            flush()
            zones[:] = [z for z in zones if z[0] == "comment"]
        if kind == "chrome" and name == "header" and any(z[0] == "main" for z in zones):
            kind = ""  # an article's own heading
        if kind:
            flush()
            found_main |= kind == "main"
            zones.append([kind, name, 1])
        else:
            for z in reversed(zones):
                if z[1] == name:
                    z[2] += 1
                    break
    flush()
    return found_main, blocks


class Suffixes:
    """Sampled suffixes of the streams of several pages, inside containers and outside.

    Stream i holds the blocks ``first_block[i]`` to ``first_block[i + 1]``; suffix k lies in stream ``stream[k]``,
    begins at token ``place[k]`` of it and has the hash ``gram[k]`` of its host, side and first RUN tokens.
    ``total[i]``: hash that stands for the texts of the stream's host and side.

    The low bits of both are the side (1: inside containers) and a tag of the host, the highest one is set in totals.
    """

    def __init__(self, streams: list[tuple[str, str, list[str]]]):
        blocks = [text.encode("utf-8", "replace") for _, _, texts in streams for text in texts]
        offsets = np.zeros(len(blocks) + 1, np.int64)
        np.cumsum([len(x) for x in blocks], out=offsets[1:])
        words = Words(np.frombuffer(b"".join(blocks), np.uint8), offsets)
        first_block = np.zeros(len(streams) + 1, np.int64)
        np.cumsum([len(texts) for _, _, texts in streams], out=first_block[1:])
        self.first_block, self.block = first_block, words.first
        begin = words.first[first_block]  # tokens of the streams
        n = len(words.hashes)
        sums = prefix_sums(words.hashes, 1)
        at = np.arange(max(0, n - RUN + 1))
        run = span_hash(sums, at, at + RUN, 1)
        owner = np.searchsorted(begin, at, "right") - 1
        fits = at + RUN <= begin[owner + 1]
        chosen = np.zeros(len(at), bool)
        if len(at) >= RUN:  # the least of RUN suffixes of one stream
            window = np.lib.stride_tricks.sliding_window_view(run, RUN)
            whole = fits[RUN - 1 :] & (owner[RUN - 1 :] == owner[: len(window)])
            chosen[(np.arange(len(window)) + window.argmin(1))[whole]] = True
        edges = np.concatenate([words.first[:-1], words.first[1:] - RUN])[np.tile(np.diff(words.first) >= RUN, 2)]
        edges = np.concatenate([edges, begin[:-1][np.diff(begin) >= RUN]])
        chosen[edges] = True
        place = np.flatnonzero(chosen & fits)
        salt = np.array([xxhash.xxh64_intdigest(f"{side} {host}") for host, side, _ in streams], np.uint64)
        tag = salt & ~_SIDE & _TAGS | np.array([side == "main" for _, side, _ in streams], np.uint64)
        self.stream = owner[place]
        self.place = place - begin[self.stream]
        self.gram = mix64(run[place] ^ salt[self.stream]) & ~_TOTAL & ~_TAGS | tag[self.stream]
        self.total = mix64(salt + np.uint64(1)) & ~_TAGS | _TOTAL | tag
        self.bounds = np.searchsorted(self.stream, np.arange(len(streams) + 1))


def _sides(page: str) -> tuple[bool, list[str], list[str]]:
    """(has a container, blocks inside the containers, blocks outside), chrome among the latter."""
    has_main, blocks = read_page(page)
    return has_main, [t for z, t in blocks if z == "main"], [t for z, t in blocks if z != "main"]


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, grams) for each text of a batch: equal texts of a host have one key, whatever surrounds them."""
    for batch in batches:
        found: dict[int, tuple[str, str, list[str]]] = {}
        for tkey, page, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            has_main, inside, outside = _sides(page or "")
            if inside:
                found[xxhash.xxh64_intdigest("main " + host + " " + " ".join(inside))] = (host, "main", inside)
            if outside:
                found[xxhash.xxh64_intdigest(f"open {host} {tkey}")] = (host, "", outside)
        s = Suffixes(list(found.values()))
        grams = [np.unique(np.append(s.gram[a:b], t)).tobytes() for a, b, t in zip(s.bounds[:-1], s.bounds[1:], s.total, strict=True)]
        yield pa.RecordBatch.from_arrays([int64(np.array(list(found), np.uint64)), pa.array(grams, pa.binary())], ["key", "grams"])


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    head = np.flatnonzero(np.append(np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]))
    return grams[head], (np.add.reduceat(counts, head) if len(head) else counts)


def _counts(buckets: int):
    """Rows (bucket, grams, counts): in how many texts of a task each interval occurs."""

    def dealt(parts: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate([np.zeros(0, np.uint64), *parts])
        grams, counts = _summed(grams, np.ones(len(grams), np.int32))
        bucket = (mix64(grams) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(ends))
        pieces = [order[ends[b] : ends[b + 1]] for b in some]
        columns = [pa.array(some.astype(np.int32)), pa.array([grams[x].tobytes() for x in pieces], pa.binary()), pa.array([counts[x].astype(np.int32).tobytes() for x in pieces], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                parts.append(np.frombuffer(x, np.uint64))
                size += len(parts[-1])
            if size > HELD:
                yield dealt(parts)
                parts, size = [], 0
        if parts:
            yield dealt(parts)

    return run


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """(gram, n): the intervals of a bucket that enough texts share on any host, and in how many texts."""
    grams, counts = (np.concatenate([np.frombuffer(x, kind) for x in frame[c]]) for c, kind in (("grams", np.uint64), ("counts", np.int32)))
    grams, counts = _summed(grams, counts)
    inside = (grams & _SIDE == 1) & (grams & _TOTAL == 0)
    some = counts >= np.where(inside, LEAST, 2)
    return pd.DataFrame({"gram": grams[some].view(np.int64), "n": counts[some]})


def repeated_runs(pages: DataFrame) -> DataFrame:
    """(gram, n) over ``pages`` (tkey, html, host): see ``Suffixes``. Runs inside containers that are too rare for every host of their tag are left out."""
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pages.mapInArrow(_texts_of, "key bigint, grams binary").groupBy("key").agg(F.first("grams").alias("grams")).select("grams")
    dealt = texts.mapInArrow(_counts(buckets), "bucket int, grams binary, counts binary")
    found, _ = stored(dealt.groupBy("bucket").applyInPandas(_repeated, "gram bigint, n int"))
    tag = F.col("gram").bitwiseAND(int(_TAGS))
    # one row a tag: 131,072 at most, whatever the number of hosts
    least = found.where("gram < 0").groupBy(tag.alias("tag")).agg(F.min("n").alias("texts"))
    judged = found.withColumn("tag", tag).join(F.broadcast(least), "tag", "left")
    inside = (F.col("gram") >= 0) & (F.col("gram").bitwiseAND(1) == 1)
    return judged.where(~inside | (F.col("n") >= SHARE * F.coalesce("texts", F.lit(0)))).select("gram", "n")


def main_text(page: str, host: str = "", texts_with: Callable[[np.ndarray], np.ndarray] | None = None) -> str:
    """The page's main text; ``texts_with``: the number of texts in which intervals (hashes) occur."""
    has_main, blocks = read_page(page)
    blocks = [(z, t) for z, t in blocks if (z == "main") == has_main]
    every = [t for z, t in blocks if z != "chrome"]
    if texts_with is None or not every:
        return "\n".join(every)
    s = Suffixes([(host, "main" if has_main else "", [t for _, t in blocks])])
    n, total = texts_with(s.gram), texts_with(s.total)[0]
    hits = s.place[n >= (max(LEAST, SHARE * total) if has_main else 2)]
    if not len(hits):
        return "\n".join(every)
    edge = np.zeros(s.block[-1] + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + RUN, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    kept, left, size = [], 0, 0
    for (zone, text), a, b in zip(blocks, s.block[:-1].tolist(), s.block[1:].tolist(), strict=True):
        if zone == "chrome":
            continue
        size += b - a
        if covered[b] - covered[a] < COVERED * (b - a):
            kept.append(text)
            left += b - a
    whole = 2 * left < size if has_main else not kept
    return "\n".join(every if whole else kept)


def _lookup(grams: np.ndarray, counts: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Counts of sorted ``grams``; 0 for others."""

    def texts_with(wanted: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(grams, wanted), len(grams) - 1)
        return np.where(grams[at] == wanted, counts[at], 0)

    return texts_with


def _answer(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_all(grams: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_with = _lookup(grams, counts)
        for batch in batches:
            yield _answer(batch, [main_text(page or "", host, texts_with) for page, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, url, tkey): the intervals that a page asks for."""
    for batch in batches:
        for url, tkey, page, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            has_main, inside, outside = _sides(page or "")
            s = Suffixes([(host, "main" if has_main else "", inside if has_main else outside)])
            grams = np.unique(np.concatenate([s.gram, s.total]))
            yield pa.RecordBatch.from_arrays([int64(grams), pa.array([url] * len(grams), pa.string()), pa.array([tkey] * len(grams), pa.int64())], ["gram", "url", "tkey"])


def _with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, host, known in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            pairs = sorted((x["gram"] % 2**64, x["n"]) for x in known or ())
            texts.append(main_text(page or "", host, _lookup(np.array([g for g, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))))
        yield _answer(batch, texts)


_OUT = "page_id bigint, url string, text string, n_chars bigint"


def extract_text(pages: DataFrame, sent: int = 4_000_000) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    ``sent``: repeated intervals (12 bytes each) that are sent to every task; with more of them each page's are joined to it.
    """
    session_of(pages)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = pages.withColumn("host", host).withColumn("tkey", F.coalesce(F.xxhash64("html"), F.lit(0)))
    shared, _ = stored(repeated_runs(keyed.select("tkey", "html", "host")))
    if shared.count() <= sent:
        rows = shared.toArrow()
        grams, counts = (np.concatenate([np.zeros(0, kind), *(np.asarray(c) for c in rows.column(k).chunks)]) for k, kind in ((0, np.int64), (1, np.int32)))
        grams, counts = _summed(grams.view(np.uint64), counts)
        return keyed.select("page_id", "url", "html", "host").mapInArrow(_with_all(grams, counts), _OUT)
    asked = keyed.select(F.coalesce("url", F.lit("")).alias("url"), "tkey", "html", "host").distinct().mapInArrow(_asked, "gram bigint, url string, tkey bigint")
    own = asked.join(shared, "gram").groupBy(F.col("url").alias("own_url"), F.col("tkey").alias("own_tkey")).agg(F.collect_list(F.struct("gram", "n")).alias("known"))
    joined = keyed.join(own, (F.coalesce("url", F.lit("")) == F.col("own_url")) & (F.col("tkey") == F.col("own_tkey")), "left")
    return joined.select("page_id", "url", "html", "host", "known").mapInArrow(_with_own, _OUT)
