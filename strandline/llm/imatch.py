"""I-Match document fingerprints over an inverse-document-frequency band.

Terms are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A corpus pass
counts the documents of every term; the lexicon keeps the terms whose idf,
ln(N / df), lies in the band. As df >= N * exp(-idf_high) for each of them, the
lexicon has at most exp(idf_high) times the mean number of distinct terms of a
document, however large the corpus: that bounds what is sent to the tasks.

The randomised lexicons are fixed for all texts: ``SUBSETS`` draws, each of which
gives nested sub-lexicons that keep 1, 1/2, 1/4, ... of the lexicon (level 0, 1,
2, ...). A text's distinct terms in a sub-lexicon, sorted, are hashed in that
order. Its fingerprint gives these hashes at three levels of each draw, from the
one that is expected to keep one of its terms: at lower levels almost any edit
changes a hash, at higher ones no term is left. The likeness of two is, over the
levels both give, twice the number of equal hashes over the sub-lexicons that
hold a term, of the one and of the other (texts that differ eightfold in their
numbers of terms, so with a likeness of an eighth at most, have 0).

The edited text of a document (its last quarter replaced by the beginning of the
next document) needs the next document: rows are dealt into ranges of doc_id, as
many as the session has shuffle partitions, and read in order; the first document
of each range is also sent to the range before.

Defined results: null text counts as empty; a text without lexicon terms is
fingerprinted by all its terms; equal fingerprints have likeness 1, also empty
ones; documents with one doc_id come in the order of their packed texts; a null doc_id
comes first; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import Words, int64, mix64, session_of, text_chunks

SUBSETS = 48
LEVELS = 3
_SALT = np.random.default_rng(5).integers(0, 2**63, SUBSETS, dtype=np.uint64)
_ORDER = np.uint64(0x9E3779B97F4A7C15)
#: (term, document) counts a task holds before it adds them up.
HELD = 2_000_000
NO_ID = -(2**63)


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, value) pairs, by doc and value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(value)
    value, count = value[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[head], (np.add.reduceat(count, head) if len(head) else count)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term hash, documents) of a task's documents."""
    parts, size = [], 0
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            words = Words(data, offsets, lower=True)
            order = np.argsort(words.hashes, kind="stable")  # documents stay in order within a term
            value = words.hashes[order]
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            parts.append((value[new], np.ones(int(new.sum()), np.int64)))
            size += len(parts[-1][0])
            if size > HELD:
                parts = [_added(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:  # mostly rare terms: pass them on
                    yield pa.RecordBatch.from_arrays([int64(parts[0][0]), pa.array(parts[0][1].astype(np.int32))], ["term", "n"])
                    parts, size = [], 0
    if parts:
        value, count = _added(parts)
        yield pa.RecordBatch.from_arrays([int64(value), pa.array(count.astype(np.int32))], ["term", "n"])


def lexicon(docs: DataFrame, idf_low: float, idf_high: float) -> np.ndarray:
    """Sorted hashes of the terms in the band; see the module for their bound."""
    total = docs.count()
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_term_counts, "term bigint, n int").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    kept = counts.where((idf >= idf_low) & (idf <= idf_high)).select("term").toArrow().column(0)
    return np.sort(np.asarray(kept.combine_chunks() if kept.num_chunks else pa.array([], pa.int64())).view(np.uint64))


def fingerprints(texts: list[bytes], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, LEVELS * SUBSETS 16-bit hashes; 0: the sub-lexicon holds none of the terms) of each text."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, words.hashes), len(lexicon) - 1)
        inside = lexicon[at] == words.hashes
    else:
        inside = np.zeros(len(doc), bool)
    inside |= np.bincount(doc[inside], minlength=len(texts))[doc] == 0
    doc, term = _distinct(doc[inside], words.hashes[inside])
    count = np.bincount(doc, minlength=len(texts))
    level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    out = np.zeros((len(texts), LEVELS, SUBSETS), np.uint16)
    if len(doc):
        full = np.flatnonzero(count)
        head = np.searchsorted(doc, full)
        own = mix64(term ^ np.uint64(0x1234567))
        size = int(np.diff(np.append(head, len(doc))).max())
        power = np.cumprod(np.append(np.uint64(1), np.full(size, _ORDER)), dtype=np.uint64)
        for j in range(SUBSETS):
            draw = mix64(term ^ _SALT[j])
            for k in range(LEVELS):
                shift = (64 - (level + k))[doc].astype(np.uint64)
                chosen = np.where(shift < 64, draw >> np.minimum(shift, np.uint64(63)), np.uint64(0)) == 0
                at = np.flatnonzero(chosen)
                if not len(at):
                    continue
                held = np.searchsorted(at, head)
                some = np.diff(np.append(held, len(at))) > 0
                rank = np.arange(len(at)) - np.repeat(held[some], np.diff(np.append(held[some], len(at))))
                total = np.add.reduceat(own[at] * power[rank], held[some])
                out[full[some], k, j] = (1 + mix64(total) % np.uint64(65535)).astype(np.uint16)
    return level, out


def likeness(level_a: np.ndarray, a: np.ndarray, level_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, at the levels both have: twice the equal hashes over the sub-lexicons that hold a term of one and of the other (Dice)."""
    equal, held = np.zeros(len(a)), np.zeros(len(a))
    for x in range(LEVELS):
        for y in range(LEVELS):
            same = level_a + x == level_b + y
            equal += same * ((a[:, x] == b[:, y]) & (a[:, x] != 0)).sum(1)
            held += same * ((a[:, x] != 0).sum(1) + (b[:, y] != 0).sum(1))
    whole = (level_a == level_b) & (a == b).all((1, 2))
    return np.where(whole, 1.0, 2 * equal / np.maximum(held, 1))


def _text_of(level: int, hashes: np.ndarray) -> str:
    return f"{level}:{hashes.astype('>u2').tobytes().hex()}"


def _least(bounds: np.ndarray):
    """The least id of each range in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(np.asarray(batch.column(0)))
            place, first = np.unique(np.searchsorted(bounds, ids, "right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(ids[first])], ["range", "head"])

    return run


def _deal(bounds: np.ndarray, heads: dict[int, int]):
    """Each row with its range; the first document of a range also for the range before. Texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(NO_ID))
            at = np.searchsorted(bounds, ids, "right")
            packed = [packer.compress(x.as_buffer()) if x.is_valid else b"" for x in batch.column(1)]
            guest = [i for i, d in enumerate(ids.tolist()) if d in heads]
            row = np.concatenate([np.arange(len(ids)), np.array(guest, np.int64)])
            place = np.concatenate([at, np.array([heads[int(ids[i])] for i in guest], np.int64)])
            flag = np.arange(len(row)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(flag), pa.array(ids[row]), pa.array([packed[i] for i in row], pa.binary())], ["range", "guest", "doc_id", "packed"])

    return run


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(terms: np.ndarray):
    """Rows of whole ranges in order: every row but a guest with the row after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        carry: list[tuple] = []
        for batch in batches:
            rows = list(carry)
            for place, guest, doc, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows.append((place, guest, doc, unpacker.decompress(packed).decode("utf-8", "replace") if packed else ""))
            carry = rows[-1:]
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1] and a[0] == b[0]]
            if not pairs:
                continue
            level, own = fingerprints([x[3].encode("utf-8", "replace") for x in rows], terms)
            at = np.array([i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]])
            edited = [(a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4]).encode("utf-8", "replace") for a, b in pairs]
            edited_level, other = fingerprints(edited, terms)
            ids = [None if a[2] == NO_ID else a[2] for a, _ in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                    pa.array([_text_of(level[i], own[i]) for i in at]), pa.array([_text_of(x, y) for x, y in zip(edited_level, other, strict=True)]),
                    pa.array(likeness(level[at], own[at], edited_level, other)), pa.array(likeness(level[at], own[at], level[at + 1], own[at + 1])),
                ],
                _OUT,
            )

    return run


def fingerprint_documents(docs: DataFrame, idf_low: float = 3.9, idf_high: float = 7.6) -> DataFrame:
    """The columns of ``_SCHEMA`` for every row of ``docs`` (doc_id, text)."""
    spark = session_of(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = lexicon(docs, idf_low, idf_high)

    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    # the least id of each range that has one: as many rows as there are ranges
    low = ids.mapInArrow(_least(bounds), "range int, head bigint").groupBy("range").agg(F.min("head").alias("head")).orderBy("range").collect()
    heads = {r["head"]: low[i - 1]["range"] for i, r in enumerate(low)}
    dealt = docs.mapInArrow(_deal(bounds, heads), "range int, guest boolean, doc_id bigint, packed binary")
    ordered = dealt.repartitionById(max(1, ranges), F.col("range")).sortWithinPartitions("range", "guest", "doc_id", "packed")
    return ordered.mapInArrow(_compare(terms), _SCHEMA)
