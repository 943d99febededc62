"""Exact substring dedup over a compacted de Bruijn graph of word k-mers.

Every window of ``window`` words is an edge path of k-mer nodes. A window is
represented by its least k-mer (its anchor), so the consecutive windows of a
document that share an anchor are compacted into one path: about one row for 13
words instead of one for each. Spark joins then decide, without ever gathering a
group:

* an anchor seen in one document only ends there: nothing on it repeats;
* all other paths are read back at their source coordinates (doc_id, first word,
  length), and a path is from then on known by a 128-bit BLAKE2 digest of its
  words; hashes only ever propose. An anchor with one such path does not branch:
  every later document's whole path is covered;
* where paths branch, one leader of each distinct path is read back again and its
  single windows are compared by digests of their words.

Result per row of the input: which words lie in a window whose word sequence
also starts in a document with a smaller doc_id.

Defined results: null or short text loses nothing (null has no words and the
hash of the empty string); rows that share a doc_id do not cover each other;
a row with null doc_id is returned untouched and covers nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import Words, int64, prefix_sums, session_of, span_hash, stored, text_chunks

_POSITION = np.uint64((1 << 28) - 1)
_PATHS = "doc_id bigint, tkey bigint, h bigint, s int, n int"
_DIGESTS = "doc_id bigint, tkey bigint, h bigint, p1 bigint, p2 bigint, s int, n int"
#: Digests that are passed on together.
AT_ONCE = 100_000


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of valid windows, their anchors' places, k-mer hashes) of a chunk."""
    k = (window + 1) // 2
    span = window - k + 1
    n, first = len(words.hashes), words.first
    sums = prefix_sums(words.hashes, 1)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - k + 1)
    kmer = span_hash(sums, at, at + k, 1)
    low = (kmer & ~_POSITION) | at.astype(np.uint64)
    done = 1
    while done < span:  # least of ever longer runs, the last two overlap
        step = min(done, span - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    left = np.repeat(first[1:], np.diff(first))[: n - window + 1] - np.arange(n - window + 1)
    start = np.flatnonzero(left >= window)
    return start, (low[start] & _POSITION).astype(np.int64), kmer


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (np.asarray(batch.column(k)) for k in (0, 2))
            for a, _, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets)
                start, anchor, kmer = _anchors(words, window)
                if not len(start):
                    continue
                doc = np.searchsorted(words.first, start, "right") - 1
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(start)))
                s, d = start[head], doc[head]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a + d]), pa.array(keys[a + d]), int64(kmer[anchor[head]]),
                        pa.array((s - words.first[d]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    ["doc_id", "tkey", "h", "s", "n"],
                )

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def _read_back(window: int, single: bool):
    """Digests of the paths listed with each document (doc_id, text, tkey, paths of h, s and n), or of their single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, s, n, digests = [], [], [], [], []
            for r, (text, listed) in enumerate(zip(batch.column(1), batch.column(3).to_pylist(), strict=True)):
                words = text.as_buffer().to_pybytes().split()
                for path in listed:
                    first, count = path["s"], path["n"]
                    for at, size in ((first + i, 1) for i in range(count)) if single else ((first, count),):
                        row.append(r)
                        h.append(path["h"])
                        s.append(at)
                        n.append(size)
                        digests.append(_digest(words[at : at + size - 1 + window]))
                if len(row) > AT_ONCE or (row and r == batch.num_rows - 1):
                    take = pa.array(row)
                    columns = [batch.column(0).take(take), batch.column(2).take(take), pa.array(h, pa.int64()), *_halves(digests), pa.array(s, pa.int32()), pa.array(n, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "h", "p1", "p2", "s", "n"])
                    row, h, s, n, digests = [], [], [], [], []

    return run


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            total, gone, digest, kept_text = [], [], [], []
            for text, found in zip(batch.column(1), spans, strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                total.append(len(words))
                if found:
                    drop = np.zeros(len(words) + 1, np.int64)
                    np.add.at(drop, [x["s"] for x in found], 1)
                    np.add.at(drop, [x["s"] + x["n"] - 1 + window for x in found], -1)
                    keep = np.cumsum(drop[:-1]) == 0
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                gone.append(total[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept_text, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept ``text``) for every row of ``docs`` (doc_id, text)."""
    spark = session_of(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("tkey", F.xxhash64("text"))
    paths = texts.where("doc_id is not null").mapInArrow(_paths(window), _PATHS)

    anchors = paths.groupBy("h").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    # small sides are stored, so that joins read two plain exchanges and Spark can split a very common anchor
    anchors, _ = stored(anchors.where("d0 < d1").select("h"))
    dealt = texts.repartition(F.col("doc_id"), F.col("tkey"))

    def read_back(listed: DataFrame, single: bool) -> DataFrame:
        by_document = listed.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("h", "s", "n")).alias("paths"))
        return stored(dealt.join(by_document, ["doc_id", "tkey"]).select("doc_id", "text", "tkey", "paths").mapInArrow(_read_back(window, single), _DIGESTS))[0]

    verified = read_back(paths.join(anchors, "h"), False)
    words = F.struct("p1", "p2")
    forks, _ = stored(verified.groupBy("h").agg((F.min(words) < F.max(words)).alias("branches")).where("branches").select("h", "branches"))
    leaders, _ = stored(verified.groupBy("h", "p1", "p2").agg(F.min("doc_id").alias("lead")))
    led = verified.join(leaders, ["h", "p1", "p2"])
    later = led.where("doc_id > lead").select("doc_id", "tkey", "s", "n")
    # a leader's windows are looked up, and those of the anchor's first document are what they are found in
    lead = led.where("doc_id = lead").join(forks, "h").select("doc_id", "tkey", "h", "s", "n")
    windows = read_back(lead, True)
    first, _ = stored(windows.groupBy("p1", "p2").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("p1", "p2", "d0"))
    single = windows.join(first, ["p1", "p2"]).where("doc_id > d0").select("doc_id", "tkey", "s", "n")

    covered = later.unionAll(single).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    joined = dealt.join(covered, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", text string" if keep_text else "")
    return joined.mapInArrow(_cut(window, keep_text), schema)
