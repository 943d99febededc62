"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a whole text: densities of a fixed insult list and of a lexicon
learned from labelled text (words and word beginnings that are far commoner in
toxic documents), their nearness to second-person words, capitals, punctuation
and obfuscation rates. Trees, lexicon and calibration are fitted on disjoint
parts of a bounded labelled sample; scoring reads every document's whole text.

Bounds of the sample (parameters): about ``sample_rows`` labelled documents, of a
text longer than ``sample_chars`` characters a stretch of that length from a
hashed place. The lexicon has no bound but the sample's. Labels come only from documents whose
crc32(doc_id as text) mod 4 is not 2; labels, lang, source and doc_id are never
features.

Defined results: null text counts as empty and gets the score of an empty text;
several labels of one document count once (toxic if any is), and so do several
texts of one doc_id (that of the least hash); equal texts get equal scores; without labels of
both kinds the score is the share of toxic labels, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import _BYTE, _LOWER, bounded_rows, prefix_sums, session_of, span_hash, text_chunks
from strandline.llm.langid import held_out

INSULTS = "idiot moron scum trash worthless pathetic disgusting stupid loser clown dumb fool filth vermin garbage ugly hate jerk imbecile retard freak pig".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Beginnings of words that may enter the learned lexicon, in bytes.
STEMS = (4, 5, 6, 7)
#: Texts that the driver looks at together while fitting.
DRIVER_TEXTS = 50
#: Words within which a second-person word is near.
NEAR = 5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[33, 63]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _words_of(data: np.ndarray, offsets: np.ndarray):
    """Runs of letters: starts, ends, text of each, prefix sums of the lower-cased bytes."""
    low, n = _LOWER[data], len(data)
    letter = _LETTER[low]
    begins, ends = letter.copy(), letter.copy()
    cut = offsets[(offsets > 0) & (offsets < n)]
    if n:
        begins[1:] &= ~letter[:-1]
        begins[cut] = letter[cut]
        ends[:-1] &= ~letter[1:]
        ends[cut - 1] = letter[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end, doc, prefix_sums(_BYTE[low], 0), letter


def units(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word number, hash) of every word and of every beginning in STEMS."""
    out = [(np.arange(len(start)), span_hash(sums, start, end, 0))]
    for size in STEMS:
        at = np.flatnonzero(end - start > size)
        # a beginning is another unit than the word that looks like it
        out.append((at, span_hash(sums, start[at], start[at] + size, 0) ^ np.uint64(0x5851F42D4C957F2D)))
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(span_hash(prefix_sums(_BYTE[_LOWER[data]], 0), np.array([0]), np.array([len(data)]), 0)[0])
    return np.sort(np.array(out, np.uint64))


_INSULT, _SECOND = _hash_words(INSULTS), _hash_words(SECOND_PERSON)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted table, -1 if it has none."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


@dataclass
class Lexicon:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of features for each text of a chunk."""
    n = len(offsets) - 1
    start, end, doc, sums, letter = _words_of(data, offsets)
    count = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(count, 1)
    per = lambda at, w=None: np.bincount(doc[at], w, n)
    groups = units(sums, start, end)
    insult = _member(groups[0][1], _INSULT) >= 0
    weight = np.zeros(len(start))
    for at, value in groups:
        place = _member(value, lexicon.keys)
        hit = place >= 0
        np.maximum.at(weight, at[hit], lexicon.weights[place[hit]])
    learned = weight > 0
    second = _member(groups[0][1], _SECOND) >= 0
    hits = np.flatnonzero(insult | learned)
    run = np.concatenate([[0], np.cumsum(second)])
    first = np.searchsorted(doc, np.arange(n + 1))
    lo, hi = np.maximum(hits - NEAR, first[doc[hits]]), np.minimum(hits + NEAR + 1, first[doc[hits] + 1])
    near = hits[run[hi] > run[lo]]
    top = np.zeros(n)
    np.maximum.at(top, doc, weight)

    def bytes_of(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1)
    is_letter, space = bytes_of(letter), _SPACE[data]
    inner = np.zeros(len(data), bool)  # a symbol or digit between letters
    if len(data) > 2:
        inner[1:-1] = ~letter[1:-1] & ~space[1:-1] & letter[:-2] & letter[2:] & (data[1:-1] != 39) & (data[1:-1] != 45)
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
    symbols = bytes_of(~letter & ~space & ~_SHOUT[data] & ~_DIGIT[data])
    return np.column_stack([
        np.log1p(count), per(insult) / some, np.minimum(per(insult), 20), per(learned) / some, np.minimum(per(learned), 20), per(learned, weight[learned]) / some, top,
        per(second) / some, per(near) / some, bytes_of(_UPPER[data]) / np.maximum(is_letter, 1), bytes_of(_SHOUT[data]) / size, symbols / size, bytes_of(inner) / some, bytes_of(same) / size, bytes_of(_DIGIT[data]) / size,
    ])


def _unit_counts(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct unit hashes of a chunk, and for each the (toxic, other) documents that hold it."""
    start, end, doc, sums, _ = _words_of(data, offsets)
    keys, counts = [], []
    for at, value in units(sums, start, end):
        order = np.lexsort((doc[at], value))
        v, d = value[order], doc[at][order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        keys.append(v[new])
        counts.append(np.column_stack([toxic[d[new]], ~toxic[d[new]]]).astype(np.int64))
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


def learn_lexicon(texts: list[str], toxic: np.ndarray, least: int = 4, ratio: float = 8.0) -> Lexicon:
    """Words and beginnings at least ``ratio`` times likelier in toxic documents, seen in ``least`` of them."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    for a in range(0, len(texts), DRIVER_TEXTS):
        more = _unit_counts(*_joined(texts[a : a + DRIVER_TEXTS]), toxic[a : a + DRIVER_TEXTS])
        keys, counts = _summed(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))
    odds = ((counts[:, 0] + 0.5) / (toxic.sum() + 1)) / ((counts[:, 1] + 0.5) / ((~toxic).sum() + 1))
    chosen = (counts[:, 0] >= least) & (odds >= ratio)
    return Lexicon(keys[chosen], np.log(odds[chosen]))


def text_features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    return np.concatenate([features(*_joined(texts[a : a + DRIVER_TEXTS]), lexicon) for a in range(0, len(texts), DRIVER_TEXTS)])


@dataclass
class Trees:
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:  # complete trees; node i has children 2i + 1 and 2i + 2
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


DEPTH = 3


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees of depth 3 on the logistic loss, over quantile histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(base=float(np.log(mean / (1 - mean))))
    score = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == i)
                if len(rows) < 20:
                    continue
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = 1e-6
                for j, b in enumerate(binned):
                    if not len(edges[j]):
                        continue
                    left_g = np.cumsum(np.bincount(b[rows], g[rows], len(edges[j]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b[rows], h[rows], len(edges[j]) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[i], cut[i] = gain[k], j, edges[j][k]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + ridge)
        model.trees.append((feature, cut, leaf))
        score += leaf[leaf_of]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, calibrated share), both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, least and largest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in ((b[0] + 0.02) / (b[1] + 0.2),) * 2])
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None or self.knots is None:
            return np.full(len(offsets) - 1, self.share)
        raw = self.trees.raw(features(data, offsets, self.lexicon))
        # the raw score breaks ties inside a calibrated step
        return np.clip(0.995 * np.interp(raw, *self.knots) + 0.005 / (1 + np.exp(-raw)), 0.0, 1.0)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Lexicon, trees and calibration from three disjoint parts of labelled texts."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    part = np.arange(len(texts)) % 5  # the texts come in hashed order
    masks = [part < 2, (part == 2) | (part == 3), part == 4]
    if len(toxic) < 25 or any(toxic[m].all() or not toxic[m].any() for m in masks):
        return Model(Lexicon(), None, None, share)
    pick = lambda m: [t for t, k in zip(texts, m, strict=True) if k]
    first = learn_lexicon(pick(masks[0]), toxic[masks[0]])
    trees = boost(text_features(pick(masks[1]), first), toxic[masks[1]].astype(float))
    raw = trees.raw(text_features(pick(masks[2]), first))
    return Model(first, trees, isotonic(raw, toxic[masks[2]].astype(float)), share)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int) -> tuple[list[str], np.ndarray]:
    """At most about ``sample_rows`` learnable labelled texts, in an order set by a hash of doc_id."""
    may = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    some = bounded_rows(may, "doc_id", sample_rows, may.count()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # at most sample_rows ids and flags: small enough to send to every task
    some = F.broadcast(some)
    # of a long text one stretch, at a place that a hash of its doc_id sets
    at = (1 + F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1)))).cast("int")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(some, "doc_id")
    rows = rows.select("doc_id", "toxic", F.xxhash64("doc_id", "text").alias("h"), F.substr(F.col("text"), at, F.lit(sample_chars)).alias("text"))
    # documents that share a doc_id count once
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("h", "text", "toxic")).alias("r")).select("r.*").collect()
    rows.sort(key=lambda r: (r["h"], r["text"]))
    return [r["text"] for r in rows], np.array([bool(r["toxic"]) for r in rows], bool)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(model.score(data, offsets))], ["doc_id", "tkey", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, sample_chars: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, tkey (xxhash64 of the text), held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    session_of(docs)
    model = fit(*labelled_sample(docs, labels, sample_rows, sample_chars))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tkey"))
    kind = dict(texts.dtypes)["doc_id"]
    out = texts.mapInArrow(_scores(model), f"doc_id {kind}, tkey bigint, score double")
    return out.select("doc_id", "tkey", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep_clean(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(data, offsets) for _, _, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("text")))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, sample_chars: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they are."""
    session_of(docs)
    model = fit(*labelled_sample(docs, labels, sample_rows, sample_chars))
    return docs.mapInArrow(_keep_clean(model, threshold), docs.schema)
