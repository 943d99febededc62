"""SentencePiece encoding and decoding by suffix-array matching.

For a batch of texts the distinct words not met before are joined into one
indexed text. Its suffix array (suffixes ordered by as many characters as the
longest piece has) gives, by binary search, the range of suffixes that begin
with each piece: all places of all pieces. The places become lattice edges,
sorted by position; relaxing them from left to right yields the encoding.

The models served are BPE models with byte fallback. Their encoding is not a
cheapest path, so an edge is relaxed by BPE's own rule: the encoding of a prefix
that ends with a piece is the encoding of what comes before plus that piece,
exactly when the last piece before and this one, merged by rank from characters,
stay those two pieces. One edge into each position passes. Results equal those
of the sentencepiece library on every text (tests compare them).

White space: a space becomes U+2581, one is put in front of the text; decoding
undoes both, so a text that itself holds U+2581 comes back with spaces there.

Defined results: null text encodes to null and decodes from null (the digests
count it as empty); the empty text has no ids; repeated rows are encoded alike,
an empty table gives an empty one; characters no piece covers become byte pieces; bytes that are no
UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import session_of, worker_cache

SPACE = "▁"
#: Words whose encodings a Python worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 800_000, 16_000_000
#: Characters of new words that are indexed at a time.
INDEXED = 400_000
#: Characters from which on a word's edges are relaxed one by one instead of side by side with other words'.
LONG = 200
_UNIT = re.compile(f"{SPACE}?[^{SPACE}]+|{SPACE}")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with their scores; which are byte pieces, which are ordinary ones."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_base: int
    unknown: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read the model file on the driver; the vocabulary itself is what is sent to the tasks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        pieces = tuple(sp.id_to_piece(i) for i in ids)
        odd = [sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids]
        return Vocabulary(pieces, tuple(sp.get_score(i) for i in ids), tuple(not x for x in odd), pieces.index("<0x00>"), sp.unk_id())


class PairTable:
    """Flags of pairs of pieces (left << 20 | right) in an open-addressed hash table, for many pairs at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.key, self.flag = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """0 or 1, -1 for a pair that is not there."""
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.flag[slot], np.int8(-1))
        probing = np.flatnonzero((held != keys) & (held >= 0))
        while len(probing):
            slot[probing] = (slot[probing] + 1) & ((1 << self.bits) - 1)
            held = self.key[slot[probing]]
            hit = held == keys[probing]
            out[probing[hit]] = self.flag[slot[probing[hit]]]
            probing = probing[~hit & (held >= 0)]
        return out

    def add(self, keys: np.ndarray, flags: np.ndarray) -> None:
        """Put in distinct pairs that are not there."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = self.key >= 0
            keys, flags = np.append(self.key[old], keys), np.append(self.flag[old], flags)
            self.__init__(int(4 * len(keys)).bit_length())
        self.n += len(keys)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.key[at], self.flag[at] = keys[free[first]], flags[free[first]]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Encoder and decoder of one vocabulary, with what it has learned of words and of pairs of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        ids = [i for i, ok in enumerate(vocabulary.normal) if ok]
        self.id_of = {vocabulary.pieces[i]: i for i in ids}
        self.score = {vocabulary.pieces[i]: vocabulary.scores[i] for i in ids}
        # runs of the space mark have the least scores and merge after all else: they are handled apart
        words = [i for i in ids if vocabulary.pieces[i].strip(SPACE) or vocabulary.pieces[i] == SPACE]
        self.mark = self.id_of.get(SPACE, vocabulary.unknown)
        self.widest = max(len(vocabulary.pieces[i]) for i in words)
        self.code = np.zeros(0x110000, np.uint16)
        alphabet = sorted(set("".join(vocabulary.pieces[i] for i in words)))
        self.code[[ord(c) for c in alphabet]] = 2 + np.arange(len(alphabet))
        words.sort(key=lambda i: [ord(c) for c in vocabulary.pieces[i]])
        self.word_ids = np.array(words, np.int64)
        self.word_size = np.array([len(vocabulary.pieces[i]) for i in words], np.int64)
        rows = np.zeros((len(words), self.widest), ">u2")
        for r, i in enumerate(words):
            rows[r, : self.word_size[r]] = self.code[[ord(c) for c in vocabulary.pieces[i]]]
        tail = np.arange(self.widest)[None, :] >= self.word_size[:, None]
        kind = f"S{2 * self.widest}"
        self.low = np.ascontiguousarray(rows).view(kind).reshape(-1)
        self.high = np.ascontiguousarray(np.where(tail, 0xFFFF, rows).astype(">u2")).view(kind).reshape(-1)
        self.kind = kind
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0  # characters of the known words
        self.length = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.pairs = PairTable()
        self.whole = np.full(len(vocabulary.pieces), -1, np.int8)  # whether a piece's characters merge into it; -1: not known yet
        self.runs: dict[int, tuple[int, ...]] = {}
        self.number = list(range(len(vocabulary.pieces)))
        self.decimal = [str(i) for i in self.number]
        base = vocabulary.byte_base
        self.shown = [p if ok else "" for p, ok in zip(vocabulary.pieces, vocabulary.normal, strict=True)]
        for b in range(128):
            self.shown[base + b] = chr(b)
        self.high_bytes = set(range(base + 128, base + 256))

    def _merged(self, text: str) -> list[str]:
        """BPE from single characters: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, where = s, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _stays(self, keys: np.ndarray) -> np.ndarray:
        """Whether the two pieces of each pair, merged from characters, stay these two."""
        known = self.pairs.find(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            pieces = self.v.pieces
            parts = [(pieces[k >> 20], pieces[k & 0xFFFFF]) for k in new.tolist()]
            self.pairs.add(new, np.array([self._merged(x + y) == [x, y] for x, y in parts], np.int8))
            known = self.pairs.find(keys)
        return known == 1

    def _alone(self, pieces: np.ndarray) -> np.ndarray:
        for p in np.unique(pieces[self.whole[pieces] < 0]).tolist():
            self.whole[p] = self._merged(self.v.pieces[p]) == [self.v.pieces[p]]
        return self.whole[pieces] == 1

    def _good(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether a piece may follow the last one before it (-1: none)."""
        out, first = np.zeros(len(piece), bool), before < 0
        out[first] = self._alone(piece[first])
        out[~first] = self._stays(before[~first] << 20 | piece[~first])
        return out

    def _learn(self, words: list[str]) -> None:
        """Encode new words: index their joined text, find every piece's places, relax the edges."""
        joined = "\x00".join(words) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        stops = np.cumsum([len(w) + 1 for w in words])
        code[stops - 1] = 1  # no piece holds the code that ends a word
        padded = np.concatenate([code, np.ones(self.widest, np.uint16)]).astype(">u2")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.widest)[: len(code)]).view(self.kind).reshape(-1)
        array = np.argsort(suffixes, kind="stable")
        ordered = suffixes[array]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = hi - lo
        rank = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = array[rank]
        size = np.repeat(self.word_size, count)
        end, piece = start + size, np.repeat(self.word_ids, count)
        heads = np.concatenate([[0], stops[:-1]])
        owner = np.searchsorted(stops, start, "right")
        head = heads[owner]
        last = np.full(len(code) + 1, -1, np.int64)  # the last piece of the encoding that ends here; -1: a character without a piece
        is_long = (stops - 1 - heads)[owner] > LONG
        # all words side by side: first the edges that end at a word's first character, the longest before the others, and so on
        side = np.flatnonzero(~is_long)
        turn = ((end - head)[side] * (self.widest + 1) + self.widest - size[side]).astype(np.uint16)
        order = np.argsort(turn, kind="stable")
        side, turn = side[order], turn[order]
        cuts = np.flatnonzero(np.append(np.ones(min(1, len(turn)), bool), turn[1:] != turn[:-1])).tolist() + [len(turn)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = side[a:b]
            at = at[last[end[at]] < 0]  # one edge into each position passes
            before = np.where(start[at] == head[at], -1, last[start[at]])
            at = at[self._good(before, piece[at])]
            last[end[at]] = piece[at]
        long_edges = np.flatnonzero(is_long)
        if len(long_edges):
            long_edges = long_edges[np.lexsort((start[long_edges], end[long_edges]))]
            self._relax_long(start[long_edges], end[long_edges], piece[long_edges], head[long_edges], last)
        self._keep(words, heads, stops - 1, last)

    def _keep(self, words: list[str], heads: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
        """Read the words' pieces back from their ends and remember them."""
        at, lanes, steps = ends.copy(), np.arange(len(words)), []
        plain = np.ones(len(words), bool)
        while len(lanes):
            p = last[at[lanes]]
            plain[lanes[p < 0]] = False
            lanes, p = lanes[p >= 0], p[p >= 0]
            steps.append((lanes, p))
            at[lanes] -= self.length[p]
            lanes = lanes[at[lanes] > heads[lanes]]
        count = np.zeros(len(words), np.int64)
        for lanes, _ in steps:
            count[lanes] += 1
        stop = np.cumsum(count)
        flat = np.zeros(int(stop[-1]), np.int64)
        for k, (lanes, p) in enumerate(steps):
            flat[stop[lanes] - 1 - k] = p
        flat, a, number, base = flat.tolist(), 0, self.number, self.v.byte_base
        for word, b, whole in zip(words, stop.tolist(), plain.tolist(), strict=True):
            if whole:
                self.known[word] = tuple(flat[a:b])
            a = b
        for i in np.flatnonzero(~plain).tolist():  # words with characters that no piece covers
            out, left, place = [], int(heads[i]), int(ends[i])
            while place > left:
                p = int(last[place])
                if p < 0:
                    out.extend(number[base + b] for b in reversed(words[i][place - left - 1].encode("utf-8", "replace")))
                    place -= 1
                else:
                    out.append(number[p])
                    place -= int(self.length[p])
            self.known[words[i]] = tuple(reversed(out))

    def _relax_long(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, head: np.ndarray, last: np.ndarray) -> None:
        """The edges of long words, one by one in the order of their ends."""
        found, memo = last.tolist(), {}
        for s, e, p, h in zip(start.tolist(), end.tolist(), piece.tolist(), head.tolist(), strict=True):
            if found[e] >= 0:
                continue
            key = (found[s] if s != h else -1, p)
            good = memo.get(key)
            if good is None:
                good = memo[key] = bool(self._good(np.array([key[0]]), np.array([p]))[0])
            if good:
                found[e] = p
        last[:] = found

    def _run(self, n: int) -> tuple[int, ...]:
        """Encoding of n adjacent space marks."""
        if n not in self.runs:
            self.runs[n] = tuple(self.id_of[p] for p in self._merged(SPACE * n))
        return self.runs[n]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        split = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh: set[str] = set()
        for units in split:
            fresh.update(units)
        new = fresh.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED or self.held + sum(map(len, new)) > REMEMBERED_CHARS:
            self.known, self.held, new = {}, 0, fresh
        self.held += sum(map(len, new))
        if self.pairs.n > 4 * REMEMBERED:
            self.pairs = PairTable()
        new = sorted(new)
        a = size = 0
        for b, word in enumerate(new):
            size += len(word) + 1
            if size >= INDEXED or b == len(new) - 1:
                self._learn(new[a : b + 1])
                a, size = b + 1, 0
        known, out = self.known, []
        for text, units in zip(texts, split, strict=True):
            ids: list[int] = []
            for u in units:
                ids += known[u]
            if "  " in text or SPACE in text or text[:1] == " ":
                ids = self._join_marks(ids)
            out.append(ids)
        return out

    def _join_marks(self, ids: list[int]) -> list[int]:
        out, n = [], 0
        for i in ids:
            if i == self.mark:
                n += 1
                continue
            if n:
                out += self._run(n)
                n = 0
            out.append(i)
        return out + list(self._run(n)) if n else out

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        if self.high_bytes.isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            base, parts, held = self.v.byte_base, [], bytearray()
            for i in ids:
                if base <= i < base + 256:
                    held.append(i - base)
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held.clear()
                parts.append(shown[i])
            parts.append(held.decode("utf-8", "replace"))
            text = "".join(parts)
        return text.replace(SPACE, " ").removeprefix(" ")


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder for this vocabulary; it outlives the task."""
    cache, key = worker_cache(), ("sentencepiece", len(vocabulary.pieces), hash(vocabulary.pieces))
    if key not in cache:
        cache[key] = Encoder(vocabulary)
    return cache[key]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of a few million characters."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size > 2_000_000 or b == len(texts) - 1:
            yield a, b + 1
            a, size = b + 1, 0


def encode_texts(docs: DataFrame, model: str, column: str = "text", into: str = "ids") -> DataFrame:
    """The rows of ``docs`` with the ids (array<int>) of ``column``; ``model`` is a path the driver can read."""
    session_of(docs)
    vocabulary = Vocabulary.load(model)
    rest = [c for c in docs.columns if c != into]
    docs = docs.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for a, b in _batches(texts):
                ids = encoder.encode([t or "" for t in texts[a:b]])
                ids = pa.array([x if t is not None else None for x, t in zip(ids, texts[a:b], strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], [*rest, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(None).cast("array<int>")).schema)


def decode_ids(rows: DataFrame, model: str, column: str = "ids", into: str = "text") -> DataFrame:
    """The rows with the text that the ids in ``column`` stand for."""
    session_of(rows)
    vocabulary = Vocabulary.load(model)
    rest = [c for c in rows.columns if c != into]
    rows = rows.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else encoder.decode(x) for x in ids], pa.string())], [*rest, into])

    return rows.mapInArrow(run, rows.withColumn(into, F.lit(None).cast("string")).schema)


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (of the ids joined by commas), decoded_sha256, round_trip for every row."""
    session_of(docs)
    vocabulary = Vocabulary.load(model)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        decimal = encoder.decimal
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _batches(texts):
                part = texts[a:b]
                ids = encoder.encode(part)
                back = [encoder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(t) for t in part], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]), pa.array([t == s for t, s in zip(back, part, strict=True)]),
                    ],
                    names,
                )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
