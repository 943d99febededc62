"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language gives longest matches. A
document is parsed greedily into phrases, each the longest string that occurs in
the language's text; the language that needs the fewest phrases, normalised by
the size of its text, wins. Letters are lower-cased, every run of other
characters counts as one space; every letter of the samples keeps its own code.

Whole texts are parsed, side by side in blocks of ``BLOCK`` characters: each
block is first parsed from a fresh start, then again from the state that the
block before it leaves, until both parses are in one state, from where on they
are the same. The phrases are those of one parse from left to right.

An automaton's transitions are a hash table of about 4 MB for the 60,000
characters of a language, or a dense table where those of all languages take
``DENSE_BYTES`` at most (few languages of small alphabets); both give the same
parse. Bounds of the labelled sample (parameters):
``languages`` languages, those with most learnable documents (of equal ones the
first by name); about ``sample_docs`` documents and at most ``sample_chars``
characters for each, and ``total_chars`` characters in all; of a long text a
stretch from a hashed place.

Defined results: null text and text without a letter give ``und`` with score 0;
so does everything when no labelled document exists; of languages that need
equally many bits the first by name wins; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import session_of, worker_cache

BLOCK = 256
#: Characters that are parsed at a time.
AT_ONCE = 2_000_000
SPACE = 0
#: Bytes that dense tables of all languages together may take in a Python worker.
DENSE_BYTES = 200_000_000


def held_out(doc_id: Column) -> Column:
    """True for the documents no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class ParseTable:
    """Transitions of a suffix automaton over codes below ``alphabet``, probed for many (state, code) at once.

    An open-addressed hash table of 64-bit entries: state * alphabet + code, and the next state in the low ``NEXT`` bits.
    """

    NEXT = np.uint64(24)
    FREE = np.uint64(2**64 - 1)
    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: list[int], alphabet: int):
        step = suffix_automaton(codes)
        sizes = [len(x) for x in step]
        state = np.repeat(np.arange(len(step), dtype=np.uint64), sizes)
        code = np.fromiter((c for x in step for c in x), np.uint64, sum(sizes))
        target = np.fromiter((t for x in step for t in x.values()), np.uint64, sum(sizes))
        self.root = np.zeros(alphabet, np.uint64)
        self.root[list(step[0])] = list(step[0].values())
        bits = max(4, int(2 * len(code)).bit_length())
        self.alphabet, self.shift, self.mask = np.uint64(alphabet), np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.entry = np.full(1 << bits, self.FREE)
        key = state * self.alphabet + code
        slot = (key * self.ODD) >> self.shift
        todo = np.arange(len(key))
        while len(todo):
            free = self.entry[slot[todo]] == self.FREE
            at, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.entry[at] = key[won] << self.NEXT | target[won]
            placed = np.zeros(len(key), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def advance(self, state: np.ndarray, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """States after the code (0: between phrases); phrases that end on the way are added to ``count``."""
        key = state * self.alphabet + code
        slot = (key * self.ODD) >> self.shift
        held = self.entry[slot]
        to = held & np.uint64((1 << int(self.NEXT)) - 1)
        stuck = np.flatnonzero(held >> self.NEXT != key)
        if len(stuck):
            probing = stuck[held[stuck] != self.FREE]
            while len(probing):
                slot[probing] = (slot[probing] + np.uint64(1)) & self.mask
                held = self.entry[slot[probing]]
                hit = held >> self.NEXT == key[probing]
                to[probing[hit]] = held[hit] & np.uint64((1 << int(self.NEXT)) - 1)
                key[probing[hit]] = self.FREE  # settled
                probing = probing[~hit & (held != self.FREE)]
            stuck = stuck[key[stuck] != self.FREE]
            fresh = self.root[code[stuck]]  # a phrase begins here; a code that the language's text lacks is one
            to[stuck] = fresh
            count[stuck] += (state[stuck] > 0).astype(np.int32) + (fresh == 0)
        return to


class DenseTable:
    """The same as ``ParseTable`` with one cell for each (state, code): 4 * next state + phrases that end on the way."""

    def __init__(self, codes: list[int], alphabet: int):
        step = suffix_automaton(codes)
        cells = np.empty((len(step), alphabet), np.uint32)
        cells[:] = [4 * step[0][c] + 1 if c in step[0] else 2 for c in range(alphabet)]
        cells[0] = [4 * step[0][c] if c in step[0] else 1 for c in range(alphabet)]
        rows = np.repeat(np.arange(len(step)), [len(x) for x in step])
        cells[rows, np.fromiter((c for x in step for c in x), np.int64, len(rows))] = np.fromiter((4 * v for x in step for v in x.values()), np.int64, len(rows))
        self.cells, self.alphabet = cells.reshape(-1), np.uint64(alphabet)

    def advance(self, state: np.ndarray, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        got = self.cells[state * self.alphabet + code]
        count += (got & np.uint32(3)).astype(np.int32)
        return (got >> np.uint32(2)).astype(np.uint64)


def tables_of(coded: list[list[int]], alphabet: int) -> list[DenseTable] | list[ParseTable]:
    """A table for each language; dense ones (faster, same results) where all of them are small."""
    dense = sum(2 * 4 * (len(c) + 1) * alphabet for c in coded) <= DENSE_BYTES
    return [(DenseTable if dense else ParseTable)(c, alphabet) for c in coded]


def letters() -> np.ndarray:
    """For every code point: is it a letter."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def encode(texts: list[str], code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts in a row, where each begins (and the end), and the number of letters of each."""
    parts, counts = [], []
    for text in texts:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = code_of[points]
        keep = code != SPACE
        counts.append(int(keep.sum()))
        keep[1:] |= code[:-1] != SPACE
        parts.append(code[keep])
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=begins[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), begins, np.array(counts, np.int64)


def phrases(codes: np.ndarray, begins: np.ndarray, tables: list[DenseTable] | list[ParseTable]) -> np.ndarray:
    """Phrases that each text (row) needs in each language (column)."""
    sizes = np.diff(begins)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    head = begins[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    filled = np.minimum(BLOCK, begins[owner + 1] - head)
    order = np.argsort(-filled, kind="stable")  # full blocks first: the later steps need only some
    live = np.searchsorted(-filled[order], -np.arange(BLOCK), "left")
    out = np.zeros((len(sizes), len(tables)), np.int64)
    if not len(owner):
        return out
    follows = np.append(owner[1:] == owner[:-1], False)  # the next block is of the same text
    deep = int(filled.max())
    steps = codes[np.minimum(head[order] + np.arange(deep)[:, None], len(codes) - 1)]
    back = np.argsort(order)
    for k, table in enumerate(tables):
        states, counts = np.zeros((deep, len(owner)), np.uint32), np.zeros((deep, len(owner)), np.int32)
        state, count = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.int32)
        for t in range(deep):
            n = live[t]
            state = table.advance(state[:n], steps[t, :n], count[:n])
            states[t, :n], counts[t, :n] = state, count[:n]
        fresh_last = states[filled - 1, back]
        last, total = fresh_last.copy(), counts[filled - 1, back]
        fresh_total = total.copy()
        # parse on from where the block before really ends, until the fresh parse is met
        redo = np.flatnonzero(follows & (last > 0)) + 1
        while len(redo):
            at, state, count, before = redo, last[redo - 1].astype(np.uint64), np.zeros(len(redo), np.int32), last[redo]
            t = 0
            while len(at):
                state = table.advance(state, codes[head[at] + t], count)
                met = state == states[t, back[at]]
                here = at[met]
                total[here], last[here] = count[met] + fresh_total[here] - counts[t, back[here]], fresh_last[here]
                ends = ~met & (filled[at] == t + 1)
                total[at[ends]], last[at[ends]] = count[ends], state[ends]
                on = ~met & ~ends
                at, state, count, t = at[on], state[on], count[on], t + 1
            changed = redo[last[redo] != before]
            redo = changed[follows[changed]] + 1
        open_ = ~follows & (last > 0)  # the text ends inside a phrase
        out[:, k] = np.bincount(owner, total + open_, len(sizes)).astype(np.int64)
    return out


def _model(samples: dict[str, list[str]]) -> tuple[list[str], np.ndarray, list[DenseTable] | list[ParseTable], np.ndarray]:
    """Languages, code of each code point (every letter of the samples has its own), parse tables, log sizes."""
    cache, key = worker_cache(), ("langid", hash(tuple((k, len(v), hash(tuple(v))) for k, v in sorted(samples.items()))))
    if key not in cache:
        alpha = letters()
        used = np.unique(np.concatenate([np.frombuffer("".join(v).lower().encode("utf-32-le", "surrogatepass"), np.uint32) for v in samples.values()]))
        used = used[alpha[used]]
        code_of = np.zeros(0x110000, np.uint64)
        code_of[alpha] = 1  # a letter of no sample is a phrase in every language
        code_of[used] = 2 + np.arange(len(used), dtype=np.uint64)
        names = sorted(samples)
        coded = [encode(["\n".join(samples[k])], code_of)[0].tolist() for k in names]
        cache[key] = (names, code_of, tables_of(coded, len(used) + 2), np.log(np.array([len(c) + 2.0 for c in coded])))
    return cache[key]


def _predict(samples: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if not samples:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts))], ["doc_id", "lang_pred", "score"])
                continue
            names, code_of, tables, logs = _model(samples)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                    size += len(texts[end])
                    end += 1
                codes, begins, count = encode(texts[at:end], code_of)
                bits = phrases(codes, begins, tables) * logs
                best = bits.argmin(1)
                spread = np.exp(-(bits - bits.min(1, keepdims=True)) / 4)
                score = np.where(count > 0, 1 / spread.sum(1), 0.0)
                names_out = [names[b] if n else "und" for b, n in zip(best, count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(names_out, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                at = end

    return run


def language_sample(docs: DataFrame, sample_docs: int, sample_chars: int, languages: int, total_chars: int) -> dict[str, list[str]]:
    """Labelled texts of each language, within the bounds; the same ones on every run."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not sizes:
        return {}
    sample_chars = min(sample_chars, total_chars // len(sizes))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(np.ceil(1e6 * min(1.0, 2 * sample_docs / n)))))])
    each = max(1, 4 * sample_chars // sample_docs)
    # of a long text one stretch, at a place that a hash of its doc_id sets
    at = (1 + F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.length("text") - each + 1, F.lit(1)))).cast("int")
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", F.xxhash64("doc_id").alias("h"), F.substr(F.col("text"), at, F.lit(each)).alias("text"))
    found: dict[str, list[str]] = {k: [] for k in sizes}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        have = found[r["lang"]]
        if len(have) < 2 * sample_docs and (room := sample_chars - sum(map(len, have))) > 0:
            skip = r["h"] % max(1, len(r["text"]) - room + 1)
            have.append(r["text"][skip : skip + room])
    return found


def identify_languages(docs: DataFrame, sample_docs: int = 100, sample_chars: int = 60_000, languages: int = 200, total_chars: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang); lang is read only for the sample."""
    session_of(docs)
    samples = language_sample(docs, sample_docs, sample_chars, languages, total_chars)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_predict(samples), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
