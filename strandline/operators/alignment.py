"""Monotonic alignment of sequences: sentences across languages, tokens with timed intervals, tree tokens with words.

A section is one group: its alignment depends on order and runs in one task;
sections run in parallel. Costs are those of spans of one or two sentences.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.functions import vectors as V
from strandline.functions.tokens import forms_of, last_class, normal_token
from strandline.operators.guards import LEAST_MEAN_SIMILARITY, LEAST_SIMILARITY, MOST_COST

# --- fixed values ---
COSINE_WEIGHT, LENGTH_WEIGHT, PUNCT_WEIGHT, MERGE_PENALTY = 1.0, 0.25, 0.10, 0.10
TRIPLE_WEIGHTS = (1.0, 1.0, 0.5)
TOKEN_GROUPS = [(1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2), (2, 3), (3, 2), (3, 3)]
# --- end of fixed values ---


def pair_cost(cosine: Column, log_ratio: Column, punct_differs: Column, p: Column, q: Column) -> Column:
    """Cost of a span pair of p and q sentences, in SQL functions."""
    local = COSINE_WEIGHT * (1 - cosine) + LENGTH_WEIGHT * log_ratio + PUNCT_WEIGHT * punct_differs.cast("double")
    return local * (p + q) / 2 + MERGE_PENALTY * ((p - 1) + (q - 1))


@dataclass(frozen=True)
class Span:
    chars: int
    punct: str
    vector: np.ndarray
    length: int


def span_cost(a: Span, b: Span) -> tuple[float, float]:
    """(cost, cosine) of two spans."""
    cosine = float(np.clip(a.vector @ b.vector, -1, 1))
    local = COSINE_WEIGHT * (1 - cosine) + LENGTH_WEIGHT * abs(math.log((a.chars + 1) / (b.chars + 1))) + PUNCT_WEIGHT * (a.punct != b.punct)
    return local * (a.length + b.length) / 2 + MERGE_PENALTY * (a.length + b.length - 2), cosine


def span_tables(a: Section, b: Section) -> dict[tuple[int, int], tuple[list, list]]:
    """By lengths (p, q) of one or two: costs and cosines of every span of ``a`` with every one of ``b``, from one matrix product each."""
    key = id(b)
    if key not in a.tables:
        found = {}
        for p, q in itertools.product((1, 2), repeat=2):
            one, two = ([s.span(i, n) for i in range(len(s) - n + 1)] for s, n in ((a, p), (b, q)))
            if not one or not two:
                continue
            cosine = np.clip(np.stack([x.vector for x in one]) @ np.stack([x.vector for x in two]).T, -1, 1)
            ratio = np.abs(np.log(np.array([x.chars + 1.0 for x in one])[:, None] / np.array([x.chars + 1.0 for x in two])))
            differ = np.array([x.punct for x in one])[:, None] != np.array([x.punct for x in two])
            local = COSINE_WEIGHT * (1 - cosine) + LENGTH_WEIGHT * ratio + PUNCT_WEIGHT * differ
            found[p, q] = ((local * (p + q) / 2 + MERGE_PENALTY * (p + q - 2)).tolist(), cosine.tolist())
        a.tables[key] = found
    return a.tables[key]


def cost_between(a: Section, i: int, p: int, b: Section, j: int, q: int) -> tuple[float, float]:
    """(cost, cosine) of the span of p sentences of ``a`` from i and that of q sentences of ``b`` from j."""
    if p > 2 or q > 2:
        return span_cost(a.span(i, p), b.span(j, q))
    cost, cosine = span_tables(a, b)[p, q]
    return cost[i][j], cosine[i][j]


class Unreachable(ValueError):
    """No path consumes every sentence of every side."""


Block = tuple[tuple[int, ...], tuple[int, ...]]


def monotone_path(counts: Sequence[int], cost: Callable[[tuple[int, ...], tuple[int, ...]], float], longest: int = 2) -> list[Block]:
    """Least-cost path from all starts to all ends, each step taking 1 .. longest of every side: (starts, lengths) blocks.

    Points are visited in lexicographic order, steps too; the first of equal costs wins.
    """
    steps = list(itertools.product(range(1, longest + 1), repeat=len(counts)))
    best: dict[tuple[int, ...], float] = {(0,) * len(counts): 0.0}
    came: dict[tuple[int, ...], tuple[int, ...]] = {}
    end = tuple(counts)
    for point in itertools.product(*(range(n + 1) for n in counts)):
        here = best.get(point)
        if here is None:
            continue
        for step in steps:
            to = tuple(map(sum, zip(point, step, strict=True)))
            if any(t > n for t, n in zip(to, counts, strict=True)):
                continue
            total = here + cost(point, step)
            if total < best.get(to, math.inf):
                best[to], came[to] = total, step
    if end not in best:
        raise Unreachable(f"no path to {end}")
    blocks, at = [], end
    while any(at):
        start = tuple(a - s for a, s in zip(at, came[at], strict=True))
        blocks.append((start, came[at]))
        at = start
    return blocks[::-1]


class Section:
    """Sentences of one side of a section, and its spans on demand."""

    def __init__(self, texts: Sequence[str], vectors: np.ndarray):
        self.texts, self.vectors, self.spans, self.tables = list(texts), np.asarray(vectors, float), {}, {}

    def __len__(self) -> int:
        return len(self.texts)

    def text(self, start: int, length: int) -> str:
        return " ".join(t for t in (x.strip() for x in self.texts[start : start + length]) if t)

    def span(self, start: int, length: int) -> Span:
        """A span's vector is the normalised mean of its sentences' vectors."""
        key = (start, length)
        if key not in self.spans:
            text, mean = self.text(start, length), self.vectors[start : start + length].mean(0)
            self.spans[key] = Span(len(text), last_class(text), mean / max(np.linalg.norm(mean), 1e-12), length)
        return self.spans[key]


def align_pair(a: Section, b: Section) -> list[Block]:
    tables = span_tables(a, b)
    return monotone_path((len(a), len(b)), lambda at, n: tables[n][0][at[0]][at[1]])


def triple_costs(sides: Sequence[Section], at: Sequence[int], n: Sequence[int]) -> list[tuple[float, float]]:
    """(cost, cosine) of the pairs 0-1, 0-2, 1-2."""
    return [cost_between(sides[i], at[i], n[i], sides[j], at[j], n[j]) for i, j in ((0, 1), (0, 2), (1, 2))]


def align_triple(sides: Sequence[Section], start: Sequence[int], counts: Sequence[int]) -> list[Block]:
    """Three-way path inside a window."""

    def cost(at: tuple[int, ...], n: tuple[int, ...]) -> float:
        return sum(w * c for w, (c, _) in zip(TRIPLE_WEIGHTS, triple_costs(sides, [s + x for s, x in zip(start, at, strict=True)], n), strict=True))

    return [(tuple(s + x for s, x in zip(start, at, strict=True)), n) for at, n in monotone_path(counts, cost)]


@dataclass
class Triplet:
    start: tuple[int, ...]
    length: tuple[int, ...]
    source: str


def merge_paths(sides: Sequence[Section], left: list[Block], right: list[Block]) -> tuple[list[Triplet], int, int]:
    """Triplets from two pairwise paths over the first side; also the number of conflicts and of unresolved windows.

    Where both paths take equally many sentences of the first side the blocks
    join directly. Otherwise the window up to the next boundary both paths have
    is aligned three-way; if that has no path, a window one sentence wider each
    way (out to shared boundaries); if that has none, one block to be fixed.
    """
    ends = [[0, *(at[0] + n[0] for at, n in path)] for path in (left, right)]
    shared = sorted(set(ends[0]) & set(ends[1]))
    # for each path, the position of the other side at every boundary of the first side
    other = [{0: 0, **{at[0] + n[0]: at[1] + n[1] for at, n in path}} for path in (left, right)]
    begins = [{at[0]: (at, n) for at, n in path} for path in (left, right)]
    total = len(sides[0])
    out: list[Triplet] = []
    conflicts = unresolved = cursor = 0

    def window(a: int, b: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        start = (a, other[0][a], other[1][a])
        return start, tuple(e - s for s, e in zip(start, (b, other[0][b], other[1][b]), strict=True))

    while cursor < total:
        (at, n), (at2, n2) = begins[0][cursor], begins[1][cursor]
        if n[0] == n2[0]:
            out.append(Triplet((cursor, at[1], at2[1]), (n[0], n[1], n2[1]), "pairwise_agree"))
            cursor += n[0]
            continue
        conflicts += 1
        stop = next(b for b in shared if b > cursor)
        try:
            solved, reach = align_triple(sides, *window(cursor, stop)), stop
        except Unreachable:
            wide = (max(b for b in shared if b <= max(0, cursor - 1)), min(b for b in shared if b >= min(total, stop + 1)))
            if wide == (cursor, stop):
                raise
            while out and out[-1].start[0] + out[-1].length[0] > wide[0]:
                out.pop()
            reach = wide[1]
            try:
                solved = align_triple(sides, *window(*wide))
            except Unreachable:
                unresolved += 1
                out.append(Triplet(*window(*wide), "needs_fix"))
                solved = []
        out += [Triplet(s, k, "tri_repair") for s, k in solved]
        cursor = reach
    return out, conflicts, unresolved


def triplet_rows(sides: Sequence[Section]) -> list[dict]:
    """Aligned triplets of a section with similarities, costs and review flags."""
    triplets, _, _ = merge_paths(sides, align_pair(sides[0], sides[1]), align_pair(sides[0], sides[2]))
    rows = []
    for i, t in enumerate(triplets):
        costs = triple_costs(sides, t.start, t.length)
        spans = [s.span(a, n) for s, a, n in zip(sides, t.start, t.length, strict=True)]
        similar = [c for _, c in costs]
        review = min(similar) < LEAST_SIMILARITY or sum(similar) / 3 < LEAST_MEAN_SIMILARITY or max(c for c, _ in costs) > MOST_COST or len({s.punct for s in spans}) > 1 or sum(n == 2 for n in t.length) > 1 or t.source == "needs_fix"
        rows.append({
            "triplet": i, "start0": t.start[0], "start1": t.start[1], "start2": t.start[2], "pattern": "-".join(map(str, t.length)), "source": t.source,
            "mean_similarity": sum(similar) / 3, "max_cost": max(c for c, _ in costs), "char_ratio1": abs(math.log((spans[0].chars + 1) / (spans[1].chars + 1))), "char_ratio2": abs(math.log((spans[0].chars + 1) / (spans[2].chars + 1))), "needs_review": bool(review),
        })
    return rows


def by_section(sentences: DataFrame) -> DataFrame:
    """Dealt by section in as many parts as the session shuffles into: sections are small, their alignment is not, so parts must not be joined by size."""
    return sentences.repartition(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), "section")


def over_sections(left: DataFrame, right: DataFrame, run: Callable[[int, dict, dict], Iterable[tuple]], schema: str, size: int = 10_000) -> DataFrame:
    """``run(section, left rows, right rows)`` of every section that either side has, rows as lists by column in the order of ``idx``.

    Sections are many and short, so a frame for each would cost more than its work: both sides come in one sorted
    stream and one section at a time is held.
    """
    both = by_section(left.withColumn("sl_side", F.lit(0)).unionByName(right.withColumn("sl_side", F.lit(1)), allowMissingColumns=True))
    types = to_arrow_schema(StructType.fromDDL(schema))

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key = held = None
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            where, side = rows.pop("section"), rows.pop("sl_side")
            edges = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1] or side[i] != side[i - 1]), len(where)]
            for a, b in itertools.pairwise(edges):
                if a == b:
                    continue
                if held is None or where[a] != key:
                    if held is not None:
                        yield key, *held
                    key, held = where[a], ({c: [] for c in rows}, {c: [] for c in rows})
                for c, values in rows.items():
                    held[side[a]][c] += values[a:b]
        if held is not None:
            yield key, *held

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for section, one, two in sections(batches):
            out += run(section, one, two)
            if len(out) >= size:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return both.sortWithinPartitions("section", "sl_side", F.asc_nulls_last("idx")).mapInArrow(stream, schema)


TRIPLET_SCHEMA = "section bigint, triplet int, start0 int, start1 int, start2 int, pattern string, source string, mean_similarity double, max_cost double, char_ratio1 double, char_ratio2 double, needs_review boolean"


def align_sections(sentences: DataFrame) -> DataFrame:
    """Triplets for every section of (section, side 0..2, idx, text, vec); a section without a path raises."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sides = []
        frame = frame.sort_values(["side", "idx"])
        for k in range(3):
            part = frame[frame["side"] == k]
            sides.append(Section(part["text"].tolist(), np.stack(part["vec"].to_numpy()) if len(part) else np.zeros((0, 1))))
        rows = pd.DataFrame(triplet_rows(sides))
        rows.insert(0, "section", key[0])
        return rows

    return by_section(sentences).groupBy("section").applyInPandas(run, TRIPLET_SCHEMA)


def align_pairs(sentences: DataFrame) -> DataFrame:
    """Pairwise blocks of sides 0 and 1 for every section: starts, lengths and cost."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (Section(p["text"].tolist(), np.stack(p["vec"].to_numpy())) for p in (frame[frame["side"] == k].sort_values("idx") for k in (0, 1)))
        rows = [(key[0], i, s[0], n[0], s[1], n[1], span_cost(a.span(s[0], n[0]), b.span(s[1], n[1]))[0]) for i, (s, n) in enumerate(align_pair(a, b))]
        return pd.DataFrame(rows, columns=["section", "block", "start0", "length0", "start1", "length1", "cost"])

    return by_section(sentences.where("side < 2")).groupBy("section").applyInPandas(run, "section bigint, block int, start0 int, length0 int, start1 int, length1 int, cost double")


class Forms:
    """Spellings of groups of consecutive tokens in normal spelling, each on demand and once."""

    def __init__(self, tokens: Sequence[str], language: str):
        self.tokens, self.language, self.found = tokens, language, {}

    def of(self, start: int, length: int) -> set[str]:
        key = (start, length)
        if key not in self.found:
            self.found[key] = forms_of(list(self.tokens[start : start + length]), self.language)
        return self.found[key]


def soft_token(token: str) -> bool:
    """Punctuation (in normal spelling) that may be skipped."""
    return not token or token == "..." or all(c in "-.?!,:;\"'" for c in token)


def align_tokens(words: Sequence[str], intervals: Sequence[str], language: str = "", reach: int = 3) -> tuple[list[tuple[int, int] | None], str]:
    """(first, last interval) of each word, None where it has none, and 'exact' or 'approx'.

    Greedy: the first group in the order of preference that is equal; else skip
    punctuation (intervals first); else the nearest equal token ahead on either
    side; else one of each is left out.
    """
    found: list[tuple[int, int] | None] = [None] * len(words)
    words, intervals = [normal_token(t) for t in words], [normal_token(t) for t in intervals]
    left, right = Forms(words, language), Forms(intervals, language)
    i = j = missed = 0
    while i < len(words) and j < len(intervals):
        if words[i] and words[i] == intervals[j]:  # the first group of all, equal without its forms
            found[i] = (j, j)
            i, j = i + 1, j + 1
            continue
        group = next(((a, b) for a, b in TOKEN_GROUPS if i + a <= len(words) and j + b <= len(intervals) and not left.of(i, a).isdisjoint(right.of(j, b))), None)
        if group:
            a, b = group
            found[i : i + a] = [(j, j + b - 1)] * a
            i, j = i + a, j + b
            continue
        if soft_token(intervals[j]):
            j, missed = j + 1, missed + 1
            continue
        if soft_token(words[i]):
            i, missed = i + 1, missed + 1
            continue
        ahead = next((d for d in range(1, reach + 1) if j + d < len(intervals) and not left.of(i, 1).isdisjoint(right.of(j + d, 1))), None)
        later = next((d for d in range(1, reach + 1) if i + d < len(words) and not left.of(i + d, 1).isdisjoint(right.of(j, 1))), None)
        if ahead is not None and (later is None or ahead <= later):
            j, missed = j + ahead, missed + ahead
        elif later is not None:
            i, missed = i + later, missed + later
        else:
            i, j, missed = i + 1, j + 1, missed + 2
    missed += len(words) - i + len(intervals) - j
    return found, "approx" if missed else "exact"


def align_token_sections(words: DataFrame, intervals: DataFrame, language: str = "") -> DataFrame:
    """onset and offset of every word (section, idx, token) from the intervals (section, idx, token, onset, offset) of its section."""

    def run(section: int, left: dict, right: dict) -> Iterator[tuple]:
        kept = [(idx, token) for idx, token in zip(left["idx"], left["token"], strict=True) if normal_token(token)]
        found, status = align_tokens([token for _, token in kept], right["token"], language)
        on, off = right["onset"], right["offset"]
        for (idx, token), at in zip(kept, found, strict=True):
            yield section, idx, token, at and on[at[0]], at and off[at[1]], status

    return over_sections(words.select("section", "idx", "token"), intervals.select("section", "idx", "token", "onset", "offset"), run, "section bigint, idx int, token string, onset double, offset double, status string")


def consume_sentence(tree: Sequence[str], rows: Sequence[str], language: str = "", start: int = 0) -> int:
    """Rows (from ``start`` on) that a sentence's tree tokens take up.

    Edit distance with free matches of groups of up to 4 (zh: 5); the end is the
    cheapest, then the nearest to the token count, then the one with most matched
    tokens, then the earliest. Raises over the cost limit.
    """
    n, zh, left = len(tree), language == "zh", len(rows) - start
    if not n:
        return 0
    if left <= 0:
        raise ValueError("no rows left for the sentence")
    most = min(left, max(n + 12, 3 * n) if zh else max(n + 8, 2 * n))
    widest = 5 if zh else 4
    limit = max(4.0, 0.40 * n) if zh else max(3.0, 0.25 * n)
    tree = [normal_token(t) for t in tree]
    # as many rows that are the tokens themselves cost nothing and are nearest: no other end can be before that one
    if n <= most and all(t and t == normal_token(r) for t, r in zip(tree, rows[start : start + n], strict=True)):
        return n
    rows = [normal_token(t) for t in rows[start : start + most]]
    score: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, 0)}  # cost, -matches

    def offer(at: tuple[int, int], value: tuple[float, int]) -> None:
        if value[0] <= limit and value < score.get(at, (math.inf, 0)):  # costs only grow: a path over the limit ends over it
            score[at] = value

    forms = Forms(tree, language), Forms(rows, language)  # each group's once, and only where a path comes by
    for i in range(n + 1):
        for j in range(most + 1):
            here = score.get((i, j))
            if here is None:
                continue
            cost, minus = here
            if i < n:
                offer((i + 1, j), (cost + 1, minus))
            if j < most:
                offer((i, j + 1), (cost + 1, minus))
            for a in range(1, min(widest, n - i) + 1):
                for b in range(1, min(widest, most - j) + 1):
                    if not forms[0].of(i, a).isdisjoint(forms[1].of(j, b)):
                        offer((i + a, j + b), (cost, minus - max(a, b)))
    ends = [(score[(n, j)][0], abs(j - n), score[(n, j)][1], j) for j in range(1, most + 1) if (n, j) in score]
    if not ends or min(ends)[0] > limit:
        raise ValueError("the sentence does not fit the rows")
    return min(ends)[3]


def sentence_spans(words: DataFrame, trees: DataFrame, language: str = "") -> DataFrame:
    """Sentences of a section from its timed words (section, idx, token, onset, offset) and its tree sentences (section, sentence, tokens)."""
    glue = "" if language == "zh" else " "

    def run(section: int, left: dict, right: dict) -> Iterator[tuple]:
        at, tokens = 0, left["token"]
        for sentence, tree in zip(right["idx"], right["tokens"], strict=True):
            taken = consume_sentence(tree, tokens, language, at)
            if not taken:
                raise ValueError(f"sentence {sentence} of section {section} is empty")
            on, off = ([v for v in left[c][at : at + taken] if v is not None and v == v] for c in ("onset", "offset"))
            yield section, sentence, glue.join(tokens[at : at + taken]), min(on, default=None), max(off, default=None), taken
            at += taken

    return over_sections(words.select("section", "idx", "token", "onset", "offset"), trees.select("section", F.col("sentence").alias("idx"), "tokens"), run, "section bigint, sentence int, text string, onset double, offset double, n_words int")


def flag_ratio_outliers(rows: DataFrame, ratios: Sequence[str]) -> DataFrame:
    """needs_review also where a length ratio is an outlier, with a note only where there was none."""
    from strandline.operators.inference import iqr_outliers

    out = rows.withColumn("sl_flag", F.lit(False))
    for r in ratios:
        out = iqr_outliers(out, r, []).withColumn("sl_flag", F.col("sl_flag") | F.col("is_outlier")).drop("is_outlier")
    note = F.when(F.col("sl_flag") & (F.coalesce("note", F.lit("")) == ""), "char_ratio_outlier").otherwise(F.col("note"))
    return out.withColumns({"needs_review": F.col("needs_review") | F.col("sl_flag"), "note": note}).drop("sl_flag")


def cosine_of(a: Column, b: Column) -> Column:
    return V.cosine_clipped(a, b)
