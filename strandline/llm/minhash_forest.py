"""MinHash near-duplicate groups with an LSH forest.

Method: every distinct shingle set gets a 96-value MinHash signature. The forest
is 24 sorted orders of the signatures: order t compares values from 4 t on,
round about. Sets that agree in an order's first 4 values are one region of it (a
pair at similarity 0.8 shares a region with probability 1 - 3e-6). In each order
a set meets its ``neighbours`` predecessors in its region, those of the longest
common prefixes: a small region is compared whole at depth 4, in a large one the
depth grows until about ``neighbours`` sets remain around each. A neighbour is a
candidate when the whole signatures agree as often as those of a pair at
``percent`` do in all but some 3e-7 of cases (five standard deviations).

The orders are dealt by ranges and sorted within them, so no region is gathered,
whatever its size; a pair that a range boundary cuts in one order meets in
others. In a region of many more than ``neighbours`` different sets a linked pair
can stand too far apart in every order and is then lost (the README gives figures). Candidate groups (components of candidates, ids only) are confirmed on
the full shingle sets, in blocks of bounded size, and the confirmed links make
the groups.

Defined results: null or blank text has an empty set and is linked with nothing;
exact copies are one set and always linked; rows with one doc_id are one
document; a null doc_id has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import Words, int64, mix64, prefix_sums, session_of, span_hash, stored, text_chunks
from strandline.llm.components import connected_components

TREES, BASE = 24, 4
VALUES = TREES * BASE
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)

_PRINT_SCHEMA = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, keys array<bigint>, sig binary"
_SET_SCHEMA = "doc_id bigint, grp bigint, chunks int, cc bigint, shingles binary"


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, one text after the other, and where each text's begin (and the end)."""
    words = Words(data, offsets, lower=True)
    first, n = words.first, len(words.hashes)
    sums = prefix_sums(words.hashes, 1)
    whole = span_hash(sums, np.arange(n - size + 1), np.arange(size, n + 1), 1) if n >= size else np.zeros(0, np.uint64)
    parts = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            parts.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            parts.append(span_hash(sums, np.array([a]), np.array([b]), 1))
        else:
            parts.append(np.zeros(0, np.uint64))
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=begins[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), begins


def _tree_keys(signature: np.ndarray) -> np.ndarray:
    """Hashes (rows x TREES) of every tree's values of the signature."""
    tree = np.arange(TREES)
    state = mix64(np.broadcast_to(tree.astype(np.uint64) + np.uint64(1), (len(signature), TREES)))
    for step in range(BASE):
        state = mix64(state + signature[:, BASE * tree + step])
    return state


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                hashes, begins = _sets(data, offsets, size)
                count = np.diff(begins)
                full = np.flatnonzero(count)
                signature = np.zeros((len(count), VALUES), np.uint64)
                k1, k2 = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
                if len(full):
                    at = begins[:-1][full]
                    for k in range(VALUES):
                        signature[full, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _MUL[k], at)
                    k1[full] = np.add.reduceat(mix64(hashes), at)
                    k2[full] = np.add.reduceat(mix64(hashes ^ _XOR[0]), at)
                keys = _tree_keys(signature >> np.uint64(32)).reshape(-1)
                short = ((signature >> np.uint64(32)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(count), int64(k1), int64(k2), pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * TREES), int64(keys)),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "keys", "sig"],
                )

    return run


def agreement(percent: int) -> int:
    """Signature values in which a pair at ``percent`` agrees at least, but for five standard deviations."""
    q = percent / 100
    return max(BASE, int(np.floor(VALUES * q - 5 * np.sqrt(VALUES * q * (1 - q)))))


def neighbour_ties(region: np.ndarray, order: np.ndarray, ids: np.ndarray, neighbours: int, least: int, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ties (least id of a group, other id) among rows sorted by (region, signature); rows under ``known`` are tied already.

    ``order``: rows x VALUES signature values as this order reads them.
    """
    n = len(ids)
    near = np.full(n, -1)
    more: list[np.ndarray] = []
    for j in range(1, min(neighbours, n - 1) + 1):
        at = np.arange(max(j, known), n)
        at = at[region[at] == region[at - j]]
        if not len(at):
            break  # rows of a region are adjacent
        at = at[(order[at] == order[at - j]).sum(1) >= least]
        first = near[at] < 0
        near[at[first]] = at[first] - j
        more.append(np.column_stack([at[~first], at[~first] - j]))
    root = np.where(near >= 0, near, np.arange(n))
    while (root != root[root]).any():
        root = root[root]
    head = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(head, root, ids)
    lead = head[root]
    a, b = [lead[lead != ids]], [ids[lead != ids]]
    if more:
        pairs = np.concatenate(more)
        x, y = lead[pairs[:, 0]], lead[pairs[:, 1]]
        other = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)])[x != y], axis=0)
        a.append(other[:, 0])
        b.append(other[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _ties(neighbours: int, least: int):
    """Candidates among the sorted rows (region, order, rep) of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, ids, order = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint8)
        for batch in batches:
            known = len(ids)
            region, ids = np.append(region, np.asarray(batch.column(0))), np.append(ids, np.asarray(batch.column(2)))
            order = np.concatenate([order, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)])
            a, b = neighbour_ties(region, order, ids, neighbours, least, known)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            region, ids, order = region[-neighbours:], ids[-neighbours:], order[-neighbours:]

    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                hashes, begins = _sets(data, offsets, size)
                sets = pa.array([hashes[x:y].tobytes() for x, y in zip(begins[:-1], begins[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(batch.column(k).slice(a, b - a) for k in (2, 3, 4)), sets], ["doc_id", "grp", "chunks", "cc", "shingles"])

    return run


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Roots (least index) of the groups that links of at least ``percent`` / 100 make.

    ``side``: compare only sets of different sides. Each pair that lies in two groups is compared on the full sets; pairs already grouped are not.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    begins = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    owner = np.repeat(np.arange(n), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    posting, at = owner[by_term], np.searchsorted(term[by_term], np.arange(term.max(initial=-1) + 2))
    group = np.arange(n)
    settled = np.zeros(n, bool)

    def probe(i: int) -> None:
        nonlocal group
        own = term[begins[i] : begins[i + 1]]
        shared = np.bincount(np.concatenate([posting[at[t] : at[t + 1]] for t in own]), minlength=n) if len(own) else np.zeros(n, np.int64)
        hit = 100 * shared >= percent * (sizes + sizes[i] - shared)
        hit &= (group != group[i]) & (sizes > 0)
        if side is not None:
            hit &= side != side[i]
        if sizes[i] and hit.any():
            roots = np.unique(np.append(group[hit], group[i]))
            group[np.isin(group, roots)] = roots[0]

    first = min(n, 8) if side is None else 0
    for i in range(first):
        probe(i)
    if side is None:  # every pair that can still matter has an end outside this group
        settled = group == np.bincount(group, minlength=n).argmax()
    for i in range(first, n):
        if not settled[i] and (side is None or side[i] == 0):
            probe(i)
    return group


def _verify(percent: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("cc", sort=False):
            part = part.sort_values(["doc_id", "chunk"], ignore_index=True)
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            side = None if key[1] == key[2] else (part["chunk"] != key[1]).to_numpy().astype(int)
            root = linked(sets, percent, side)
            ids = part["doc_id"].to_numpy()
            moved = root != np.arange(len(root))
            out.append(pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return run


def candidate_ties(reps: DataFrame, percent: int, neighbours: int) -> DataFrame:
    """(a, b): ids of distinct sets ``reps`` (rep, keys, sig) that are neighbours in some order of the forest."""
    spark = reps.sparkSession
    rows = reps.select("rep", F.posexplode("keys").alias("tree", "region"))
    # stored, so that the join reads two plain exchanges and Spark can split a large region
    regions, _ = stored(rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region"))
    hits = rows.join(regions, "region").join(reps.select("rep", "sig"), "rep")
    order = F.expr(f"concat(substring(sig, {BASE} * tree + 1), substring(sig, 1, {BASE} * tree))")
    ordered = hits.select("region", order.alias("order"), "rep")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(ranges, "region", "order", "rep").sortWithinPartitions("region", "order", "rep")
    return ordered.mapInArrow(_ties(neighbours, agreement(percent)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, neighbours: int = 32, block_shingles: int = 250_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    ``percent``: least shared part of two distinct shingle sets, in hundredths of their union.
    ``neighbours``: predecessors that a set meets in each sorted order.
    ``block_shingles``: shingles that are compared in one task; larger candidate groups are compared block against block.
    """
    spark = session_of(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, _ = stored(texts.mapInArrow(_prints(shingle), _PRINT_SCHEMA))
    known = prints.where("doc_id is not null and n_shingles > 0")
    reps = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("keys", "sig"), "doc_id").alias("own"), F.max("n_shingles").alias("n"))
    reps, _ = stored(reps.select("k1", "k2", "rep", "own.keys", "own.sig", "n"))
    groups = connected_components(candidate_ties(reps, percent, neighbours)).withColumnRenamed("component", "cc")

    weight = groups.join(reps.select(F.col("rep").alias("node"), "n"), "node")
    sized, _ = stored(weight.groupBy("cc").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("chunks"), F.sum("n").alias("weight")))
    total = sized.agg(F.sum("weight")).first()[0] or 0
    buckets = max(1, 4 * total // block_shingles)
    members = groups.join(sized, "cc").select(
        F.col("node").alias("doc_id"), F.when(F.col("chunks") > 1, F.col("cc")).otherwise(-1 - F.pmod(F.xxhash64("cc"), F.lit(buckets))).alias("grp"), "chunks", "cc"
    )
    sets = texts.join(members, "doc_id").select("doc_id", "text", "grp", "chunks", "cc").mapInArrow(_with_sets(shingle), _SET_SCHEMA)
    sets = sets.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "shingles"), F.col("chunks")).cast("int"))
    blocks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("grp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "cc", "doc_id", "chunk", "shingles")
    links = blocks.groupBy("grp", "i", "j").applyInPandas(_verify(percent), "a bigint, b bigint")
    found = connected_components(links)

    answer = prints.select("doc_id", "n_shingles", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    answer = answer.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), component)
    return answer.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
