"""Nested leave-one-run-out ridge encoding, one group (subject, condition, ...) a task.

A group is one subject's scans under one condition: rows of run, scan, a
feature vector x, nuisance vector z and target vector y. Every fit uses
training runs only: residualise x and y on z, standardise x, reduce by
principal components, then ridge. The training set "all runs but i and j" serves
the outer fold i with inner fold j and the other way round, so its
decomposition is made once.

Fits and scores need only sums of products of a run's columns (1, x, z, y), and the
R of the QR decomposition of these columns has the same ones. So a run of many
scans is held as R, and a task's memory depends on the columns, not on the scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# --- fixed values ---
ALPHAS = np.logspace(-2, 6, 15)
COMPONENTS, VARIANCE = 128, 0.95
SD_FLOOR, R_CLIP = 1e-6, 0.999999
#: A column is constant if what is left of it without its mean is this share of it: rounding.
ROUNDING = 1e-12
#: Bytes of scans that a task holds before it replaces them by fewer.
HELD = 16_000_000
# --- end of fixed values ---


def centred(a: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The columns without their means; ``one`` is the column of ones (of its R, where rows are R)."""
    return a - one[:, None] * (one @ a / (one @ one))


def target_r(y: np.ndarray, fitted: np.ndarray, one: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pearson r of each column, clipped; 0 for a constant one. ``size``: the sum of squares of y before residualisation."""
    a, b = centred(y, one), centred(fitted, one)
    aa, bb = (a * a).sum(0), (b * b).sum(0)
    moves = (aa > ROUNDING**2 * np.maximum(size, (y * y).sum(0))) & (bb > ROUNDING**2 * (fitted * fitted).sum(0))
    under = np.sqrt(aa * bb)
    r = np.divide((a * b).sum(0), under, out=np.zeros(y.shape[1]), where=moves & (under > 0))
    return np.clip(r, -R_CLIP, R_CLIP)


class Fold:
    """A ridge model for every alpha, fitted on the training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, train: np.ndarray, one: np.ndarray | None = None):
        zt, ones = z[train], (np.ones(len(z)) if one is None else one)[train]
        n = ones @ ones
        rcond = np.finfo(float).eps * max(n, z.shape[1])
        self.of_x, *_ = np.linalg.lstsq(zt, x[train], rcond=rcond)
        self.of_y, *_ = np.linalg.lstsq(zt, y[train], rcond=rcond)
        rest = x[train] - zt @ self.of_x
        self.mean = ones @ rest / n
        rest = rest - ones[:, None] * self.mean
        square = (rest**2).sum(0)
        sd = np.sqrt(square / n)
        self.sd = np.where(sd < SD_FLOOR, 1.0, sd)
        self.sd[square <= ROUNDING**2 * (x[train] ** 2).sum(0)] = np.inf  # says nothing
        standard = rest / self.sd
        self.centre = ones @ standard / n
        standard = standard - ones[:, None] * self.centre
        _, s, axes = np.linalg.svd(standard, full_matrices=False)
        part = s**2 / max((s**2).sum(), 1e-300)
        most = min(COMPONENTS, len(s))
        keep = min(most, int(np.searchsorted(np.cumsum(part[:most]), VARIANCE)) + 1)
        self.axes = axes[:keep]
        u, self.s, self.vt = np.linalg.svd(standard @ self.axes.T, full_matrices=False)
        self.uty = u.T @ (y[train] - zt @ self.of_y)

    def predict(self, x: np.ndarray, z: np.ndarray, alpha: float, one: np.ndarray | None = None) -> np.ndarray:
        ones = (np.ones(len(x)) if one is None else one)[:, None]
        scores = ((x - z @ self.of_x - ones * self.mean) / self.sd - ones * self.centre) @ self.axes.T
        return scores @ (self.vt.T @ ((self.s / (self.s**2 + alpha))[:, None] * self.uty))

    def target(self, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        return y - z @ self.of_y


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, runs: np.ndarray, alphas: Sequence[float] = ALPHAS, one: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, z, r2) of every target over outer leave-one-run-out folds. A run's rows are scans (``one`` is 1, or absent) or R of (one, x, z, y)."""
    names = np.unique(runs)
    if len(names) < 3:
        raise ValueError("nested leave-one-run-out needs three runs")
    x, y, z, one = (np.asarray(a, float) for a in (x, y, z, np.ones(len(x)) if one is None else one))
    size = {held: (y[runs == held] ** 2).sum(0) for held in names}
    inner: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for i, j in combinations(names, 2):
        fold = Fold(x, y, z, (runs != i) & (runs != j), one)
        for outer, held in ((i, j), (j, i)):
            rows = runs == held
            truth = fold.target(y[rows], z[rows])
            inner[outer, held] = np.array([np.arctanh(target_r(truth, fold.predict(x[rows], z[rows], a, one[rows]), one[rows], size[held])) for a in alphas])
    sse, total, square, n = (np.zeros(y.shape[1]) for _ in range(4))
    fold_z = []
    for outer in names:
        mean = np.mean([inner[outer, held] for held in names if held != outer], axis=0)
        chosen = len(alphas) - 1 - mean[::-1].argmax(0)  # the larger alpha of equals
        fold, rows = Fold(x, y, z, runs != outer, one), runs == outer
        ones = one[rows]
        truth, fitted = fold.target(y[rows], z[rows]), np.empty((rows.sum(), y.shape[1]))
        for a in np.unique(chosen):
            fitted[:, chosen == a] = fold.predict(x[rows], z[rows], alphas[a], ones)[:, chosen == a]
        fold_z.append(np.arctanh(target_r(truth, fitted, ones, size[outer])))
        sse += ((truth - fitted) ** 2).sum(0)
        total, square, n = total + ones @ truth, square + (truth**2).sum(0), n + ones @ ones
    mean_z, spread = np.mean(fold_z, axis=0), square - total**2 / n
    moves = spread > ROUNDING**2 * sum(size.values())
    return np.tanh(mean_z), mean_z, np.where(moves, 1 - sse / np.where(moves, spread, 1), 0.0)


def _codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each different row of the columns."""
    code = np.zeros(len(table), np.int64)
    for c in columns:
        found = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    return code


def _vectors(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, and where each row's begin and how many they are."""
    lists = table.column(column).combine_chunks()
    if lists.null_count:
        raise ValueError(f"a scan without {column}")
    many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(many) - many, many


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat, _, many = _vectors(table, column)
    if (many != many[0]).any():
        raise ValueError(f"{column} of a group differs in length")
    return flat.reshape(len(many), many[0])


def _fewer(table: pa.Table, keys: list[str]) -> pa.Table:
    """Rows with the same sums of products: R of each run (and keys) that has at least twice as many rows as columns. The others stay, in order."""
    if not len(table):
        return table
    code = _codes(table, [*keys, "run"])
    order = np.argsort(code, kind="stable")
    one = table.column("one").to_numpy()
    parts = {c: _vectors(table, c) for c in ("x", "nuisance", "y")}
    at, ones, made = [], [], {c: ([], []) for c in parts}
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        widths = [int(many[rows[0]]) for _, _, many in parts.values()]
        if any((many[rows] != w).any() for (_, _, many), w in zip(parts.values(), widths, strict=True)):
            raise ValueError("a run's vectors differ in length")
        held = np.column_stack([one[rows], *(flat[start[rows][:, None] + np.arange(w)] for (flat, start, _), w in zip(parts.values(), widths, strict=True))])
        if len(held) >= 2 * held.shape[1]:
            held = np.linalg.qr(held, mode="r")
        at.append(rows[: len(held)])
        ones.append(held[:, 0])
        for (values, many), part, w in zip(made.values(), np.split(held[:, 1:], np.cumsum(widths)[:-1], axis=1), widths, strict=True):
            values.append(part.ravel())
            many.append(np.full(len(held), w))
    out = {c: table.column(c).take(pa.array(np.concatenate(at))) for c in (*keys, "run", "scan")} | {"one": pa.array(np.concatenate(ones))}
    for c, (values, many) in made.items():
        kind = table.schema.field(c).type
        lists = pa.LargeListArray if pa.types.is_large_list(kind) else pa.ListArray
        ends = np.concatenate([[0], np.cumsum(np.concatenate(many))])
        out[c] = lists.from_arrays(pa.array(ends, pa.int64() if lists is pa.LargeListArray else pa.int32()), pa.array(np.concatenate(values)), type=kind)
    return pa.Table.from_arrays([out[c] for c in table.column_names], schema=table.schema)


def _streamed(batches: Iterator[pa.RecordBatch], keys: list[str], flush: bool) -> Iterator[pa.Table]:
    """Fewer rows for all batches, from at most about ``HELD`` bytes of them at a time; with ``flush`` what does not get fewer goes out early."""
    held, size, limit = [], 0, HELD
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= limit:
            held = [_fewer(pa.concat_tables(held), keys)]
            size = held[0].nbytes
            if flush and size > HELD // 2:
                yield held[0]
                held, size = [], 0
            limit = max(HELD, 2 * size)  # so that what is held is not done again for every batch
    if held:
        yield _fewer(pa.concat_tables(held), keys)


_COLUMNS = ["run", "scan", "one", "x", "nuisance", "y"]


def _with_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    vectors = [F.col(c).cast("array<double>").alias(c) for c in ("x", "nuisance", "y")]
    return rows.select(*keys, "run", "scan", (F.col("one") if "one" in rows.columns else F.lit(1.0)).alias("one"), *vectors)


def condensed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for ``encode_groups`` with the same fits and scores (but for rounding) before anything is shuffled: each task's scans of a run as their R, where these are many."""
    rows = _with_one(rows, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _streamed(batches, keys, True):
            yield from table.to_batches()

    return rows.mapInArrow(run, rows.schema)


def encode_groups(rows: DataFrame, keys: list[str], targets: list[str] | None) -> DataFrame:
    """keys, target, r, z, r2 from rows of (keys, run, scan, x, nuisance, y): arrays of doubles, y as long as ``targets``. Rows may be ``condensed``.

    Without ``targets`` y may differ in length between groups, and the target's place in it is given as ``position``.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "position int" if targets is None else "target string", "r double, z double, r2 double"])
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table,) = _streamed((b.select(_COLUMNS) for b in batches), [], False)
        table = table.sort_by([("run", "ascending"), ("scan", "ascending")])
        x, z, y = (_matrix(table, c) for c in ("x", "nuisance", "y"))
        found = encode(x, y, z, table.column("run").to_numpy(), one=table.column("one").to_numpy())
        n = y.shape[1]
        names = pa.array(range(n), pa.int32()) if targets is None else pa.array(targets)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()] * n, f.type) for k, f in zip(key, out, strict=False)), names, *map(pa.array, found)], names=out.names)

    return _with_one(rows, keys).groupBy(*keys).applyInArrow(run, schema)


def shuffle_average(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means over shuffles: r through atanh, z and r2 plain."""
    clipped = F.least(F.greatest("r", F.lit(-R_CLIP)), F.lit(R_CLIP))
    return rows.groupBy(*keys).agg(F.tanh(F.avg(F.atanh(clipped))).alias("r"), F.avg("z").alias("z"), F.avg("r2").alias("r2"))
