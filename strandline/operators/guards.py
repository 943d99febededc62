"""Loads and merges that check what they return, and the status rules built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.sets import keep_last, require_unique


def require_some(rows: DataFrame, what: str) -> DataFrame:
    """The rows; raises when there is none."""
    if not rows.take(1):
        raise ValueError(f"no {what}")
    return rows


def of_model(rows: DataFrame, model: str, what: str = "rows", column: str = "model") -> DataFrame:
    """A model's rows of a manifest; raises when it has none."""
    return require_some(rows.where(F.col(column) == model), f"{what} of model {model}")


def runs_of_subject(runs: DataFrame, subject: str, value, order: str) -> DataFrame:
    """A subject's runs in order; raises when it has none."""
    return require_some(runs.where(F.col(subject) == value), f"runs of subject {value}").orderBy(order)


def first_run(runs: DataFrame, subject: str, order: str) -> DataFrame:
    """The first run of each subject."""
    return keep_last(runs, [subject], [F.asc(order)])


def files_by_condition(manifest: DataFrame, keys: list[str], condition: str, path: str) -> DataFrame:
    """keys and files: a map from condition to path; two paths of one condition raise when it is read."""
    pairs = manifest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(condition, path))).alias("sl_pairs"))
    return pairs.select(*keys, F.map_from_entries("sl_pairs").alias("files"))


def complete_groups(rows: DataFrame, group: list[str], member: str, wanted: Sequence) -> DataFrame:
    """group, members (sorted), complete: whether the group has every wanted member."""
    found = rows.groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return found.withColumn("complete", F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), "members")) == 0)


def require_complete(rows: DataFrame, group: list[str], member: str, wanted: Sequence) -> DataFrame:
    """The rows; raises when a group lacks a wanted member."""
    lacking = complete_groups(rows, group, member, wanted).where("not complete").take(1)
    if lacking:
        raise ValueError(f"incomplete: {lacking[0].asDict()}")
    return rows


def joined_with_dimension(rows: DataFrame, dimension: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join with a small table; a row that finds no ``value`` there raises when it is read."""
    joined = rows.join(F.broadcast(dimension), keys, "left")
    missing = F.concat(F.lit(f"no {value} for "), F.to_json(F.struct(*keys)))
    return joined.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(missing).cast(dict(joined.dtypes)[value])).otherwise(F.col(value)))


def usable_first(rows: DataFrame, usable: Column, order: str, n: int) -> DataFrame:
    """The first n usable rows; raises when there are fewer. The cap is the operator."""
    out = rows.where(usable).orderBy(order).limit(n)
    if (found := out.count()) < n:
        raise ValueError(f"{found} usable rows, {n} wanted")
    return out


def priority(path: Column, patterns: Sequence[str]) -> Column:
    """Place of the first pattern a path contains, after all of them for none."""
    out = F.lit(len(patterns))
    for i, p in reversed(list(enumerate(patterns))):
        out = F.when(path.contains(p), i).otherwise(out)
    return out


def present(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that the table has, in the order given."""
    return rows.select(*[n for n in names if n in rows.columns])


def merge_chunks(chunks: Sequence[DataFrame], keys: list[str], model: str | None = None, column: str = "model") -> DataFrame:
    """All chunks by column name; raises for a key that two rows have, and for rows of another model."""
    merged = chunks[0]
    for c in chunks[1:]:
        merged = merged.unionByName(c)
    if model is not None and merged.where(~F.col(column).eqNullSafe(model)).take(1):
        raise ValueError(f"rows of another model than {model}")
    return require_unique(merged, keys)


def merge_latest(chunks: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """All chunks by column name; of a key's rows those of the last chunk that has it."""
    merged = None
    for i, c in enumerate(chunks):
        part = c.withColumn("sl_chunk", F.lit(i))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    newest = F.max("sl_chunk").over(Window.partitionBy(*keys))
    return merged.withColumn("sl_newest", newest).where("sl_chunk = sl_newest").drop("sl_chunk", "sl_newest")


def expected_members(rows: DataFrame, group: list[str], member: str, cap: int | None) -> DataFrame:
    """group, expected: distinct members of each group, ``cap`` at most."""
    n = F.count_distinct(member)
    return rows.groupBy(*group).agg((n if cap is None else F.least(n, F.lit(cap))).cast("bigint").alias("expected"))


def next_step(done: Column, wanted: Column, merged: Column) -> Column:
    """What is to be done for a chunked table: run, resume, merge or nothing."""
    return F.when(done == 0, "run").when(done < wanted, "resume").when(~merged, "merge").otherwise("nothing")


def inclusion_counts(subjects: DataFrame, group: str, included: str) -> DataFrame:
    """group, n_subjects, n_included, n_excluded."""
    inside = F.sum(F.col(included).cast("long"))
    return subjects.groupBy(group).agg(F.count("*").alias("n_subjects"), inside.alias("n_included"), (F.count("*") - inside).alias("n_excluded"))


# --- fixed values: the review limits of an aligned triplet ---
LEAST_SIMILARITY, LEAST_MEAN_SIMILARITY, MOST_COST = 0.35, 0.40, 1.25
MOST_UNRESOLVED = 0.01
# --- end of fixed values ---


def review_flag(similar: Sequence[Column], costs: Sequence[Column], classes: Sequence[Column], lengths: Sequence[Column], source: Column) -> Column:
    """Whether an aligned triplet needs a reader: any of the rules suffices."""
    total = similar[0] + similar[1] + similar[2]
    merged = sum(((n == 2).cast("int") for n in lengths[1:]), (lengths[0] == 2).cast("int"))
    return (F.least(*similar) < LEAST_SIMILARITY) | (total / 3 < LEAST_MEAN_SIMILARITY) | (F.greatest(*costs) > MOST_COST) | (F.size(F.array_distinct(F.array(*classes))) > 1) | (merged > 1) | (source == "needs_fix")


def require_resolved(triplets: DataFrame, source: str = "source", most: float = MOST_UNRESOLVED) -> DataFrame:
    """The triplets; raises when more than ``most`` of them are unresolved."""
    share = triplets.agg(F.avg((F.col(source) == "needs_fix").cast("double"))).first()[0]
    if share is not None and share > most:
        raise ValueError(f"{share:.2%} of the triplets are unresolved")
    return triplets


def masked_update(mask: Column, column: str, value: Column) -> Column:
    """``value`` where the mask holds, the column's own elsewhere (also where the mask is null)."""
    return F.when(mask, value).otherwise(F.col(column))


class Memo:
    """Tables computed once and kept by the executors; ``clear`` lets them go."""

    def __init__(self) -> None:
        self._held: dict[str, DataFrame] = {}

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = make().persist()
        return self._held[name]

    def clear(self) -> None:
        for frame in self._held.values():
            frame.unpersist()
        self._held = {}


# --- atlas ---


def voxel_places(voxels: DataFrame, index: str, shape: tuple[int, int, int], affine: Sequence[Sequence[float]]) -> DataFrame:
    """i, j, k of a voxel number (last axis fastest), its x, y, z by the affine, and the hemisphere by the sign of x."""
    _, b, c = shape
    v = F.col(index)
    at = voxels.withColumns({"i": F.floor(v / (b * c)), "j": F.floor(v / c) % b, "k": v % c})
    place = lambda row: row[0] * F.col("i") + row[1] * F.col("j") + row[2] * F.col("k") + row[3]
    placed = at.withColumns({axis: place(row) for axis, row in zip("xyz", affine, strict=False)})
    return placed.withColumn("hemisphere", F.when(F.col("x") < 0, "L").otherwise("R"))


def regions_of(voxels: DataFrame, label: str) -> DataFrame:
    """region (from 0), label, hemisphere, n_voxels and the mean place of the labelled voxels; raises when there is none."""
    found = voxels.where(F.col(label) > 0).groupBy(label, "hemisphere").agg(F.count("*").alias("n_voxels"), *[F.avg(a).alias(a) for a in "xyz"])
    numbered = found.withColumn("region", F.dense_rank().over(Window.orderBy(label, "hemisphere")) - 1)  # one row a region: few
    return require_some(numbered, "labelled voxel")


def voxels_of_regions(labels: DataFrame, regions: DataFrame, label: list[str], voxel: str) -> DataFrame:
    """Each region's voxels as a sorted list."""
    joined = labels.join(F.broadcast(regions), label)
    return joined.groupBy("region").agg(F.array_sort(F.collect_list(voxel)).alias("voxels"))


def scattered(grid: DataFrame, values: DataFrame, voxel: str, value: str) -> DataFrame:
    """Every voxel of the grid with its value, NaN where the mask left it out."""
    return grid.join(values, voxel, "left").withColumn(value, F.coalesce(value, F.lit(float("nan"))))
