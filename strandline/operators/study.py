"""The study's pipeline: sentence spans and features to designs, designs and targets to subject metrics.

A design depends on the stimulus only, so all subjects of a language (and all
regions, or voxels) are targets side by side: one decomposition of a design serves
them all. Targets are dealt into chunks of bounded width; a task fits one
(language, layer, condition, shuffle, chunk).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.operators import encoding as E
from strandline.operators import inference as I
from strandline.operators import metrics as M
from strandline.operators import timeseries as T
from strandline.sources.sinks import append_missing

# --- fixed values ---
CHUNK = 512
#: Acoustic regressors, and those left out in each nuisance mode.
ACOUSTIC, PITCH = ["rms", "pitch"], ["pitch"]
MODES = {"full": [], "no_acoustic": ACOUSTIC, "no_pitch": PITCH}
LAGS = 4
# --- end of fixed values ---


@dataclass(frozen=True)
class Variant:
    """One robustness setting: which features, design, nuisance and targets it uses."""

    name: str
    features: str = "pooled"
    design: str = "hrf"
    nuisance: str = "full"
    targets: str = "region"


VARIANTS = [
    Variant("last_token", features="last_token"), Variant("fir", design="fir"), Variant("no_acoustic", nuisance="no_acoustic"), Variant("no_pitch", nuisance="no_pitch"),
    Variant("context", features="context"), Variant("voxelwise", targets="voxel"),
]


def sentence_weights(spans: DataFrame, keys: list[str], sentence: str, kernel: list[float], hz: float, bins: int, tr: float, scans: int, fir: bool = False) -> DataFrame:
    """keys, scan, sentence, w: each sentence's boxcar convolved with the kernel, at the scans; without the kernel (``fir``) its share of the scan's bins."""
    boxes = T.interval_bins(spans, F.col("onset"), F.col("offset"), hz, bins).select(*keys, sentence, "bin", F.lit(1.0).alias("x"))
    if fir:
        each = tr * hz
        held = boxes.groupBy(*keys, sentence, F.least(F.floor(F.col("bin") / each), F.lit(scans - 1)).cast("int").alias("scan")).agg((F.sum("x") / each).alias("w"))
        return held
    return T.convolved_at_scans(boxes, [*keys, sentence], kernel, hz, tr, scans).withColumnRenamed("y", "w")


def design(weights: DataFrame, features: DataFrame, language: str, runs: list[str], sentence: str, kinds: list[str], scans: int) -> DataFrame:
    """language, kinds, runs, scan, x: the scan's weighted sum of feature vectors, for every scan (zeros where no sentence reaches).

    A sentence's weights meet its vectors; each task adds up what it reads, so it holds the designs of its own size and a batch, however many sentences there are.
    """
    keys = [language, *kinds]
    types = dict(features.dtypes) | dict(weights.dtypes)
    held = weights.groupBy(language, sentence).agg(F.collect_list(F.struct(*runs, "scan", "w")).alias("sl_w"))
    met = features.select(*keys, sentence, "vec").join(held, [language, sentence]).select(*keys, "vec", "sl_w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("sl_w")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            frame = pd.DataFrame({c: flat.field(c).to_numpy(zero_copy_only=False) for c in (*runs, "scan", "w")} | {"sl_row": row})
            for c in keys:
                frame[f"sl_{c}"] = batch.column(c).to_pandas().to_numpy()[row]
            vectors = batch.column("vec").to_pandas()
            for name, part in frame.groupby([*(f"sl_{c}" for c in keys), *runs], sort=False):
                used, place = np.unique(part["sl_row"].to_numpy(), return_inverse=True)
                basis = np.zeros((scans, len(used)))
                np.add.at(basis, (part["scan"].to_numpy(), place), part["w"].to_numpy())
                sums[name] = sums.get(name, 0.0) + basis @ np.stack(vectors.iloc[used].to_numpy()).astype(float)
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * scans, f.type) for v, f in zip(name, out, strict=False)), pa.array(np.arange(scans), pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=out.names)

    schema = ", ".join([*(f"{c} {types[c]}" for c in (*keys, *runs)), "scan int, x array<double>"])
    out = to_arrow_schema(StructType.fromDDL(schema))
    parts = met.mapInArrow(run, schema).groupBy(*keys, *runs, "scan").agg(F.collect_list("x").alias("sl_x"))  # one a task at most
    total = F.aggregate(F.slice("sl_x", 2, F.size("sl_x")), F.element_at("sl_x", 1), lambda t, x: F.zip_with(t, x, lambda a, b: a + b))
    every = features.groupBy(*keys).agg(F.max(F.size("vec")).alias("sl_width")).join(weights.select(language, *runs).distinct(), language)
    every = every.withColumn("scan", F.explode(F.sequence(F.lit(0), F.lit(scans - 1))))
    rows = every.join(parts.select(*keys, *runs, "scan", total.alias("x")), [*keys, *runs, "scan"], "left")
    return rows.select(*keys, *runs, "scan", F.coalesce("x", F.array_repeat(F.lit(0.0), F.col("sl_width"))).alias("x"))


def fir_design(rows: DataFrame, keys: list[str], lags: int = LAGS) -> DataFrame:
    """x with the vectors of the ``lags`` - 1 scans before joined to it, zeros before a run's beginning."""
    w = Window.partitionBy(*keys).orderBy("scan")
    zeros = F.transform("x", lambda v: v * 0)
    return rows.withColumn("x", F.concat(*[F.coalesce(F.lag("x", k).over(w), zeros) if k else F.col("x") for k in range(lags)]))


def nuisance_vector(frame: DataFrame, keys: list[str], mode: str = "full") -> DataFrame:
    """keys, scan, nuisance: the frame's columns as one vector, without those the mode leaves out."""
    left_out = MODES[mode]
    columns = sorted(c for c in frame.columns if c not in (*keys, "scan", *left_out))
    return frame.select(*keys, "scan", F.array(*[F.col(c).cast("double") for c in columns]).alias("nuisance"))


def acoustic_design(frame: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The baseline's design (the acoustic regressors alone) and what is left as its nuisance."""
    x = frame.select(*keys, "scan", F.array(*[F.col(c).cast("double") for c in ACOUSTIC]).alias("x"))
    return x, nuisance_vector(frame, keys, "no_acoustic")


def wide_targets(targets: DataFrame, language: str, run: str, units: list[str], size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(language, chunk, run, scan, y) and (language, chunk, position, units): units side by side in chunks of ``size``.

    The numbering orders the units of a language (subjects times regions or voxels) once.
    """
    number = F.row_number().over(Window.partitionBy(language).orderBy(*units)) - 1
    places = targets.select(language, *units).distinct().withColumn("sl_n", number)
    places = places.select(language, *units, F.floor(F.col("sl_n") / size).cast("int").alias("chunk"), (F.col("sl_n") % size).alias("position"))
    cells = targets.join(places, [language, *units]).groupBy(language, "chunk", run, "scan").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("sl_cells"))
    return cells.select(language, "chunk", run, "scan", F.transform("sl_cells", lambda c: c["value"]).alias("y")), places


def encode_study(x: DataFrame, nuisance: DataFrame, targets: DataFrame, language: str, run: str, kinds: list[str], units: list[str], size: int = CHUNK) -> DataFrame:
    """language, kinds, units, r, z, r2 of every unit: targets (language, run, scan, units, value) fitted from x beside nuisance."""
    y, places = wide_targets(targets, language, run, units, size)
    rows = x.join(nuisance, [language, run, "scan"]).join(y, [language, run, "scan"]).withColumnRenamed(run, "run")
    fitted = E.encode_groups(rows, [language, *kinds, "chunk"], None)
    return fitted.join(places, [language, "chunk", "position"]).drop("chunk", "position")


def study_metrics(designs: DataFrame, frame: DataFrame, targets: DataFrame, language: str, run: str, units: list[str], size: int = CHUNK) -> DataFrame:
    """language, condition, layer, units, r, z, r2: shuffles averaged, and the acoustic baseline (condition acoustic_only, no layer)."""
    kinds = ["condition", "layer", "shuffle"]
    text = encode_study(designs, nuisance_vector(frame, [language, run]), targets, language, run, kinds, units, size)
    x, rest = acoustic_design(frame, [language, run])
    x = x.withColumns({"condition": F.lit("acoustic_only"), "layer": F.lit(-1), "shuffle": F.lit(0)})
    base = encode_study(x, rest, targets, language, run, kinds, units, size)
    both = E.shuffle_average(text.unionByName(base), [language, "condition", "layer", *units])
    return both.withColumn("layer", F.when(F.col("layer") >= 0, F.col("layer")))


def run_study(designs: DataFrame, frame: DataFrame, targets: DataFrame, path: str, settings: dict, language: str = "lang", run: str = "run", units: tuple[str, ...] = ("subject", "roi")) -> None:
    """``encode_study`` of all designs into the table at ``path``, left out what it holds already (same settings); safe to run again."""
    keys = [language, "condition", "layer", "shuffle"]

    def make(todo: DataFrame) -> DataFrame:
        wanted = designs.join(F.broadcast(todo), keys, "left_semi")  # one row a design
        return encode_study(wanted, nuisance_vector(frame, [language, run]), targets, language, run, keys[1:], list(units))

    append_missing(designs.select(*keys).distinct(), make, path, settings, keys)


def cells(deltas: DataFrame, keys: list[str], value: str, permutations: int = 10_000) -> DataFrame:
    """keys, n, mean, se, dz, p_perm, ci_low, ci_high, positive: one robustness cell a group of subjects' values."""
    drawn = I.resampled(deltas, keys, value, permutations=permutations)
    return drawn.join(M.effects(deltas, keys, value).drop("mean", "n"), keys).withColumn("positive", F.col("mean") > 0)


def condition_delta(metrics: DataFrame, keys: list[str], first: str = "shared", second: str = "specific") -> DataFrame:
    """keys, delta: mean z of the first condition less that of the second."""
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("z")))
    return metrics.groupBy(*keys).agg((mean(first) - mean(second)).alias("delta"))


def robustness_summary(found: DataFrame, key: str = "setting") -> DataFrame:
    """key, n_cells, n_positive, failures (the cells of another sign, as text)."""
    name = F.when(~F.col("positive"), F.col("cell"))
    return found.groupBy(key).agg(F.count("*").alias("n_cells"), F.sum(F.col("positive").cast("long")).alias("n_positive"), F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("failures"))
